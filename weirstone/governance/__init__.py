"""Renderings of contracts and grants: tags, inventory, access matrix."""

from weirstone.governance.render import access_matrix, load_grants, pii_in_rows, pii_inventory, pii_tag_sql, privileges_by_principal, render_access_matrix

__all__ = ["access_matrix", "load_grants", "pii_in_rows", "pii_inventory", "pii_tag_sql", "privileges_by_principal", "render_access_matrix"]
