"""Seeded generators of change events and batch feeds."""
