"""Data contracts: their language, loading, compatibility and Spark types."""

from weirstone.contracts.compat import breaks, check_all, field_rows, observed_fields
from weirstone.contracts.model import Contract, Field, latest_contracts, load_definitions
from weirstone.contracts.types import spark_type, struct_type

__all__ = ["Contract", "Field", "breaks", "check_all", "field_rows", "latest_contracts", "load_definitions", "observed_fields", "spark_type", "struct_type"]
