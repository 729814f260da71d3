"""Contract types as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from weirstone.contracts.model import Contract

_PLAIN: dict[str, T.DataType] = {
    "string": T.StringType(), "integer": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}


def spark_type(name: str) -> T.DataType:
    if name in _PLAIN:
        return _PLAIN[name]
    if m := re.fullmatch(r"decimal\((\d+), ?(\d+)\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    raise ValueError(f"unknown contract type {name!r}")


def struct_type(contract: Contract) -> T.StructType:
    """Every field nullable: a payload is parsed first and held against the contract afterwards."""
    return T.StructType([T.StructField(f.name, spark_type(f.type), True) for f in contract.fields])
