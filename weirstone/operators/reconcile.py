"""Counts held against counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile_counts(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, matches) for every key of either side; a side that lacks it counts 0."""
    left, right = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((expected, "expected"), (actual, "actual")))
    both = left.join(right, key, "full_outer").select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in ("expected", "actual")))
    return both.withColumn("matches", F.col("expected") == F.col("actual"))


def per_file_counts(rows: DataFrame, column: str = "_source_file") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("rows_loaded"))
