"""Merging rows into a table's rows, as plans; the table layer commits the outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AmbiguousMerge(ValueError):
    """Several source rows would update one target row."""


def ambiguous_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return source.groupBy(*keys).count().where("count > 1")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """All target rows, with the columns ``update`` from the source row of the same keys, and the source rows that have no target.

    Columns that only one side has are null on the other's rows. Null keys match nothing.
    """
    names = [*target.columns, *(c for c in source.columns if c not in target.columns)]
    left = target.select(*keys, F.struct("*").alias("_t"))
    right = source.select(*keys, F.struct("*").alias("_s"))
    both = left.join(right, list(keys), "full_outer")
    types = {f.name: f.dataType for f in [*source.schema, *target.schema]}

    def value(name: str):
        old = F.col(f"_t.{name}") if name in target.columns else F.lit(None).cast(types[name])
        new = F.col(f"_s.{name}") if name in source.columns else F.lit(None).cast(types[name])
        fresh = F.col("_t").isNull() | (F.col("_s").isNotNull() if name in update else F.lit(False))
        return F.when(fresh, new).otherwise(old).alias(name)

    return both.select(*(value(n) for n in names))


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The source rows whose keys the target lacks, one by key. Nothing of the target is rewritten."""
    return source.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def set_difference(items: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Items that ``known`` doesn't list."""
    return items.join(known.select(column), column, "left_anti")
