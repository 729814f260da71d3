"""Deduplication with a fixed survivor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row by key, the first by ``order``; give a tiebreak to make the survivor definite.

    Spark turns the filter on row_number into a limit by group ahead of the shuffle.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def exact_duplicates_dropped(rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    """One row by identity columns; which one, if others differ, is left open."""
    return rows.dropDuplicates(list(identity))
