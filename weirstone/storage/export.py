"""Tables as plain Parquet files of a set size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weirstone.storage.table import Table


def write_sized(rows: DataFrame, path: str, held_bytes: int, file_bytes: int) -> int:
    """Write rows that take ``held_bytes`` as Parquet in even files of about ``file_bytes``, in place of what was there; the number of rows.

    Rows are counted while they are written.
    """
    seen = Observation()
    files = max(1, math.ceil(held_bytes / file_bytes))
    rows.repartition(files).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def export_table(table: Table, path: str, file_bytes: int, version: int | None = None) -> int:
    """A version of a table (by default the latest) in files whose number follows from the bytes that its folders hold."""
    number = version or table.latest().number
    return write_sized(table.read(number), path, table.bytes(number), file_bytes)
