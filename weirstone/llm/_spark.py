"""Spark helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. A local one only for a session whose executors are local, as in tests."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="weirstone-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(held)
    return held


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that lost executors cost no recomputation of what is above."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder, for loops.

    A checkpoint keeps the planner's guess of its size, and each join multiplies the guesses of its
    sides, so after some rounds the numbers themselves take longer than the work. A table's size is measured.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> tuple[DataFrame, int]:
    """(rows with gapless numbers from 0 in the given order, their count); only the partitions' sizes reach the driver."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    marked = rows.withColumn("_part", F.spark_partition_id()).withColumn("_inside", F.monotonically_increasing_id() % (1 << 33))
    sizes = {r["_part"]: r["n"] for r in marked.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(F.lit(starts or [0]).cast("array<long>"), F.col("_part") + 1)
    return marked.withColumn(name, start + F.col("_inside")).drop("_part", "_inside"), total


def before(df: DataFrame, within: Sequence[str], order: str, value: str, name: str, group: int = 1024) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows with smaller ``order`` (whole numbers, one row each): in two levels, so that no task holds a long line."""
    rows = df.withColumn("_group", F.floor(F.col(order) / group))
    sums = rows.groupBy(*within, "_group").agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*within).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum"))
    inside = Window.partitionBy(*within, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(sums, [*within, "_group"]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_before", "_group")


def row_key(df: DataFrame) -> list[Column]:
    """Two hashes of all columns, for rows to be told apart by what they hold."""
    cells = [F.map_entries(cell) if isinstance(field.dataType, T.MapType) else cell for field in df.schema for cell in [F.col(f"`{field.name.replace('`', '``')}`")]]
    return [F.xxhash64(*cells), F.xxhash64(F.lit("again"), *cells)]


def one_by(rows: DataFrame, keys: Sequence[str], row: str, order: Column | None = None) -> DataFrame:
    """One row by ``keys`` (not null): that with the least ``order``. Keys that come once, as most do, are not shuffled with their ``row``."""
    repeated = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    if repeated.isEmpty():
        return rows.select(*keys, row)
    some = rows if order is None else rows.withColumn("_order", order)
    first = F.first(row) if order is None else F.min_by(row, "_order")
    one = some.join(repeated, list(keys), "left_semi").groupBy(*keys).agg(first.alias(row))
    return rows.join(repeated, list(keys), "left_anti").select(*keys, row).union(one.select(*keys, row))


def broadcast_below(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if counting shows that it stays below ``limit`` bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def spread(*cols: Column | str, parts: int) -> Column:
    """A bucket from 0 to parts - 1 by a hash of the columns, for two-level sums over large groups."""
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")


def rows_with_text(docs: DataFrame, text_col: str, carry: Sequence[str] | None) -> tuple[DataFrame, str | None]:
    """(rows for a task: ``row``, a struct of the columns to carry through, and ``text``; where the text is in the row).

    All columns are carried by default, and a string column among them then goes over once only.
    """
    row = F.struct(*(F.col(f"`{name.replace('`', '``')}`") for name in (docs.columns if carry is None else carry))).alias("row")
    if carry is None and isinstance(docs.schema[text_col].dataType, T.StringType):
        return docs.select(row), text_col
    return docs.select(row, F.col(text_col).cast("string").alias("text")), None


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the columns that both sides have."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def whole(df: DataFrame, name: str) -> bool:
    """Whether a column holds whole numbers of 64 bits at most."""
    return isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType))


def with_numbers(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``_number``, a whole number for each id, null for null; the ids: ``_number`` and ``_id``). Numbers are in the order of the ids."""
    ids = df.select(F.col(f"`{name}`").alias("_id")).where("_id is not null").distinct()
    ids = cut(numbered(ids, "_id", name="_number")[0].select("_number", "_id"))
    return df.join(ids.hint("merge"), df[name] == ids["_id"], "left").drop("_id"), ids


def named(df: DataFrame, ids: DataFrame, *names: str) -> DataFrame:
    """``df`` with the ids that numbers in the given columns stand for."""
    for name in names:
        one = ids.select(F.col("_number").alias("_n"), F.col("_id").alias("_named"))
        df = df.join(one.hint("merge"), F.col(name) == F.col("_n"), "left").withColumn(name, F.col("_named")).drop("_n", "_named")
    return df
