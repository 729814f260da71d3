"""Batch files of several formats, and loading each file once."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.functions import broadcast_if_small, plain_path
from weirstone.operators.reconcile import per_file_counts
from weirstone.storage.table import Files, Table


@dataclass(frozen=True)
class Feed:
    """How a dataset's files are read; CSV without inference, so its columns are strings."""

    format: str
    pattern: str
    options: Mapping[str, str] = field(default_factory=dict)


#: The batch datasets and their formats.
FEEDS = {
    "branches": Feed("csv", "*.csv", {"header": "true"}),
    "products": Feed("json", "*.json", {"multiLine": "true"}),
    "fx_rates": Feed("parquet", "*.parquet", {"mergeSchema": "true"}),
}

LEDGER = "file_path string not null, dataset string not null, rows_loaded long not null, run_id string not null, loaded_at timestamp not null"


def _source_file() -> Column:
    """A file as Spark itself names it, whatever form its folder was given in: listings and rows agree on it."""
    return plain_path(F.col("_metadata.file_path"))


def landed(spark: SparkSession, folder: str, feed: Feed) -> DataFrame:
    """(file_path, bytes, modified_at) of a feed's files in the landing folder, without their content; none if there is no such folder."""
    if not Files(spark, folder).exists():
        return spark.createDataFrame([], "file_path string, bytes long, modified_at timestamp")
    files = spark.read.format("binaryFile").option("pathGlobFilter", feed.pattern).load(folder)
    return files.select(_source_file().alias("file_path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified_at"))


def read_feed(spark: SparkSession, feed: Feed, folder: str, since: datetime | None = None) -> DataFrame:
    """The rows of a folder's files, each with the file it came from in ``_source_file``; of files modified at ``since`` or later, if given."""
    reader = spark.read.format(feed.format).options(**feed.options).option("pathGlobFilter", feed.pattern)
    if since is not None:
        # Whole seconds, and only what is later than them.
        before = (since.astimezone(timezone.utc) - timedelta(seconds=1)).replace(microsecond=0, tzinfo=None)
        reader = reader.option("modifiedAfter", before.isoformat()).option("timeZone", "UTC")
    return reader.load(folder).select("*", _source_file().alias("_source_file"))


def _load(spark: SparkSession, name: str, feed: Feed, folder: str, lake: str, run_id: str, ledger: Table) -> int:
    entered = (ledger.read() if ledger.exists() else spark.createDataFrame([], LEDGER)).where(F.col("dataset") == name)
    table, mark = Table(spark, f"{lake}/{name}"), ("copy_into", entered.count())
    new = landed(spark, folder, feed).join(entered, "file_path", "left_anti")
    # A commit of rows is marked by the ledger's state before it. If the table has that mark already, a run broke off
    # between the two commits; the files it added are in the table, and only entered now.
    broken_off = table.seen(mark)
    if broken_off:
        held = table.read().select(F.col("_source_file").alias("file_path")).join(broadcast_if_small(new, "file_path"), "file_path", "left_semi").distinct()
        new = new.join(held.withColumn("held", F.lit(True)), "file_path", "left").withColumn("fresh", F.col("held").isNull())
    else:
        new = new.withColumn("fresh", F.lit(True))
    # Written, so that all that follows sees the same files, whatever lands meanwhile.
    pending = f"{lake}/_copy_pending/{uuid.uuid4().hex}"
    new.write.parquet(pending)
    new = spark.read.parquet(pending)
    try:
        since, n, n_fresh = new.agg(F.min(F.when(F.col("fresh"), F.col("modified_at"))), F.count("*"), F.count_if("fresh")).first()
        if not n:
            return 0
        fresh = new.where("fresh").select(F.col("file_path").alias("_source_file"))
        if n_fresh:
            rows = read_feed(spark, feed, folder, since)
            rows = rows.join(broadcast_if_small(fresh, "_source_file"), "_source_file", "left_semi").select(*rows.columns)
            made = table.append(rows.withColumns({"_run_id": F.lit(run_id), "_ingest_ts": F.current_timestamp()}), mark=None if broken_off else mark)
            if made is None:  # a rival has loaded and enters them
                return 0
        # Counted from what the table holds now; files without rows are entered too, and are not read again.
        counted = per_file_counts(table.read() if broken_off else table.read_added(made.number)).withColumnRenamed("_source_file", "file_path")
        entries = new.join(counted, "file_path", "left").withColumn("rows_loaded", F.coalesce("rows_loaded", F.lit(0).cast("long")))
        entry = ledger.append(entries.select("file_path", F.lit(name).alias("dataset"), "rows_loaded", F.lit(run_id).alias("run_id"), F.current_timestamp().alias("loaded_at")))
        added = ledger.read_added(entry.number).join(fresh.withColumnRenamed("_source_file", "file_path"), "file_path", "left_semi")
        return added.agg(F.coalesce(F.sum("rows_loaded"), F.lit(0))).first()[0]
    finally:
        Files(spark, pending).delete("")


def copy_into(spark: SparkSession, landing: str, lake: str, run_id: str, feeds: Mapping[str, Feed] = FEEDS) -> dict[str, int]:
    """Load each file once, by its path; rows by dataset. A resend under another name loads again.

    The landing folder's files come as rows, and an anti-join with the ledger leaves the new ones; the
    driver holds no list of files. What is read starts at the oldest new file's time of modification.
    Rows carry their file, and a commit takes all rows of a file or none. So a file that is in the table
    but not in the ledger (a run broke off between the two commits) is only entered on the next try,
    whatever other files have landed since.
    """
    ledger = Table(spark, f"{lake}/_copy_ledger")
    return {name: _load(spark, name, feed, f"{landing}/{name}", lake, run_id, ledger) for name, feed in feeds.items()}
