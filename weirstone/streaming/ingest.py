"""Streaming ingestion of change events into an event table by entity and a quarantine."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirstone.config import Config
from weirstone.operators.envelope import events_of, mark_unknown_entities, parse_envelope, quarantined
from weirstone.sources.landing import change_events
from weirstone.storage.table import Files, Group


@dataclass
class Counts:
    rows_read: int = 0
    rows_written: int = 0
    rows_quarantined: int = 0


def _append(group: Group, name: str, rows: DataFrame, n: int, mark: tuple[str, int], settled: str | None) -> tuple[int, int]:
    """Add a batch's rows for a table; (the number added, the table's version).

    A batch of the same query that the table has adds nothing. A table that another query wrote (its
    checkpoint was lost, and batches count from 0 again) may hold what the source delivers anew: a
    commit takes all rows of a file or message or none, so those whose source is there are left out.
    Once a query has been through all that the source held (``settled``), nothing older comes again.
    """
    table = group.table(name)
    held = table.latest()
    if held and held.marks.get(mark[0], -1) >= mark[1]:
        return 0, held.number
    if held and set(held.marks) - {mark[0]} and settled != mark[0]:
        rows = rows.join(table.read().select("source_ref").distinct(), "source_ref", "left_anti").select(*rows.columns)
        n = rows.count()
    if n:
        table.append(rows, ["ingest_date"], mark)
    if n or held:
        return n, table.latest().number
    return 0, 0


def write_batch(batch: DataFrame, number: int, *, config: Config, run_id: str, counts: Counts, query: str, strict: bool = False) -> None:
    """Classify a micro-batch once, then append its quarantine and its entities' events, and publish them together.

    Every table remembers the query and the batch number, so a batch that is delivered again adds
    nothing, and one that broke off between two tables is completed. Readers of the group see all
    of a batch or nothing. ``query`` is the id that the checkpoint holds. Rows count as written where they were added.
    """
    spark, names = batch.sparkSession, [e.name for e in config.entities]
    group, mark = bronze(spark, config), (query, number)
    if group.seen(mark):
        return
    parsed = parse_envelope(batch)
    parsed = mark_unknown_entities(parsed, names) if strict else parsed
    stamp = {"run_id": F.lit(run_id), "ingest_ts": F.current_timestamp(), "ingest_date": F.current_date()}
    seen = Observation()
    sound = F.col("error_reason").isNull()
    by_entity = [F.count_if(sound & (F.col("entity") == n)).alias(f"n_{i}") for i, n in enumerate(names)]
    parsed = parsed.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(~sound).alias("bad"), *by_entity).persist()
    try:
        parsed.write.format("noop").mode("overwrite").save()
        found, settled, versions = seen.get, group.latest()["settled"], {}
        counts.rows_read += found["read"]
        if found["bad"]:
            added, versions["_quarantine"] = _append(group, "_quarantine", quarantined(parsed).withColumns(stamp), found["bad"], mark, settled)
            counts.rows_quarantined += added
        for i, name in enumerate(names):
            if n := found[f"n_{i}"]:
                added, versions[name] = _append(group, name, events_of(parsed, name).withColumns(stamp), n, mark, settled)
                counts.rows_written += added
        group.publish({name: v for name, v in versions.items() if v}, mark)
        for name in versions:
            if group.table(name).gather(partition_by=["ingest_date"]):
                group.publish({name: group.table(name).latest().number})
    finally:
        parsed.unpersist()


def bronze(spark: SparkSession, config: Config) -> Group:
    """The tables of events and the quarantine, as of the last whole batch."""
    return Group(spark, f"{config.storage.lakehouse_root}/bronze")


def run_stream(spark: SparkSession, config: Config, run_id: str, *, mode: str | None = None, strict: bool = False) -> Counts:
    """Take in all that has landed since the last run and stop. A rerun without new files reads nothing."""
    counts = Counts()
    checkpoint = f"{config.storage.checkpoints_dir}/bronze_events"

    def query() -> str:
        """The id that Spark keeps in the checkpoint, which a new checkpoint has anew."""
        return json.loads(Files(spark, checkpoint).read("metadata"))["id"]

    def each(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, config=config, run_id=run_id, counts=counts, query=query(), strict=strict)

    stream = change_events(spark, config, mode).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    bronze(spark, config).publish({}, settled=query())
    return counts
