"""Histories (SCD 2) from a stream of events, with each key's latest event kept in state.

An event that is later than all of its key closes the open version and opens its own: that takes only
the state. Events that come late reopen a history: the stored timelines of their keys are read, put in
order again, and only what changed is merged. Every event is a row of the timeline table, deletes
too, with the time and kind of the one that follows it; ``versions`` makes the history of it.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weirstone.storage.table import Table

#: What tells an event of the timeline from others; what changes of it later.
IDENTITY, FOLLOWING = ["key", "at", "tie", "op"], ["next_at", "next_op"]

#: Keys share their state by so many buckets. A checkpoint goes with this number.
STATE_BUCKETS = 4096

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestEvent(StatefulProcessor):
    """Says what new events of a bucket's keys change. A task holds those of one bucket and micro-batch.

    The latest events of a bucket's keys are one value of the state, so that calls to it don't grow in number with the keys.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "events binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        lines: dict[Any, dict[tuple, Row]] = defaultdict(dict)
        for r in rows:
            lines[r["key"]][r["at"], r["tie"], r["op"]] = r["row"]
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        late = set()
        before = {}
        for name, once in lines.items():
            last = before[name] = held.get(name)
            if last is not None and min(once) <= last:
                late.add(name)
            held[name] = max(once) if last is None else max(last, max(once))
        if any(held[name] != before[name] for name in lines):
            self.state.update((pickle.dumps(held),))
        for name, once in lines.items():
            said = lambda kind, event, row, after, name=name: Row(kind=kind, key=name, at=event[0], tie=event[1], op=event[2], row=row, next_at=after and after[0], next_op=after and after[2])
            line = sorted(once)
            if name in late:
                yield from (said("late", event, once[event], None) for event in line)
                continue
            if before[name] is not None:
                yield said("close", before[name], None, line[0])
            for event, after in zip(line, [*line[1:], None], strict=True):
                yield said("event", event, once[event], after)


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """While a stream starts; it keeps the settings that it started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


def apply_changes(changes: DataFrame, timeline: Table, buckets: int | None = None) -> None:
    """Merge what a micro-batch changed. A batch that is delivered again changes nothing more."""
    folder = f"_staged/{uuid.uuid4().hex}"
    changes.write.parquet(f"{timeline.path}/{folder}")
    changes = timeline.spark.read.schema(changes.schema).parquet(f"{timeline.path}/{folder}")
    try:
        plain, late = changes.where("kind <> 'late'").drop("kind"), changes.where("kind = 'late'").drop("kind")
        if not late.isEmpty():
            held = timeline.read()
            held = held.join(late.select("key").distinct(), "key", "left_semi")
            fresh = late.join(held.select(*IDENTITY), IDENTITY, "left_anti").withColumn("fresh", F.lit(True))
            line = Window.partitionBy("key").orderBy("at", "tie", "op")
            both = held.withColumn("fresh", F.lit(False)).unionByName(fresh).withColumns({"then_at": F.lead("at").over(line), "then_op": F.lead("op").over(line)})
            moved = both.where(F.col("fresh") | ~F.col("then_at").eqNullSafe(F.col("next_at")) | ~F.col("then_op").eqNullSafe(F.col("next_op")))
            plain = plain.unionByName(moved.drop("fresh", *FOLLOWING).withColumnsRenamed({"then_at": "next_at", "then_op": "next_op"}))
        timeline.merge(plain, IDENTITY, FOLLOWING, buckets)
    finally:
        timeline.files.delete(folder)


def historize_stream(events: DataFrame, timeline: Table, checkpoint: str, *, key: str, at: str, tie: str, op: str = "op", buckets: int | None = None) -> None:
    """Take in all that a stream of events holds and stop; ``timeline`` has every event with what follows it.

    Events are in order by ``at`` and then ``tie`` (a whole number); one that is delivered again (same
    time, tie and kind) counts once. Events without a key, time, tie or kind are left out. ``buckets``: of a
    new timeline, which merges touch as far as they have rows there.
    """
    rows = events.where(" and ".join(f"`{name}` is not null" for name in (key, at, tie, op)))
    rows = rows.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(op).alias("op"), F.struct("*").alias("row"))
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(name, kind) for name, kind in {"kind": T.StringType(), **kinds, "next_at": kinds["at"], "next_op": T.StringType()}.items()])
    shared = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(STATE_BUCKETS)))
    changes = shared.groupBy("bucket").transformWithState(LatestEvent(), schema, "Update", "None")
    with _state_in_rocksdb(events.sparkSession):
        query = changes.writeStream.outputMode("update").foreachBatch(lambda batch, _: apply_changes(batch, Table(batch.sparkSession, timeline.path), buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def versions(timeline: DataFrame) -> DataFrame:
    """The events' own columns with valid_from, valid_to, is_current and is_deleted: a row for each event that opens a version and is not replaced at once."""
    held = timeline.where((F.col("op") != "d") & (F.col("next_at").isNull() | (F.col("next_at") != F.col("at"))))
    return held.select("row.*", F.col("at").alias("valid_from"), F.col("next_at").alias("valid_to"), F.col("next_at").isNull().alias("is_current"), F.coalesce(F.col("next_op") == "d", F.lit(False)).alias("is_deleted"))

