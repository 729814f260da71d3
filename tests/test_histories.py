"""Histories from a stream equal those of all events at once, however the events are dealt into batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weirstone.operators import scd2
from weirstone.storage.table import Table
from weirstone.streaming import histories

T0 = datetime(2024, 1, 1)
SCHEMA = "who string, n long, at timestamp_ntz, op string, value double"


def streamed(spark, folder, batches):
    timeline = Table(spark, f"{folder}/timeline")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        events = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        histories.historize_stream(events, timeline, f"{folder}/checkpoint", key="who", at="at", tie="n")
    return timeline


def shown(df):
    return sorted((r["who"], r["n"], r["value"], r["valid_from"], r["valid_to"], r["is_current"], r["is_deleted"]) for r in df.collect())


@pytest.mark.parametrize("how", ["in order", "shuffled", "again"])
def test_batches(spark, tmp_path, how):
    chance = random.Random(5)
    rows = [(f"k{chance.randint(0, 5)}", n, T0 + timedelta(seconds=chance.randint(0, 60)), chance.choice("uuud"), float(n)) for n in range(150)]
    rows.sort(key=lambda r: (r[2], r[1]))
    whole = scd2.intervals(spark.createDataFrame(rows, SCHEMA), "who", ("at", "n"), "at", identity=("n", "op"))
    if how != "in order":
        chance.shuffle(rows)
    batches = [rows[:50], rows[50:110], rows[110:]]
    if how == "again":
        batches = [rows[:90], rows[40:120], rows]
    batches[0] = [*batches[0], (None, 900, T0, "u", 1.0), ("k1", None, T0, "u", 1.0), ("k1", 901, None, "u", 1.0)]
    timeline = streamed(spark, tmp_path, batches)
    assert shown(histories.versions(timeline.read())) == shown(whole)
    assert timeline.read().count() == 150


def test_a_batch_that_is_delivered_again_changes_nothing(spark, tmp_path):
    timeline = streamed(spark, tmp_path, [[("a", 1, T0, "u", 1.0), ("a", 2, T0 + timedelta(1), "u", 2.0)]])
    before = sorted(map(str, timeline.read().collect()))
    kinds = timeline.read().schema
    same = timeline.read().withColumn("kind", F.lit("event")).select("kind", *kinds.names)
    histories.apply_changes(same, timeline)
    assert sorted(map(str, timeline.read().collect())) == before


def test_on_time_events_read_no_timeline(spark, tmp_path, monkeypatch):
    read, places = Table.read, []
    monkeypatch.setattr(Table, "read", lambda self, *a: places.append(self.path) or read(self, *a))
    at = lambda k: T0 + timedelta(hours=k)
    timeline = streamed(spark, tmp_path, [[("a", k, at(k), "u", 0.0)] for k in range(2)])
    assert places == []
    streamed(spark, tmp_path, [[("a", 9, at(0.5), "d", 0.0)]])
    assert len(places) == 1
    assert [(r[1], r[4], r[6]) for r in shown(histories.versions(timeline.read()))] == [(0, at(0.5), True), (1, None, False)]


def test_the_keys_of_a_bucket_share_a_call_to_the_state():
    calls, held = [], []

    class Value:
        def exists(self):
            return bool(held)

        def get(self):
            calls.append("get")
            return held[-1]

        def update(self, value):
            calls.append("update")
            held.append(value)

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802 - Spark's name
            return Value()

    state = histories.LatestEvent()
    state.init(Handle())
    rows = lambda n, hour: iter([Row(key=f"k{k}", at=T0 + timedelta(hours=hour), tie=n, op="u", row=k) for k in range(100)])
    said = lambda n, hour: [(r["kind"], r["key"], r["tie"]) for r in state.handleInputRows((7,), rows(n, hour), None)]
    assert said(1, 1) == [("event", f"k{k}", 1) for k in range(100)]
    assert said(2, 2) == [(kind, f"k{k}", n) for k in range(100) for kind, n in (("close", 1), ("event", 2))]
    assert said(3, 0) == [("late", f"k{k}", 3) for k in range(100)]
    assert calls == ["update", "get", "update", "get"]
