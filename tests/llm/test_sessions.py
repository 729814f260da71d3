import math
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from weirstone.llm import oracles, queries, sessions

DATA = "/root/testdata/sf0.001"
MINUTE = sessions.MINUTE
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, head string, us string"
T0 = datetime(2024, 1, 1)


def brute(rows, gap=30 * MINUTE, longest=120 * MINUTE, late_after=60 * MINUTE, ends=True):
    """Click by click. ``rows``: click_id, ts, arrived_at, client_id, kind, value."""
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    timely, late, seen = defaultdict(list), defaultdict(list), set()
    for click, ts, arrived, client, kind, value, *_ in rows:
        if None in (click, ts, client) or click in seen:
            continue
        seen.add(click)
        final = ends and kind == "purchase" and value is not None and value >= 60
        cents = 0 if value is None or math.isnan(value) else math.floor(100 * value + 0.5)
        (late if arrived is not None and us(arrived) - us(ts) > late_after else timely)[client].append((us(ts), click, final, cents))
    out = []
    for client, line in timely.items():
        held = []
        for row in sorted(line):
            why = None
            if held:
                last = held[-1][0][-1]
                why = "end" if last[2] else "gap" if row[0] - last[0] >= gap else "length" if row[0] - held[-1][0][0][0] > longest else None
            if why:
                held[-1][1] = why
            if why or not held:
                held.append([[row], None])
            else:
                held[-1][0].append(row)
        held[-1][1] = "end" if held[-1][0][-1][2] else "none"
        starts = [x[0][0][0] for x in held] + [1 << 62]
        for k, (own, why) in enumerate(held):
            n_late = sum(starts[k] <= x[0] < starts[k + 1] for x in late.get(client, ()))
            out.append((client, own[0][1], own[0][0], own[-1][0], len(own), n_late, sum(x[3] for x in own), why, [x[1] for x in own]))
    return sorted(out)


def given(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cut_at", [{}, {"line_rows": 30, "group_rows": 40}])
def test_whole_table(spark, cut_at):
    clicks = queries.table(spark, DATA, "clicks")
    rows = [tuple(r) for r in clicks.select("click_id", "ts", "arrived_at", "client_id", "kind", "value").collect()]
    assert given(sessions.sessions(clicks, **cut_at)) == brute(rows)


def test_lines_without_hard_breaks_are_cut_at_their_starts(spark):
    clicks = queries.table(spark, DATA, "clicks").where("client_id = 7 or client_id > 40")
    rows = [tuple(r) for r in clicks.select("click_id", "ts", "arrived_at", "client_id", "kind", "value").collect()]
    found = sessions.sessions(clicks, gap=10**15, longest=10 * MINUTE, final=F.lit(False), line_rows=20, group_rows=30)
    assert given(found) == brute(rows, gap=10**15, longest=10 * MINUTE, ends=False)


def test_no_group_holds_a_busy_client(spark):
    rows = [(k, T0 + timedelta(seconds=20 * k), None, 1, "purchase" if k % 50 == 0 else "view", 70.0, "", "") for k in range(5000)]
    placed = sessions._long_lines(sessions.distinct_clicks(spark.createDataFrame(rows, SCHEMA), 60 * MINUTE, F.col("kind") == "purchase"), 30 * MINUTE, 120 * MINUTE, 400)
    assert placed.groupBy("head").count().agg(F.max("count")).first()[0] <= 400


def test_edges_nulls_ties_and_repeats(spark):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    rows = [
        (1, at(0), at(0), 1, "view", 1.005, "", ""),
        (2, at(0), None, 1, "purchase", 60.0, "", ""),  # a final one at the time of the next
        (3, at(0), at(60), 1, "view", None, "", ""),  # 60 minutes are not late
        (4, at(29), at(90), 1, None, -0.005, "", ""),  # late
        (5, at(30), at(30), 1, "view", float("nan"), "", ""),  # a gap of just 30 minutes
        (6, at(0), at(61), 1, "view", 5.0, "", ""),  # late at the time of two starts
        (7, at(500), at(800), 1, "view", 5.0, "", ""),  # late, after the last session
        (8, at(-10), at(800), 1, "view", 5.0, "", ""),  # late, before the first
        (9, at(5), at(900), 2, "view", 5.0, "", ""),  # late clicks only
        (None, at(1), at(1), 1, "view", 1.0, "", ""),
        (10, None, at(1), 1, "view", 1.0, "", ""),
        (11, at(1), at(1), None, "view", 1.0, "", ""),
        *[(20 + k, at(25 * k), at(25 * k), 3, "view", 2.0, "", "") for k in range(10)],  # cut by length
        (40, at(0), at(0), 4, "view", 0.0, "", ""),
        (41, at(29), at(0), 4, "view", 0.0, "", ""),
        (42, at(58), at(0), 4, "view", 0.0, "", ""),
        (43, at(87), at(0), 4, "view", 0.0, "", ""),
        (44, at(116), at(0), 4, "view", 0.0, "", ""),
        (45, at(120), at(0), 4, "view", 0.0, "", ""),  # 120 minutes still belong
        (46, at(120) + timedelta(microseconds=1), at(0), 4, "purchase", 99.0, "", ""),
    ]
    clicks = spark.createDataFrame(rows + rows[:5], SCHEMA)
    want = brute(rows)
    assert given(sessions.sessions(clicks)) == want
    assert given(sessions.sessions(clicks, line_rows=2, group_rows=2)) == want
    assert {x[7] for x in want} == {"end", "gap", "length", "none"}
    assert given(sessions.sessions(clicks.limit(0))) == []
    assert given(sessions.sessions(clicks.where("client_id = 2"))) == []
    named = clicks.withColumn("client_id", F.concat(F.lit("c"), "client_id"))
    assert given(sessions.sessions(named)) == sorted((f"c{x[0]}", *x[1:]) for x in want)


def test_rows_of_one_id_that_differ_give_one(spark):
    rows = [(1, T0, T0, 1, "view", 1.0, "", ""), (1, T0 + timedelta(hours=9), T0, 2, "view", 2.0, "", "")]
    once = given(sessions.sessions(spark.createDataFrame(rows, SCHEMA)))
    assert len(once) == 1 and once == given(sessions.sessions(spark.createDataFrame(rows[::-1], SCHEMA)))


def test_query_and_its_sql(spark):
    found = queries.op11_gap_sessions(spark, DATA)
    db = duckdb.connect()
    db.sql(f"create view clicks as select * from '{Path(DATA)}/clicks.parquet'")
    want = db.sql(oracles.SESSIONS)
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    assert given(found.select(names)) == sorted(want.select(", ".join(names)).fetchall())


def test_nothing_is_broadcast(spark):
    clicks = queries.table(spark, DATA, "clicks")
    found = sessions.sessions(clicks, line_rows=30, group_rows=40)
    found.count()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_clicks_are_shuffled_once_before_they_are_written(spark, monkeypatch):
    monkeypatch.setattr(sessions, "BUSY_SLOTS", 64)
    once = sessions.distinct_clicks(queries.table(spark, DATA, "clicks"), 60 * MINUTE, F.lit(False))
    busy = once.select("client_id").distinct().where("client_id % 50 = 3")
    marked = sessions._marked_busy(once, busy)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "min_by" not in plan
    told = {r["client_id"]: r["busy"] for r in marked.select("client_id", "busy").distinct().collect()}
    ids = {r["client_id"] for r in busy.collect()}
    assert ids and all(told[k] for k in ids) and not all(told.values())
