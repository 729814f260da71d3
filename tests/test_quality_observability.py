from datetime import datetime, timedelta, timezone

import pytest
from pydantic import ValidationError
from pyspark.sql import functions as F

from weirstone.observability import detectors as D
from weirstone.observability import metrics as M
from weirstone.observability.narrative import incident_report
from weirstone.observability.report import render_html, report
from weirstone.quality import Suite, load_suites, run_suite, suite_summary

NOW = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
WARN = {"severity": "warn"}


@pytest.fixture(scope="module")
def rows(spark):
    at = lambda h: datetime(2026, 1, 1, h) if h else None
    return spark.createDataFrame([("A", "retail", at(10)), ("B", "retail", at(11)), ("B", "vip", at(0)), (None, None, at(0))], "id string, segment string, updated_at timestamp")


@pytest.mark.parametrize(
    ("check", "status", "observed"),
    [
        ({"type": "not_null", "column": "id"}, "fail", "1 null values"),
        ({"type": "unique", "columns": ["id"]}, "fail", "1 duplicate keys"),
        ({"type": "unique", "columns": ["id", "segment"]}, "pass", "0 duplicate keys"),
        ({"type": "accepted_values", "column": "segment", "values": ["retail"]}, "fail", "1 out-of-domain values"),
        ({"type": "row_count_between", "min_rows": 4, "max_rows": 4}, "pass", "4 rows"),
        ({"type": "row_count_between", "min_rows": 5} | WARN, "warn", "4 rows"),
        ({"type": "freshness", "column": "updated_at", "max_age_hours": 1}, "pass", "latest event 1.0h old"),
        ({"type": "freshness", "column": "updated_at", "max_age_hours": 0.5}, "fail", "latest event 1.0h old"),
        ({"type": "referential_integrity", "column": "id", "ref_table": "r", "ref_column": "ref_id"} | WARN, "warn", "2 orphaned values"),
        ({"type": "referential_integrity", "column": "id", "ref_table": "r", "ref_column": "ref_id", "ref_filter": "ref_id <> 'A'"}, "fail", "3 orphaned values"),
    ],
)
def test_checks(spark, rows, check, status, observed):
    ref = spark.createDataFrame([("A",), ("A",)], "ref_id string")
    suite = Suite.model_validate({"table": "t", "layer": "silver", "checks": [check]})
    found = run_suite(rows, suite, lambda _: ref, NOW).first()
    assert (found["status"], found["observed"]) == (status, observed)


def test_no_rows_are_not_fresh(rows):
    suite = Suite.model_validate({"table": "t", "layer": "silver", "filter": "id = 'none'", "checks": [{"type": "freshness", "column": "updated_at", "max_age_hours": 1}]})
    found = run_suite(rows, suite, lambda _: None, NOW)
    assert found.first()["observed"] == "no rows / all-null event time"
    assert tuple(suite_summary(found).first()) == (0, 1, 0, 0.0)
    assert suite_summary(found.where("false")).first()["pass_rate"] == 1.0


def test_shipped_suites():
    suites = load_suites()
    assert sorted(len(s.checks) for s in suites) == [4, 6, 7, 8]
    assert sum(c.severity == "warn" for s in suites for c in s.checks) == 3
    with pytest.raises(ValidationError):
        Suite.model_validate({"table": "t", "layer": "silver", "checks": [{"type": "magic"}]})
    with pytest.raises(ValidationError):
        Suite.model_validate({"table": "t", "layer": "silver", "checks": []})


def metrics(spark, *rows):
    """(run, step, layer, status, day, seconds, read, quarantined)"""
    out = []
    for run, step, layer, status, day, seconds, read, bad in rows:
        at = datetime(2026, 1, day, tzinfo=timezone.utc)
        out.append((run, at.date(), "p", step, layer, status, at, at + timedelta(seconds=seconds), float(seconds), read, read, bad, None, None, None, "Boom" if status == "failed" else None, None))
    return spark.createDataFrame(out, M.SCHEMA)


def past(step="s", seconds=10, bad=10, n=4):
    return [(f"h{i}", step, "silver", "success", 1 + i, seconds + i % 2, 1000, bad) for i in range(n)]


@pytest.mark.parametrize(("history", "bad", "found"), [(past(), 200, True), (past(bad=15), 16, False), ([], 200, True), ([], 50, False), ([], 51, True), (past(n=2), 40, False)])
def test_spikes(spark, history, bad, found):
    run, old = D.split_runs(metrics(spark, *history, ("now", "s", "silver", "success", 9, 10, 1000, bad)))
    assert (D.quarantine_spikes(run, D.merged(D.moments(old, "run_id"))).count() == 1) == found


@pytest.mark.parametrize(("history", "seconds", "found"), [(past(), 500, True), (past(), 11, False), (past(n=2), 500, False)])
def test_slow_steps(spark, history, seconds, found):
    run, old = D.split_runs(metrics(spark, *history, ("now", "s", "silver", "success", 9, seconds, 1000, 0)))
    assert (D.duration_anomalies(run, D.merged(D.moments(old, "run_id"))).count() == 1) == found


def test_findings_are_sorted_and_told(spark):
    rows = metrics(spark, *past(), ("now", "s", "silver", "success", 9, 900, 1000, 300), ("now", "g", "gold", "failed", 9, 1, None, None), ("now", "b", "bronze", "failed", 9, 1, None, None))
    checks = spark.createDataFrame([("t", "referential_integrity(a -> b.c)", "warn", "warn", "2 orphaned values"), ("t", "unique(a)", "error", "fail", "1 duplicate keys"), ("t", "freshness(x)", "warn", "warn", "old"), ("t", "not_null(a)", "error", "pass", "0")], "table string, description string, severity string, status string, observed string")
    run, old = D.split_runs(rows, "now")
    found = D.all_findings(run, D.merged(D.moments(old, "run_id")), checks)
    assert [r["severity"] for r in found.collect()] == ["critical", "high", "high", "medium", "medium", "low", "low"]
    assert tuple(D.overall_status(found).first()) == ("SEV-1 CANDIDATE", 7)
    assert {r["severity"]: r["n"] for r in D.severity_counts(found).collect()} == {"critical": 1, "high": 2, "medium": 2, "low": 2}
    text = incident_report(rows, checks, NOW)
    assert "SEV-1 CANDIDATE" in text and "### 7. [LOW]" in text and "- error: `Boom`" in text
    with pytest.raises(LookupError):
        incident_report(rows, None, NOW, "no such run")


@pytest.mark.parametrize(("severities", "status"), [([], "HEALTHY"), (["low"], "HEALTHY WITH NOTES"), (["low", "medium"], "SEV-3 / DEGRADED"), (["high"], "SEV-2 CANDIDATE")])
def test_overall_status(spark, severities, status):
    rows = spark.createDataFrame([(s,) for s in severities], "severity string")
    assert D.overall_status(rows).first()["status"] == status


def test_tracked_steps_and_reports(spark, tmp_path):
    lake = str(tmp_path)
    with M.track_step(spark, lake, "r1", "p", "fine", "gold") as step:
        step.rows_read, step.dq_checks_passed, step.dq_checks_failed, step.extra = 5, 2, 1, {"a": "b"}
    with pytest.raises(KeyError), M.track_step(spark, lake, "r1", "p", "bad<er>"):
        raise KeyError("x")
    rows = M.metrics_table(spark, lake).read()
    assert {r["step"]: r["status"] for r in rows.collect()} == {"fine": "success", "bad<er>": "failed"}
    assert rows.where("status = 'failed'").first()["error"] == "KeyError: 'x'"
    text, page = report(rows)
    assert "steps=2 failed=1" in text and "2/3" in text and "bad&lt;er&gt;" in page
    assert tuple(M.run_kpis(M.latest_run(rows)).first()) == (2, 1, 0, 0)
    assert M.runs_over_time(rows).first()["failed_steps"] == 1
    assert M.export_metrics(spark, lake, f"{tmp_path}/out") == 2
    assert spark.read.parquet(f"{tmp_path}/out").where(F.col("extra").isNotNull()).count() == 1
    assert render_html("r", []).startswith("<!doctype html>")
    with pytest.raises(RuntimeError):
        report(rows.where("false"))


def test_run_ids(monkeypatch):
    monkeypatch.setenv("LAKEHOUSE_RUN_ID", "from-env")
    assert M.current_run_id() == "from-env" and M.current_run_id("given") == "given"
    monkeypatch.delenv("LAKEHOUSE_RUN_ID")
    assert M.current_run_id().startswith("adhoc-") and len(M.current_run_id()) == 16


def test_moments_merge_to_those_of_all(spark):
    import numpy as np

    chance = np.random.default_rng(1)
    rows = [(f"r{k % 7}", s, "silver", "success", 1, float(x), int(n), int(b)) for k in range(60) for s in ("a", "b") for x, n, b in [(chance.normal(1000, 3), chance.integers(0, 3) * 100, chance.integers(0, 50))]]
    m = metrics(spark, *rows)
    merged = {(r["step"], r["metric"]): (r["runs"], r["mean"], r["m2"]) for r in D.merged(D.moments(m, "run_id")).collect()}
    whole = {(r["step"], r["metric"]): (r["runs"], r["mean"], r["m2"]) for r in D.moments(m).collect()}
    assert set(merged) == set(whole) and len(whole) == 4
    for k in whole:
        assert merged[k] == pytest.approx(whole[k], rel=1e-9)
    assert D.merged(D.moments(m.where("false"), "run_id")).count() == 0


def test_past_moments_are_worked_out_once_a_run(spark, tmp_path):
    lake = str(tmp_path)
    for run in ("r1", "r2", "r3"):
        with M.track_step(spark, lake, run, "p", "s", "gold") as step:
            step.rows_read, step.rows_quarantined = 100, 5
        past = M.past_moments(spark, lake, run)
    held = past.where("metric = 'quarantine_ratio'").orderBy("run_id").collect()
    assert [(r["run_id"], r["runs"], r["mean"]) for r in held] == [("r1", 1, 0.05), ("r2", 1, 0.05)]
    assert {r["run_id"] for r in past.collect()} == {"r1", "r2"}


def test_all_checks_in_one_scan(spark, tmp_path):
    """Keys of several columns, doubles with both zeros, references of another type, nulls: as counted apart, in one scan."""
    rows = [(1, "a", 0.0), (1, "a", -0.0), (2, None, 1.5), (2, None, 1.5), (3, "b", None), (None, "b", float("nan"))]
    spark.createDataFrame(rows, "k int, s string, d double").write.parquet(f"{tmp_path}/t")
    t, ref = spark.read.parquet(f"{tmp_path}/t"), spark.createDataFrame([(1,), (3,), (3,)], "id long")
    suite = Suite.model_validate({"table": "t", "layer": "silver", "checks": [
        {"type": "unique", "columns": ["k", "s", "d"]}, {"type": "unique", "columns": ["d"]}, {"type": "unique", "columns": ["s"]},
        {"type": "referential_integrity", "column": "k", "ref_table": "r", "ref_column": "id"}, {"type": "not_null", "column": "s"}, {"type": "row_count_between", "min_rows": 1},
    ]})
    found = run_suite(t, suite, lambda _: ref, NOW, with_rows=True)
    assert [r["observed"] for r in found.collect()] == ["2 duplicate keys", "2 duplicate keys", "3 duplicate keys", "2 orphaned values", "2 null values", "6 rows"]
    assert {r["row_count"] for r in found.collect()} == {6}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
