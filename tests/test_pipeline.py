"""One small bank through the whole pipeline, twice."""

import time
import json
from collections import Counter
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weirstone.config import load_config
from weirstone.generators import changes, feeds
from weirstone.observability import metrics as M
from weirstone.operators import scd2
from weirstone.plans import lakehouse as L
from weirstone.storage.table import CommitConflict, Table


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    config = load_config(root=tmp_path_factory.mktemp("lake"), environ={})
    run = L.Run(spark, config, "r1", datetime(2026, 1, 1, 12, tzinfo=timezone.utc))
    run.summary = L.land(run, 400, 42, 5.0)
    run.outcomes = L.run_all(run)
    return run


def test_every_step_succeeds(run):
    assert set(run.outcomes.values()) == {"success"}
    rows = M.metrics_table(run.spark, run.lake).read()
    assert rows.where("status = 'failed'").count() == 0 and rows.count() >= 10
    assert "run_id=r1" in (run.config.storage.reports_dir / "run.txt").read_text()
    assert "SET TAGS" in (run.config.storage.reports_dir / "pii_tags.sql").read_text()
    assert rows.where("step = 'build'").first()["dq_checks_passed"] >= 24
    assert "# Pipeline Incident Report — run `r1`" in (run.config.storage.reports_dir / "incident_r1.md").read_text()


def test_what_is_read_is_written_or_put_aside(run):
    step = M.metrics_table(run.spark, run.lake).read().where("step = 'stream_events'").first()
    assert step["rows_read"] == 400 == step["rows_written"] + step["rows_quarantined"]
    assert run.read("bronze/_quarantine").count() == run.summary.corrupt > 0


def test_batch_files_load_once(run):
    assert [run.read(f"bronze/{n}").count() for n in ("branches", "products", "fx_rates")] == [50, 9, 5]
    paths = [r[0] for r in run.read("bronze/_copy_ledger").select("file_path").collect()]
    assert len(paths) == 4 and all(p.startswith("/") for p in paths)


def test_histories_hold_together(run):
    for name in ("customers", "accounts", "loan_applications"):
        rows = run.read(f"silver/{name}")
        assert scd2.chain_violations(rows).count() == 0
        assert rows.where("is_deleted and is_current").count() == 0
    events = run.read("bronze/customers").count()
    assert run.read("silver/customers").count() == events
    assert run.read("silver/transactions").groupBy("transaction_id").count().where("count > 1").count() == 0


def test_deleted_keys_have_no_current_version(run):
    gone = run.read("silver/loan_applications").where("is_deleted").select("business_key")
    assert gone.count() > 0
    assert run.read("silver/loan_applications").where("is_current").join(gone, "business_key").count() == 0


def test_quality_files(run):
    said = {p.name: json.loads(p.read_text()) for p in Path(run.checks).iterdir() if p.suffix == ".json"}
    assert set(said) == {"silver_customers.json", "silver_accounts.json", "silver_transactions.json", "gold_account_daily_metrics.json"}
    assert sum(len(x["checks"]) for x in said.values()) == 25


def test_a_second_run_adds_nothing(run):
    before = {n: run.read(n).count() for n in ("bronze/customers", "silver/customers", "silver/transactions", "silver/accounts", "bronze/branches", "gold/dim_customers")}
    again = L.Run(run.spark, run.config, "r2", run.now)
    assert L.run_bronze(again)["rows_read"] == 0
    assert set(L.run_copy_into(again).values()) == {0}
    L.run_silver(again)
    assert {n: run.read(n).count() for n in before} == before


def test_touched_keys_only(run):
    whole = run.read("silver/accounts").count()
    counts = L.run_silver(L.Run(run.spark, run.config, "r3", run.now), changed_since="2020-01-01")
    assert counts["accounts"]["written"] == whole == run.read("silver/accounts").count()


def test_needed_steps_block_the_rest(run):
    def broken(_):
        raise ValueError("no")

    out = L.run_all(run, [("a", broken, False), ("b", broken, True), ("c", lambda _: None, True)])
    assert out == {"a": "failed: ValueError: no", "b": "failed: ValueError: no", "c": "skipped"}
    assert [tuple(r) for r in M.metrics_table(run.spark, run.lake).read().where("pipeline = 'run' and step = 'c'").select("status", "error").collect()] == [("skipped", "b failed")]


def test_a_slow_step_is_cancelled(run):
    """Its own jobs end, others go on, later steps are skipped, and all of it is in the run's rows."""
    other = run.__class__(run.spark, run.config, "slow-run", run.now)
    nap = F.udf(lambda x: __import__("time").sleep(0.5) or x, "long")

    def slow(r):
        with M.track_step(r.spark, r.lake, r.run_id, "p", "slow", "silver"):
            r.spark.range(0, 400, 1, 4).select(nap("id").alias("x")).agg(F.sum("x")).collect()

    def stubborn(r):
        for _ in range(3):
            try:
                slow(r)
            except Exception:  # noqa: BLE001, S110 - it tries again
                pass

    began = time.monotonic()
    out = L.run_all(other, [("quick", lambda r: r.spark.range(5).count(), True), ("slow", slow, False), ("stubborn", stubborn, True), ("after", slow, True)], {"*": 60, "slow": 4, "stubborn": 4})
    assert time.monotonic() - began < 60
    assert out["quick"] == "success" and out["after"] == "skipped"
    assert out["slow"] == "failed: StepTimeout: slow took more than 4 s" and out["stubborn"].startswith("failed: StepTimeout")
    rows = {(r["pipeline"], r["step"], r["status"]) for r in M.metrics_table(run.spark, run.lake).read().where("run_id = 'slow-run'").collect()}
    assert rows >= {("p", "slow", "failed"), ("run", "slow", "failed"), ("run", "stubborn", "failed"), ("run", "after", "skipped")}
    assert run.spark.range(7).count() == 7


def test_limits_of_the_command_line():
    assert L._limits(["90", "gold=5", "marts=2.5"]) == {"*": 90.0, "gold": 5.0, "marts": 2.5} and L._limits([]) == {}


def test_generators_repeat_themselves(tmp_path):
    lines = [e.line for e in changes.generate(300, 7)]
    assert lines == [e.line for e in changes.generate(300, 7)] != [e.line for e in changes.generate(300, 8)]
    raw = [json.loads(x) for x in lines]
    assert [x["source"]["lsn"] for x in raw] == list(range(1, 301))
    assert all(b["ts_ms"] - a["ts_ms"] >= 100 for a, b in zip(raw, raw[1:], strict=False)) and raw[0]["ts_ms"] > changes.EPOCH_MS
    assert all((x["before"] is None) == (x["op"] == "c") and (x["after"] is None) == (x["op"] == "d") for x in raw)
    assert {x["source"]["table"] for x in raw} == set(changes.KEYS)
    summary = changes.Summary()
    broken = sum(1 for e in changes.generate(500, 7, 10.0, summary) if not _parses(e.line))
    assert broken == summary.corrupt > 20
    feeds.write_feeds(tmp_path)
    one, two = sorted((tmp_path / "branches").iterdir())
    assert one.read_bytes() == two.read_bytes()
    counts = changes.write_events(changes.generate(100, 7), tmp_path / "cdc", rotate_every=10)
    assert sum(counts.values()) == 100 == sum(len(p.read_text().splitlines()) for p in Path(tmp_path / "cdc").rglob("*.ndjson"))


def _parses(line):
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def test_table_versions(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        t.read()
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert t.append(rows((1, "a"))).number == 1
    t.append(rows((2, "b")).withColumn("extra", F.lit(7)))
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a", None), (2, "b", 7)]
    assert t.read(1).count() == 1
    assert t.append(rows((3, "c")), mark=("q", 0)) and t.append(rows((3, "c")), mark=("q", 0)) is None
    base = t.latest()
    t.append(rows((4, "d")))
    with pytest.raises(CommitConflict):
        t.overwrite(rows((9, "z")), on=base)
    assert t.merge(rows((1, "new"), (5, "e")), ["k"], ["v"]) == 2
    assert {r["k"]: r["v"] for r in t.read().collect()} == {1: "new", 2: "b", 3: "c", 4: "d", 5: "e"}
    with pytest.raises(ValueError):
        t.merge(rows((1, "x"), (1, "y")), ["k"], ["v"])
    with pytest.raises(TypeError):
        t.append(spark.createDataFrame([("x",)], "k string"))
    assert t.merge_absent(rows((5, "no"), (6, "f"), (6, "f")), ["k"]) == 2 and t.read().count() == 6
    assert t.vacuum() == [] and len(t.vacuum(unlisted_s=0)) > 0 and t.read().count() == 6


def test_a_claim_whose_writer_is_gone(spark, tmp_path, monkeypatch):
    from weirstone.storage import table as module

    monkeypatch.setattr(module, "CLAIM_S", 1)
    t = Table(spark, f"{tmp_path}/t")
    (tmp_path / "t" / "_log").mkdir(parents=True)
    (tmp_path / "t" / "_log" / "000000000001.json.claim").touch()
    assert t.append(spark.createDataFrame([(1,)], "k int")).number == 1 and t.read().count() == 1


def test_config(tmp_path):
    config = load_config(root=tmp_path, environ={"LAKEHOUSE_SOURCE_MODE": "kafka", "LAKEHOUSE_ROOT": "hdfs://x/y"})
    assert config.source.mode == "kafka" and config.table("silver", "a") == "hdfs://x/y/silver/a"
    assert config.storage.exports_dir == f"{tmp_path}/data/exports" and config.entity("transactions").scd == "append_only"
    with pytest.raises(ValueError):
        load_config(environ={"LAKEHOUSE_SOURCE_MODE": "carrier"})


def test_transports(spark):
    from weirstone.sources import landing

    config = load_config(environ={})
    auto = config.model_copy(update={"source": config.source.model_copy(update={"mode": "auto"})})
    assert landing.resolve_mode(config) == "file"
    assert [landing.resolve_mode(auto, probe=lambda *_, a=a: a) for a in (True, False)] == ["kafka", "file"]
    with pytest.raises(ValueError):
        landing.change_events(spark, config, "carrier")
    row = spark.createDataFrame([(b"k", b"v", "banking.cdc.accounts", 3, 9)], "key binary, value binary, topic string, partition int, offset long")
    assert tuple(landing.from_messages(row, "banking.cdc").first()) == ("accounts", "k", "v", "banking.cdc.accounts:3:9")
    assert Counter(landing.COLUMNS) == Counter(landing.from_messages(row, "banking.cdc").columns)
