"""The pipeline from landing to marts, in one session; each step can be called by itself."""

from __future__ import annotations

import argparse
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirstone import governance
from weirstone.config import Config, load_config
from weirstone.contracts import Contract, latest_contracts
from weirstone.generators import changes, feeds
from weirstone.observability import metrics as M
from weirstone.observability.narrative import incident_report
from weirstone.observability.report import report
from weirstone.operators import enforcement, gold, marts, scd2
from weirstone.operators.merge import insert_absent
from weirstone.quality import load_suites, run_suites
from weirstone.quality.suite import MART_SUITES
from weirstone.retrieval import index
from weirstone.retrieval.chunks import chunk_corpus
from weirstone.retrieval.corpus import write_corpus
from weirstone.retrieval.embed import HashingEmbedder
from weirstone.session import build_session
from weirstone.sources.files import copy_into
from weirstone.storage.export import export_table
from weirstone.storage.table import Files, Table
from weirstone.streaming.ingest import bronze, run_stream

#: Bytes of an exported file.
EXPORT_BYTES = 128 << 20

BATCH_TABLES = ("branches", "products", "fx_rates")


@dataclass
class Run:
    """What every step needs."""

    spark: SparkSession
    config: Config
    run_id: str = field(default_factory=M.current_run_id)
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    @property
    def lake(self) -> str:
        return self.config.storage.lakehouse_root

    @property
    def checks(self) -> str:
        """Where the outcomes of suites are, in the lake's store."""
        return f"{self.lake}/_observability/checks"

    def table(self, layer: str, name: str) -> Table:
        return Table(self.spark, self.config.table(layer, name))

    def read(self, place: str) -> DataFrame:
        """A table by 'layer/name'; those of bronze as of the last whole batch."""
        layer, name = place.split("/", 1)
        return bronze(self.spark, self.config).read(name) if layer == "bronze" else self.table(layer, name).read()


def run_bronze(run: Run, mode: str | None = None, strict: bool = False) -> dict[str, int]:
    with M.track_step(run.spark, run.lake, run.run_id, "bronze", "stream_events", "bronze") as step:
        counts = run_stream(run.spark, run.config, run.run_id, mode=mode, strict=strict)
        step.rows_read, step.rows_written, step.rows_quarantined = counts.rows_read, counts.rows_written, counts.rows_quarantined
    return vars(counts)


def run_copy_into(run: Run) -> dict[str, int]:
    with M.track_step(run.spark, run.lake, run.run_id, "bronze", "copy_into", "bronze") as step:
        counts = copy_into(run.spark, run.config.source.batch_landing_dir, f"{run.lake}/bronze", run.run_id)
        step.rows_read = step.rows_written = sum(counts.values())
    return counts


def historize(run: Run, contract: Contract, scd: str, changed_since: str | None = None) -> dict[str, int]:
    """An entity's events, held against its contract, into its history or facts and the quarantine.

    With ``changed_since`` (an earlier run's id is not enough; a timestamp of ingest) only the keys
    that have events since are worked out anew, over their whole history.
    """
    name = contract.contract
    # Checked events are written once, and counted on the way; all that follows reads them from there.
    place, seen = f"{run.lake}/_checked/{name}-{uuid.uuid4().hex}", Observation()
    checked = enforcement.check_payloads(run.read(f"bronze/{name}"), contract, before=scd == "type2")
    bad = F.size("violations") > 0
    checked.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(bad).alias("bad")).write.parquet(place)
    checked = run.spark.read.schema(checked.schema).parquet(place)
    try:
        if seen.get["bad"]:
            put_aside(run, enforcement.quarantine_rows(checked.where(bad), contract))
        valid = checked.where(~bad).drop("violations")
        if changed_since:
            valid = valid.withColumn("_key", F.coalesce(f"after.{contract.primary_key[0]}", f"before.{contract.primary_key[0]}") if scd == "type2" else F.col(f"after.{contract.primary_key[0]}"))
            valid = scd2.touched_history(valid, valid.where(F.col("ingest_ts") >= F.lit(changed_since).cast("timestamp")), "_key")
        if scd == "type2":
            written = run.table("silver", name).merge(scd2.build_versions(valid, contract), scd2.IDENTITY, scd2.CLOSING)
        else:
            written = run.table("silver", name).merge_absent(scd2.fact_rows(valid, contract), contract.primary_key[:1])
        return {"read": seen.get["read"], "written": written, "quarantined": seen.get["bad"]}
    finally:
        Files(run.spark, place).delete("")


def put_aside(run: Run, broken: DataFrame) -> None:
    """Violating events into the quarantine, once each: rereading all events adds no row twice."""
    quarantine, identity = run.table("silver", "_quarantine"), ["_row_key"]
    rows = broken.withColumn("_row_key", F.sha2(F.concat_ws("\x1f", "entity", "raw_line", "op", F.col("ts_ms").cast("string")), 256))
    rows = insert_absent(quarantine.read(), rows, identity) if quarantine.exists() else rows.dropDuplicates(identity)
    quarantine.append(rows.withColumns({"quarantined_at": F.current_timestamp(), "quarantine_date": F.current_date()}), ["quarantine_date"])


def run_silver(run: Run, changed_since: str | None = None) -> dict[str, dict[str, int]]:
    contracts, out = latest_contracts(), {}
    for entity in run.config.entities:
        if not run.table("bronze", entity.name).exists():
            continue
        with M.track_step(run.spark, run.lake, run.run_id, "silver", f"historize_{entity.name}", "silver") as step:
            out[entity.name] = counts = historize(run, contracts[entity.name], entity.scd, changed_since)
            step.rows_read, step.rows_written, step.rows_quarantined = counts["read"], counts["written"], counts["quarantined"]
    return out


def run_gold(run: Run, thresholds: gold.Thresholds = gold.Thresholds()) -> int:
    with M.track_step(run.spark, run.lake, run.run_id, "gold", "account_daily_metrics", "gold") as step:
        rows = gold.account_daily_metrics(run.read("silver/transactions"), run.read("silver/accounts"), run.read("silver/customers"), thresholds)
        rows = rows.withColumns({"computed_at": F.current_timestamp(), "run_id": F.lit(run.run_id)})
        run.table("gold", "account_daily_metrics").overwrite(rows)
        step.rows_written = run.read("gold/account_daily_metrics").count()
    return step.rows_written


def staging(run: Run) -> dict[str, DataFrame]:
    """The staging views."""
    return {
        "stg_customers": marts.stg_customers(run.read("silver/customers")),
        "stg_accounts": marts.stg_accounts(run.read("silver/accounts")),
        "stg_transactions": marts.stg_transactions(run.read("silver/transactions")),
        "stg_loan_applications": marts.stg_loan_applications(run.read("silver/loan_applications")),
        "stg_branches": marts.stg_branches(run.read("bronze/branches")),
        "stg_fx_rates": marts.stg_fx_rates(run.read("bronze/fx_rates")),
    }


def run_marts(run: Run) -> dict[str, int]:
    """Build the marts and run the checks on staging and marts; an error in those fails the step."""
    with M.track_step(run.spark, run.lake, run.run_id, "marts", "build", "gold") as step:
        views = staging(run)
        built = {
            "dim_customers": marts.dim_customers(views["stg_customers"], views["stg_accounts"]),
            "fct_transactions": marts.fct_transactions(views["stg_transactions"], views["stg_accounts"], views["stg_fx_rates"]),
            "mart_loan_funnel": marts.mart_loan_funnel(views["stg_loan_applications"]),
        }
        for name, rows in built.items():
            run.table("gold", name).overwrite(rows)
        counts = {name: run.read(f"gold/{name}").count() for name in built}
        step.rows_written = sum(counts.values())
        read = lambda place: views[place[8:]] if place.startswith("staging/") else run.read(place)
        results = run_suites(load_suites(MART_SUITES), read, run.now)
        step.dq_checks_passed = sum(r.count("pass") for r in results)
        step.dq_checks_failed = sum(r.count("fail") + r.count("warn") for r in results)
        if broken := [f"{r.table}: {c['description']}" for r in results for c in r.checks if c["status"] == "fail"]:
            raise ChecksFailed("; ".join(broken))
    return counts


def run_export(run: Run, file_bytes: int = EXPORT_BYTES) -> dict[str, int]:
    """Silver and batch tables as plain Parquet in files of about ``file_bytes``, for engines that know no versions."""
    out = {}
    with M.track_step(run.spark, run.lake, run.run_id, "silver", "export", "silver") as step:
        for layer, names in (("silver", [e.name for e in run.config.entities]), ("bronze", BATCH_TABLES)):
            for name in names:
                if run.table(layer, name).exists():
                    out[name] = export_table(run.table(layer, name), f"{run.config.storage.exports_dir}/silver/{name}", file_bytes)
        step.rows_written = sum(out.values())
    return out


class ChecksFailed(RuntimeError):
    """Checks of error severity failed; the message names them."""


def run_quality(run: Run) -> list:
    """Run all suites; their outcomes are written before a failed check fails the step."""
    with M.track_step(run.spark, run.lake, run.run_id, "quality", "suites") as step:
        results = run_suites(load_suites(), run.read, run.now, run.checks)
        step.dq_checks_passed = sum(r.count("pass") for r in results)
        step.dq_checks_failed = sum(r.count("fail") + r.count("warn") for r in results)
        step.dq_pass_rate = step.dq_checks_passed / max(1, step.dq_checks_passed + step.dq_checks_failed)
        if broken := [f"{r.table}: {c['description']}" for r in results for c in r.checks if c["status"] == "fail"]:
            raise ChecksFailed("; ".join(broken))
    return results


def run_report(run: Run) -> tuple[Path, Path]:
    rows = M.metrics_table(run.spark, run.lake).read()
    M.export_metrics(run.spark, run.lake, f"{run.config.storage.exports_dir}/observability/pipeline_run_metrics")
    text, page = report(rows)
    folder = run.config.storage.reports_dir
    folder.mkdir(parents=True, exist_ok=True)
    paths = folder / "run.txt", folder / "run.html"
    for path, content in zip(paths, (text, page), strict=True):
        path.write_text(content, encoding="utf-8")
    return paths


def run_incidents(run: Run) -> Path:
    results = None
    if Files(run.spark, run.checks).exists():
        raw = run.spark.read.json(run.checks, multiLine=True)
        results = raw.select("table", F.explode("checks").alias("c")).select("table", "c.*")
    past = M.past_moments(run.spark, run.lake, run.run_id)
    text = incident_report(M.metrics_table(run.spark, run.lake).read(), results, run.now, run.run_id, past)
    path = run.config.storage.reports_dir / f"incident_{run.run_id}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def run_governance(run: Run) -> list[Path]:
    """Tag statements and the access matrix, as files."""
    folder = run.config.storage.reports_dir
    folder.mkdir(parents=True, exist_ok=True)
    files = {folder / "pii_tags.sql": governance.pii_tag_sql(), folder / "access_matrix.md": governance.render_access_matrix(run.spark)}
    for path, content in files.items():
        path.write_text(content, encoding="utf-8")
    return list(files)


def build_retrieval(run: Run, seed: int = 42) -> str:
    """Write the sample corpus and index it; the index's place."""
    corpus, place = f"{run.config.storage.exports_dir}/retrieval_corpus", f"{run.config.storage.exports_dir}/retrieval_index"
    write_corpus(Files(run.spark, corpus), seed)
    index.save_index(index.build_index(chunk_corpus(run.spark, corpus), HashingEmbedder()), place)
    return place


def ask(run: Run, question: str, k: int = 3) -> str:
    """The answer to a question from the index as it is; a passage and where else to look."""
    held = index.load_index(run.spark, f"{run.config.storage.exports_dir}/retrieval_index")
    return index.format_answer(question, index.search(held, HashingEmbedder(), question, k).collect())


def run_retrieval(run: Run, questions: Sequence[str] = ("How long are bronze events kept?", "Who may read gold tables?"), k: int = 3, seed: int = 42) -> list[str]:
    """Write the sample corpus, index it, and answer questions from it."""
    build_retrieval(run, seed)
    return [ask(run, q, k) for q in questions]


def land(run: Run, events: int = 2000, seed: int = 42, corrupt_pct: float = 2.0) -> changes.Summary:
    summary = changes.Summary()
    changes.write_events(changes.generate(events, seed, corrupt_pct, summary), run.config.source.cdc_landing_dir, run=f"events_{run.run_id}")
    feeds.write_feeds(run.config.source.batch_landing_dir, seed)
    return summary


#: (name, step, whether later steps need it)
STEPS: list[tuple[str, Callable[[Run], Any], bool]] = [
    ("bronze_stream", run_bronze, True),
    ("bronze_copy_into", run_copy_into, True),
    ("silver", run_silver, True),
    ("gold", run_gold, True),
    ("export", run_export, False),
    ("marts", run_marts, False),
    ("quality", run_quality, False),
    ("governance", run_governance, False),
    ("retrieval", run_retrieval, False),
    ("report", run_report, False),
    ("incidents", run_incidents, False),
]


class StepTimeout(RuntimeError):
    """A step took longer than it may; its jobs were cancelled."""


#: Seconds that a step whose jobs were cancelled gets to come to its end.
GRACE_S = 30


def within(run: Run, name: str, step: Callable[[Run], Any], limit_s: float) -> None:
    """Call a step; once it has taken ``limit_s`` seconds, cancel its Spark jobs, and those it still begins, and fail.

    The step runs in a thread whose jobs carry a tag of their own, so no other job is touched. Code that
    never comes back to Spark can't be stopped; after ``GRACE_S`` more seconds it is left behind.
    """
    context, tag, outcome = run.spark.sparkContext, f"step-{uuid.uuid4().hex}", []

    def body() -> None:
        context.addJobTag(tag)
        try:
            step(run)
            outcome.append(None)
        except Exception as e:  # noqa: BLE001 - it goes on in the caller
            outcome.append(e)
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=body, daemon=True)
    thread.start()
    thread.join(limit_s)
    if not thread.is_alive():
        if outcome and outcome[0] is not None:
            raise outcome[0]
        return
    end = time.monotonic() + GRACE_S
    while thread.is_alive() and time.monotonic() < end:
        context.cancelJobsWithTag(tag)
        thread.join(0.5)
    raise StepTimeout(f"{name} took more than {limit_s:g} s")


def run_all(run: Run, steps: list[tuple[str, Callable[[Run], Any], bool]] | None = None, limits: Mapping[str, float] | None = None) -> dict[str, str]:
    """All steps in order. After a needed one fails, the rest are skipped; other failures are noted.

    ``limits`` has the seconds that steps may take; ``*`` stands for those not named. A skipped step
    has a row in the run metrics too, and one that was stopped before it could write its own.
    """
    out, blocked, limits = {}, None, limits or {}
    for name, step, needed in steps if steps is not None else STEPS:
        began, at = time.monotonic(), datetime.now(timezone.utc)
        note = lambda status, error: M.append_row(run.spark, run.lake, run.run_id, "run", name, None, at, time.monotonic() - began, M.Step(status=status, error=error))  # noqa: B023, E731
        if blocked:
            out[name] = "skipped"
            note("skipped", f"{blocked} failed")
            continue
        limit = limits.get(name, limits.get("*"))
        try:
            step(run) if limit is None else within(run, name, step, limit)
            out[name] = "success"
        except Exception as e:  # noqa: BLE001 - the outcome is the report
            out[name] = f"failed: {type(e).__name__}: {e}"
            blocked = name if needed else None
            if isinstance(e, StepTimeout):
                note("failed", str(e))
    return out


def _limits(given: Sequence[str]) -> dict[str, float]:
    """From ``step=seconds`` or plain seconds for all steps."""
    pairs = (text.rpartition("=") for text in given)
    return {name or "*": float(seconds) for name, _, seconds in pairs}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Run the lakehouse pipeline, or one step of it.")
    parser.add_argument("step", nargs="?", default="all", choices=["all", "land", "ask", *(n for n, _, _ in STEPS)])
    parser.add_argument("--config")
    parser.add_argument("--root", default=".")
    parser.add_argument("--run-id")
    parser.add_argument("--events", type=int, default=2000)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--corrupt-pct", type=float, default=2.0)
    parser.add_argument("--limit", action="append", default=[], metavar="STEP=SECONDS", help="how long a step may take, or SECONDS for every step; may be given again")
    parser.add_argument("--build", action="store_true", help="ask: write and index the corpus first")
    parser.add_argument("--query", help="ask: the question")
    parser.add_argument("--top-k", type=int, default=3, help="ask: how many passages")
    parser.add_argument("--now", help="reference time of freshness checks, ISO")
    given = parser.parse_args(argv)
    config = load_config(given.config, root=given.root)
    spark = build_session(memory=config.spark.driver_memory, shuffle_partitions=config.spark.shuffle_partitions)
    now = datetime.fromisoformat(given.now) if given.now else datetime.now(timezone.utc)
    run = Run(spark, config, M.current_run_id(given.run_id), now)
    if given.step == "ask":
        if given.build:
            print(build_retrieval(run, given.seed))
        if given.query:
            print(ask(run, given.query, given.top_k))
        return 0
    if given.step in ("all", "land"):
        print(land(run, given.events, given.seed, given.corrupt_pct))
    if given.step == "land":
        return 0
    done = run_all(run, [s for s in STEPS if given.step in ("all", s[0])], _limits(given.limit))
    for name, outcome in done.items():
        print(f"{name:20s} {outcome}")
    return int(any(x != "success" for x in done.values()))


if __name__ == "__main__":
    raise SystemExit(main())
