"""One row by pipeline step, in a table of run metrics."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.observability.detectors import moments
from weirstone.storage.export import export_table
from weirstone.storage.table import Table

#: The columns of the metrics table.
SCHEMA = """run_id STRING NOT NULL, run_date DATE NOT NULL, pipeline STRING NOT NULL, step STRING NOT NULL, layer STRING, status STRING NOT NULL,
    started_at TIMESTAMP NOT NULL, finished_at TIMESTAMP NOT NULL, duration_s DOUBLE NOT NULL, rows_read BIGINT, rows_written BIGINT,
    rows_quarantined BIGINT, dq_checks_passed INT, dq_checks_failed INT, dq_pass_rate DOUBLE, error STRING, extra MAP<STRING,STRING>"""


def current_run_id(given: str | None = None) -> str:
    return given or os.environ.get("LAKEHOUSE_RUN_ID") or f"adhoc-{uuid.uuid4().hex[:10]}"


@dataclass
class Step:
    """What a step may report while it runs."""

    rows_read: int | None = None
    rows_written: int | None = None
    rows_quarantined: int | None = None
    dq_checks_passed: int | None = None
    dq_checks_failed: int | None = None
    dq_pass_rate: float | None = None
    status: str = "success"
    error: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


def metrics_table(spark: SparkSession, lake: str) -> Table:
    return Table(spark, f"{lake}/_observability/pipeline_run_metrics")


def append_row(spark: SparkSession, lake: str, run_id: str, pipeline: str, step: str, layer: str | None, started: datetime, seconds: float, said: Step) -> None:
    done = datetime.fromtimestamp(started.timestamp() + seconds, timezone.utc)
    row = (run_id, started.date(), pipeline, step, layer, said.status, started, done, seconds, said.rows_read, said.rows_written, said.rows_quarantined, said.dq_checks_passed, said.dq_checks_failed, said.dq_pass_rate, said.error, said.extra or None)
    # Not under the step's tags: a step that is cancelled still gets its row.
    context, tags = spark.sparkContext, spark.sparkContext.getJobTags()
    context.clearJobTags()
    try:
        metrics_table(spark, lake).append(spark.createDataFrame([row], SCHEMA).coalesce(1), ["run_date"])
    finally:
        for tag in tags:
            context.addJobTag(tag)


@contextmanager
def track_step(spark: SparkSession, lake: str, run_id: str, pipeline: str, step: str, layer: str | None = None) -> Iterator[Step]:
    """Times the block and writes its row: a success, or a failure with its error, which goes on up."""
    said, started, began = Step(), datetime.now(timezone.utc), time.monotonic()
    try:
        yield said
    except Exception as e:
        said.status, said.error = "failed", f"{type(e).__name__}: {e}"
        raise
    finally:
        append_row(spark, lake, run_id, pipeline, step, layer, started, time.monotonic() - began, said)


def latest_run(metrics: DataFrame) -> DataFrame:
    """The rows of the run whose step started last, in order."""
    last = metrics.agg(F.max_by("run_id", "started_at").alias("run_id"))
    return metrics.join(F.broadcast(last), "run_id", "left_semi").orderBy("started_at")


def runs_over_time(metrics: DataFrame) -> DataFrame:
    """Per run: its first start, rows written, failed steps."""
    return metrics.groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.sum(F.coalesce("rows_written", F.lit(0))).alias("rows_written"), F.count_if(F.col("status") == "failed").alias("failed_steps"))


def run_kpis(run: DataFrame) -> DataFrame:
    """Steps, failed steps, rows written and quarantined of one run."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return run.agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "failed").alias("failed_steps"), total("rows_written"), total("rows_quarantined"))


def export_metrics(spark: SparkSession, lake: str, path: str, file_bytes: int = 32 << 20) -> int:
    """The metrics table as plain Parquet in files of about ``file_bytes``; the number of rows."""
    return export_table(metrics_table(spark, lake), path, file_bytes)


def past_moments(spark: SparkSession, lake: str, run_id: str) -> DataFrame:
    """Moments of all runs but this one, by run. They are kept in a table: each run's are worked out once, when a later one asks."""
    held, rows = Table(spark, f"{lake}/_observability/step_moments"), metrics_table(spark, lake).read().where(F.col("run_id") != run_id)
    fresh = rows.join(held.read().select("run_id").distinct(), "run_id", "left_anti") if held.exists() else rows
    held.merge_absent(moments(fresh, "run_id"), ["run_id", "step", "metric"])
    return held.read().where(F.col("run_id") != run_id)
