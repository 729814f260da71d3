"""Incident detectors over run metrics and data-quality results, as DataFrames of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from worst to least.
SEVERITIES = ("critical", "high", "medium", "low")

#: How many past runs make a baseline, how far above it is odd, and the threshold without one.
MIN_HISTORY, SPIKE_SIGMAS, SPIKE_MARGIN, SPIKE_STATIC, SLOW_SIGMAS, SLOW_MARGIN = 3, 2.0, 0.01, 0.05, 3.0, 0.5


def split_runs(metrics: DataFrame, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(this run's rows, all other runs' rows); without an id this run is the one that started last."""
    if run_id is None:
        chosen = metrics.agg(F.max_by("run_id", "started_at").alias("run_id"))
        return metrics.join(F.broadcast(chosen), "run_id", "left_semi"), metrics.join(F.broadcast(chosen), "run_id", "left_anti")
    return metrics.where(F.col("run_id") == run_id), metrics.where(F.col("run_id") != run_id)


def _finding(severity: Column, title: Column, affected: Column, cause: Column, advice: Column, /, **evidence: Column) -> list[Column]:
    said = F.map_from_arrays(F.array(*(F.lit(k) for k in evidence)), F.array(*(F.coalesce(v.cast("string"), F.lit("n/a")) for v in evidence.values())))
    return [severity.alias("severity"), title.alias("title"), affected.alias("affected"), cause.alias("probable_cause"), advice.alias("recommendation"), said.alias("evidence")]


def _place() -> Column:
    return F.concat_ws("/", "pipeline", "step")


def failed_steps(run: DataFrame) -> DataFrame:
    """Failed steps: critical in gold, else high."""
    severity = F.when(F.col("layer") == "gold", "critical").otherwise("high")
    return run.where("status = 'failed'").select(*_finding(severity, F.concat(F.lit("Pipeline step failed: "), _place()), _place(), F.lit("The step raised an exception; layers after it are out of date."), F.lit("Read the error and the quarantine before touching checkpoints; rerun the step once mended."), error=F.col("error"), duration_s=F.format_number("duration_s", 1), started_at=F.col("started_at")))


def quality_findings(results: DataFrame) -> DataFrame:
    """From (table, description, severity, status, observed): failures are high; warnings medium for references, else low."""
    fail, reference = F.col("status") == "fail", F.col("description").startswith("referential_integrity")
    severity = F.when(fail, "high").when(reference, "medium").otherwise("low")
    title = F.concat(F.when(fail, "DQ check failed on ").otherwise("DQ warning on "), "table", F.lit(": "), "description")
    cause = F.when(fail, "Rows that keep the contract stopped coming, or a transformation broke.").when(reference, "Orphans mostly stem from upstream events in quarantine.").otherwise("Quality drifts without blocking; watch the trend.")
    advice = F.when(fail, "Hold back what builds on this table; look at its quarantine and its last changes.").when(reference, "Look for the missing keys in the quarantine, then reprocess.").otherwise("Review within a working day.")
    return results.where(F.col("status").isin("fail", "warn")).select(*_finding(severity, title, F.col("table"), cause, advice, observed=F.col("observed"), severity=F.col("severity")))


#: What of a step is held against past runs; null where a run says nothing of it.
OBSERVED = {"quarantine_ratio": "case when rows_read > 0 then coalesce(rows_quarantined, 0) / rows_read end", "duration_s": "cast(duration_s as double)"}


def moments(metrics: DataFrame, *by: str) -> DataFrame:
    """(by, step, metric, runs, mean, m2): how often a value was observed, its mean and its squared deviations from it."""
    values = F.array(*(F.struct(F.lit(name).alias("metric"), F.expr(value).alias("v")) for name, value in OBSERVED.items()))
    seen = metrics.select(*by, "step", F.inline(values)).where("v is not null")
    return seen.groupBy(*by, "step", "metric").agg(F.count("v").alias("runs"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"))


def merged(parts: DataFrame) -> DataFrame:
    """(step, metric, runs, mean, m2) of several rows of moments, as if of all that they observed."""
    of = Window.partitionBy("step", "metric")
    whole = parts.withColumn("_mean", F.sum(F.col("runs") * F.col("mean")).over(of) / F.sum("runs").over(of))
    off = F.col("mean") - F.col("_mean")
    return whole.groupBy("step", "metric").agg(F.sum("runs").alias("runs"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("runs") * off * off).alias("m2"))


def _past(baseline: DataFrame, metric: str) -> DataFrame:
    return baseline.where(F.col("metric") == metric).select("step", "runs", "mean", F.sqrt(F.col("m2") / F.col("runs")).alias("sd"))


def quarantine_spikes(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """Steps whose quarantined share is above mean + max(2 sd, 0.01) of past runs (merged moments), or 0.05 with fewer than three."""
    ratio = F.col("rows_quarantined") / F.col("rows_read")
    now = run.where("rows_read > 0 and rows_quarantined > 0").withColumn("ratio", ratio).join(_past(baseline, "quarantine_ratio"), "step", "left")
    known = F.coalesce(F.col("runs") >= MIN_HISTORY, F.lit(False))
    now = now.withColumn("threshold", F.when(known, F.col("mean") + F.greatest(F.col("sd") * SPIKE_SIGMAS, F.lit(SPIKE_MARGIN))).otherwise(SPIKE_STATIC))
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    basis = F.when(known, F.format_string("baseline of %d runs", F.coalesce("runs", F.lit(0)))).otherwise(F.format_string("fixed threshold, only %d runs", F.coalesce("runs", F.lit(0))))
    return now.where("ratio > threshold").select(*_finding(F.lit("medium"), F.concat(F.lit("Quarantine spike in "), _place()), F.col("step"), F.lit("Payloads changed upstream, or a producer sends more malformed events."), F.lit("Count the quarantine by reason; if a contract changed, evolve it rather than patch rows."), quarantine_ratio=percent("ratio"), threshold=percent("threshold"), basis=basis, rows_quarantined=F.col("rows_quarantined")))


def duration_anomalies(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """Steps that took longer than mean + max(3 sd, 0.5 s) of at least three past runs."""
    now = run.join(_past(baseline, "duration_s").where(F.col("runs") >= MIN_HISTORY), "step").withColumn("threshold", F.col("mean") + F.greatest(F.col("sd") * SLOW_SIGMAS, F.lit(SLOW_MARGIN)))
    one = lambda c: F.format_string("%.1f", F.col(c))
    return now.where("duration_s > threshold").select(*_finding(F.lit("low"), F.concat(F.lit("Duration anomaly in "), _place()), F.col("step"), F.lit("More rows, skew, or a busy machine; results are not in doubt."), F.lit("Hold rows_read against past runs; if it is level, look at file sizes and shuffles."), duration_s=one("duration_s"), baseline_mean_s=one("mean"), threshold_s=one("threshold"), history_runs=F.col("runs")))


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity)


def all_findings(run: DataFrame, baseline: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Every detector's findings, worst first, then by title. ``baseline``: the merged moments of past runs."""
    found = failed_steps(run).unionByName(quarantine_spikes(run, baseline)).unionByName(duration_anomalies(run, baseline))
    found = found.unionByName(quality_findings(results)) if results is not None else found
    return found.orderBy(rank(F.col("severity")), "title")


def overall_status(findings: DataFrame) -> DataFrame:
    """One row: status, n_findings."""
    worst = F.min(rank(F.col("severity")))
    status = F.when(worst == 1, "SEV-1 CANDIDATE").when(worst == 2, "SEV-2 CANDIDATE").when(worst == 3, "SEV-3 / DEGRADED").when(worst.isNotNull(), "HEALTHY WITH NOTES").otherwise("HEALTHY")
    return findings.agg(status.alias("status"), F.count(F.lit(1)).alias("n_findings"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
