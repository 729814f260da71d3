"""An incident report in Markdown from a run's rows and findings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from weirstone.observability.detectors import all_findings, merged, moments, overall_status, split_runs


def _timeline(run: Sequence[Any]) -> list[str]:
    shown = lambda v: "—" if not v else str(v)
    rows = [f"| {r['pipeline']}/{r['step']} | {r['status']} | {r['duration_s']:.1f} | {shown(r['rows_read'])} | {shown(r['rows_written'])} | {shown(r['rows_quarantined'])} |" for r in run]
    return ["| step | status | secs | read | written | quarantined |", "|---|---|---|---|---|---|", *rows]


def _section(number: int, f: Any) -> list[str]:
    evidence = [f"- {k}: `{v}`" for k, v in f["evidence"].items()]
    return [f"### {number}. [{f['severity'].upper()}] {f['title']}", "", f"**Affected:** `{f['affected']}`", "", f"**Probable cause:** {f['probable_cause']}", "", "**Evidence:**", *evidence, "", f"**Recommended action:** {f['recommendation']}", ""]


def render(run_id: str, run: Sequence[Any], findings: Sequence[Any], status: str, at: datetime) -> str:
    counts = ", ".join(f"{n} {s}" for s, n in sorted(Counter(f["severity"] for f in findings).items())) or "no findings"
    if findings:
        worst = findings[0]
        summary = f"The run has {len(findings)} finding(s). The worst: [{worst['severity'].upper()}] {worst['title']} — {worst['probable_cause']}"
    else:
        summary = "Every step succeeded, every suite passed, and nothing departs from past runs."
    parts = [f"# Pipeline Incident Report — run `{run_id}`", "", f"Generated: {at.isoformat(timespec='seconds')}  ", f"Overall status: **{status}** ({counts})", "", "## Summary", "", summary, "", "## Run timeline", "", *_timeline(run), ""]
    for i, f in enumerate(findings, 1):
        parts += ["## Findings", ""] * (i == 1) + _section(i, f)
    return "\n".join(parts)


def incident_report(metrics: DataFrame, results: DataFrame | None, at: datetime, run_id: str | None = None, past: DataFrame | None = None) -> str:
    """The report on a run (by default the last). ``past``: moments of earlier runs, where they are kept; else they are worked out of the metrics."""
    run, history = split_runs(metrics, run_id)
    findings = all_findings(run, merged(moments(history, "run_id") if past is None else past), results).persist()
    try:
        rows, found, status = run.orderBy("started_at").collect(), findings.collect(), overall_status(findings).first()["status"]
    finally:
        findings.unpersist()
    if not rows:
        raise LookupError(f"no rows of run {run_id}")
    return render(rows[0]["run_id"], rows, found, status, at)
