"""A run's metrics as text or as a page."""

from __future__ import annotations

import html
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from weirstone.observability.metrics import latest_run

_COLUMNS = (("pipeline", 10, "<"), ("step", 32, "<"), ("status", 8, "<"), ("secs", 6, ">"), ("read", 7, ">"), ("written", 7, ">"), ("quar", 5, ">"), ("dq", 7, ">"))


def _cells(row: Any) -> list[str]:
    shown = lambda c: "-" if row[c] is None else str(row[c])
    dq = "-" if row["dq_checks_passed"] is None else f"{row['dq_checks_passed']}/{row['dq_checks_passed'] + (row['dq_checks_failed'] or 0)}"
    return [row["pipeline"], row["step"], row["status"], f"{row['duration_s']:.1f}", shown("rows_read"), shown("rows_written"), shown("rows_quarantined"), dq]


def render_text(run_id: str, rows: Sequence[Any]) -> str:
    line = lambda cells: " ".join(f"{c:{align}{width}}" for c, (_, width, align) in zip(cells, _COLUMNS, strict=True)).rstrip()
    rule = "-" * 96
    failed = sum(r["status"] == "failed" for r in rows)
    return "\n".join([f"pipeline run report  run_id={run_id}", rule, line([n for n, _, _ in _COLUMNS]), rule, *(line(_cells(r)) for r in rows), rule, f"steps={len(rows)} failed={failed}"])


def render_html(run_id: str, rows: Sequence[Any]) -> str:
    def tr(cells: Sequence[str], tag: str, kind: str = "") -> str:
        return f"<tr{kind}>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"

    body = "\n".join(tr(_cells(r), "td", " class='failed'" if r["status"] == "failed" else "") for r in rows)
    title = html.escape(run_id)
    style = "body{font-family:monospace;margin:2rem} td,th{border:1px solid #ccc;padding:4px 8px;text-align:left} tr.failed td{background:#fdd}"
    return f"<!doctype html>\n<html><head><meta charset='utf-8'><title>run {title}</title><style>{style}</style></head><body>\n<h1>Pipeline run {title}</h1>\n<table>\n{tr([n for n, _, _ in _COLUMNS], 'th')}\n{body}\n</table>\n</body></html>\n"


def report(metrics: DataFrame) -> tuple[str, str]:
    """(text, html) of the latest run."""
    rows = latest_run(metrics).collect()
    if not rows:
        raise RuntimeError("no run has been recorded")
    return render_text(rows[0]["run_id"], rows), render_html(rows[0]["run_id"], rows)
