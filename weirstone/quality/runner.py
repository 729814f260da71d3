"""Running suites: all checks of a table in one scan of it, keys and references included."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.functions import epoch_ms
from weirstone.quality.suite import Check, Suite
from weirstone.storage.table import Files

RESULTS = "check_no int, description string, severity string, status string, passed boolean, observed string"


def _millis(at: datetime) -> int:
    return round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


#: What a check on single rows wants of a row, and how that is gathered.
MEASURES: dict[str, tuple[Callable[[Check], Column], Callable[[Column], Column]]] = {
    "not_null": (lambda c: F.col(c.column).isNull().cast("long"), F.sum),
    "accepted_values": (lambda c: (~F.col(c.column).isin(*c.values)).cast("long"), F.sum),
    "row_count_between": (lambda c: F.lit(1).cast("long"), F.sum),
    "freshness": (lambda c: epoch_ms(F.col(c.column)), F.max),
}

#: What is counted by the checks that want a count of zero.
COUNTED = {"not_null": "null values", "unique": "duplicate keys", "accepted_values": "out-of-domain values", "referential_integrity": "orphaned values"}


def verdict(check: Check, value: Column, now: datetime) -> tuple[Column, Column]:
    """(passed, observed) from a measure."""
    count = F.coalesce(value, F.lit(0)).cast("string")
    if check.type in COUNTED:
        return value == 0, F.concat(count, F.lit(f" {COUNTED[check.type]}"))
    if check.type == "row_count_between":
        return value.between(check.min_rows, (1 << 63) - 1 if check.max_rows is None else check.max_rows), F.concat(count, F.lit(" rows"))
    age = (F.lit(_millis(now)) - value) / 3_600_000
    return F.coalesce(age <= check.max_age_hours, F.lit(False)), F.when(age.isNull(), "no rows / all-null event time").otherwise(F.format_string("latest event %.1fh old", age))


def _key(rows: DataFrame, names: Sequence[str]) -> Column:
    """Values as texts, one to one; null stays null."""
    floats = {f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")}
    return F.array(*((F.col(n) + F.lit(0.0) if n in floats else F.col(n)).cast("string") for n in names))


def run_suite(rows: DataFrame, suite: Suite, ref: Callable[[str], DataFrame], now: datetime, with_rows: bool = False) -> DataFrame:
    """One row by check: check_no, description, severity, status (pass, fail, warn), passed, observed; and row_count, if asked for.

    Lazy; ``now`` is given, never read from a clock. The table is scanned once: a row becomes a tag with
    what the checks on single rows want, and one for each key that it is checked for. Reference rows
    add tags of theirs. One aggregation by tag then has the duplicates and the orphans; nulls are values to a unique key.
    """
    rows = rows.where(suite.filter) if suite.filter else rows
    checks = list(enumerate(suite.checks))
    plain = [(i, c) for i, c in checks if c.type in MEASURES]
    none = [F.lit(None).cast("long").alias(f"p{i}") for i, _ in plain]
    tag = lambda no, key, parent, values: F.struct(F.lit(no).alias("no"), key.alias("key"), F.lit(parent).alias("parent"), *values)
    tags = [tag(-1, F.array().cast("array<string>"), False, [MEASURES[c.type][0](c).alias(f"p{i}") for i, c in plain])]
    sides = []
    for i, c in checks:
        if c.type == "unique":
            tags.append(tag(i, _key(rows, c.columns), False, none))
        if c.type == "referential_integrity":
            held = ref(c.ref_table)
            held = held.where(c.ref_filter) if c.ref_filter else held
            # A value is compared in the type that the reference has.
            kind = held.schema[c.ref_column].dataType
            typed = rows if rows.schema[c.column].dataType == kind else rows.withColumn(c.column, F.col(c.column).try_cast(kind))
            key = _key(rows, [c.column]) if typed is rows else F.array(F.col(c.column).try_cast(kind).cast("string"))
            tags.append(F.when(F.col(c.column).isNotNull(), tag(i, key, False, none)))
            sides.append(held.select(F.lit(i).alias("no"), _key(held, [c.ref_column]).alias("key"), F.lit(True).alias("parent"), *none))
    every = rows.select(F.inline(F.array_compact(F.array(*tags))))
    for side in sides:
        every = every.unionByName(side)
    gathered = [MEASURES[c.type][1](f"p{i}").alias(f"p{i}") for i, c in plain]
    met = every.groupBy("no", "key").agg(F.count_if(~F.col("parent")).alias("n"), F.bool_or("parent").alias("parent"), *gathered)
    mine = lambda i: F.col("no") == i
    counted = {
        "unique": lambda i: F.sum(F.when(mine(i), F.col("n") - 1)),
        "referential_integrity": lambda i: F.sum(F.when(mine(i) & ~F.col("parent"), F.col("n"))),
    }
    measures = [(counted[c.type](i) if c.type in counted else F.max(f"p{i}")).alias(f"m{i}") for i, c in checks]
    measured = met.agg(F.coalesce(F.sum(F.when(mine(-1), F.col("n"))), F.lit(0)).alias("row_count"), *measures)
    listed = []
    for i, c in checks:
        value = F.col(f"m{i}") if c.type == "freshness" else F.coalesce(f"m{i}", F.lit(0))
        passed, observed = verdict(c, value, now)
        status = F.when(passed, "pass").otherwise("fail" if c.severity == "error" else "warn")
        more = [F.col("row_count")] if with_rows else []
        listed.append(F.struct(F.lit(i).alias("check_no"), F.lit(c.describe()).alias("description"), F.lit(c.severity).alias("severity"), status.alias("status"), passed.alias("passed"), observed.alias("observed"), *more))
    return measured.select(F.inline(F.array(*listed))).orderBy("check_no")


def suite_summary(results: DataFrame) -> DataFrame:
    """n_passed, n_failed, n_warned, pass_rate (1.0 without checks)."""
    n = lambda s: F.count_if(F.col("status") == s)
    rate = F.coalesce(n("pass") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0))
    return results.agg(n("pass").alias("n_passed"), n("fail").alias("n_failed"), n("warn").alias("n_warned"), rate.alias("pass_rate"))


@dataclass(frozen=True)
class SuiteResult:
    table: str
    layer: str
    row_count: int
    executed_at: datetime
    checks: list[dict]

    def count(self, status: str) -> int:
        return sum(c["status"] == status for c in self.checks)

    @property
    def pass_rate(self) -> float:
        return self.count("pass") / len(self.checks) if self.checks else 1.0

    def json(self) -> str:
        """With sorted keys."""
        said = {"table": self.table, "layer": self.layer, "row_count": self.row_count, "executed_at": self.executed_at.isoformat(), "pass_rate": self.pass_rate, "checks": [{k: c[k] for k in ("description", "severity", "status", "observed")} for c in self.checks]}
        return json.dumps(said, indent=2, sort_keys=True)


def run_suites(suites: Iterable[Suite], read: Callable[[str], DataFrame], now: datetime, folder: str | None = None) -> list[SuiteResult]:
    """Run suites over the tables that ``read`` opens; the outcomes, also as a JSON file by table in ``folder``, which may be in any store."""
    out = []
    for suite in suites:
        rows = read(suite.table)
        found = [r.asDict() for r in run_suite(rows, suite, read, now, with_rows=True).collect()]
        out.append(SuiteResult(suite.table, suite.layer, found[0]["row_count"] if found else rows.count(), now, found))
        if folder is not None:
            Files(rows.sparkSession, folder).write(f"{suite.table.replace('/', '_')}.json", out[-1].json())
    return out
