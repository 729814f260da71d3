"""Version histories (SCD type 2) from change events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.contracts import Contract

CLOSING = ("valid_to", "is_current", "is_deleted")
IDENTITY = ("business_key", "valid_from")


def intervals(events: DataFrame, key: str, order: Sequence[str], start: str, op: str = "op", identity: Sequence[str] | None = None) -> DataFrame:
    """Events that open a version (all but deletes) with valid_from, valid_to, is_current, is_deleted.

    Repeated deliveries (same key, identity columns) count once. A version ends where the key's next
    event begins, a delete included; the latest has no end. Events of one key at one time leave only
    the last by ``order``: the others' versions would be empty.
    """
    if identity:
        events = events.dropDuplicates([key, *identity])
    line = Window.partitionBy(key).orderBy(*order)
    out = events.withColumn("_next_op", F.lead(op).over(line)).withColumn("_next_at", F.lead(start).over(line))
    out = out.where((F.col(op) != "d") & (F.col("_next_at").isNull() | (F.col("_next_at") != F.col(start))))
    flags = {"valid_from": F.col(start), "valid_to": F.col("_next_at"), "is_current": F.col("_next_at").isNull(), "is_deleted": F.coalesce(F.col("_next_op") == "d", F.lit(False))}
    return out.withColumns(flags).drop("_next_op", "_next_at")


def build_versions(events: DataFrame, contract: Contract) -> DataFrame:
    """Version rows of a contract's valid events: business_key, its fields, the interval, _run_id.

    The business key is the first primary-key field, of the after image or else the before image.
    """
    key = contract.primary_key[0]
    keyed = events.withColumn("business_key", F.coalesce(F.col(f"after.{key}"), F.col(f"before.{key}")))
    found = intervals(keyed, "business_key", ("ts_ms", "lsn"), "ts_ms", identity=("lsn", "op"))
    at: dict[str, Column] = {c: F.timestamp_millis(c) for c in ("valid_from", "valid_to")}
    return found.withColumns(at).select("business_key", "after.*", "valid_from", "valid_to", "is_current", F.col("run_id").alias("_run_id"), "is_deleted")


def fact_rows(events: DataFrame, contract: Contract) -> DataFrame:
    """Append-only facts: creates and snapshot reads; later updates and deletes of a fact don't count."""
    return events.where(F.col("op").isin("c", "r")).select("after.*", F.col("run_id").alias("_run_id"))


def touched_history(events: DataFrame, changed_keys: DataFrame, key: str) -> DataFrame:
    """Only the events of keys that changed, for recomputing a part of a history."""
    return events.join(changed_keys.select(key).distinct(), key, "left_semi")


def current(versions: DataFrame) -> DataFrame:
    return versions.where("is_current and not is_deleted")


def chain_violations(versions: DataFrame, key: str = "business_key") -> DataFrame:
    """Keys whose versions overlap, or that have two current ones: (key, overlaps, n_current)."""
    line = Window.partitionBy(key).orderBy("valid_from")
    late = F.coalesce(F.col("valid_to") > F.lead("valid_from").over(line), F.col("valid_to").isNull() & F.lead("valid_from").over(line).isNotNull())
    per_key = versions.withColumn("_late", late.cast("int")).groupBy(key).agg(F.sum("_late").alias("overlaps"), F.sum(F.col("is_current").cast("int")).alias("n_current"))
    return per_key.where("overlaps > 0 or n_current > 1")


def as_of(versions: DataFrame, probes: DataFrame, key: str, at: str) -> DataFrame:
    """Probes (key, at, ...) with the version that held then, if any.

    An equality join on the key and an interval test inside it; no range join over all rows.
    """
    held = versions.withColumnRenamed(key, "_key")
    inside = (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return probes.join(held, (probes[key] == held["_key"]) & inside, "left").drop("_key")
