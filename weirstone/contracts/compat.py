"""Whether the next version of a contract still serves its readers, as a diff of rows.

A contract is a table of its fields: (contract, version, field, type, nullable, allowed_values, key_no,
event_time). Adjacent versions meet in a full outer join by field, and what changed for the worse is
read off the two sides.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirstone.contracts.model import DEFINITIONS, Contract, load_definitions

FIELD_ROWS = "contract string, version int, field string, type string, nullable boolean, allowed_values array<string>, key_no int, event_time boolean"


def field_rows(spark: SparkSession, contracts: Iterable[Contract]) -> DataFrame:
    """The fields of contracts, a row each; ``key_no`` is the place in the primary key, if any."""
    rows = []
    for c in contracts:
        keys = {name: k for k, name in enumerate(c.primary_key)}
        rows += [(c.contract, c.version, f.name, f.type, f.nullable, f.allowed_values, keys.get(f.name), f.name == c.event_time_field) for f in c.fields]
    return spark.createDataFrame(rows, FIELD_ROWS)


def observed_fields(rows: DataFrame, contract: Column, version: Column, listed: Iterable[str], numbers: Iterable[str] = ()) -> DataFrame:
    """What rows show of their contract, as field rows: a field is there if some row has a value, nullable if some lacks it.

    ``listed`` fields allow the values seen; ``numbers`` are bigint if all values are whole, else double.
    """
    text = [F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value"), F.lit("string").alias("type")) for n in listed]
    number = [F.struct(F.lit(n).alias("field"), F.lit(None).cast("string").alias("value"), F.when(F.col(n).isNotNull(), F.when(F.col(n) == F.floor(n), "bigint").otherwise("double")).alias("type")) for n in numbers]
    seen = rows.select(contract.alias("contract"), version.cast("int").alias("version"), F.inline(F.array(*text, *number)))
    there = F.when(F.col("type") == "string", F.col("value").isNotNull()).otherwise(F.col("type").isNotNull())
    # "double" comes after "bigint", so one number that is not whole decides.
    found = seen.groupBy("contract", "version", "field").agg(F.max("type").alias("type"), (~F.bool_and(F.coalesce(there, F.lit(False)))).alias("nullable"), F.bool_or(F.coalesce(there, F.lit(False))).alias("there"), F.sort_array(F.collect_set("value")).alias("values"))
    allowed = F.when(F.col("type") == "string", F.col("values"))
    return found.where("there").select("contract", "version", "field", "type", "nullable", allowed.alias("allowed_values"), F.lit(None).cast("int").alias("key_no"), F.lit(False).alias("event_time"))


def breaks(fields: DataFrame) -> DataFrame:
    """(contract, old_version, version, field, kind, detail): what each version breaks for readers of the one before it.

    A field that goes, changes its type, no longer takes null or loses allowed values (no list allows
    all, so to drop a list loses all of its values), a new field that must be filled, and a changed
    place in the primary key or as the event time.
    """
    steps = fields.select("contract", "version").distinct()
    steps = steps.withColumn("old_version", F.lag("version").over(Window.partitionBy("contract").orderBy("version"))).where("old_version is not null")
    new = fields.join(steps, ["contract", "version"]).select("contract", "version", "field", F.struct(*fields.columns).alias("now"))
    old = fields.withColumnRenamed("version", "old_version").join(steps, ["contract", "old_version"])
    old = old.select("contract", "version", "field", F.struct("type", "nullable", "allowed_values", "key_no", "event_time").alias("was"))
    both = new.join(old, ["contract", "version", "field"], "full_outer").join(steps, ["contract", "version"])
    lost = F.array_sort(F.array_except("was.allowed_values", F.coalesce("now.allowed_values", F.array().cast("array<string>"))))
    place = lambda side: F.coalesce(F.col(f"{side}.key_no").cast("string"), F.lit("none"))
    event = lambda side: F.coalesce(F.col(f"{side}.event_time"), F.lit(False))
    moved = lambda a, b: F.concat_ws(" to ", a, b)
    gone, fresh = F.col("now").isNull(), F.col("was").isNull()
    found = {
        "removed": (gone, F.lit("")),
        "added_required": (fresh & ~F.col("now.nullable"), F.lit("")),
        "type_changed": (F.col("was.type") != F.col("now.type"), moved("was.type", "now.type")),
        "became_required": (F.col("was.nullable") & ~F.col("now.nullable"), F.lit("")),
        "values_lost": (F.size(lost) > 0, F.array_join(lost, ",")),
        "key_changed": (place("was") != place("now"), moved(place("was"), place("now"))),
        "event_time_changed": (event("was") != event("now"), F.lit("")),
    }
    told = F.array_compact(F.array(*(F.when(~(gone & F.lit(kind == "values_lost")) & holds, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))) for kind, (holds, detail) in found.items())))
    return both.select("contract", "old_version", "version", "field", F.inline(told))


def check_all(spark: SparkSession, folder: str | Path = DEFINITIONS) -> DataFrame:
    """Breaks between adjacent versions of the contracts in a folder."""
    return breaks(field_rows(spark, load_definitions(folder)))


def main() -> int:
    from weirstone.session import build_session

    found = check_all(build_session("contracts")).orderBy("contract", "version", "field", "kind").collect()
    for r in found:
        print(f"{r.contract} v{r.old_version} -> v{r.version}: {r.field} {r.kind} {r.detail}".rstrip())
    return int(bool(found))


if __name__ == "__main__":
    raise SystemExit(main())
