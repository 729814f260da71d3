"""Change-event envelopes: permissive parsing, classification of malformed lines, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

ENVELOPE = T.StructType([
    T.StructField("op", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("source", T.StructType([T.StructField("table", T.StringType()), T.StructField("lsn", T.LongType()), T.StructField("connector", T.StringType()), T.StructField("db", T.StringType())])),
    T.StructField(CORRUPT, T.StringType()),
])

#: Create, update, delete, snapshot read.
OPS = ("c", "u", "d", "r")


def error_reason(envelope: Column) -> Column:
    """Why a parsed envelope is malformed, or null; the first reason that holds."""
    reasons = [
        (envelope.isNull(), "unparseable_json"),
        (envelope[CORRUPT].isNotNull(), "corrupt_envelope"),
        (envelope["op"].isNull(), "missing_op"),
        (~envelope["op"].isin(*OPS), "unknown_op"),
        (envelope["ts_ms"].isNull(), "missing_or_invalid_ts_ms"),
        (envelope["source"]["table"].isNull(), "missing_source_table"),
    ]
    return F.coalesce(*(F.when(broken, F.lit(reason)) for broken, reason in reasons))


def parse_envelope(lines: DataFrame, raw_col: str = "raw_value") -> DataFrame:
    """``lines`` with ``envelope`` (null for null or blank lines) and ``error_reason`` (null if well-formed)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.withColumn("envelope", F.from_json(F.col(raw_col), ENVELOPE, options))
    return parsed.withColumn("error_reason", error_reason(F.col("envelope")))


def mark_unknown_entities(parsed: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Well-formed events of entities that nobody configured get the reason ``unknown_entity``."""
    unknown = F.col("error_reason").isNull() & ~F.coalesce(F.col("entity").isin(*entities), F.lit(False))
    return parsed.withColumn("error_reason", F.when(unknown, F.lit("unknown_entity")).otherwise(F.col("error_reason")))


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error_reason").isNotNull()).select("entity", F.col("raw_value").alias("raw_line"), "error_reason", "source_ref")


def events_of(parsed: DataFrame, entity: str) -> DataFrame:
    """An entity's well-formed events; before and after images stay raw text."""
    held = parsed.where(F.col("error_reason").isNull() & (F.col("entity") == entity))
    return held.select("event_key", "raw_value", "envelope.op", "envelope.ts_ms", F.col("envelope.source.lsn").alias("lsn"), "source_ref")
