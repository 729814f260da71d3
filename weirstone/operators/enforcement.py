"""Holding event payloads against a data contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.contracts import Contract, struct_type

NO_VIOLATION = "array<string>"


def _images(contract: Contract, raw_col: str, parts: Sequence[str]) -> Column:
    """A struct of the images named, all out of one parse of the line. An image that is there but is no object has all its fields null."""
    kind = struct_type(contract)
    parsed = F.from_json(F.col(raw_col), T.StructType([T.StructField(part, kind) for part in parts]))
    empty = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kind))

    def image(line: Column, part: str) -> Column:
        # The second look at a line is for images that the first left null.
        return F.coalesce(line[part], F.when(F.get_json_object(F.col(raw_col), f"$.{part}").isNotNull(), empty)).alias(part)

    return F.transform(F.array(parsed), lambda line: F.struct(*(image(line, part) for part in parts)))[0]


def parse_payloads(events: DataFrame, contract: Contract, raw_col: str = "raw_value") -> DataFrame:
    """``events`` with typed ``after`` and ``before`` images. What doesn't fit a field's type becomes null."""
    return events.select("*", F.inline(F.array(_images(contract, raw_col, ("after", "before")))))


def rules(contract: Contract, image: Column) -> list[Column]:
    """One column by rule on the image, in field order: the violation's name, or null. Nulls pass value lists."""
    out = []
    for field in contract.fields:
        value = image[field.name]
        if not field.nullable:
            out.append(F.when(value.isNull(), F.lit(f"null_violation:{field.name}")))
        if field.allowed_values:
            out.append(F.when(~value.isin(*field.allowed_values), F.lit(f"enum_violation:{field.name}")))
    return out


#: Fixed value: the violation of an event whose after image is absent or no object.
NO_IMAGE = "payload_violation:after_missing_or_unparseable"


def violations(contract: Contract, image: Column) -> Column:
    """All violations of an event with this after image. Creates, updates and reads need one; deletes pass."""
    found = rules(contract, image)
    none = F.array().cast(NO_VIOLATION)
    every = F.array_compact(F.array(*found)) if found else none
    imaged = F.col("op").isin("c", "u", "r")
    return F.when(imaged & image.isNull(), F.array(F.lit(NO_IMAGE))).when(imaged, every).otherwise(none)


def enforce_contract(events: DataFrame, contract: Contract, before: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """(valid, quarantined, number of rules); quarantined rows name all their violations in field order."""
    checked = check_payloads(events, contract, before=before)
    valid = checked.where(F.size("violations") == 0).drop("violations")
    return valid, checked.where(F.size("violations") > 0), len(rules(contract, F.col("after")))


def check_payloads(events: DataFrame, contract: Contract, raw_col: str = "raw_value", before: bool = True) -> DataFrame:
    """``events`` with ``after``, ``before`` (unless left out) and ``violations``; a line is parsed once, for all of them.

    The parsed images are named by a lambda and come out of a generator, so neither the rules nor a
    filter on their outcome make the planner repeat the parsing.
    """
    parts = ("after", "before") if before else ("after",)
    once = F.transform(F.array(_images(contract, raw_col, parts)), lambda x: F.struct(*(x[part].alias(part) for part in parts), violations(contract, x["after"]).alias("violations")))
    return events.select("*", F.inline(once))


def quarantine_rows(broken: DataFrame, contract: Contract) -> DataFrame:
    """Violating events in the shape of the quarantine table, without clock columns."""
    return broken.select(F.lit(contract.contract).alias("entity"), F.lit(contract.version).alias("contract_version"), F.col("raw_value").alias("raw_line"), "violations", "op", "ts_ms", "run_id")
