"""What contracts and grants say, as tables, SQL and Markdown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.contracts import Contract, latest_contracts

GRANTS = Path(__file__).parent / "grants.yaml"
SCHEMA = "silver.banking"
NONE = "—"


def load_grants(path: str | Path = GRANTS) -> dict[str, Any]:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def pii_rows(contracts: Mapping[str, Contract] | None = None) -> list[tuple[str, int, str, str]]:
    held = contracts or latest_contracts()
    return [(name, held[name].version, f.name, f.pii_category or "") for name in sorted(held) for f in held[name].pii_fields]


def pii_inventory(spark: SparkSession, contracts: Mapping[str, Contract] | None = None) -> DataFrame:
    return spark.createDataFrame(pii_rows(contracts), "table_name string, version int, column_name string, category string")


def pii_tag_sql(contracts: Mapping[str, Contract] | None = None, schema: str = SCHEMA) -> str:
    """A statement by PII field, the tables in order of name."""
    held, out = contracts or latest_contracts(), []
    for name in sorted(held):
        out.append(f"-- {name} (contract v{held[name].version})")
        out += [f"ALTER TABLE {schema}.{name} ALTER COLUMN {f.name} SET TAGS ('pii' = 'true', 'pii_category' = '{f.pii_category}');" for f in held[name].pii_fields]
        out.append("")
    return "\n".join(out)


def privileges_by_principal(who: DataFrame, held: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``who`` (principal, kind) with a column by securable: the privileges shown, USE if there are only those, a dash for none.

    ``held``: principal, securable, privileges (an array). Several rows of a cell are taken together.
    """
    cells = held.groupBy("principal").pivot("securable", list(columns)).agg(F.array_distinct(F.flatten(F.collect_list("privileges"))).alias("all"))
    shown = lambda c: F.array_join(F.filter(F.col(f"`{c}`"), lambda p: ~p.startswith("USE_")), ", ")
    cell = lambda c: F.when(F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0)) <= 0, NONE).when(shown(c) == "", "USE").otherwise(shown(c)).alias(c)
    return who.join(cells, "principal", "left").select("principal", "kind", *(cell(c) for c in columns))


def access_matrix(spark: SparkSession, grants: Mapping[str, Any] | None = None) -> DataFrame:
    """Principals by securable, from the grants file."""
    grants = grants or load_grants()
    who = spark.createDataFrame([(p["name"], p["kind"]) for p in grants["principals"]], "principal string, kind string")
    held = spark.createDataFrame([(g["principal"], g["securable"].partition("/")[2], g["privileges"]) for g in grants["grants"]], "principal string, securable string, privileges array<string>")
    return privileges_by_principal(who, held, sorted({g["securable"].partition("/")[2] for g in grants["grants"]})).orderBy("principal")


def pii_in_rows(rows: DataFrame, tagged: Mapping[str, str]) -> DataFrame:
    """(column_name, category, filled, distinct_values) of a table's tagged columns: what an inventory says of the data itself."""
    cells = F.array(*(F.struct(F.lit(name).alias("column_name"), F.lit(category).alias("category"), F.col(name).cast("string").alias("value")) for name, category in tagged.items()))
    per_value = rows.select(F.inline(cells)).groupBy("column_name", "category", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy("column_name", "category").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"), F.count("value").alias("distinct_values"))


def render_access_matrix(spark: SparkSession, grants: Mapping[str, Any] | None = None) -> str:
    """The matrix and the PII inventory in Markdown."""
    row = lambda cells: "| " + " | ".join(cells) + " |"
    matrix = access_matrix(spark, grants)
    names = matrix.columns[2:]
    lines = ["# Access Matrix", "", row(["Principal", "Kind", *names]), "|---" * (2 + len(names)) + "|", *(row(list(r)) for r in matrix.collect())]
    lines += ["", "PII inventory:", "", row(["Table", "Column", "Category"]), "|---|---|---|", *(row([t, c, k]) for t, _, c, k in pii_rows()), ""]
    return "\n".join(lines)
