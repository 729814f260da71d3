"""The suite language (YAML): one model of a check, and a table of what each kind takes and says."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Literal

import yaml
from pydantic import BaseModel, ConfigDict, model_validator
from pydantic import Field as Limit

SUITES, MART_SUITES = Path(__file__).parent / "suites", Path(__file__).parent / "mart_suites"


@dataclass(frozen=True)
class Kind:
    """The settings that a kind of check needs, those that it may have, and the text in brackets after its name."""

    needs: tuple[str, ...]
    says: Callable[[Check], str]
    may: tuple[str, ...] = field(default=())


#: The kinds' names, settings and texts.
KINDS = {
    "not_null": Kind(("column",), lambda c: c.column),
    "unique": Kind(("columns",), lambda c: ", ".join(c.columns)),
    "accepted_values": Kind(("column", "values"), lambda c: c.column),
    "row_count_between": Kind((), lambda c: f"{c.min_rows}, {'inf' if c.max_rows is None else c.max_rows}", ("min_rows", "max_rows")),
    "freshness": Kind(("column", "max_age_hours"), lambda c: f"{c.column}, {c.max_age_hours:g}h"),
    "referential_integrity": Kind(("column", "ref_table", "ref_column"), lambda c: f"{c.column} -> {c.ref_table}.{c.ref_column}", ("ref_filter",)),
}


class _Part(BaseModel):
    model_config = ConfigDict(extra="forbid", frozen=True)


class Check(_Part):
    """A check of any kind; only the settings of its kind may be given."""

    type: str
    severity: Literal["error", "warn"] = "error"
    column: str | None = None
    columns: list[str] | None = None
    values: list[str] | None = None
    min_rows: int = 0
    max_rows: int | None = None
    max_age_hours: float | None = None
    ref_table: str | None = None
    ref_column: str | None = None
    ref_filter: str | None = None

    @model_validator(mode="after")
    def _as_its_kind_has_it(self) -> Check:
        kind = KINDS.get(self.type)
        if kind is None:
            raise ValueError(f"unknown kind of check: {self.type}")
        if missing := [name for name in kind.needs if getattr(self, name) in (None, [])]:
            raise ValueError(f"{self.type} needs {missing}")
        if stray := self.model_fields_set - {"type", "severity", *kind.needs, *kind.may}:
            raise ValueError(f"{self.type} does not take {sorted(stray)}")
        return self

    def describe(self) -> str:
        return f"{self.type}({KINDS[self.type].says(self)})"


class Suite(_Part):
    table: str
    layer: Literal["bronze", "silver", "gold"]
    filter: str | None = None
    checks: list[Check] = Limit(min_length=1)


def load_suites(folder: str | Path = SUITES) -> list[Suite]:
    return [Suite.model_validate(yaml.safe_load(p.read_text(encoding="utf-8"))) for p in sorted(Path(folder).glob("*.yaml"))]
