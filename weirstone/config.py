"""Settings of a lakehouse: one file, with two overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path
from typing import Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field


class _Part(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Kafka(_Part):
    bootstrap_servers: str = "localhost:19092"
    topic_prefix: str = "banking.cdc"
    starting_offsets: str = "earliest"


class Source(_Part):
    mode: Literal["file", "kafka", "auto"] = "file"
    cdc_landing_dir: str = "data/landing/cdc"
    cdc_pattern: str = "*.ndjson"
    batch_landing_dir: str = "data/landing/batch"
    kafka: Kafka = Field(default_factory=Kafka)


class Storage(_Part):
    lakehouse_root: str = "data/lakehouse"
    checkpoints_dir: str = "data/checkpoints"
    exports_dir: str = "data/exports"
    warehouse_db: Path = Path("data/warehouse")
    run_dir: Path = Path("data/run")
    reports_dir: Path = Path("data/reports")


class Entity(_Part):
    name: str
    primary_key: str
    scd: Literal["type2", "append_only"]


class Spark(_Part):
    driver_memory: str = "3g"
    shuffle_partitions: int = 8
    session_timezone: str = "UTC"


#: The entities of the banking domain.
ENTITIES = [
    Entity(name="customers", primary_key="customer_id", scd="type2"),
    Entity(name="accounts", primary_key="account_id", scd="type2"),
    Entity(name="transactions", primary_key="transaction_id", scd="append_only"),
    Entity(name="loan_applications", primary_key="application_id", scd="type2"),
]


class Config(_Part):
    source: Source = Field(default_factory=Source)
    storage: Storage = Field(default_factory=Storage)
    entities: list[Entity] = Field(default_factory=lambda: list(ENTITIES))
    spark: Spark = Field(default_factory=Spark)

    def table(self, layer: str, name: str) -> str:
        return f"{self.storage.lakehouse_root}/{layer}/{name}"

    def entity(self, name: str) -> Entity:
        return next(e for e in self.entities if e.name == name)

    def rooted(self, root: Path) -> Config:
        """Relative paths taken from ``root``. Tables and landing folders are strings, since they may be URIs of any store."""

        def at(value: object) -> object:
            if isinstance(value, Path):
                return root / value
            return value if "://" in str(value) or str(value).startswith("/") else str(root / str(value))

        folders = lambda part: {k: at(v) for k, v in part if k.endswith(("_dir", "_root", "_db"))}
        under = lambda part: part.model_copy(update=folders(part))
        return self.model_copy(update={"source": under(self.source), "storage": under(self.storage)})


def load_config(path: str | Path | None = None, *, root: str | Path | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """Read ``path`` (defaults without one); ``LAKEHOUSE_SOURCE_MODE`` and ``LAKEHOUSE_ROOT`` win over it."""
    environ = os.environ if environ is None else environ
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) if path else {}
    config = Config.model_validate(raw or {})
    config = config.rooted(Path(root) if root else Path.cwd())
    if mode := environ.get("LAKEHOUSE_SOURCE_MODE"):
        config = Config.model_validate(config.model_dump() | {"source": config.source.model_dump() | {"mode": mode}})
    if lake := environ.get("LAKEHOUSE_ROOT"):
        config = config.model_copy(update={"storage": config.storage.model_copy(update={"lakehouse_root": lake if "://" in lake else str(Path(lake).absolute())})})
    return config
