"""Nothing is lost or doubled when a checkpoint goes, or a run breaks off between two commits."""

import os
import shutil
from collections import Counter
from datetime import datetime, timezone
from pathlib import Path

import pytest

from weirstone.config import load_config
from weirstone.generators import changes
from weirstone.plans import lakehouse as L
from weirstone.sources.files import Feed, copy_into
from weirstone.storage.table import Table


def lines_of(folder):
    return Counter(line for p in Path(folder).rglob("*.ndjson") for line in p.read_text().splitlines() if line.strip())


def held(run):
    out = Counter()
    for e in run.config.entities:
        if run.table("bronze", e.name).exists():
            out += Counter(r[0] for r in run.read(f"bronze/{e.name}").select("raw_value").collect())
    return out


def test_a_lost_checkpoint(spark, tmp_path):
    run = L.Run(spark, load_config(root=str(tmp_path)), "r1", datetime(2024, 1, 1, tzinfo=timezone.utc))
    landing = run.config.source.cdc_landing_dir
    changes.write_events(changes.generate(120, 1), landing, run="one")
    assert L.run_bronze(run, mode="file")["rows_written"] == 120
    shutil.rmtree(f"{run.config.storage.checkpoints_dir}")
    changes.write_events(changes.generate(30, 2), landing, run="two")
    counts = L.run_bronze(run, mode="file")
    assert counts["rows_read"] == 150 and counts["rows_written"] == 30
    assert held(run) == lines_of(landing)
    changes.write_events(changes.generate(20, 3), landing, run="three")
    assert L.run_bronze(run, mode="file")["rows_written"] == 20
    assert held(run) == lines_of(landing)


def test_a_crash_between_the_rows_and_the_ledger(spark, tmp_path, monkeypatch):
    landing, lake, feeds = tmp_path / "in", str(tmp_path / "lake"), {"d": Feed("csv", "*.csv", {"header": "true"})}
    (landing / "d").mkdir(parents=True)
    (landing / "d" / "a.csv").write_text("id\n1\n2\n")
    append = Table.append

    def broken(self, *args, **kwargs):
        if self.path.endswith("_copy_ledger"):
            raise RuntimeError("gone")
        return append(self, *args, **kwargs)

    monkeypatch.setattr(Table, "append", broken)
    with pytest.raises(RuntimeError):
        copy_into(spark, str(landing), lake, "r1", feeds)
    monkeypatch.setattr(Table, "append", append)
    (landing / "d" / "b.csv").write_text("id\n3\n")
    (landing / "d" / "c.csv").write_text("id\n")
    assert copy_into(spark, str(landing), lake, "r2", feeds) == {"d": 1}
    assert sorted(r[0] for r in Table(spark, f"{lake}/d").read().select("id").collect()) == ["1", "2", "3"]
    ledger = {r["file_path"].rsplit("/", 1)[1]: r["rows_loaded"] for r in Table(spark, f"{lake}/_copy_ledger").read().collect()}
    assert ledger == {"a.csv": 2, "b.csv": 1, "c.csv": 0}
    assert copy_into(spark, str(landing), lake, "r3", feeds) == {"d": 0}


@pytest.mark.parametrize("root", ["in", "in put", "100%20 é"])
@pytest.mark.parametrize("form", ["path", "uri", "relative"])
def test_every_file_loads_once_whatever_its_name(spark, tmp_path, root, form):
    landing, feeds = tmp_path / root, {"d": Feed("csv", "*.csv", {"header": "true"})}
    (landing / "d").mkdir(parents=True)
    names = ["a b.csv", "a%41.csv", "a+b.csv", "ä 日.csv", "plain.csv", "x;y.csv", "c#d.csv", "e?f.csv"]
    for k, name in enumerate(names):
        (landing / "d" / name).write_text(f"id\n{k}\n{k + 100}\n")
    (landing / "d" / "other.txt").write_text("id\n999\n")
    given = {"path": str(landing), "uri": f"file:{landing}", "relative": os.path.relpath(landing, spark._jvm.java.lang.System.getProperty("user.dir"))}[form]
    lake = str(tmp_path / "lake")
    assert copy_into(spark, given, lake, "r1", feeds) == {"d": 2 * len(names)}
    assert copy_into(spark, given, lake, "r2", feeds) == {"d": 0}
    assert copy_into(spark, str(landing), lake, "r3", feeds) == {"d": 0} == copy_into(spark, f"file://{landing}", lake, "r4", feeds)
    (landing / "d" / "late one.csv").write_text("id\n500\n")
    assert copy_into(spark, given, lake, "r5", feeds) == {"d": 1}
    ids = [int(r[0]) for r in Table(spark, f"{lake}/d").read().select("id").collect()]
    assert sorted(ids) == sorted([*range(len(names)), *range(100, 100 + len(names)), 500])
    assert Table(spark, f"{lake}/_copy_ledger").read().where("rows_loaded > 0").count() == len(names) + 1


def test_nothing_has_landed(spark, tmp_path):
    feeds = {"d": Feed("csv", "*.csv", {"header": "true"}), "e": Feed("csv", "*.csv", {"header": "true"})}
    (tmp_path / "in" / "e").mkdir(parents=True)
    assert copy_into(spark, str(tmp_path / "in"), str(tmp_path / "lake"), "r", feeds) == {"d": 0, "e": 0}


def test_an_old_file_that_lands_late(spark, tmp_path):
    feeds = {"d": Feed("csv", "*.csv", {"header": "true"})}
    folder = tmp_path / "in" / "d"
    folder.mkdir(parents=True)
    (folder / "new.csv").write_text("id\n1\n")
    assert copy_into(spark, str(tmp_path / "in"), str(tmp_path / "lake"), "r1", feeds) == {"d": 1}
    (folder / "old.csv").write_text("id\n2\n3\n")
    os.utime(folder / "old.csv", (1_000_000_000, 1_000_000_000))
    assert copy_into(spark, str(tmp_path / "in"), str(tmp_path / "lake"), "r2", feeds) == {"d": 2}


def test_a_crash_between_two_tables_of_a_batch(spark, tmp_path, monkeypatch):
    """What one table has of a batch is not seen before the others have theirs."""
    run = L.Run(spark, load_config(root=str(tmp_path)), "r1", datetime(2024, 1, 1, tzinfo=timezone.utc))
    landing = run.config.source.cdc_landing_dir
    changes.write_events(changes.generate(80, 1), landing, run="one")
    append = Table.append

    def broken(self, *args, **kwargs):
        if self.path.endswith("/transactions"):
            raise RuntimeError("gone")
        return append(self, *args, **kwargs)

    monkeypatch.setattr(Table, "append", broken)
    with pytest.raises(Exception):  # noqa: B017 - the stream wraps it
        L.run_bronze(run, mode="file")
    assert run.table("bronze", "customers").exists()
    group = L.bronze(spark, run.config)
    assert group.latest()["tables"] == {}
    monkeypatch.setattr(Table, "append", append)
    L.run_bronze(run, mode="file")
    assert held(run) == lines_of(landing) and set(group.latest()["tables"]) >= {"customers", "transactions"}


def test_later_batches_read_no_history(spark, tmp_path, monkeypatch):
    """After a lost checkpoint one run compares with what the tables hold; the next ones do not."""
    run = L.Run(spark, load_config(root=str(tmp_path)), "r1", datetime(2024, 1, 1, tzinfo=timezone.utc))
    landing = run.config.source.cdc_landing_dir
    changes.write_events(changes.generate(60, 1), landing, run="one")
    L.run_bronze(run, mode="file")
    shutil.rmtree(f"{run.config.storage.checkpoints_dir}")
    changes.write_events(changes.generate(30, 2), landing, run="two")
    assert L.run_bronze(run, mode="file")["rows_written"] == 30
    changes.write_events(changes.generate(20, 3), landing, run="three")
    read, places = Table.read, []
    monkeypatch.setattr(Table, "read", lambda self, *a: places.append(self.path) or read(self, *a))
    assert L.run_bronze(run, mode="file")["rows_written"] == 20
    assert not [p for p in places if "/bronze/" in p]
    monkeypatch.setattr(Table, "read", read)
    assert held(run) == lines_of(landing)
