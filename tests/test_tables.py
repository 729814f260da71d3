"""Tables laid out by buckets, groups of tables, gathered folders, and what vacuum leaves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from weirstone.storage import table as module
from weirstone.storage.table import CommitConflict, Group, Layout, Table


def files_of(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_merge_rewrites_only_buckets_with_source_keys(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    t.overwrite(rows, layout=Layout(("k",), 400))
    before, version = set(t.latest().snapshots), t.latest().number
    few = rows.where("k % 5000 = 7").withColumn("v", F.lit("new"))
    assert t.merge(few, ["k"], ["v"]) == 4
    after = t.latest()
    assert len(before) == 400 and len(before - set(after.snapshots)) <= 4 and len(after.added) <= 4
    assert t.read().where("v = 'new'").count() == 4 and t.read().count() == 20_000 and t.read(version).where("v = 'new'").count() == 0
    # The plan reads no other bucket.
    inside, outside = t._touched(few, after, after.layout)
    assert len(inside) <= 4 and len(outside) >= 396


def test_keys_of_another_type_and_null_keys(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.merge(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string"), ["k"], ["v"], buckets=4)
    assert t.merge(spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string"), ["k"], ["v"]) == 3
    assert sorted(map(str, held(t.read()))) == sorted(map(str, [(1, "a"), (2, "B"), (3, "C"), (None, "n"), (None, "N")]))
    assert t.latest().layout == Layout(("k",), 4)


def test_other_keys_lay_the_table_out_anew(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.append(spark.createDataFrame([(1, 10), (2, 20)], "k int, m int"))
    t.merge(spark.createDataFrame([(2, 21)], "k int, m int"), ["k"], ["m"], buckets=3)
    t.append(spark.createDataFrame([(5, 50)], "k int, m int"))  # by bucket as well
    assert all("/_bucket=" in s for s in t.latest().snapshots)
    t.merge(spark.createDataFrame([(7, 50)], "k int, m int"), ["m"], ["k"], buckets=2)
    assert t.latest().layout == Layout(("m",), 2) and held(t.read()) == [(1, 10), (2, 21), (7, 50)]


def test_merge_absent_by_bucket(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    assert t.merge_absent(spark.range(50).selectExpr("id as k", "1 as run"), ["k"]) == 50
    assert t.merge_absent(spark.range(40, 60).selectExpr("id as k", "2 as run"), ["k"]) == 20
    assert t.merge_absent(spark.range(0).selectExpr("id as k", "3 as run"), ["k"]) == 0
    assert held(t.read().groupBy("run").count()) == [(1, 50), (2, 10)]


def test_an_empty_merge_and_a_rival(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    none = spark.createDataFrame([], "k int, v string")
    assert t.merge(none, ["k"], ["v"]) == 0 and held(t.read()) == []
    source = spark.createDataFrame([(1, "x")], "k int, v string")
    write = Table._write

    def slow(self, *args, **kwargs):
        made = write(self, *args, **kwargs)
        if self is t:
            Table(spark, t.path).append(source)
        return made

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Table, "_write", slow)
        with pytest.raises(CommitConflict):
            t.merge(source, ["k"], ["v"])
    assert held(t.read()) == [(1, "x")]


def test_vacuum_leaves_what_a_writer_has_not_committed_yet(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    rows = spark.createDataFrame([(1,)], "k int")
    t.append(rows)
    t.overwrite(rows)
    flying = t._write(rows)
    assert t.vacuum() == []
    assert len(t.vacuum(unlisted_s=0)) == 2 and not (tmp_path / "t" / flying[0]).exists()
    assert t.read().count() == 1


def test_folders_are_gathered_by_level(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    for k in range(9):
        t.append(spark.createDataFrame([(k,)], "k int"), mark=("q", k))
        t.gather(most=3)
    assert [s.split("-")[0] for s in t.latest().snapshots] == ["snap=2"]
    assert held(t.read()) == [(k,) for k in range(9)] and t.read_added().count() == 0 and t.seen(("q", 8))
    assert not t.gather(most=3)


def test_a_rival_commit_of_the_same_mark_adds_nothing(spark, tmp_path, monkeypatch):
    t, rows = Table(spark, f"{tmp_path}/t"), spark.createDataFrame([(1,)], "k int")
    monkeypatch.setattr(Table, "seen", lambda self, mark: False)  # both writers looked before either committed
    assert t.append(rows, mark=("q", 0)) and t.append(rows, mark=("q", 0)) is None
    assert t.read().count() == 1


def test_old_manifests_and_claims_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "KEPT_VERSIONS", 4)
    monkeypatch.setattr(module, "PRUNE_EVERY", 2)
    log = Group(spark, f"{tmp_path}/g")
    for k in range(12):
        log.publish({"a": k + 1})
    names = sorted(os.listdir(tmp_path / "g" / "_log"))
    assert log.latest()["tables"] == {"a": 12} and len([n for n in names if n[0] == "0"]) <= 2 * 6
    assert json.loads((tmp_path / "g" / "_log" / f"{12:012d}.json").read_text())["tables"] == {"a": 12}


def test_a_group_shows_tables_together(spark, tmp_path):
    g, rows = Group(spark, f"{tmp_path}/g"), spark.createDataFrame([(1,)], "k int")
    for name in ("a", "b"):
        g.table(name).append(rows)
    g.publish({"a": 1, "b": 1}, ("q", 0))
    g.table("a").append(rows)
    assert g.read("a").count() == 1 and g.table("a").read().count() == 2
    g.publish({"a": 2}, ("q", 1))
    assert g.read("a").count() == 2 and g.read("b").count() == 1 and g.seen(("q", 1)) and not g.seen(("r", 0))
    g.table("c").append(rows)
    assert g.read("c").count() == 1 and g.holds("c") and not g.holds("d")
