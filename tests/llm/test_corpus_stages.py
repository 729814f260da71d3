"""The corpus pipeline, stage by stage, against brute force on a small table."""

import brute
import pytest

import corpus_pipeline
from weirstone.llm import quality
from weirstone.llm.queries import table


@pytest.fixture(scope="module")
def sf_dir(spark, prose, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    item = prose(999, 20)
    docs = [(i, prose(i, 30 + i % 50), "en", f"src{i % 3}") for i in range(120)]
    docs += [(200 + i, " ".join(x + "***" for x in prose(i, 60).split(" ")), "en", "src0") for i in range(30)]
    docs += [(300, docs[4][1], "en", "src1"), (301, docs[4][1] + " more", "en", "src1"), (302, prose(302, 30) + " " + item, "en", None), (303, None, None, None), (5, docs[5][1], "en", "src2")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(0, 120, 2), *range(200, 230, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf_dir, tmp_path):
    docs, item = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").first()["text"]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()] if "text" in docs.columns else None
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality":
            accepted = quality.score(before, quality.train(before, table(spark, sf_dir, "labels"))).where("predicted = 1")
            assert sorted(map(str, kept[name])) == sorted(str((r["doc_id"], r["text"])) for r in accepted.select("row.*").collect())
            assert not any(i and 200 <= i < 230 for i, _ in kept[name])
    rows = [(i, t) for i, t in kept["quality"]]
    unique = list({i: (i, t) for i, t in rows}.values())
    smallest = brute.components(unique)
    assert sorted(kept["near_duplicates"], key=str) == sorted([(i, t) for i, t in unique if smallest[i][1] == i], key=str)
    assert sorted(kept["decontamination"], key=str) == sorted([(i, t) for i, t in kept["near_duplicates"] if not brute.contamination(t, [(1, item)])[1]], key=str)
    assert {i for i, _ in kept["mixing"]} <= {i for i, _ in kept["decontamination"]} and len(kept["mixing"]) > 100
    assert {r["doc_id"] for r in docs.collect()} == {i for i, t in kept["mixing"] if t}


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r["slot"] for r in found.collect()) == list(range(found.count()))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_shards"]


@pytest.fixture(scope="module")
def odd_dir(spark, prose, tmp_path_factory):
    """Columns with names that the operators use themselves, nulls in all columns, a very long text, repeated rows."""
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, prose(i, 40), "en", f"src{i % 2}", "x", 7, 0.5) for i in range(60)]
    rows += [(100, prose(100, 90_000), "en", None, None, None, None), (None,) * 7, (None, prose(101, 40), None, None, "y", 1, 0.1), (102, "", "en", "src0", "z", 2, 0.2), (3, rows[3][1], "en", "src1", "x", 7, 0.5)]
    named = "doc_id long, text string, lang string, source string, `meta.lang` string, row int, score double"
    spark.createDataFrame(rows, named).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(5, 40)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("stage", dict(corpus_pipeline.STAGES))
def test_odd_rows_and_names(spark, prose, odd_dir, stage):
    docs = table(spark, odd_dir, "documents")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, odd_dir)
    found = out.collect()
    ids = [r["doc_id"] for r in found]
    if stage == "token_shards":
        assert {*ids} == {*range(60), 100, None} and {r["slot"] for r in found} == set(range(len(found)))
        return
    assert out.columns == docs.columns
    same = {tuple(r) for r in docs.collect()}
    if stage != "mixing":
        # Rows come out whole, whatever else their columns are called.
        assert {tuple(r) for r in found} <= same
    if stage == "near_duplicates":
        assert sorted(map(str, ids)) == sorted(map(str, [*range(60), 100, 102, None, None]))
    if stage == "decontamination":
        assert sorted(map(str, ids)) == sorted(map(str, [*(i for i in range(60) if i != 5), 3, 100, 102, None, None]))
    if stage == "mixing":
        words = [(r["doc_id"], len(brute.spaced(r["text"]))) for r in found]
        assert all(n for _, n in words) and sum(n for i, n in words if i == 100) <= 2 * 90_000
        assert {(r["doc_id"], r["meta.lang"], r["row"], r["score"]) for r in found} <= {(r[0], *r[4:]) for r in same}


@pytest.mark.parametrize("stage", dict(corpus_pipeline.STAGES))
def test_no_documents(spark, odd_dir, stage):
    docs = table(spark, odd_dir, "documents").where("false")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, odd_dir)
    assert out.collect() == [] and (stage == "token_shards" or out.columns == docs.columns)
