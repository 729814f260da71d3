import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirstone.llm import quality


def spoilt(text, kind):
    w = text.split(" ")
    return [" ".join(x + "***" for x in w), " ".join(x.upper() + "!!" for x in w), " ".join(x for x in w[: len(w) // 8 + 1] for _ in range(9)), " | ".join(w)][kind % 4]


@pytest.fixture(scope="module")
def corpus(spark, prose):
    chance, rows, labels = random.Random(4), [], []
    for i in range(1200):
        good = chance.random() < 0.8
        text = prose(i, chance.randint(15, 150))
        rows.append((i, text if good else spoilt(text, i), "src", 1))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(5000, None, "s", 1), (5001, "", "s", 1), (None, "no id", "s", 1), (5002, "w " * 60_000, "s", 1), (3, rows[3][1], "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (9, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int"), {i: q for i, q, _ in labels}


def test_held_out_rows_are_told_apart(spark, corpus):
    docs, labels, truth = corpus
    model = quality.train(docs, labels)
    assert 0.6 < model.prior < 0.95
    found = quality.score(docs, model).select("row.doc_id", "score", "predicted", quality.held_out(F.col("row.doc_id")).alias("out")).collect()
    assert len(found) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert all(r["out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    fresh = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["out"] and r["doc_id"] in truth]
    assert len(fresh) > 80 and np.mean([a == b for a, b in fresh]) > 0.95
    again = quality.train(docs.repartition(3), labels)
    assert np.allclose(again.weights, model.weights, atol=1e-4)


def test_labels_of_held_out_rows_do_not_count(spark, corpus):
    docs, labels, _ = corpus
    model = quality.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.train(docs, flipped).weights, model.weights, atol=1e-4)


def test_without_labels_all_documents_stay(spark, corpus):
    docs, labels, _ = corpus
    model = quality.train(docs, labels.where("false"))
    assert {r["predicted"] for r in quality.score(docs, model).collect()} == {1}
    assert quality.score(docs.where("false"), model).count() == 0
    assert quality.train(docs.where("false"), labels).prior == 0.5


def test_features_are_of_the_whole_text():
    x = quality.features(pa.array(["", None, "abc", "a a a a", "AB|", "x " * 50_000 + "!!!!"], pa.string()))
    assert x.shape == (6, quality.N_FEATURES) and np.isfinite(x).all()
    assert (x[0] == 0).all() and (x[1] == 0).all()
    assert x[3][len(quality.KINDS) + 2] == 0.75
    assert x[5][6] == pytest.approx(4 / 100_004)
    assert x[2][quality.N_SHAPES :].sum() == 1 and x[5][quality.N_SHAPES :].max() == pytest.approx(0.5, abs=0.01)


def test_the_prior_is_estimated():
    chance = np.random.default_rng(0)
    p = chance.normal(2, 1, (2000, 3))
    u = np.concatenate([chance.normal(2, 1, (1400, 3)), chance.normal(-2, 1, (600, 3))])
    chance.shuffle(u)
    assert quality.estimate_prior(p, u) == pytest.approx(0.7, abs=0.06)


@pytest.mark.parametrize("texts", ["one", "many"])
def test_an_id_with_many_rows_adds_nothing_to_the_draw(spark, prose, monkeypatch, texts):
    """One trusted id has nearly all rows: what reaches the driver stays in its bound, and both kinds are drawn."""
    hot = spark.range(20_000).select(F.lit("a-1").alias("doc_id"), F.lit(prose(1, 30)) if texts == "one" else F.concat(F.lit(prose(1, 30) + " w"), F.col("id").cast("string")))
    rest = spark.createDataFrame([(f"b-{k}", prose(k, 30) if k % 2 else spoilt(prose(k, 30), k)) for k in range(400)], "doc_id string, text string")
    docs = hot.toDF("doc_id", "text").union(rest)
    labels = spark.createDataFrame([("a-1", 1)] + [(f"b-{k}", k % 2) for k in range(0, 60)], "doc_id string, quality int")
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda p, u: seen.update(p=len(p), u=len(u)) or real(p, u))
    model = quality.train(docs, labels, sample_rows=100)
    assert 0 < seen["p"] <= 150 and 50 <= seen["u"] <= 150
    found = quality.score(docs.dropDuplicates(["doc_id"]), model, carry=["doc_id"]).count()
    assert found == 401


real = quality.fit
