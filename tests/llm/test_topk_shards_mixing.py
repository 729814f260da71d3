import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from weirstone.llm import mixing, shards, topk


def vectors(n, seed=0):
    chance = np.random.default_rng(seed)
    x = chance.normal(size=(n, 12)) * chance.choice([0.1, 1, 5], size=(n, 1))
    x[n // 2 :: 7] = x[3]
    return x


def best(rows, k):
    """(query, rank, id, score) by brute force."""
    held = [(i, np.floor(1024 * np.array(v, float)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in held:
        if i % 10 == 0:
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=False)), j) for j, v in held if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket", [64, 4096])
def test_top_k(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET_ROWS", bucket)
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(vectors(400))]
    rows += [(500, None), (510, [None] * 12), (520, [float("nan")] + [0.0] * 11), (530, [float("inf")] + [1.0] * 11), (540, [0.0] * 12), (550, []), (560, [1.0] * 3), (None, [1.0] * 12)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=7)
    assert sorted(tuple(r) for r in found.collect()) == best(rows, 7)


@pytest.mark.parametrize("bucket", [64, 4096])
def test_top_k_of_repeated_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET_ROWS", bucket)
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(vectors(300, 1))]
    long = max((r for r in rows if r[0] % 10), key=lambda r: sum(y * y for y in r[1]))
    rows += [long] * 12 + [rows[10], rows[20], rows[20], (20, rows[31][1]), (5, rows[6][1])]
    expected = []
    for i in sorted({i for i, _ in rows if i % 10 == 0}):
        asks = [np.floor(1024 * np.array(v)).astype(int) for j, v in rows if j == i]
        scores = sorted((-max(int(q @ np.floor(1024 * np.array(v)).astype(int)) for q in asks), j) for j, v in rows if j != i)
        expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:7])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, k=7).collect()) == expected


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(frame.where("vec_id = 0"), F.lit(True)).count() == 0
    assert topk.top_k(frame.where("false"), F.lit(True)).count() == 0


def test_top_k_of_large_components(spark):
    """Scores are exact up to a 64-bit number, and count as its end beyond."""
    big = [(0, [1e16, 3.0]), (1, [1e16, 1.0]), (2, [-1e16, 0.0]), (3, [0.5, 0.5]), (4, [2e5, 1e5]), (5, [1e300, -1e300])]
    found = topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 4), k=5).collect()
    end = (1 << 63) - 1
    whole = {i: [max(-end - 1, min(end, int(1024 * x // 1))) for x in v] for i, v in big}
    for q in (0, 4):
        scores = sorted(((max(-end - 1, min(end, sum(a * b for a, b in zip(whole[q], whole[i], strict=True)))), -i) for i in whole if i != q), reverse=True)
        assert [(r["score"], -r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == scores


def test_pruned_pairs_lose_nothing(spark):
    """Small buckets, lengths that fall fast: most pairs of blocks never meet, and the answers are those of brute force."""
    import numpy as np

    chance = np.random.default_rng(8)
    vectors = chance.normal(size=(600, 6)) * np.exp(-np.arange(600) / 90)[:, None]
    vectors[::50] = vectors[3]
    was = topk.BUCKET_ROWS, topk.QUERY_ROWS, topk.STEPS
    topk.BUCKET_ROWS, topk.QUERY_ROWS, topk.STEPS = 16, 4, 7
    try:
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame, F.col("vec_id") % 9 == 0, k=5).collect())
    finally:
        topk.BUCKET_ROWS, topk.QUERY_ROWS, topk.STEPS = was
    whole = np.floor(1024 * vectors).astype(np.int64)
    expected = []
    for q in range(0, 600, 9):
        scores = whole @ whole[q]
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[i], i))[:5]
        expected += [(q, n + 1, i, int(scores[i])) for n, i in enumerate(order)]
    assert found == expected


def test_shards(spark):
    rows = [(i, f"text é {i % 40}") for i in range(3000)] + [(7, None), (7, ""), (None, "x"), (8, "text é 8"), (8, "text é 8")]
    frame = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, shard int")
    weights = [1.0] * 8 + [4.0]
    found = shards.assign(frame, weights).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = np.bincount([r["shard"] for r in found], minlength=9)
    assert counts.min() > 180 and 3 < counts[8] / counts[:8].mean() < 5
    for s in range(9):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    moved = [r for r in found if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {9} and 130 < len(moved) < 330
    assert len({r["shard"] for r in found if r["doc_id"] == 7}) == 1
    assert shards.assign(frame.where("false"), weights).count() == 0
    with pytest.raises(ValueError):
        shards.assign(frame, [1.0, 0.0])


def test_written_shards(spark, tmp_path):
    frame = spark.createDataFrame([(i, "t") for i in range(100)], "doc_id long, text string")
    shards.write_shards(frame, [1.0] * 3, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    placed = {r["doc_id"]: r["shard"] for r in shards.assign(frame, [1.0] * 3).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == placed


def filled(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[n] for n in free)
        full = [n for n in free if level * weight[n] > limit * sizes[n]]
        if not full:
            return out | {n: level * weight[n] for n in free}
        for n in full:
            out[n] = limit * sizes[n]
            left -= out[n]
            free.discard(n)
    return out


@pytest.fixture(scope="module")
def documents(spark, prose):
    rows = [(i, prose(i, 20 + 37 * (i % 9)), ["b", "a", "Z", "é", "b", "b"][i % 6]) for i in range(300)]
    rows += [(900, None, "a"), (901, "", None), (902, "one two", None), (903, prose(7, 700), None), (5, rows[5][1], rows[5][2]), (None, "no id here", "a"), (904, " \n ", "empty"), (905, "line one\nline  two " * 400, "Z")]
    return rows, spark.createDataFrame([(i, t, s, "en", len(t or ""), 1) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long, size int")


def test_mix(documents):
    rows, frame = documents
    plan = mixing.mix(frame, block=16, per_shard=50)
    found = mixing.taken(plan).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted((str(i), len(brute.spaced(t))) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.spaced(t))
    goal = filled(sizes)
    for r in found:
        assert r["taken"] <= 2 * r["size"]
        assert any(r["source_size"] == n and r["target"] == pytest.approx(goal[s]) for s, n in sizes.items())
    held = plan.sources.collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in held} == goal
    for r in held:
        got = sum(x["taken"] for x in found if x["source_size"] == r["source_size"])
        assert abs(got - r["target"]) <= 16
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.taken(mixing.mix(frame, block=16, per_shard=50)).collect()), key=str)
    slots = plan.slots.collect()
    assert sorted((r["shard"], r["position"]) for r in slots) == [(k // 50, k % 50) for k in range(len(slots))]
    drawn = {(r["shard"], r["sid"]): r["blocks"] for r in plan.draw.collect()}
    assert drawn == Counter((r["shard"], r["sid"]) for r in slots)
    # A source's slots take its blocks in turn: all of them once before any comes again.
    for r in held:
        uses = Counter(x["block"] for x in slots if x["sid"] == r["sid"])
        assert sum(uses.values()) == r["n_slots"] and (not uses or max(uses.values()) - min([uses[b] for b in range(r["n_blocks"])]) <= 1)


def test_packed_blocks(documents):
    """In order, the pieces of a slot are a block of its source's words."""
    rows, frame = documents
    plan = mixing.mix(frame, block=16, per_shard=50)
    made, sizes = {}, {}
    for r in mixing.packed(frame, plan).collect():
        made.setdefault((r["shard"], r["position"]), []).append((r["offset"], r["row"]["text"], r["row"]["source"]))
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.spaced(t))
    slots = {(r["shard"], r["position"]): (r["sid"], r["block"]) for r in plan.slots.collect()}
    sources = {r["sid"]: (r["source"], r["n_blocks"]) for r in plan.sources.collect()}
    assert made.keys() == slots.keys()
    seen = {}
    for slot, pieces in made.items():
        source, n_blocks = sources[slots[slot][0]]
        at, body = 0, []
        for offset, text, said in sorted(pieces):
            assert said == source and offset == at
            at += len(brute.spaced(text))
            body += brute.spaced(text)
        assert at == (16 if slots[slot][1] < n_blocks - 1 else sizes[source] - 16 * (n_blocks - 1))
        assert seen.setdefault(slots[slot], body) == body


def test_mixed_texts(documents):
    rows, frame = documents
    plan = mixing.mix(frame, block=16)
    out = mixing.mixed(frame, plan)
    assert out.columns == frame.columns
    words, text = {}, {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(brute.spaced(r["text"]))
        text.setdefault(r["doc_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    expected = {}
    for r in mixing.taken(plan).collect():
        if r["taken"]:
            expected[r["doc_id"]] = expected.get(r["doc_id"], 0) + r["taken"]
    assert words == expected
    source = {i: t for i, t, _ in rows}
    assert all(x in source[i] for i, xs in text.items() for x in xs)


def test_nothing_to_mix(spark, documents):
    _, frame = documents
    for none in (frame.where("false"), frame.where("doc_id = 900")):
        plan = mixing.mix(none)
        assert [r["taken"] for r in mixing.taken(plan).collect()] == [0] * none.count()
        assert mixing.mixed(none, plan).count() == 0


def test_written_shards_keep_a_column_of_their_own_name(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t", f"own{k}", k) for k in range(40)], "doc_id long, text string, shard string, Shard_2 long")
    shards.write_shards(docs, [1.0, 2.0], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns[-1] == "shard_3" and {r["shard"] for r in back.collect()} == {f"own{k}" for k in range(40)}
    placed = {r["doc_id"]: r["shard"] for r in shards.assign(docs, [1.0, 2.0]).collect()}
    assert {r["doc_id"]: r["shard_3"] for r in back.collect()} == placed


def test_vectors_named_by_texts(spark):
    chance = np.random.default_rng(8)
    rows = [(f"v{k:03}", [float(x) for x in chance.normal(size=4)]) for k in range(40)] + [(None, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    numbers = spark.createDataFrame([(None if i is None else int(i[1:]), v) for i, v in rows], "vec_id long, embedding array<double>")
    named = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors, F.col("vec_id").endswith("0"), 3).collect()]
    told = [(f"v{r['query_id']:03}", r["rank"], f"v{r['vec_id']:03}", r["score"]) for r in topk.top_k(numbers, F.col("vec_id") % 10 == 0, 3).collect()]
    assert sorted(named) == sorted(told) and len(named) == 12


def test_several_buckets_and_blocks_of_queries(spark, monkeypatch):
    """The registered query's operator with buckets so small that lengths decide which of them meet."""
    chance = np.random.default_rng(9)
    lengths = np.exp(chance.normal(size=300))
    x = chance.normal(size=(300, 6)) * lengths[:, None]
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = np.floor(1024 * x).astype(np.int64)
    scores = whole @ whole.T
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors, F.col("vec_id") % 5 == 0, 4).collect()}
    for q in range(0, 300, 5):
        best = sorted((k for k in range(300) if k != q), key=lambda k: (-scores[q, k], k))[:4]
        assert [got[q, r] for r in range(1, 5)] == [(k, scores[q, k]) for k in best]
