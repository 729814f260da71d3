import random

import brute
import numpy as np
import pytest

from weirstone.llm import decontam, neardup
from weirstone.llm.components import connected_components


#: As the query has it.
TIGHT = {"shingle": 3, "threshold": 85, "bands": 10}


def loud(text):
    return "".join(x.upper() if x.isascii() else x for x in text)


def edited(text, seed, n):
    chance, w = random.Random(seed), text.split(" ")
    for i in chance.sample(range(len(w)), n):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


def test_near_duplicates(spark, prose):
    base, chain = prose(1, 120), prose(2, 200)
    docs = [(10, base), (11, base), (12, loud(base).replace(" ", "\t\n")), (13, None), (14, ""), (15, " \n "), (16, "two words"), (17, "Two  words"), (18, "two word"), (19, prose(3, 6000)), (20, "solo")]
    docs += [(30 + k, edited(base, k, k)) for k in range(1, 9)]  # from nearly equal to apart
    docs += [(50 + k, edited(edited(chain, 1, 3), k, 2)) for k in range(12)] + [(5, chain)]
    docs += [(100 + k, edited(base, 100 + k, 2 + k % 5)) for k in range(60)]
    docs += [(200 + k, prose(50 + k, 40)) for k in range(30)]
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, node string, key int, n_shingles int")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame, **TIGHT).collect()}
    assert found == brute.components(docs)
    assert len({c for _, c in found.values()}) < len(docs) - 40


def test_near_duplicates_of_odd_rows(spark, prose):
    text = prose(1, 50)
    rows = [(None, text), (7, text), (7, text), (7, prose(2, 50)), (None, prose(3, 50)), (None, None), (8, None)]
    found = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **TIGHT).collect()), key=repr)
    assert found == sorted([(None, 48, 7, False), (7, 48, 7, True), (7, 48, 7, True), (7, 48, 7, True), (None, 48, None, False), (None, 0, None, False), (8, 0, 8, True)], key=repr)


def test_near_duplicates_of_an_id_with_two_texts(spark, prose):
    """Whichever text of an id comes first, a near-copy of either is linked with it."""
    pairs = [(prose(100 + k, 60), prose(200 + k, 60)) for k in range(20)]
    rows = [row for k, (x, y) in enumerate(pairs) for row in ((k, x), (k, y), (1000 + k, x + " more"), (2000 + k, y + " more"))]
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **TIGHT).collect()}
    assert found == {i: (i % 1000, i < 1000) for i, _ in rows}


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert neardup.near_duplicates(empty).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_matches(empty, items).count() == 0


def test_overlaps():
    chance = np.random.default_rng(1)
    sets = [np.unique(chance.integers(0, 300, chance.integers(1, 120)).astype(np.int64)) for _ in range(40)]
    expected = [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]]
    assert neardup._overlaps(sets[:20], sets[20:]).tolist() == expected


def test_blocks_of_many_short_texts_take_little_memory():
    """Two blocks of the most texts that a task holds: some hundreds, here 2,000 of mostly the same words."""
    import tracemalloc

    chance = np.random.default_rng(2)
    blocks = []
    for k in range(2):
        sets = [np.unique(np.append(np.arange(25), chance.integers(100, 160, 3))).astype(np.int64) for _ in range(2000)]
        blocks.append((np.arange(2000) + k * 2000, np.arange(2000) + k * 2000, sets))
    tracemalloc.start()
    a, b = neardup.links(85, *blocks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    sample = {(x, y) for x in range(40) for y in range(2000) for both in [len(np.intersect1d(blocks[0][2][x], blocks[1][2][y]))] if 100 * both >= 85 * (len(blocks[0][2][x]) + len(blocks[1][2][y]) - both)}
    assert {(x, y - 2000) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < 40} == sample and sample


def test_loose_cluster(spark):
    """Texts that share most words, of several sizes, of which only some are linked: in small blocks, against brute force."""
    chance = random.Random(5)
    docs = []
    for k in range(260):
        body = [f"w{x}" for x in range(20 + 3 * (k % 4))] + [f"u{chance.randrange(9)}" for _ in range(chance.choice([1, 4, 6]))]
        docs.append((k, " ".join(body)))
    was = neardup.BLOCK_TEXTS
    neardup.BLOCK_TEXTS = 16
    try:
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **TIGHT).collect()}
    finally:
        neardup.BLOCK_TEXTS = was
    assert found == brute.components(docs)


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1), *((k, k + 1) for k in range(100, 140))]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7} | {k: 100 for k in range(100, 141)}


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_matches(spark, prose, block_bytes):
    items = [(1, prose(1, 25)), (2, prose(2, 10)), (3, "Short ITEM"), (4, None), (5, "..."), (6, prose(1, 25)), (12, prose(3, 12)), (13, "one")]
    one = prose(1, 25).split(" ")
    texts = [
        None, "", "...", prose(9, 80), prose(9, 30) + ". " + loud(prose(1, 25)) + "! " + prose(8, 30), " ".join(one[:10]), " ".join(one[:9]), " ".join(one[3:15] + one[3:15]), "a short, item b", "short short item item",
        prose(2, 10) + " " + prose(3, 12), " ".join([prose(7, 3000), prose(2, 10), prose(6, 3000)]), prose(2, 9), "one", "One one-one", prose(9, 80),
    ]
    docs = spark.createDataFrame([(i, t, "r", "s", i) for i, t in enumerate(texts)] + [(0, None, "r", "s", 0)], "doc_id long, text string, row string, spans string, n_hit long")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_matches(docs, benchmark, block_bytes=block_bytes).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute.contamination(texts[r["row"]["doc_id"]], items), texts[r["row"]["doc_id"]]
        w = brute.words(texts[r["row"]["doc_id"]])
        said = dict((str(i), [brute.words(t) for j, t in items if j == i]) for i, _ in items)
        for x in r["spans"]:
            own = w[x["start"] : x["start"] + x["length"]]
            assert any(own == v[x["item_start"] : x["item_start"] + x["length"]] for v in said[x["item"]])
            # As long as it gets, in both directions.
            for v in said[x["item"]]:
                if own == v[x["item_start"] : x["item_start"] + x["length"]]:
                    after, item_after = x["start"] + x["length"], x["item_start"] + x["length"]
                    assert after == len(w) or item_after == len(v) or w[after] != v[item_after]
                    assert x["start"] == 0 or x["item_start"] == 0 or w[x["start"] - 1] != v[x["item_start"] - 1]
    longest = max(s["length"] for r in found if r["row"]["doc_id"] == 4 for s in r["spans"])
    assert longest == 25
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([i for i, t in enumerate(texts) if not brute.contamination(t, items)[1]] + [0])


def test_suffix_array():
    chance = np.random.default_rng(4)
    code = np.concatenate([chance.integers(1, 4, 300), np.tile([1, 2, 3, 1], 40), [5]])
    order = decontam.suffix_array(code, 5, len(code))[0]
    assert order.tolist() == sorted(range(len(code)), key=lambda k: code[k:].tolist())


def test_a_passage_that_many_items_share_stays_linear(prose):
    """300 items of one passage, a text that repeats it: as many spans as places, and a broadcast within its bound."""
    import pickle

    import pyarrow as pa

    passage = prose(1, 30)
    items = [(str(k), f"own{k} {passage} end{k}") for k in range(300)]
    tests = decontam.Suffixes(items, 10)
    n_words, n_hit, spans, found = decontam.matches(pa.array([" ".join([passage] * 300), passage, "x"]), [tests], tests.longest)
    assert n_words.tolist() == n_hit.tolist()[:2] + [1] and n_hit.tolist() == [9000, 30, 0]
    assert [len(x) for x in spans.to_pylist()][1:] == [1, 0] and len(spans[0]) <= 600
    assert [len(x) for x in found.to_pylist()] == [300, 300, 0]
    many = [(str(k), prose(1000 + k, 150)) for k in range(2000)]
    assert len(pickle.dumps(decontam.Suffixes(many, 10))) < 4 * sum(len(t.encode()) for _, t in many)


def test_items_without_an_id(spark, prose):
    items = spark.createDataFrame([(None, prose(1, 12)), ("", prose(2, 12)), (None, prose(3, 12))], "item_id string, text string")
    docs = spark.createDataFrame([(1, prose(1, 12) + " " + prose(2, 12) + " " + prose(3, 12), "x")], ["doc_id", "text", "meta.lang"])
    row = decontam.find_matches(docs, items).first()
    assert row["items"] == ["", None] and row["n_hit"] == 36


def test_many_blocks_are_one_pass(spark, prose, monkeypatch):
    """Twenty blocks of benchmark: one node of the plan, the same rows as of one block, and no spans unless asked for."""
    items = [(k, prose(k, 14)) for k in range(20)] + [(7, prose(3, 14))]
    texts = [" ".join([prose(500 + k, 20), prose(k % 20, 14), prose((k + 5) % 20, 14)]) for k in range(25)] + [prose(900, 40), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    many = decontam.find_matches(docs, benchmark, block_bytes=80)
    assert len(list(decontam.blocks_of(benchmark, "item_id", "text", 80))) >= 20
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    one = decontam.find_matches(docs, benchmark)
    spread = lambda df: sorted((r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"], sorted(map(tuple, r["spans"]))) for r in df.collect())
    got = spread(many)
    assert [x[:4] for x in got] == [x[:4] for x in spread(one)]
    assert [x[1:4] for x in got] == [brute.contamination(t, items) for t in texts]
    plain = decontam.find_matches(docs, benchmark, block_bytes=80, with_spans=False)
    assert plain.columns == ["row", "n_words", "n_hit", "items"] and sorted(tuple(r)[1:] for r in plain.collect()) == sorted((x[1], x[2], x[3]) for x in got)


def test_windows_of_different_items_are_of_different_classes(prose):
    items = [("a", prose(1, 10)), ("b", prose(1, 10)), ("c", prose(2, 10)), ("b", prose(2, 10)), ("a", prose(3, 10))]
    tests = decontam.Suffixes(items, 10)
    ends = np.cumsum(tests.kind_count)
    sets = [sorted(tests.names.to_pylist()[k] for k in tests.kind_names[end - n : end]) for end, n in zip(ends, tests.kind_count, strict=True)]
    assert sorted(sets) == [["a"], ["a", "b"], ["b", "c"]] and sorted(tests.kind.tolist()) == [0, 1, 2]


def test_ids_that_are_no_numbers(spark, prose):
    from weirstone.llm import neardup

    base = prose(1, 60)
    rows = [("b-9", base), ("b-10", base + " end"), ("a", prose(2, 40)), (None, base), ("z", None), ("a", prose(3, 40)), ("c", prose(2, 40))]
    docs = spark.createDataFrame([(t, i, "own") for i, t in rows], "text string, doc_id string, _named string")
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert found == sorted([("b-9", "b-10", False), ("b-10", "b-10", True), ("a", "a", True), (None, "b-10", False), ("z", "z", True), ("a", "a", True), ("c", "a", False)], key=str)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([("a", prose(2, 40)), ("a", prose(3, 40)), ("b-10", base + " end"), ("z", None)], key=str)
