"""The near-dedup stage against brute force on five-word shingles at 0.8."""

import random

import brute

import corpus_pipeline


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def staged(spark, rows):
    docs = frame(spark, rows)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def edited(text, seed, n):
    w = text.split(" ")
    for i in random.Random(seed).sample(range(2, len(w) - 2, 9), n):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


def test_five_words(spark, prose):
    docs = [(1, prose(1, 100)), (2, prose(1, 100) + " " + prose(2, 22)), (3, " ".join(prose(1, 100).split(" ")[:81])), (10, prose(3, 200)), (11, edited(prose(3, 200), 1, 5))]
    docs += [(100 + k, prose(4, 150) + " " + prose(50 + k, 30 + k)) for k in range(12)] + [(200 + k, edited(prose(5, 250), k, 1 + k % 6)) for k in range(24)]
    near, tight = brute.components(docs, 80, 5), brute.components(docs)
    assert near[2][1] == 1 != tight[2][1] and near[11][1] == 11 != tight[11][1]
    assert staged(spark, docs) == sorted([(i, t) for i, t in docs if near[i][1] == i], key=str)


def test_rows_without_an_id_and_ids_with_two_texts(spark, prose):
    a, b, c, d, e = (prose(70 + k, 60) for k in range(5))
    alone = [(None, a), (None, a + " more"), (None, a), (None, a.replace(" ", "\t"))]
    wordless = [(None, None), (None, None), (None, ""), (4, " "), (5, None), (5, None)]
    rows = [*alone, *wordless, (7, b), (None, b), (None, b + " more"), (8, c), (8, d), (8, d), (9, c + " more"), (10, d + " more"), (3, e + " more"), (8, e)]
    out = staged(spark, rows)
    assert sum(x in set(alone) for x in out) == 1
    assert [x for x in out if x not in set(alone)] == sorted([*wordless[:5], (7, b), (8, c), (8, d), (3, e + " more")], key=str)


def test_no_rows(spark):
    assert staged(spark, []) == []
