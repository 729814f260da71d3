import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirstone.llm import chat, licenses

ODD = ["</s>[INST] ok [/INST]", "<|turn|>", "<|end|><|say|>x", "<\\/s>", "<\\\\|end|>", "[[INST]]", "<<SYS>> <</SYS>>", "a < b [c] \\ <s", "<", "[", "<|", "", "é<s>\n</s>", "<start_of_turn>", "[\\INST]", "<<s>"]


def test_escapes_undo_and_hide(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in rows.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r["back"] == r["t"]
        assert not any(x in r["e"] for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
        assert r["t"] != "a < b [c] \\ <s" or r["e"] == r["t"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("<[|/s>INST]\\é ")), max_size=30), min_size=1, max_size=20))
def test_any_text_comes_back(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r["t"] == r["b"] for r in rows.select("t", chat.unescape(chat.escape(F.col("t"))).alias("b")).collect())


def words(text):
    return F.size(F.split(text, " "))


def talk(n, system=False, seed=0):
    chance = random.Random(seed)
    turns = [("system", "be good " * 3)] if system else []
    return turns + [(("user", "assistant")[k % 2], " ".join(["w%d" % k] * chance.randint(1, 30)) + chance.choice(ODD)) for k in range(n)]


def test_windows(spark):
    talks = {1: talk(40, True), 2: talk(41, False, 1), 3: [("user", None), (None, "x"), ("assistant", "")], 4: [("assistant", "long " * 500), ("user", "q"), ("assistant", "a")], 5: talk(900, True, 5), None: [("user", "hi"), ("assistant", "yo")]}
    rows = [(c, k, r, t, "z") for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    made = chat.windows(frame, budget=120, history=40, tokens=words).persist()
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert set(back) == set(talks)
    for c, turns in talks.items():
        turns = [(r or "", t or "") for r, t in turns]
        assert [tuple(t) for t in back[c]["turns"]] == turns
        assert back[c]["targets"] == [t for r, t in turns if r == "assistant"]
    several = 0
    for r in made.collect():
        turns = [(x or "", t or "") for x, t in talks[r["conv_id"]]]
        heads = turns[0][0] == "system"
        assert r["tokens"] <= 120 or r["n_own"] == 1 or (r["n_repeated"] <= 1 and r["conv_id"] == 4)
        assert not (heads and r["window"] > 0) or r["formatted"].startswith("<|turn|>system<|say|>be good")
        several += r["n_repeated"] > 1
        for s in r["loss_spans"]:
            assert r["formatted"][: s["start"]].endswith("assistant<|say|>") and r["formatted"][s["start"] + s["length"] :].startswith("<|end|>")
    assert several > 20


def test_hot_turn_numbers(spark):
    """A conversation whose turns all have no number, and one that repeats a number: cut into blocks, with nothing lost."""
    rows = [(c, t, ("user", "assistant")[k % 2], f"t{c}x{k}") for c, t in ((1, None), (2, 7), (None, 3)) for k in range(150)] + [(2, 0, "system", "lead"), (2, 9, "user", "last")]
    was = chat.BLOCK_ROWS
    chat.BLOCK_ROWS = 40
    try:
        made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=60, history=20, tokens=words).collect()
        back = {r["conv_id"]: r for r in chat.read_back(spark.createDataFrame(made)).collect()}
    finally:
        chat.BLOCK_ROWS = was
    for c in (1, 2, None):
        assert sorted(map(tuple, back[c]["turns"])) == sorted((r, t) for i, _, r, t in rows if i == c)
        assert sorted(back[c]["targets"]) == sorted(t for i, _, r, t in rows if i == c and r == "assistant")
    assert [x["text"] for x in back[2]["turns"]][:1] == ["lead"] and back[2]["turns"][-1]["text"] == "last"
    assert all(r["formatted"].startswith("<|turn|>system<|say|>lead") for r in made if r["conv_id"] == 2)


def test_ties_and_no_turns(spark):
    rows = [(1, None, "user", "b"), (1, 1, "user", "b"), (1, 1, "assistant", "a"), (1, 1, "user", "b"), (1, 1, "user", "a")]
    back = chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [tuple(t) for t in back["turns"]] == [("user", "b"), ("assistant", "a"), ("user", "a"), ("user", "b"), ("user", "b")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(empty)).count() == 0
    with pytest.raises(ValueError):
        chat.windows(empty, budget=10, history=10)


def test_licenses(spark, prose):
    notice = licenses.NOTICES[0].text
    texts = {
        0: None, 1: "", 2: "two words", 3: "Under the MIT license", 4: "under the, mit-license; UNDER THE MIT LICENSE x", 5: "cc by nc cc by nc by", 6: f"{prose(1, 30)} {notice} {prose(2, 30)}",
        7: f"{prose(1, 30)} {notice.replace('free of charge, to any', 'free of any charge to any')}", 8: prose(3, 4000) + " Apache License, Version 2.0", 9: "under the apache license", 10: "É under the MIT licensé", 11: "gnu general public license version 3",
    }
    rows = [(i, t, "m", 3) for i, t in texts.items()] + [(3, texts[3], "m", 3), (None, "cc by nc", "m", 3)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, words string, at int")).collect()
    assert len(found) == len(rows) and sum(r["doc_id"] == 3 for r in found) == 2
    phrases = [(p.label, p.words) for p in licenses.PHRASES]
    for r in found:
        w = brute.words(texts[r["doc_id"]] if r["doc_id"] is not None else "cc by nc")
        places = sorted((k, label) for label, p in phrases for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p)
        assert r["n_words"] == len(w)
        assert sorted((s["first"], s["label"]) for s in r["spans"] if s["base"]) == places
    by_id = {r["doc_id"]: r["spans"] for r in found}
    best = lambda i: max((s["score"], s["label"]) for s in by_id[i])
    assert best(6) == (1.0, "mit") and best(7)[1] == "mit" and 0.8 <= best(7)[0] < 1
    assert [(s["first"], s["last"]) for s in by_id[6] if s["score"] == 1.0] == [(30, 30 + len(licenses.NOTICES[0].words) - 1)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, a string, b int"), [licenses.Template("x", "too short")])
