"""Registered queries, on the smallest tables, against plain Python over the same rows."""

import math
import os
import struct
import zlib

import brute
import duckdb
import numpy as np
import pytest
import xxhash

from weirstone.llm import licenses, queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in queries.table(spark, SF, "documents").collect()}


def test_op1(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    talks = {}
    for c, t, r, x in sorted([*rows, (-1, 0, "user", odd), (-1, 1, "assistant", odd)], key=lambda x: x[:2]):
        talks.setdefault(c, []).append((r or "", x or ""))
    found = {r["conv_id"]: r for r in queries.op1_chat_format(spark, SF).collect()}
    assert found.keys() == talks.keys()
    for c, turns in talks.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert tuple(found[c])[1:5] == (len(turns), brute.sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), brute.sha(loss))
        assert found[c]["formatted_chars"] >= sum(len(x) for _, x in turns)


def test_op2(spark, documents):
    for r in queries.op2_license_scan(spark, SF).collect():
        w = brute.words(documents[r["doc_id"]]["text"])
        places = [(i, p.label) for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.words)] == p.words]
        at, labels = [i for i, _ in places], sorted({x for _, x in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    ran = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(found.columns)
    said = lambda x: repr(round(x, 9)) if isinstance(x, float) else str(x)
    expected = sorted(tuple(said(r[names.index(c)]) for c in found.columns) for r in ran.fetchall())
    assert sorted(tuple(map(said, r)) for r in found.collect()) == expected


def hashed(*values):
    """The hash of several columns: the seed of each is the hash of those before it."""
    seed = 42
    for x in values:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<i" if isinstance(x, np.int32) else "<q", x), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def heaviest(doc_id, n):
    name = signed(hashed(str(doc_id), np.int32(0)))
    scores = [1 / -math.log(((hashed(name, np.int32(i)) >> 11) + 0.5) / (1 << 53)) for i in range(n)]
    return scores.index(max(scores))


def test_op4_shards_and_slots(spark, documents):
    rows = {r["doc_id"]: r for r in queries.op4_rendezvous_shards(spark, SF).collect()}
    shards = {}
    for i, r in rows.items():
        assert (r["shard"], r["grown_shard"]) == (heaviest(i, 40), heaviest(i, 41))
        shards.setdefault(r["shard"], []).append((signed(hashed(i, r["size"], r["text_crc32"])) % 256, i))
    for held in shards.values():
        assert [rows[i]["slot"] for _, i in sorted(held)] == list(range(len(held)))


def test_op9(spark, documents):
    spm = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.model_path())
    rows = queries.op9_sequences(spark, SF).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    expected = {}
    for i, d in documents.items():
        ids = [*spm.encode(d["text"]), spm.eos_id()] if d["text"] else []
        for k in range(0, len(ids), 256):
            expected[i, k // 256] = (len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], np.uint16).tobytes()))
    assert len(rows) == len(expected)
    assert {(r["doc_id"], r["sequence"]): (r["n_tokens"], r["ids_crc32"]) for r in rows} == expected


def test_op10(spark):
    truth = {r["doc_id"]: r["quality"] for r in queries.table(spark, LARGER, "labels").collect()}
    rows = queries.op10_quality(spark, LARGER).collect()
    assert len(rows) == queries.table(spark, LARGER, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    fresh = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = ([x for x, q in fresh if q == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.97
    assert np.mean([(x >= 0.7) == q for x, q in fresh]) > 0.95


def test_op4(spark, documents):
    rows = queries.op4_rendezvous_shards(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 16, zlib.crc32(text), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_op8(spark, documents):
    spm = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.model_path())
    for r in queries.op8_token_counts(spark, SF).collect():
        text = documents[r["doc_id"]]["text"] or ""
        n = len(spm.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_op5(spark, documents):
    rows = {r["doc_id"]: r for r in queries.op5_mix_sources(spark, SF).collect()}
    sizes, got = {}, {}
    for i, d in documents.items():
        n = len(brute.spaced(d["text"]))
        assert rows[i]["size"] == n and 0 <= rows[i]["taken"] <= 2 * n
        sizes[d["source"]] = sizes.get(d["source"], 0) + n
        got[d["source"]] = got.get(d["source"], 0) + rows[i]["taken"]
    for i, d in documents.items():
        assert rows[i]["source_size"] == sizes[d["source"]] and abs(got[d["source"]] - rows[i]["target"]) <= 128
    assert sum({d["source"]: rows[i]["target"] for i, d in documents.items()}.values()) == pytest.approx(1.5 * sum(sizes.values()))
