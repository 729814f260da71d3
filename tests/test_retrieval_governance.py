import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirstone.governance import access_matrix, pii_inventory, pii_tag_sql, render_access_matrix
from weirstone.retrieval import chunks, embed, index, ngrams
from weirstone.retrieval.corpus import write_corpus
from weirstone.storage.table import Files


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    write_corpus(Files(spark, str(folder)))
    return str(folder)


def chunked(spark, text, **limits):
    rows = spark.createDataFrame([("doc", text)], "doc_slug string, text string")
    return chunks.chunk_documents(rows, **limits).orderBy("chunk_idx").collect()


def test_sections(spark):
    found = chunked(spark, "lost\n# The Title\n\nintro\n\n## Part: One!\n\nbody\n### Empty\n\n## Two\nmore\n")
    assert [(r["chunk_id"], r["doc_title"], r["heading"], r["text"]) for r in found] == [("doc/the-title", "The Title", "The Title", "intro"), ("doc/part-one", "The Title", "Part: One!", "body"), ("doc/two", "The Title", "Two", "more")]


def test_no_heading_of_level_one(spark):
    (one,) = chunked(spark, "## Only\ntext")
    assert one["doc_title"] == "doc"
    assert chunked(spark, "nothing at all") == []


def test_long_sections_overlap_and_keep_paragraphs(spark):
    paragraphs = [f"{c * 80}" for c in "abcdefgh"]
    found = chunked(spark, "# T\n" + "\n\n".join(paragraphs), max_chars=200, overlap=20)
    assert [r["chunk_id"] for r in found] == ["doc/t", *(f"doc/t-{i}" for i in range(1, len(found)))]
    for p in paragraphs:
        assert any(p in r["text"] for r in found)
    for a, b in zip(found, found[1:], strict=False):
        assert b["text"].startswith(a["text"][-18:])


def test_vectors():
    made = embed.HashingEmbedder()
    v = made.embed(["retention of events", "retention of event", "zebra quagga", "", "a"])
    assert v.dtype == np.float32 and v.shape == (5, 384)
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 1, 1, 0, 1], atol=1e-6)
    assert v[0] @ v[1] > v[0] @ v[2]
    assert len(made.buckets("a")) == 3
    assert made.fingerprint == "hashing-v1-dim384-ngram3-5"


def test_search(spark, corpus):
    made = embed.HashingEmbedder()
    built = index.build_index(chunks.chunk_corpus(spark, corpus), made)
    hits = index.search(built, made, "How long is the retention period of bronze events?", 3).collect()
    assert len(hits) == 3 and hits[0]["doc_slug"] == "data-retention-policy" and hits[0]["score"] >= hits[1]["score"]
    said = index.format_answer("q", hits)
    assert "A (top passage" in said and said.count("  - ") == 2
    assert "No relevant passages" in index.format_answer("q", [])
    with pytest.raises(index.FingerprintMismatch):
        index.search(built, embed.HashingEmbedder(128), "q")


def test_index_on_disk(spark, corpus, tmp_path):
    made = embed.HashingEmbedder()
    index.save_index(index.build_index(chunks.chunk_corpus(spark, corpus), made), f"{tmp_path}/i")
    assert index.search(index.load_index(spark, f"{tmp_path}/i"), made, "severity of a failed gold step", 1).first()["doc_slug"] == "incident-runbook"


def test_empty_corpus(spark, tmp_path):
    (tmp_path / "x.md").write_text("no headings")
    with pytest.raises(FileNotFoundError):
        chunks.chunk_corpus(spark, str(tmp_path))


def test_access_matrix(spark):
    rows = {r["principal"]: r.asDict() for r in access_matrix(spark).collect()}
    assert list(rows) == ["analysts", "data-engineers", "svc-ingest", "svc-transform"]
    assert rows["analysts"]["gold"] == "SELECT" and rows["analysts"]["bronze"] == "—"
    text = render_access_matrix(spark)
    assert "| Principal | Kind | bronze | gold | silver |" in text and "| customers | address | quasi_identifier |" in text


def test_pii(spark):
    assert pii_inventory(spark).count() == 9
    assert pii_tag_sql().count("SET TAGS") == 9 and pii_tag_sql().startswith("-- accounts (contract v1)\nALTER TABLE silver.banking.accounts ALTER COLUMN balance SET TAGS")


@pytest.mark.parametrize("blocks", [(8192, 1024), (7, 3)])
def test_many_questions_at_once(spark, monkeypatch, blocks):
    monkeypatch.setattr(index, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(index, "QUESTION_BLOCK", blocks[1])
    chance = np.random.default_rng(3)
    vectors = np.round(chance.normal(size=(60, 5)), 1)
    vectors[10:20] = vectors[0]  # ties
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(99, None)], "id long, vec array<double>")
    found = index.top_k_many(rows, rows.where("id % 6 = 0"), 4)
    got = {}
    for r in found.orderBy("question", "rank").collect():
        got.setdefault(r["question"], []).append((r["id"], round(r["score"], 9)))
    scores = vectors @ vectors.T
    assert got == {q: [(k, round(float(scores[q, k]), 9)) for k in sorted(range(60), key=lambda k: (-round(scores[q, k], 12), -k))[:4]] for q in range(0, 60, 6)}
    assert index.top_k_many(rows.limit(0), rows, 4).count() == 0 == index.top_k_many(rows, rows.limit(0), 4).count()


def test_the_query_of_embeddings_shows_the_buckets_of_plain_python(spark):
    """Every document's filled buckets, worked out gram by gram."""
    import hashlib
    import re

    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in __spark_entry__.queries()["hash_embed"](spark, folder).collect():
        grams = set()
        for word in re.findall(r"[a-z0-9]+", (texts[r["doc_id"]] or "").lower()):
            marked = f"^{word}$"
            for n in (3, 4, 5):
                grams |= {marked[i : i + n] for i in range(max(len(marked) - n + 1, 1))}
        buckets = sorted({int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") % 384 for g in grams})
        assert r["buckets"] == ",".join(map(str, buckets)) and r["filled"] == len(buckets) and r["dim"] == 384
        assert r["norm"] == pytest.approx(1.0 if buckets else 0.0, abs=1e-3)


def test_texts_embed_alike_in_any_batch():
    texts = [f"word{k} words {'more ' * (k % 7)}" for k in range(600)] + ["", None]
    made = embed.HashingEmbedder()
    whole = made.embed(texts)
    assert all((made.embed([t])[0] == v).all() for t, v in list(zip(texts, whole, strict=True))[::37]) and not whole[-1].any()


@pytest.mark.parametrize("slice_words", [1 << 19, 4])
def test_grams_are_counted_by_document_and_shuffled_as_grams_only(spark, monkeypatch, slice_words):
    """Ids that repeat are one document, null is none; what is shuffled is grams, never grams by document."""
    from collections import Counter, defaultdict

    monkeypatch.setattr(ngrams, "CELLS", 64)
    texts = [(1, "The cat, the CATS"), (1, "cat a"), (2, "catİ x"), (None, "cat cat"), (2, None), (3, ""), (4, "..."), (5, "a1b2c3d4")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    n, docs = Counter(), defaultdict(set)
    for doc, text in texts:
        for word in re.findall(r"[a-z0-9]+", (text or "").lower()):
            marked = f"^{word}$"
            for gram in (marked[i : i + k] for k in (3, 4, 5) for i in range(max(len(marked) - k + 1, 1))):
                n[gram] += 1
                docs[gram] |= {doc} - {None}
    found = ngrams.gram_counts(rows.coalesce(1), slice_words=slice_words)
    assert sorted(map(tuple, found.collect())) == sorted((g, n[g], len(docs[g])) for g in n)
    once = ngrams.gram_counts(rows.where("text = 'a1b2c3d4'"))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(gram" in plan
    assert ngrams.gram_counts(rows.limit(0)).count() == 0


def test_a_worker_embeds_a_bounded_slice_of_a_batch_at_once(spark, monkeypatch):
    """However many texts an Arrow batch holds; the vectors are those of all texts at once."""
    texts = [f"word{k} words {'more ' * (k % 7)}" for k in range(300)] + ["", None, "long " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    size = embed.SLICE_BYTES

    class Watched(embed.HashingEmbedder):
        def embed(self, texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= size, "a slice is too large"
            return super().embed(texts)

    found = {r["k"]: r["v"] for r in rows.select("k", embed.embedded(F.col("text"), Watched()).alias("v")).collect()}
    want = embed.HashingEmbedder().embed(texts)
    assert all(found[k] == v.tolist() for k, v in enumerate(want))
    many = spark.range(4000).coalesce(1).select(F.repeat(F.concat(F.lit("text "), "id"), F.lit(200)).alias("text"))
    assert many.select(embed.embedded(F.col("text"), Watched()).alias("v")).where("size(v) = 384").count() == 4000
