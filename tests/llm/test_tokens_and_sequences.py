import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirstone.llm import binary, feistel, tokens
from weirstone.llm.queries import model_path

sentencepiece = pytest.importorskip("sentencepiece")

ODD = [None, "", " ", "   ", "\n", "\n\n", " \n a", "a\n b\nc", "▁", "x▁y ▁ z", "</s><s>[INST]<unk>", "a\tb c", "日本語 テキスト", "😀 😀\n😀", "é" * 3, "word " * 3000, "x" * 5000, "<0x0A>", "tail  ", "A.B, C!", "\x00\x01", "\r\n"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def counted(texts):
    cut = tokens.PreTokens(pa.array(texts, pa.string()))
    counts = tokens.piece_counts(model_path(), cut.distinct)
    assert counts.tolist() == tokens.encode(model_path(), cut.distinct)[1].tolist()
    return cut.per_row(counts).tolist()


def test_frequencies():
    cut = tokens.PreTokens(pa.array(["a b a", None, "b b"]))
    row, code, n = cut.frequencies()
    names = [x.as_py() for x in cut.distinct]
    assert sorted((r, names[c], k) for r, c, k in zip(row, code, n, strict=True)) == [(0, b" a", 2), (0, b" b", 1), (2, b" b", 2)]


def test_ids(model):
    """Of pre-tokens that are met for the first time, and again, and some of each; also when no more can be kept."""
    was = tokens.KEPT
    tokens.KEPT = 6
    tokens._kept.cache_clear()
    try:
        for text in ("one two\n three", "two one  four\nfive ", "one six seven two", "eight\n\n  nine one"):
            cut = tokens.PreTokens(pa.array([text]))
            ids, count = tokens.encode(model_path(), cut.distinct)
            ends = np.cumsum(count)
            assert [i for c in cut.code for i in ids[ends[c] - count[c] : ends[c]]] == model.encode(text)
    finally:
        tokens.KEPT = was
        tokens._kept.cache_clear()


def test_odd_texts(model):
    assert counted(ODD) == [len(model.encode(t or "")) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab  \n▁é日<>s/\t.1"))), min_size=1, max_size=6))
def test_any_text(texts):
    held = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert counted(texts) == [len(held.encode(t)) for t in texts]


def test_counts(spark, model):
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(ODD)] + [(0, None, "r", 1)], "doc_id long, text string, row string, n_tokens int")
    found = tokens.count_tokens(docs, model_path()).collect()
    assert len(found) == len(ODD) + 1
    for r in found:
        text = ODD[r["row"]["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(model.encode(text)))
    assert tokens.count_tokens(docs.where("false"), model_path()).count() == 0


def test_sequences_round_trip(spark, model, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, ODD[5]), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, shard string").coalesce(3)
    path = f"{tmp_path}/s"
    n = binary.write_sequences(docs, model_path(), path, length=16, per_file=50, per_shard=100, key=5)
    expected = []
    for i, t in rows:
        ids = model.encode(t) + [model.eos_id()] if t else []
        expected += [(i, k // 16, ids[k : k + 16]) for k in range(0, len(ids), 16)]
    assert n == len(expected)
    found = binary.read_sequences(spark, path, length=16, per_file=50, per_shard=100).collect()
    assert sorted(r["slot"] for r in found) == list(range(n))
    crc = lambda ids: zlib.crc32(np.array(ids, np.uint16).tobytes())
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["sequence"], r["n_tokens"], r["ids_crc32"]) for r in found), key=key) == sorted(((i, k, len(x), crc(x)) for i, k, x in expected), key=key)
    assert sorted(((r["doc_id"], r["sequence"], r["ids"]) for r in found), key=key) == sorted(expected, key=key)
    # A record is found in file slot // per_file, at slot % per_file times the stride, and in its shard at byte_offset.
    by_slot = {r["slot"]: r for r in found}
    for file in range(-(-n // 50)):
        (part,) = (tmp_path / "s" / f"shard={file // 2}" / f"file={file}").glob("part-*")
        raw = part.read_bytes()
        assert len(raw) == min(50, n - 50 * file) * binary.stride(16)
        record, at = raw[3 * binary.stride(16) :][: binary.stride(16)], by_slot[50 * file + 3]
        assert int.from_bytes(record[12:16], "little") == at["n_tokens"]
        assert (at["shard"], at["byte_offset"]) == (file // 2, (50 * (file % 2) + 3) * binary.stride(16))
    # Reading goes on from any slot, and opens no file without the slots.
    some = binary.read_sequences(spark, path, length=16, per_file=50, per_shard=100, begin=70, end=120)
    assert sorted(r["slot"] for r in some.collect()) == list(range(70, min(n, 120)))
    (tmp_path / "s" / "shard=0" / "file=0").rename(tmp_path / "gone")
    assert binary.read_sequences(spark, path, length=16, per_file=50, per_shard=100, begin=50).count() == n - 50


def test_wide_ids():
    """Ids beyond two bytes are kept whole."""
    made = binary.records(np.array([7]), tokens.PreTokens(pa.array(["ab"])), np.array([70_000, 3], np.uint32), np.array([2]), 4, 99_999, 4)
    record = made.view(binary.record_type(4, 4)).ravel()[0]
    assert record["ids"].tolist() == [70_000, 3, 99_999, 0] and record["used"] == 3 and made.shape[1] == binary.stride(4, 4)


def test_a_session_that_limits_records_of_a_file(spark, model, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        docs = spark.createDataFrame([(i, "word " * 90) for i in range(40)], "doc_id long, text string")
        found = binary.materialise(docs, model_path(), length=32, path=f"{tmp_path}/s").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(r["slot"] for r in found) == list(range(len(found))) and len(found) >= 40


def test_sequences_of_nothing(spark):
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert binary.materialise(empty, model_path()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000, 4096])
def test_permutations(n):
    out = feistel.permute(np.arange(n), n, 3)
    assert sorted(out) == list(range(n))
    assert n < 50 or (out != feistel.permute(np.arange(n), n, 4)).mean() > 0.9


def test_permutations_in_sql(spark):
    sizes = [1, 2, 3, 5, 10, 97, 1000]
    rows = spark.createDataFrame([(i, n) for n in sizes for i in range(n)], "i long, n long")
    found = rows.select("n", feistel.permuted("i", "n", "n").alias("to")).collect()
    for n in sizes:
        assert sorted(r["to"] for r in found if r["n"] == n) == list(range(n))


def test_counts_are_remembered_and_forgotten(model, monkeypatch):
    """Numbers of pieces stay right while the table of them turns over, and it stays small."""
    monkeypatch.setattr(tokens, "KEPT", 5)
    held = tokens._Counts()
    for text in ("one two\n three", "two one  four\nfive ", "one six seven two", "eight\n\n  nine one", "one two three four five six seven eight nine ten"):
        cut = tokens.PreTokens(pa.array([text]))
        assert cut.per_row(held.of(tokens.load(model_path()), cut.distinct)).tolist() == [len(model.encode(text))]
        assert len(held.young) <= 10 and len(held.old) <= 10


def test_files_grow_with_the_records():
    sizes = [binary.file_records(n) for n in (0, 1, 10**6, 1 << 30, (1 << 30) + 1, 10**11, 10**13)]
    assert sizes == [1 << 14, 1 << 14, 1 << 14, 1 << 14, 1 << 15, 1 << 21, 1 << 21]
    assert all(binary.PER_SHARD % n == 0 for n in sizes)
