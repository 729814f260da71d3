"""Token counts from pre-token frequencies, for sentencepiece BPE models.

A text is cut into pre-tokens at places that no piece of the vocabulary spans: before a run of
spaces, and before a line feed. BPE merges never cross such a place, so the tokens of a text are
those of its pre-tokens, one after the other. Each worker dictionary-encodes the pre-tokens of a
slice of documents and counts each document's distinct ones; the model says how many pieces each
distinct one has that the worker doesn't remember; these numbers are joined to the frequencies by
code and summed. No ids are held for that: ``encode`` is for those who write them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weirstone.llm._spark import rows_with_text
from weirstone.llm._text import opened, slices, text_buffer

#: The mark that stands for a space in pieces.
MARK = "▁"

#: Bytes of text whose pre-tokens are made distinct together, and distinct ones that the model gets at once.
SLICE_BYTES, AT_ONCE = 8 << 20, 4096


@lru_cache(maxsize=4)
def load(model: str):
    """The model, once the cuts between pre-tokens are known to be right for it."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(made.get_piece_size()):
        piece = made.id_to_piece(i)
        if made.is_byte(i) or made.is_control(i) or made.is_unknown(i):
            continue
        if MARK in piece.lstrip(MARK) or ("\n" in piece and len(piece) > 1):
            raise ValueError(f"piece {i} spans pre-tokens: {piece!r}")
    if made.encode("a  b ", out_type=str)[0][0] != MARK or made.decode(made.encode("Ａ  b ")) != "Ａ  b ":
        raise ValueError("the model rewrites texts or has no leading mark")
    return made


class PreTokens:
    """Pre-tokens of a slice: ``distinct`` ones, each one's ``code``, and each row's ``first``."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "") if column.null_count else column
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")
        lead = pc.if_else(pc.equal(pc.binary_length(column), 0), "", " ")
        data, offsets = text_buffer(pc.binary_join_element_wise(lead, column, ""))
        n = len(data)
        space = data == 0x20
        begin = data == 0x0A
        begin[1:] |= space[1:] & ~space[:-1]
        begin[offsets[offsets < n]] = True
        starts = np.flatnonzero(begin)
        bounds = np.append(starts, n).astype(np.int32)
        self.first = np.searchsorted(starts, offsets)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        self.distinct: pa.Array = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False)

    def frequencies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, n): how often each row has each of its distinct pre-tokens."""
        width = max(len(self.distinct), 1)
        rows = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        pairs = np.sort(rows * np.int64(width) + self.code)
        begin = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        pairs, n = pairs[begin], np.diff(np.append(begin, len(pairs)))
        return pairs // width, pairs % width, n

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """The sum over each row of a value by distinct pre-token, occurrence by occurrence."""
        sums = np.concatenate([[0], np.cumsum(values[self.code], dtype=np.int64)])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def _said(made, tokens: pa.Array) -> Iterator[tuple[list[list[int]], np.ndarray]]:
    """What the model says to given pre-tokens, some at a time, and which of these begin with a line feed.

    The model puts a mark of its own before a text, so a pre-token goes in without its first space.
    One that begins with a line feed gets that mark in vain.
    """
    data, offsets = text_buffer(tokens)
    fed = data[offsets[:-1]] == 0x0A if len(tokens) else np.zeros(0, bool)
    keep = np.ones(len(data), bool)
    keep[offsets[:-1][~fed]] = False
    ends = (offsets - np.concatenate([[0], np.cumsum(~fed)])).astype(np.int32)
    bare = pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(ends), pa.py_buffer(data[keep])])
    alone = [made.piece_to_id(MARK)]
    for k in range(0, len(tokens), AT_ONCE):
        texts = bare.slice(k, AT_ONCE).to_pylist()
        # A single space is the mark itself, while the model says nothing to an empty text.
        yield [x or alone for x in made.encode([x.decode("utf-8", "replace") for x in texts], num_threads=1)], fed[k : k + AT_ONCE]


def _encoded(made, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all given pre-tokens, end to end, and the number of each one's, as the model says them now."""
    ids, counts, feds = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for said, fed in _said(made, tokens):
        counts.append(np.fromiter(map(len, said), np.int64, len(said)))
        ids.append(np.fromiter(chain.from_iterable(said), np.uint32, int(counts[-1].sum())))
        feds.append(fed)
    count, said, fed = np.concatenate(counts), np.concatenate(ids), np.concatenate(feds)
    return np.delete(said, (np.cumsum(count) - count)[fed]), count - fed


#: Pre-tokens whose ids, or numbers of pieces, a worker keeps for its next slices and tasks, at most.
KEPT = 1 << 18


@dataclass
class _Known:
    """The pre-tokens that a worker has met, their ids end to end, and where each one's begin."""

    tokens: pa.Array
    ids: np.ndarray
    bounds: np.ndarray


@lru_cache(maxsize=4)
def _kept(model: str) -> _Known:
    return _Known(pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64))


def _met(model: str, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where each given distinct pre-token's begin there, their number); those met before are looked up."""
    made, known = load(model), _kept(model)
    at = pc.fill_null(pc.index_in(tokens, known.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    fresh, length = _encoded(made, tokens.take(pa.array(new)))
    begin, count = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64)
    begin[old], count[old] = known.bounds[at[old]], known.bounds[at[old] + 1] - known.bounds[at[old]]
    begin[new], count[new] = len(known.ids) + np.cumsum(length) - length, length
    pool = np.concatenate([known.ids, fresh])
    room = min(KEPT - len(known.tokens), len(new))
    if room > 0:
        bounds = np.cumsum(length[:room])
        known.tokens = pa.concat_arrays([known.tokens, tokens.take(pa.array(new[:room]))])
        known.bounds = np.append(known.bounds, known.bounds[-1] + bounds)
        known.ids = np.concatenate([known.ids, fresh[: bounds[-1]]])
    return pool, begin, count


def encode(model: str, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all given (distinct) pre-tokens, end to end, and the number of each one's."""
    pool, begin, count = _met(model, tokens)
    return pool[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())], count


class _Counts:
    """Numbers of pieces that a worker remembers: those of its last slices. What hasn't come up for long is forgotten."""

    def __init__(self) -> None:
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def of(self, made, tokens: pa.Array) -> np.ndarray:
        spelt = tokens.to_pylist()
        young, old = self.young, self.old
        out = np.fromiter((young.get(x) or old.get(x) or 0 for x in spelt), np.int64, len(spelt))
        new = np.flatnonzero(out == 0)  # every pre-token has a piece
        lengths = [np.fromiter(map(len, said), np.int64, len(said)) - fed for said, fed in _said(made, tokens.take(pa.array(new)))]
        out[new] = np.concatenate([np.zeros(0, np.int64), *lengths])
        if len(young) + len(spelt) > KEPT:
            self.old, self.young = young, {}
        self.young.update(zip(spelt[:KEPT], out[:KEPT].tolist(), strict=True))
        return out


@lru_cache(maxsize=4)
def _counts(model: str) -> _Counts:
    return _Counts()


def piece_counts(model: str, tokens: pa.Array) -> np.ndarray:
    """The number of each given (distinct) pre-token's pieces."""
    return _counts(model).of(load(model), tokens)


def _count(model: str, inside: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(opened(batches, inside), "text", SLICE_BYTES):
        tokens = PreTokens(batch.column("text"))
        row, code, n = tokens.frequencies()
        total = np.bincount(row, weights=n * piece_counts(model, tokens.distinct)[code], minlength=batch.num_rows).astype(np.int64)
        _, offsets = text_buffer(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(offsets)), pa.array(total)], names=["row", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, model: str, text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``row`` (a struct of its columns, or of those to ``carry``), n_bytes (UTF-8), n_tokens.

    ``model`` is the path of a sentencepiece model, which the executors have at the same place.
    Special strings in texts are plain text; no begin, end or other special token is added. Null
    counts as empty, and an empty text has no tokens. Repeated rows are counted each; an empty table gives no rows.
    """
    load(model)
    out, inside = rows_with_text(docs, text_col, carry)
    schema = T.StructType([out.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return out.mapInArrow(partial(_count, model, inside), schema)
