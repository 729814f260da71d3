"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each shard (a few megabytes of whole documents inside a task) gets a word-level suffix array of all
its suffixes: sorted by their first words, then by doubling, where only suffixes that are still tied
are sorted again, until they are told apart or tied for as long as any benchmark item. Every benchmark
suffix that holds a window is binary-searched in it (equal ones once), which gives all places of its
window. From these places matches are followed in both directions to their whole verbatim length. So
work goes with the places and the distinct windows, not with the items that share a window. The
benchmark reaches the tasks in blocks of a fixed size bound; a shard's suffix array is built once and
all blocks are searched in it, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.llm._spark import rows_with_text
from weirstone.llm._text import ALNUM, Words, lists, opened, slices

#: Bytes of benchmark text that are broadcast at once. What is broadcast takes about three times as much; a test holds it to four.
BLOCK_BYTES = 8 << 20

#: Blocks up to which a worker keeps them all for its next shards.
KEPT_BLOCKS = 4

SPANS, ITEMS = "array<struct<start:int,length:int,item:string,item_start:int>>", "array<string>"


class Suffixes:
    """The benchmark suffixes of a block of items that hold a window; equal windows are one, with a class for the items that share it."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        items = sorted(items, key=lambda x: (x[0] is None, x[0] or "", x[1]))
        words = Words(pa.array([text for _, text in items], pa.string()), ALNUM)
        names = sorted({name for name, _ in items}, key=lambda x: (x is None, x or ""))
        number = {name: k for k, name in enumerate(names)}
        self.names = pa.array(names, pa.string())
        self.name = np.array([number[name] for name, _ in items], np.int32)
        self.window, self.vocabulary = window, words.distinct
        self.code, self.first = words.code.astype(np.int32), words.first.astype(np.int32)
        self.longest = int(words.per_row.max(initial=0))
        depth = np.minimum(words.per_row, window)[words.row]
        place = np.arange(len(self.code))
        ok = place + depth <= words.first[words.row + 1]
        place, depth, row = place[ok], depth[ok], words.row[ok]
        padded = np.append(self.code, np.zeros(window, np.int32))
        matrix = padded[place[:, None] + np.arange(window)] + 1
        matrix[np.arange(window) >= depth[:, None]] = 0
        _, begin, which = np.unique(np.ascontiguousarray(matrix).view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
        #: Each distinct window: where it stands first, and its words.
        self.place, self.depth = place[begin].astype(np.int32), depth[begin].astype(np.int16)
        # Windows that the same items share are of one class.
        pairs = np.unique(which.ravel() * np.int64(len(names) + 1) + self.name[row]) if len(place) else np.zeros(0, np.int64)
        owner, name = pairs // (len(names) + 1), pairs % (len(names) + 1)
        count = np.bincount(owner, minlength=len(begin))
        name, ends = name.astype(np.int32), np.cumsum(count)
        kinds: dict[bytes, int] = {}
        self.kind = np.array([kinds.setdefault(name[end - n : end].tobytes(), len(kinds)) for end, n in zip(ends.tolist(), count.tolist(), strict=True)], np.int32)
        sets = [np.frombuffer(x, np.int32) for x in kinds]
        self.kind_count = np.array([len(x) for x in sets], np.int64)
        self.kind_names = np.concatenate([np.zeros(0, np.int32), *sets])


def suffix_array(code: np.ndarray, top: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(suffixes in order, their leading words as sorted keys, words in a key, bits of a word), told apart over ``depth`` words.

    Codes are from 1 to ``top``.
    """
    n, bits = len(code), max(int(top + 1).bit_length(), 1)
    lead = min(63 // bits, 8)
    padded = np.append(code.astype(np.int64), np.zeros(lead, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(lead):
        key = (key << bits) | padded[k : n + k]
    order = np.argsort(key)
    key = key[order]
    at = np.arange(n)
    head = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), at, 0)) if n else at
    rank = np.empty(n, np.int64)
    rank[order] = head
    reach = lead
    last = np.append(head[1:] != head[:-1], True) if n else np.zeros(0, bool)
    tied = np.flatnonzero(~((head == at) & last))
    while len(tied) and reach < depth:
        place = order[tied]
        beyond = place + reach
        pair = rank[place] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        again = np.argsort(pair)
        place, pair = place[again], pair[again]
        order[tied] = place
        fresh = np.append(True, pair[1:] != pair[:-1])
        rank[place] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        reach *= 2
    return order, key, lead, bits


def search(code: np.ndarray, suffixes: tuple[np.ndarray, np.ndarray, int, int], tests: Suffixes, spelt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the distinct windows occur: places in ``code``, and which window each is. ``spelt`` has the items' words in the shard's codes, 0 for strangers."""
    none = np.zeros(0, np.int64)
    strange = np.append(0, np.cumsum(spelt == 0))
    live = np.flatnonzero(strange[tests.place + tests.depth] == strange[tests.place])
    if not len(live) or not len(code):
        return none, none
    order, key, lead, bits = suffixes
    place, depth = tests.place[live].astype(np.int64), tests.depth[live].astype(np.int64)
    steps = np.arange(tests.window)
    words, texts = np.append(spelt, np.zeros(max(tests.window, lead), np.int64)), np.append(code, np.zeros(tests.window, code.dtype))
    low = high = np.zeros(len(live), np.int64)
    for k in range(lead):
        inside = k < depth
        low = (low << bits) | np.where(inside, words[place + k], 0)
        high = (high << bits) | np.where(inside, words[place + k], (1 << bits) - 1)
    low, high = np.searchsorted(key, low, "left"), np.searchsorted(key, high, "right")
    some = low < high
    live, place, depth, low, high = live[some], place[some], depth[some], low[some], high[some]
    deep = np.flatnonzero(depth > lead)

    def bisect(begin: np.ndarray, end: np.ndarray, beyond: bool) -> np.ndarray:
        """The first suffix that is not before (or, with ``beyond``, that is after) its window."""
        begin, end = begin.copy(), end.copy()
        while len(open_ := np.flatnonzero(begin < end)):
            middle = (begin[open_] + end[open_]) // 2
            own, other = words[place[deep[open_]][:, None] + steps], texts[order[middle][:, None] + steps]
            differs = (own != other) & (steps < depth[deep[open_]][:, None])
            at = np.argmax(differs, 1)
            rows = np.arange(len(open_))
            after = np.where(differs[rows, at], other[rows, at] < own[rows, at], beyond)
            begin[open_] = np.where(after, middle + 1, begin[open_])
            end[open_] = np.where(after, end[open_], middle)
        return begin

    low[deep], high[deep] = bisect(low[deep], high[deep], False), bisect(low[deep], high[deep], True)
    count = high - low
    which = np.repeat(np.arange(len(live)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return order[low[which] + inside], live[which]


def _followed(text: np.ndarray, items: np.ndarray, at: np.ndarray, item_at: np.ndarray, lowest: np.ndarray, beyond: np.ndarray, step: int) -> np.ndarray:
    """How many more words agree, going by ``step`` from the given places; item places stay from ``lowest`` to before ``beyond``."""
    more = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        x, y = at[open_] + step * (more[open_] + 1), item_at[open_] + step * (more[open_] + 1)
        ok = (x >= 0) & (x < len(text)) & (y >= lowest[open_]) & (y < beyond[open_])
        ok[ok] = text[x[ok]] == items[y[ok]]
        open_ = open_[ok]
        more[open_] += 1
    return more


class Shard:
    """The words of some texts end to end, and their suffix array over ``depth`` words."""

    def __init__(self, column: pa.Array, depth: int):
        words = Words(column, ALNUM)
        self.n, self.n_words, self.distinct = len(column), words.per_row.astype(np.int64), words.distinct
        # Every document ends with a mark of its own, so no suffix agrees with another beyond its document.
        self.begins, self.ends = words.first[:-1] + np.arange(self.n), words.first[1:] + np.arange(self.n)
        self.code = np.empty(len(words.code) + self.n, np.int64)
        is_end = np.zeros(len(self.code), bool)
        is_end[self.ends] = True
        self.code[is_end], self.code[~is_end] = len(words.distinct) + 1 + np.arange(self.n), words.code + 1
        self.suffixes = suffix_array(self.code, len(words.distinct) + self.n, depth)

    def row(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, "right") - 1


def _spans(shard: Shard, tests: Suffixes, spelt: np.ndarray, place: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Runs of places on one diagonal, followed to where text and item part: (row, place, length, item's name, first word there), each once."""
    if not len(place):
        return np.zeros((0, 5), np.int64)
    item = np.searchsorted(tests.first, tests.place[which], "right") - 1
    diagonal = place - tests.place[which]
    order = np.lexsort((place, diagonal))
    at, line, item = place[order], diagonal[order], item[order]
    fresh = np.append(True, (line[1:] != line[:-1]) | (at[1:] > at[:-1] + 1) | (item[1:] != item[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    start, item, line, end = at[first], item[first], line[first], at[last] + tests.depth[which][order][last] - 1
    lowest, beyond = tests.first[item].astype(np.int64), tests.first[item + 1].astype(np.int64)
    end = end + _followed(shard.code, spelt, end, end - line, lowest, beyond, 1)
    start = start - _followed(shard.code, spelt, start, start - line, lowest, beyond, -1)
    return np.unique(np.column_stack([shard.row(start), start, end + 1 - start, tests.name[item], start - line - lowest]), axis=0)


def _items(shard: Shard, tests: Suffixes, place: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item's name) of all items by document: over the classes of its windows, so a class is spelt out once by document."""
    kinds = len(tests.kind_count)
    held = np.unique(shard.row(place) * np.int64(kinds + 1) + tests.kind[which])
    row, kind = held // (kinds + 1), held % (kinds + 1)
    count, begin = tests.kind_count[kind], (np.cumsum(tests.kind_count) - tests.kind_count)[kind]
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    held = np.unique(np.repeat(row, count) * np.int64(len(tests.names) + 1) + tests.kind_names[np.repeat(begin, count) + inside])
    return held // (len(tests.names) + 1), held % (len(tests.names) + 1)


def _in_order(rows: np.ndarray, names: pa.Array, n: int) -> pa.ListArray:
    """A list by row of the distinct names, in order, null last."""
    known = sorted(set(names.to_pylist()), key=lambda x: (x is None, x or ""))
    number = {name: k for k, name in enumerate(known)}
    held = np.unique(rows * np.int64(len(known) + 1) + np.array([number[x] for x in names.to_pylist()], np.int64)) if len(rows) else np.zeros(0, np.int64)
    return lists(pa.array(known, pa.string()).take(pa.array(held % (len(known) + 1))), np.bincount(held // (len(known) + 1), minlength=n))


def matches(column: pa.Array, blocks: Iterable[Suffixes], depth: int, with_spans: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array | None, pa.Array]:
    """(n_words, n_hit, spans unless left out, items) of each text of a shard, over all blocks of the benchmark."""
    shard = Shard(column, depth)
    turns = np.zeros(len(shard.code) + 1, np.int64)
    spans, named, rows, names = [np.zeros((0, 5), np.int64)], [pa.array([], pa.string())], [np.zeros(0, np.int64)], [pa.array([], pa.string())]
    for tests in blocks:
        known = pc.fill_null(pc.index_in(tests.vocabulary, shard.distinct), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        spelt = known[tests.code] if len(tests.code) else np.zeros(0, np.int64)
        place, which = search(shard.code, shard.suffixes, tests, spelt)
        np.add.at(turns, place, 1)
        np.add.at(turns, place + tests.depth[which], -1)
        row, name = _items(shard, tests, place, which)
        rows.append(row)
        names.append(tests.names.take(pa.array(name)))
        if with_spans:
            spans.append(_spans(shard, tests, spelt, place, which))
            named.append(tests.names.take(pa.array(spans[-1][:, 3])))
    hit = np.append(0, np.cumsum(np.cumsum(turns[:-1]) > 0))
    items = _in_order(np.concatenate(rows), pa.concat_arrays(names), shard.n)
    told = None
    if with_spans:
        found, item = np.concatenate(spans), pa.concat_arrays(named)
        by = np.argsort(found[:, 0], kind="stable")
        found, item = found[by], item.take(pa.array(by))
        told = pa.StructArray.from_arrays([pa.array((found[:, 1] - shard.begins[found[:, 0]]).astype(np.int32)), pa.array(found[:, 2].astype(np.int32)), item, pa.array(found[:, 4].astype(np.int32))], names=["start", "length", "item", "item_start"])
        told = lists(told, np.bincount(found[:, 0], minlength=shard.n))
    return shard.n_words, hit[shard.ends] - hit[shard.begins], told, items


def _held(blocks: Sequence[Broadcast]) -> Iterator[Suffixes]:
    """The blocks one after the other; of many, a worker holds one at a time."""
    for block in blocks:
        yield block.value
        if len(blocks) > KEPT_BLOCKS:
            block.__dict__.pop("_value", None)


def _scan(blocks: Sequence[Broadcast], depth: int, with_spans: bool, inside: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(opened(batches, inside), "text"):
        n_words, n_hit, spans, items = matches(batch.column("text"), _held(blocks), depth, with_spans)
        columns = {"row": batch.column("row"), "n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "spans": spans, "items": items}
        yield pa.RecordBatch.from_pydict({name: x for name, x in columns.items() if x is not None})


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items in order, ``limit`` bytes at a time; the driver holds one block."""
    held: list[tuple[str | None, str]] = []
    size = 0
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    for name, text in items.orderBy("item", "text").toLocalIterator():
        if held and size + len(text.encode()) > limit:
            yield held
            held, size = [], 0
        held.append((name, text))
        size += len(text.encode())
    if held:
        yield held


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10, block_bytes: int = BLOCK_BYTES, with_spans: bool = True) -> DataFrame:
    """Per row of ``docs``: ``row`` (the row itself, as a struct), n_words, n_hit, spans, items.

    n_hit counts the document's words inside any occurrence of ``window`` consecutive item words (of
    the whole item if shorter); ``items`` are the ids, as sorted text, of all items with one. A span
    is a verbatim match of its whole length: its first word and length in the document, an item that
    it is in and its first word there (where items share a passage, the first of them in its block); spans cover
    all hits, and are left out unless asked for. Null and empty texts have no words, and items without words
    match nothing. Items of the same id count as one; those without an id count as one more, whose id is null.
    Repeated rows each have their matches. An empty benchmark gives no spans.
    """
    spark = docs.sparkSession
    out, inside = rows_with_text(docs, text_col, None)
    blocks, depth = [], window
    for items in blocks_of(benchmark, item_col, item_text_col, block_bytes) if not benchmark.isEmpty() else ():
        tests = Suffixes(items, window)
        blocks.append(spark.sparkContext.broadcast(tests))
        depth = max(depth, tests.longest)
    fields = [out.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), *[T.StructField("spans", T.DataType.fromDDL(SPANS))] * with_spans, T.StructField("items", T.DataType.fromDDL(ITEMS))]
    return out.mapInArrow(partial(_scan, blocks, depth, with_spans, inside), T.StructType(fields))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no occurrence of a benchmark window, with their columns as they were."""
    return find_matches(docs, benchmark, text_col, window=window, with_spans=False).where("n_hit = 0").select("row.*")
