"""Vectorised word work on Arrow string buffers, shared by the operators that run in ``mapInArrow``.

All functions work on the raw UTF-8 bytes of a column, so no Python string is made per row. Rows
are handled in slices of a few megabytes (``slices``), which bounds a worker's memory whatever the
Arrow batch holds; a single longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text a worker handles at once.
SLICE_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Word bytes of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[0x20] = SPACED[0x09:0x0E] = False


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, end to end, and the rows' offsets in them. A null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches' rows, at most ``limit`` bytes of ``text`` and ``rows`` rows at a time, and at least one row."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(text))
        start, n = 0, batch.num_rows
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(n, max(end, start + 1), start + rows)
            yield batch.slice(start, end - start)
            start = end
    release()


def release() -> None:
    """Give freed memory back to the system: workers stay on for later tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Words:
    """The words of a slice: ``first`` has each row's first word and, last, the number of words."""

    def __init__(self, column: pa.Array, table: np.ndarray):
        data, offsets = text_buffer(column)
        data = LOWER[data]
        n = len(data)
        mask = table[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begin, end = mask.copy(), mask.copy()
        if n:
            begin[1:] &= ~mask[:-1] | edge[1:n]
            end[:-1] &= ~mask[1:] | edge[1:n]
        starts = np.flatnonzero(begin)
        lengths = np.flatnonzero(end) + 1 - starts
        self.first = np.searchsorted(starts, offsets)
        self.per_row = np.diff(self.first)
        bounds = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(lengths, out=bounds[1:])
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[mask])])
        coded = packed.dictionary_encode()
        #: The distinct words, and for each word its place among them.
        self.distinct: pa.Array = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_row)), self.per_row)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def hash_binary(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a binary array, the same in every process."""
    if not len(values):
        return np.zeros(0, np.uint64)
    bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    n = len(data)
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    up[1:] = np.uint64(_BASE)
    down[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    out = (sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]]
    return mix(out + np.diff(bounds).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lists(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list array whose rows take ``counts`` of the values, in order."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), values if isinstance(values, pa.Array) else pa.array(values))


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Callable:
    """``fn`` over slices, as ``mapInArrow`` wants it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, limit):
            yield fn(part)

    return run


def opened(batches: Iterator[pa.RecordBatch], inside: str | None) -> Iterator[pa.RecordBatch]:
    """Batches of (row, text): where the text is in the row, it is taken from there, without a copy."""
    for batch in batches:
        text = batch.column("row").field(inside) if inside else batch.column("text")
        yield pa.RecordBatch.from_arrays([batch.column("row"), text], names=["row", "text"])
