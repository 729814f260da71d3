"""Embedders. The hashing embedder needs no model: character n-grams, hashed and weighted."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.retrieval.ngrams import cut_words, spread

#: Texts whose grams are counted at once; bytes of text that a worker embeds at once.
AT_ONCE, SLICE_BYTES = 256, 2 << 20


class Embedder(Protocol):
    @property
    def fingerprint(self) -> str: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words ``[a-z0-9]+`` in marks ^ and $, their n-grams by blake2b into buckets, 1 + ln(count), unit length.

    A batch is worked on as a whole: its distinct words are cut into grams by their offsets in one
    string, each distinct gram is hashed once, and the counts of all texts are summed in one array.
    """

    def __init__(self, dim: int = 384, shortest: int = 3, longest: int = 5):
        self.dim, self.shortest, self.longest = dim, shortest, longest

    @property
    def fingerprint(self) -> str:
        return f"hashing-v1-dim{self.dim}-ngram{self.shortest}-{self.longest}"

    def word_buckets(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(which word, bucket) of all grams of the given words; a word shorter than a gram gives one cut-off gram."""
        owner, which, grams = cut_words(words, range(self.shortest, self.longest + 1))
        hashed = np.fromiter((int.from_bytes(hashlib.blake2b(g, digest_size=8).digest(), "big") % self.dim for g in grams), np.int64, len(grams))
        return owner, hashed[which]

    def buckets(self, word: str) -> tuple[int, ...]:
        return tuple(self.word_buckets([word])[1].tolist())

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        found = [re.findall(r"[a-z0-9]+", (text or "").lower()) for text in texts]
        words = sorted(set().union(*found))
        if words:
            number = {w: k for k, w in enumerate(words)}
            owner, bucket = self.word_buckets(words)
            count = np.bincount(owner, minlength=len(words))
            first = np.cumsum(count) - count
            for k in range(0, len(texts), AT_ONCE):
                some = found[k : k + AT_ONCE]
                said = np.array([number[w] for words in some for w in words], np.int64)
                row = np.repeat(np.arange(len(some)), [len(words) for words in some])
                # Each text's distinct words, then their grams, then one count over (text, bucket).
                pair, times = np.unique(row * np.int64(len(number)) + said, return_counts=True)
                row, which = pair // len(number), pair % len(number)
                many = count[which]
                cell = np.repeat(row * self.dim, many) + bucket[spread(which, first, count)]
                out[k : k + len(some)] = np.bincount(cell, weights=np.repeat(times, many), minlength=len(some) * self.dim).reshape(-1, self.dim)
        some = out > 0
        out[some] = 1 + np.log(out[some])
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def in_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """An Arrow array's texts, at most ``limit`` bytes at a time and at least one text; a null is empty."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(upto, done + limit, "right")))
        yield pc.fill_null(texts.slice(start, end - start), "").to_pylist()
        start, done = end, upto[end - 1]


def embedded(text: Column, embedder: Embedder) -> Column:
    """The vectors of a text column. A worker takes a slice of an Arrow batch at a time, so its memory is bounded whatever a batch holds."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [embedder.embed(some) for some in in_slices(texts)]
            cells = np.concatenate([x.ravel() for x in parts] or [np.zeros(0, np.float32)])
            bounds = np.cumsum([0, *(x.shape[1] for x in parts for _ in range(len(x)))], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(cells, pa.float32()))

    return run(text)
