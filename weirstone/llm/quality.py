"""A quality classifier learnt from trusted positives and unlabelled text.

Features of whole texts (shares of kinds of bytes, shapes of words, hashed byte 3-grams) go through a
logistic model that minimises the non-negative unbiased risk of positive-unlabelled learning: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). The prior is
estimated from the data: a plain positive-against-unlabelled model ranks held-back rows of both
kinds, and the smallest ratio of their upper tails bounds the share of positives among the unlabelled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.llm._spark import rows_with_text
from weirstone.llm._text import ALNUM, LOWER, SPACED, Words, opened, slices, text_buffer

#: Rows of either kind that the model is fitted on, at most about (they are drawn by a hash of doc_id).
SAMPLE_ROWS = 20_000

#: Bytes and rows of text whose features are made together; several numbers by byte, and all features by row, are held meanwhile.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096

#: Kinds of bytes whose shares are features: capitals, small letters, digits, beyond ASCII, space, line feed, stops, brackets and quotes, other marks, controls.
KINDS = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), bytes(range(128, 256)), b" ", b"\n", b".,;:!?", b"(){}[]\"'`", b"#$%&*+-/<=>@\\^_|~", bytes([*range(10), *range(11, 32), 127])]
TABLE = np.zeros(256, np.uint8)
for _k, _x in enumerate(KINDS):
    TABLE[np.frombuffer(_x, np.uint8)] = _k
#: Shares of kinds and shapes of words; buckets of hashed 3-grams, a power of two.
N_SHAPES, GRAM_BITS = len(KINDS) + 6, 7
N_FEATURES = N_SHAPES + (1 << GRAM_BITS)

#: How much a bucket of 3-grams counts beside another feature: there are many, and small samples fit chance in them.
GRAM_SHARE = 0.3


def grams(data: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The share of each bucket among a text's byte 3-grams, in small letters."""
    low = LOWER[data].astype(np.uint32)
    whole = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    bucket = (whole * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    inside = rows[2:] == rows[:-2]
    count = np.bincount((rows[2:][inside] << GRAM_BITS) + bucket[inside], minlength=n << GRAM_BITS).reshape(n, 1 << GRAM_BITS)
    return count / np.maximum(count.sum(1, keepdims=True), 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of shares per text, computed over all of it; a null or empty text has zeros."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    counts = np.bincount(rows * 16 + TABLE[data], minlength=16 * n).reshape(n, 16)[:, : len(KINDS)].astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    words = Words(column, SPACED)
    count, row = words.per_row, words.row
    least = np.maximum(count, 1).astype(float)
    repeated = np.zeros(n)
    if len(row) > 1:
        again = (words.code[1:] == words.code[:-1]) & (row[1:] == row[:-1])
        repeated = np.bincount(row[1:][again], minlength=n) / least
    pairs = np.unique(row * np.int64(len(words.distinct) + 1) + words.code)
    distinct = np.bincount(pairs // (len(words.distinct) + 1), minlength=n) / least
    # Words whose last byte is neither a letter, a digit nor a stop.
    ends = np.zeros(0, bool)
    if len(words.distinct):
        body, bounds = text_buffer(words.distinct)
        last = body[bounds[1:] - 1]
        ends = ~ALNUM[last] & (TABLE[last] != 6)
    marked = np.bincount(row, weights=ends[words.code], minlength=n) / least if len(row) else np.zeros(n)
    shares = counts / size[:, None]
    case = counts[:, 0] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    extra = [np.log1p(count) / 10, np.diff(offsets) / least / 20, repeated, distinct, marked, case]
    return np.column_stack([shares, *extra, grams(data, rows, n)]).reshape(n, N_FEATURES).astype(np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((expand(x) - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def expand(x: np.ndarray) -> np.ndarray:
    """Shares near zero matter most, so their roots go in, and the shapes as they are as well."""
    return np.column_stack([x[:, :N_SHAPES], np.sqrt(np.maximum(x, 0))])


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = 500, rate: float = 0.05, decay: float = 3e-3) -> np.ndarray:
    """Full-batch Adam. Without a prior: positives against unlabelled, plain."""
    p, u = (np.column_stack([x, np.ones(len(x), x.dtype)]) for x in (p, u))
    w, m, v = (np.zeros(p.shape[1], p.dtype) for _ in range(3))
    every = p.sum(0)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        minus_p, minus_u = p.T @ sigmoid(zp) / len(p), u.T @ sigmoid(zu) / len(u)  # of log(1 + exp(z))
        plus = minus_p - every / len(p)  # of log(1 + exp(-z)) over positives
        if prior is None:
            grad = plus + minus_u
        else:
            risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            rest = minus_u - prior * minus_p
            grad = prior * plus + rest if risk >= 0 else -rest
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The smallest upper-tail ratio of unlabelled to positive rows over all cuts, with a margin for chance."""
    if len(p) < 2 or len(u) < 2:
        return 0.5
    w = _fit(p[::2], u[::2], None, steps=300)
    zp, zu = (np.sort(x[1::2] @ w[:-1]) for x in (p, u))
    cuts = np.quantile(zp, np.linspace(0, 0.95, 96))
    above_p, above_u = (1 - np.searchsorted(z, cuts, "left") / len(z) for z in (zp, zu))
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    best = int(np.argmin((above_u + margin) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.05, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    """The model from features of positives and of unlabelled rows. Without either nothing can be told apart, and every score is 1."""
    if not len(p) or not len(u):
        size = N_SHAPES + N_FEATURES
        return Model(np.zeros(size), np.ones(size), np.append(np.zeros(size), 30.0), 0.5)
    p, u = expand(p), expand(u)
    mean, scale = u.mean(0, dtype=float).astype(u.dtype), u.std(0, dtype=float).astype(u.dtype) + np.float32(1e-2)
    scale[-(1 << GRAM_BITS) :] /= GRAM_SHARE
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    prior = estimate_prior(p, u)
    return Model(mean, scale, _fit(p, u, prior), prior)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))], names=["positive", "x"])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``sample_rows`` positives and as many unlabelled rows, outside the held-out fold.

    Rows are drawn by a hash of id and text, so the draw is the same on every run; how many there are of
    either kind is counted first (nearly, by distinct hashes), so neither a repeated row nor an id with many
    texts adds to what is drawn. A trusted positive that is drawn is not among the unlabelled. A document with
    labels of both kinds is not a trusted positive. Ids may be of any type that has a text. Null ids and
    texts are not drawn, and repeated rows count once. Without rows of either kind every score is 1.
    """
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min(label_col).alias("label")).where("label = 1").where(~held_out(F.col("id")))
    base = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    drawn = lambda what, *by: F.pmod(F.xxhash64(F.lit(what), *by), F.lit(1 << 30)) / float(1 << 30)
    # About sample_rows ids, whatever the table holds: safe to broadcast.
    good = good.where(drawn("positive", "id") < sample_rows / max(good.count(), 1)).select("id", F.lit(True).alias("positive"))
    both = base.join(F.broadcast(good), "id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    both = both.where(F.col("positive") | ~held_out(F.col("id"))).withColumn("key", F.xxhash64("id", "text"))
    there = {r["positive"]: r["n"] for r in both.groupBy("positive").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}
    share = F.when(F.col("positive"), sample_rows / max(there.get(True, 0), 1)).otherwise(sample_rows / max(there.get(False, 0), 1))
    both = both.where(drawn("row", "key") < share).dropDuplicates(["positive", "key"]).select("positive", "text")
    rows = both.mapInArrow(_features, "positive boolean, x array<float>").toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), N_FEATURES)
    positive = rows["positive"].to_numpy()
    order = np.lexsort(x.T)
    order = order[np.random.default_rng(3).permutation(len(x))]
    x, positive = x[order], positive[order].astype(bool)
    return fit(x[positive], x[~positive])


def _scored(model: Model, inside: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(opened(batches, inside), "text", SLICE_BYTES, SLICE_ROWS):
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(features(batch.column("text"))))], names=["row", "score"])


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, carry: Sequence[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``row`` (a struct of its columns, or of those to ``carry``), score, predicted. A null text counts as empty; repeated rows score alike; an empty table gives no rows."""
    out, inside = rows_with_text(docs, text_col, carry)
    scored = out.mapInArrow(partial(_scored, model, inside), T.StructType([out.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
