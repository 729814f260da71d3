"""Near-duplicate vectors by spherical-cap filters.

Filters are the directions of a product code: a rotated vector is cut into blocks, each block has
some random words, and a filter is one word of every block. A vector belongs to the filters whose
inner product with it exceeds a threshold. They are list-decoded: words are chosen block by block,
and a beginning that the best of the other blocks can't bring over the threshold is dropped, so a
few dozen filters out of millions cost little more than the products with single words.

Vectors that share a filter meet, and each pair is verified in double precision. Equal vectors are
one from the start. Where many share a filter they meet in blocks; tasks return sums of links and
edges that span what is connected, never the pairs. A pair counts in the smallest filter it shares.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm._spark import cut
from weirstone.llm._text import lists
from weirstone.llm.components import connected_components

#: Filters that a pair at the threshold shares on average; vectors that a filter holds on average, if they had nothing in common.
COMMON, LOAD = 24, 0.25

#: Codes, each over a rotation of its own: how many filters of one code a vector has varies much, their sum less.
TURNS = 16

#: A filter holds a vector with at least and at most this probability; words of a block at most.
LEAST, MOST, WORDS = 1e-6, 1e-2, 2048

#: Vectors in a block that meets another one; rows in a group of small filters; vectors decoded at once.
BLOCK, GROUP_ROWS, AT_ONCE = 1024, 4096, 2048

#: Bits of a filter's number; above them is the number of components, so that only vectors of one length meet.
CODE_BITS = 42


@dataclass(frozen=True)
class Code:
    """Threshold of the filters; number of product codes, and blocks and words of each."""

    threshold: float
    turns: int
    blocks: int
    words: int

    @property
    def filters(self) -> int:
        return self.words**self.blocks


def choose_code(n: int, cosine: float, dim: int) -> Code:
    """The code for ``n`` vectors: filters so small that vectors without a likeness rarely share one, and so many that a pair at ``cosine`` shares ``COMMON``.

    Products of a unit vector with a normal word are normal, and those of a pair are normal together
    with ``cosine`` as correlation, whatever the vectors; the number of filters follows from that.
    """
    p = min(max(LOAD / max(n, 1), LEAST), MOST)
    t = NormalDist().inv_cdf(1 - p)
    x = np.linspace(t, t + 8, 4001)
    rest = math.sqrt(max(1 - cosine * cosine, 1e-12))
    above = np.array([0.5 * math.erfc((t - cosine * v) / rest / math.sqrt(2)) for v in x])
    both = float(np.sum(np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * above) * (x[1] - x[0]))
    filters = COMMON / both / TURNS
    blocks = min(max(2, math.ceil(math.log(filters) / math.log(WORDS))), dim)
    return Code(t, TURNS, blocks, math.ceil(filters ** (1 / blocks)))


def _units(values: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def word_products(units: np.ndarray, code: Code, turn: int, seed: int) -> list[np.ndarray]:
    """By block, the products of all vectors with the block's words, for one of the code's rotations."""
    dim = units.shape[1]
    random = np.random.default_rng([seed, turn, dim])
    turned = units @ np.linalg.qr(random.standard_normal((dim, dim)))[0]
    bounds = np.linspace(0, dim, code.blocks + 1).astype(int)
    return [turned[:, a:b] @ random.standard_normal((b - a, code.words)) for a, b in zip(bounds, bounds[1:], strict=False)]


def list_decode(products: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter number) of all filters over the threshold, by row and number.

    A word counts only if the best words of the other blocks bring it over the threshold; what has been chosen so
    far goes on with the words that are good enough beside the best of the blocks to come.
    """
    n, words = products[0].shape
    best = np.array([x.max(1) for x in products])
    row, held, number = np.arange(n), np.zeros(n), np.zeros(n, np.int64)
    for k, x in enumerate(products):
        at, word = np.nonzero(x >= (threshold - best.sum(0) + best[k])[:, None])
        value = x[at, word]
        order = np.lexsort((-value, at))
        at, word, value = at[order], word[order], value[order]
        # One rising axis for all rows: each row's products, negated, in a span of its own.
        span = 2 * np.abs(x).max() + 1
        need = threshold - best[k + 1 :].sum(0)
        wanted = np.clip(held - need[row], -span / 2, span / 2)
        begin = np.searchsorted(at, row)
        count = np.maximum(np.searchsorted(at * span - value, row * span + wanted, "right") - begin, 0)
        place = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        row, held, number = (np.repeat(y, count) for y in (row, held, number))
        held, number = held + value[place], number * words + word[place]
    order = np.lexsort((number, row))
    return row[order], number[order]


def filters_of(units: np.ndarray, code: Code, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter number) of all vectors over all rotations, by row and number."""
    found = [list_decode(word_products(units, code, turn, seed), code.threshold) for turn in range(code.turns)]
    row, number = np.concatenate([r for r, _ in found]), np.concatenate([f + turn * code.filters for turn, (_, f) in enumerate(found)])
    order = np.lexsort((number, row))
    return row[order], number[order]


def _list_filters(code_of: Callable[[int], Code], seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            same = batch.take(pa.array(np.flatnonzero(sizes == dim)))
            for start in range(0, same.num_rows, AT_ONCE):
                part = same.slice(start, AT_ONCE)
                units = _units(part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                code = code_of(int(dim))
                row, number = filters_of(units, code, seed)
                found = lists(number + (int(dim) << CODE_BITS), np.bincount(row, minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "filters"])


def _earlier(x: list[np.ndarray], y: list[np.ndarray], own: int) -> np.ndarray:
    """Which of x share a filter below ``own`` with which of y."""
    out = np.zeros((len(x), len(y)), bool)
    (a, i), (b, j) = ((np.concatenate(side), np.repeat(np.arange(len(side)), [len(z) for z in side])) for side in (x, y))
    (a, i), (b, j) = ((v[v < own], r[v < own]) for v, r in ((a, i), (b, j)))
    both = np.intersect1d(a, b)
    for k in range(0, len(both), 1024):
        some, parts = both[k : k + 1024], []
        for value, at, size in ((a, i, len(x)), (b, j, len(y))):
            place = np.searchsorted(some, value)
            ok = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == value)
            dense = np.zeros((size, len(some)), np.float32)
            dense[at[ok], place[ok]] = 1
            parts.append(dense)
        out |= parts[0] @ parts[1].T > 0
    return out


def _spanning(size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``size`` places is connected with."""
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def meet(cosine: float, own: int, left: tuple, right: tuple | None) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """What two blocks of a filter's members (or one with itself) give: (node, links) and (node, connected node), with True for the latter.

    A block: nodes, copies, unit vectors, filters. Sums count a pair only if it shares no filter below ``own``.
    """
    (node, copies, units, filters), other = left, right or left
    near = units @ other[2].T >= cosine
    if right is None:
        near = np.triu(near, 1)
    if not near.any():
        return []
    x, y = np.nonzero(near)
    shift = 0 if right is None else len(node)
    every = node if right is None else np.concatenate([node, other[0]])
    label = _spanning(len(every), x, y + shift)
    moved = np.flatnonzero(label != np.arange(len(label)))
    rows, cols = np.unique(x), np.unique(y)
    near = near[np.ix_(rows, cols)] & ~_earlier([filters[k] for k in rows], [other[3][k] for k in cols], own)
    near = near.astype(np.float64)  # sums of whole numbers below 2 ** 53 are exact
    sums = [(node[rows], near @ other[1][cols].astype(np.float64)), (other[0][cols], near.T @ copies[rows].astype(np.float64))]
    return [(a[b > 0], b[b > 0].astype(np.int64), False) for a, b in sums] + [(every[moved], every[label[moved]], True)]


def _meet_all(cosine: float, key: tuple, group: pa.Table) -> pa.Table:
    """All meetings of a group: the blocks b1 and b2 of one filter, or small filters, each with itself."""
    number, side = group["filter"].to_numpy(), group["side"].to_numpy()
    order = np.lexsort((side, number))
    group, number, side = group.take(pa.array(order)).combine_chunks(), number[order], side[order]
    node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    vectors, filters = (group[name].combine_chunks() for name in ("vector", "filters"))
    bounds = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number))
    out = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        units = _units(vectors[lo:hi].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1))
        listed = [x.values.to_numpy() for x in filters[lo:hi]]
        split = lo + int(np.searchsorted(side[lo:hi], 1))
        left, right = ((node[a:b], copies[a:b], units[a - lo : b - lo], listed[a - lo : b - lo]) for a, b in ((lo, split), (split, hi)))
        if key[1].as_py() == key[2].as_py():
            out += meet(cosine, number[lo], left, None)
        elif len(left[0]) and len(right[0]):
            out += meet(cosine, number[lo], left, right)
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in (0, 1))
    kind = np.concatenate([np.zeros(0, bool), *(np.full(len(x[0]), x[2]) for x in out)])
    return pa.table({"a": a, "b": b, "edge": kind})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, cosine: float = 0.95, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked directly), component_id (smallest id reachable over links), kept.

    Rows are linked if found and of a cosine of at least ``cosine`` in double precision. A pair at
    the threshold shares ``COMMON`` filters on average; how many are missed is measured in the
    tests, and no pair below the threshold is ever linked.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths not with each other. Repeated rows link like any equal vectors. A row
    without an id gets the smallest id of its component, or null, and is not kept. An empty table gives
    no rows. Other columns are ignored; ids have any type with an order.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    usable = F.coalesce(F.expr("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"), F.lit(False))
    rows = rows.select("vec_id", F.when(usable, F.col("vector")).alias("vector"))
    signed = rows.where("vector is not null").select("vec_id", F.xxhash64("vector").alias("sig1"), F.xxhash64(F.lit("again"), "vector").alias("sig2"), "vector")
    classes = signed.groupBy("sig1", "sig2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    total = classes.count()

    kind = rows.schema["vector"].dataType.simpleString()
    code_of = partial(choose_code, total, cosine)
    listed = cut(classes.select("node", "copies", "vector").mapInArrow(partial(_list_filters, code_of, seed), f"node long, copies long, vector {kind}, filters array<long>"))
    held = listed.select("node", F.explode("filters").alias("filter"))
    shared = cut(held.groupBy("filter").agg(F.count("*").alias("members")).where("members > 1"))
    groups = 1 + (shared.agg(F.sum("members")).first()[0] or 0) // GROUP_ROWS
    # A vector travels with those of its filters that others share. A filter of many members goes in blocks, each of which meets each; small filters share groups.
    own = held.join(shared.hint("merge"), "filter").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("filter", "members"))).alias("own"))
    joined = own.join(listed.drop("filters").hint("merge"), "node").select("node", "copies", "vector", F.col("own.filter").alias("filters"), F.explode("own").alias("f"))
    joined = joined.select("node", "copies", "vector", "filters", "f.filter", F.ceil(F.col("f.members") / block).cast("int").alias("blocks"))
    joined = joined.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    joined = joined.withColumn("group", F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("filter"), F.lit(groups))).otherwise(F.col("filter")))
    meetings = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(block, o) as b1, greatest(block, o) as b2, int(block > o) as side))")
    joined = joined.withColumn("m", F.explode(meetings)).select("node", "copies", "vector", "filters", "filter", "group", "m.*")

    def together(key: tuple, group: pa.Table) -> pa.Table:
        return _meet_all(cosine, key, group)

    found = cut(joined.groupBy("group", "b1", "b2").applyInArrow(together, "a long, b long, edge boolean"))
    links = found.where("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    components = connected_components(found.where("edge").select("a", "b"))
    named = components.join(classes.select("node", "first"), "node")
    named = named.join(cut(named.groupBy("component").agg(F.min("first").alias("least"))), "component").select("node", "least")
    place = classes.select("node", "sig1", "sig2", "copies", "first").join(links, "node", "left").join(named, "node", "left")
    place = cut(place.select("sig1", "sig2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id")))
    out = signed.select("vec_id", "sig1", "sig2").join(place.hint("merge"), ["sig1", "sig2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
