"""MinHash near-duplicate detection with tensored banding.

Two small collections of ``bands`` MinHash tuples (``rows`` values each) are made per text. A table
key pairs one tuple of either collection, so ``bands ** 2`` tables cost only ``2 * bands * rows``
MinHash values. Texts with equal shingle sets are one node from the start. In each table bucket the
members are tried against the smallest member (linear in the bucket), confirmed on full sets. Where
that leaves members of one bucket in different components, all texts involved (but those that an exact
bound on their rarest shingles rules out) meet in blocks inside tasks, which give back links only; so
every link between members of any bucket is found or implied, no bucket is capped, and no pairs are listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm._spark import broadcast_below, cut, named, one_by, row_key, whole, with_numbers
from weirstone.llm._text import SPACED, Words, hash_binary, lists, mix, per_slice
from weirstone.llm.components import connected_components

#: Nodes of texts whose every row lacks an id, and of further texts of an id; above all ids.
NO_ID = 1 << 62


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted in the row, and their number by row.

    A row with fewer words than ``shingle`` has its whole sequence as one; one without words has none.
    """
    words = Words(column, SPACED)
    by_word = hash_binary(words.distinct)[words.code]
    rows, count, n = words.row, words.per_row, len(words.code)
    place = np.arange(n)
    length = np.minimum(count, shingle)
    begins = place + length[rows] <= words.first[rows + 1] if n else np.zeros(0, bool)
    place, rows = place[begins], rows[begins]
    rolled = length[rows].astype(np.uint64)
    for i in range(shingle):
        used = i < length[rows]
        nxt = by_word[np.minimum(place + i, max(n - 1, 0))] if n else np.zeros(0, np.uint64)
        rolled = np.where(used, mix(rolled * np.uint64(0x9FB21C651E98DF25) + nxt), rolled)
    order = np.lexsort((rolled, rows))
    rolled, rows = rolled[order], rows[order]
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = (rolled[1:] != rolled[:-1]) | (rows[1:] != rows[:-1])
    return rolled[fresh], np.bincount(rows[fresh], minlength=len(count)).astype(np.int64)


def _signature(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """128 bits that stand for a whole set."""
    return [np.add.reduceat(mix(hashes ^ np.uint64(k)), starts) for k in (0x51ED270B35AE9A6D, 0x2545F4914F6CDD1D)]


def _sketch(shingle: int, bands: int, rows: int, seed: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, count = shingle_sets(batch.column("text"), shingle)
    n, full = len(count), np.flatnonzero(count)
    ends = np.cumsum(count)
    starts = (ends - count)[full]
    sig = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    tuples = np.zeros((n, 2 * bands), np.uint64)
    if len(full):
        for out, value in zip(sig, _signature(hashes, starts), strict=True):
            out[full] = value
        random = np.random.default_rng(seed)
        factor = random.integers(1 << 62, 1 << 63, 2 * bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offset = random.integers(0, 1 << 63, 2 * bands * rows, dtype=np.uint64)
        work = np.empty_like(hashes)
        for band in range(2 * bands):
            value = np.zeros(len(full), np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                np.multiply(hashes, factor[k], out=work)
                np.add(work, offset[k], out=work)
                value = mix(value * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(work, starts))
            tuples[full, band] = value
    fixed = np.full(n, bands)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("hash"), pa.array(count), *(pa.array(x.view(np.int64)) for x in sig), *(lists(np.ascontiguousarray(part).view(np.int64).ravel(), fixed) for part in (tuples[:, :bands], tuples[:, bands:]))],
        names=["doc_id", "hash", "n_shingles", "sig1", "sig2", "a", "b"],
    )


def _sets(shingle: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, count = shingle_sets(batch.column("text"), shingle)
    full = np.flatnonzero(count)
    starts = (np.cumsum(count) - count)[full]
    sig = _signature(hashes, starts) if len(full) else [np.zeros(0, np.uint64)] * 2
    return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in sig), lists(hashes.view(np.int64), count[full])], names=["sig1", "sig2", "shingles"])


def _near(threshold: int, n: str, m: str) -> str:
    """The sizes alone don't rule a link out."""
    return f"100 * least({n}, {m}) >= {threshold} * greatest({n}, {m})"


def _read_sets(base: DataFrame, classes: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the given nodes; only texts of their smallest ids, and those without an id, are made into sets."""
    wanted = broadcast_below(cut(classes.join(nodes, "node", "left_semi").select("node", F.col("first.doc_id").alias("doc_id"), "sig1", "sig2")), 72)
    texts = base.join(wanted.select("doc_id"), "doc_id", "left_semi").union(base.where("doc_id is null"))
    sets = texts.mapInArrow(per_slice(partial(_sets, shingle), "text"), "sig1 long, sig2 long, shingles array<long>")
    return sets.join(wanted.drop("doc_id"), ["sig1", "sig2"]).select("node", "shingles").dropDuplicates(["node"])


def _confirmed(sets: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (x, y) that hold on full sets, as edges (a, b)."""
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy")).cast("long")
    out = pairs.join(left, "x").join(right, "y").select("x", "y", both.alias("both"), (F.size("sx") + F.size("sy")).cast("long").alias("sizes"))
    return cut(out.where(F.expr(f"100 * both >= {threshold} * (sizes - both)")).select(F.col("x").alias("a"), F.col("y").alias("b")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()


def _rest(met: DataFrame, found: DataFrame) -> DataFrame:
    """(node, n, component) of the members of buckets that span several components."""
    rest = cut(met.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = cut(rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
    return cut(rest.join(mixed, "key", "left_semi").select("node", "n", "component").distinct())


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The intersection sizes of all sets of one list with all of the other."""
    shape = (len(left), len(right))
    out = np.zeros(shape, np.int32)
    if not left or not right:
        return out
    (a, i), (b, j) = ((np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (left, right))
    common = np.intersect1d(a, b)
    (a, i), (b, j) = ((np.searchsorted(common, x[ok]), row[ok]) for x, row in ((a, i), (b, j)) for ok in [np.isin(x, common)])
    a_order, b_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, i, b, j = a[a_order], i[a_order], b[b_order], j[b_order]
    n_a, n_b = np.bincount(a, minlength=len(common)), np.bincount(b, minlength=len(common))
    # Shingles of few texts: count their pairs. The others: products of 0/1 matrices, some columns at a time.
    rare = n_a * n_b <= 64
    times = np.where(rare[a], n_b[a], 0)
    begin = (np.cumsum(n_b) - n_b)[a]
    for some in np.array_split(np.arange(len(a)), 1 + int(times.sum()) // PAIRS_AT_ONCE):
        inside = np.arange(times[some].sum()) - np.repeat(np.cumsum(times[some]) - times[some], times[some])
        cell = np.repeat(i[some] * shape[1], times[some]) + j[np.repeat(begin[some], times[some]) + inside]
        cell, n = np.unique(cell, return_counts=True)
        out.ravel()[cell] += n.astype(np.int32)
    often = np.flatnonzero(~rare)
    for k in range(0, len(often), 1024):
        some = often[k : k + 1024]
        parts = []
        for token, row, n in ((a, i, len(left)), (b, j, len(right))):
            at = np.searchsorted(some, token)
            ok = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == token)
            dense = np.zeros((n, len(some)), np.float32)
            dense[row[ok], at[ok]] = 1
            parts.append(dense)
        out += (parts[0] @ parts[1].T).astype(np.int32)  # whole numbers below 2 ** 24 are exact
    return out


def links(threshold: int, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): one linked pair of nodes for every two components with a link between two blocks of (node, component, sets)."""
    (node_a, comp_a, sets_a), (node_b, comp_b, sets_b) = left, right
    none = np.zeros(0, np.int64)
    if not len(node_a) or not len(node_b) or (np.concatenate([comp_a, comp_b]) == comp_a[0]).all():
        return none, none
    both = _overlaps(sets_a, sets_b)
    size_a, size_b = (np.array([len(x) for x in sets], np.int64) for sets in (sets_a, sets_b))
    if max(size_a.max(), size_b.max()) < 5_000_000:  # else the products below need more bits
        both, size_a, size_b = (x.astype(np.int32) for x in (both, size_a, size_b))
    else:
        both = both.astype(np.int64)
    linked = both * (100 + threshold) >= threshold * (size_a[:, None] + size_b[None])  # 100 * both >= threshold * union
    linked &= comp_a[:, None] != comp_b[None]
    x, y = np.nonzero(linked)
    ends = np.sort(np.column_stack([comp_a[x], comp_b[y]]), 1)
    _, first = np.unique(ends, axis=0, return_index=True) if len(ends) else (None, np.zeros(0, int))
    return node_a[x[first]], node_b[y[first]]


def _links(threshold: int, group: pa.Table) -> pa.Table:
    """The links between the two blocks of a group; one block with itself where only that is there."""
    side = group["side"].to_numpy()
    node, component = group["node"].to_numpy(), group["component"].to_numpy()
    sets = [x.values.to_numpy(zero_copy_only=False) for x in group["shingles"].combine_chunks()]
    blocks = [(node[at], component[at], [sets[k] for k in at]) for at in (np.flatnonzero(side == k) for k in (0, 1))]
    a, b = links(threshold, blocks[0], blocks[1] if len(blocks[1][0]) else blocks[0])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


#: Texts and shingles, on average, in a block of texts that meets another one; pairs that are counted at once.
BLOCK_TEXTS, BLOCK_SHINGLES, PAIRS_AT_ONCE = 768, 200_000, 1 << 22

#: A smaller cluster is dealt as well: into at most so many blocks, which its texts are copied to, of so many texts.
FEW_BLOCKS, SMALL_TEXTS = 8, 64

#: Bits of a shingle that choose its place in the table of counts, which is 2 MB whatever the input.
COUNT_BITS = 18


def _lead(threshold: int, counts: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, node, component): of each set the shingles that come first, the rarest ones leading."""
    often = counts.value
    for batch in batches:
        column = batch.column("shingles")
        values, n = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((values, often[values & (len(often) - 1)], row))
        place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
        reach = n - -(-n * threshold // 100) + 1
        taken = order[place < reach[row]]
        at = pa.array(row[taken])
        yield pa.RecordBatch.from_arrays([pa.array(values[taken]), batch.column("node").take(at), batch.column("component").take(at)], names=["s", "node", "component"])


def _rare_first(sets: DataFrame, rest: DataFrame, threshold: int) -> DataFrame:
    """(node, n, component, cluster) of the texts that may have a link into another component.

    Shingles have one order for all: the rarer by a table of counts first (of fixed size, by some of
    the hash's bits), then by hash. Of two linked sets, each as long a list of its first shingles as
    its size allows shares one with the other's. So a text stays only if such a shingle of its own is
    in another component's list too, and texts that no chain of them connects never meet.
    """
    spark = sets.sparkSession
    mask = (1 << COUNT_BITS) - 1
    table = sets.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(mask)).alias("at")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[table["at"].to_numpy()] = table["n"].to_numpy()
    fn = partial(_lead, threshold, spark.sparkContext.broadcast(counts))
    lead = cut(sets.join(rest.select("node", "component"), "node").select("node", "component", "shingles").mapInArrow(fn, "s long, node long, component long"))
    shared = cut(lead.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("least")).where("lo < hi").select("s", "least"))
    tied = cut(lead.join(shared, "s").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    clusters = connected_components(tied).withColumnRenamed("component", "cluster")
    return rest.join(clusters, "node").select("node", "n", "component", "cluster")


def _meetings(members: DataFrame, threshold: int) -> DataFrame:
    """(node, component, group columns, side): who meets whom, block by block.

    Sizes go in classes that grow by 100 / threshold, so a link joins texts of one class or of
    neighbouring ones. A class of a cluster is dealt into blocks by a hash; their number follows from
    its texts and shingles, so no task numbers or sorts a cluster.
    """
    # A little wider than 100 / threshold, so that rounding never sets linked texts two classes apart.
    kind = F.floor(F.ln(F.col("n").cast("double")) / (math.log(100 / threshold) * (1 + 1e-6))).cast("int") if threshold < 100 else F.col("n").cast("int")
    members = cut(members.withColumn("kind", kind))
    load = members.groupBy("cluster", "kind").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    load = load.select("cluster", "kind", "lo", "hi", F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("shingles") / BLOCK_SHINGLES, F.least(F.col("texts") / SMALL_TEXTS, F.lit(FEW_BLOCKS)))).cast("int").alias("blocks"))
    above = load.select("cluster", (F.col("kind") - 1).alias("kind"), F.col("blocks").alias("above"), F.col("lo").alias("lo_above"), F.col("hi").alias("hi_above"))
    below = load.select("cluster", (F.col("kind") + 1).alias("kind"), F.col("blocks").alias("below"), F.col("lo").alias("lo_below"), F.col("hi").alias("hi_below"))
    # Classes that are of one component together need not meet.
    load = load.join(above, ["cluster", "kind"], "left").join(below, ["cluster", "kind"], "left")
    load = load.select("cluster", "kind", "blocks", (F.col("lo") < F.col("hi")).alias("inside"), F.when(F.least("lo", "lo_above") < F.greatest("hi", "hi_above"), F.col("above")).alias("above"), F.when(F.least("lo", "lo_below") < F.greatest("hi", "hi_below"), F.col("below")).alias("below"))
    load = cut(load.where("inside or above is not null or below is not null"))
    placed = members.join(load, ["cluster", "kind"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = "if(inside, transform(sequence(0, blocks - 1), o -> struct(kind as k1, least(block, o) as b1, kind as k2, greatest(block, o) as b2, int(block > o) as side)), array())"
    up = "if(above is null, array(), transform(sequence(0, above - 1), o -> struct(kind as k1, block as b1, kind + 1 as k2, o as b2, 0 as side)))"
    down = "if(below is null, array(), transform(sequence(0, below - 1), o -> struct(kind - 1 as k1, o as b1, kind as k2, block as b2, 1 as side)))"
    return placed.select("node", "component", "cluster", F.explode(F.expr(f"concat({own}, {up}, {down})")).alias("m")).select("node", "component", "cluster", "m.*")


def _settle(base: DataFrame, classes: DataFrame, met: DataFrame, edges: DataFrame, found: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Components once all members of the buckets in ``met`` (key, node, n) that may still link have been tried.

    Texts of buckets that span several components are thinned out and gathered by their rarest
    shingles; within such a cluster, blocks of texts of like size meet in tasks of bounded memory,
    which give links only, no pairs.
    """

    def between(group: pa.Table) -> pa.Table:
        return _links(threshold, group)

    rest = _rest(met.select("key", "node", "n"), found)
    if rest.isEmpty():
        return found
    sets = cut(_read_sets(base, classes, rest.select("node"), shingle))
    members = _rare_first(sets, rest, threshold)
    meet = cut(_meetings(members, threshold)).join(sets, "node")
    more = cut(meet.groupBy("cluster", "k1", "b1", "k2", "b2").applyInArrow(between, "a long, b long"))
    return found if more.isEmpty() else connected_components(edges.union(more))


def _bucket_members(classes: DataFrame, bands: int) -> DataFrame:
    """(key, node, n, rep, rep_n): members of table buckets with each bucket's smallest node, which is left out.

    A table key needs both its tuples to be shared, so keys are made of shared tuples only. A hot
    bucket is never one task's: its smallest member comes from a partial aggregation, and the join
    that hands it out can be split.
    """
    tuples = classes.select("node", F.posexplode(F.concat("a", "b")).alias("t", "v")).select("node", "t", F.xxhash64("t", "v").alias("v"))
    shared = cut(tuples.groupBy("v").agg(F.count("*").alias("texts")).where("texts > 1").select("v"))
    held = cut(tuples.join(shared, "v").groupBy("node").agg(F.collect_list(F.when(F.col("t") < bands, F.col("v"))).alias("a"), F.collect_list(F.when(F.col("t") >= bands, F.col("v"))).alias("b")).where("size(a) > 0 and size(b) > 0"))
    # Classes by node: their sizes come with them.
    held = held.join(classes.select("node", "n"), "node")
    keys = cut(held.select("node", "n", F.explode(F.expr("flatten(transform(a, x -> transform(b, y -> xxhash64(x, y))))")).alias("key")))
    least = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.max("node").alias("last")).where("least.node < last")
    met = keys.join(cut(least.select("key", F.col("least.node").alias("rep"), F.col("least.n").alias("rep_n"))), "key")
    return cut(met.where("rep <> node").select("key", "node", "n", "rep", "rep_n"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int, bands: int, rows: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches of all rows; classes of equal sets: node, sig1, sig2, first; component of each node that has a link).

    ``first`` is the class's row with the smallest id, and of one id the smallest hash of the text; rows without an id come last.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = base.withColumn("hash", F.xxhash64("text"))
    schema = "doc_id long, hash long, n_shingles long, sig1 long, sig2 long, a array<long>, b array<long>"
    sketches = cut(hashed.mapInArrow(per_slice(partial(_sketch, shingle, bands, rows, seed), "text"), schema))
    classes = cut(sketches.where("n_shingles > 0").groupBy("sig1", "sig2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash")).alias("first"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")))
    # A class has its smallest id for a node, so that buckets agree on the smallest member; of several with one id, the first has.
    own = F.lit(NO_ID) + F.shiftrightunsigned("sig1", 3)
    shared = classes.where("first.doc_id is not null").groupBy(F.col("first.doc_id").alias("shared")).agg(F.min("first.hash").alias("named"), F.count("*").alias("texts"))
    shared = cut(shared.where("texts > 1").select("shared", "named"))
    if shared.isEmpty():
        classes = classes.withColumn("node", F.coalesce("first.doc_id", own))
    else:
        classes = classes.join(broadcast_below(shared, 16), F.col("first.doc_id") == F.col("shared"), "left")
        classes = cut(classes.withColumn("node", F.when(F.col("first.hash") != F.col("named"), own).otherwise(F.coalesce("first.doc_id", own))).drop("shared", "named"))
    met = _bucket_members(classes, bands)
    pairs = cut(met.where(_near(threshold, "n", "rep_n")).select(F.col("node").alias("x"), F.col("rep").alias("y")).distinct())
    # Written out, so that both joins with the sets have plain shuffles, which adaptive execution splits where one text is in many pairs.
    edges = _confirmed(cut(_read_sets(base, classes, _ends(pairs), shingle)), pairs, threshold)
    return sketches, classes, _settle(base, classes, met, edges, connected_components(edges), shingle, threshold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, threshold: int = 80, bands: int = 13, rows: int = 3, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Texts are lower-cased (A-Z) and cut at white space. Two are linked if 100 * intersection >=
    threshold * union of their sets of distinct word shingles; a pair at a similarity s shares a
    table with probability (1 - (1 - s ** rows) ** bands) ** 2, about 0.9998 at 0.8 as set here (and
    at 0.85 with 10 bands).

    Null and empty texts have no shingles and are linked with nothing. Rows with the same text are
    one component. A row without an id gets the smallest id of its component, or null if none has
    one, and is not kept; repeated ids each follow their own text. Ids have any type with an order; those that
    are no whole numbers are numbered first. An empty table gives no rows.
    """
    if not whole(docs, id_col):
        told, ids = with_numbers(docs.select(id_col, text_col), id_col)
        found = near_duplicates(told, "_number", text_col, shingle=shingle, threshold=threshold, bands=bands, rows=rows, seed=seed)
        return named(found, ids, "doc_id", "component_id")
    sketches, classes, found = _grouped(docs, id_col, text_col, shingle, threshold, bands, rows, seed)
    linked = found.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    # Cut, so that the join has plain shuffles on both sides; nodes without links stay out of it, as a null component would be one key.
    tied = found.join(cut(linked), "component").select("node", "component_id", F.lit(True).alias("linked"))
    place = classes.join(tied, "node", "left").select("sig1", "sig2", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first.doc_id")).alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "sig1", "sig2").join(place, ["sig1", "sig2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, threshold: int = 80, bands: int = 13, rows: int = 3, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that stay if one of each component of near-duplicates does: that with the smallest id, or one of those without.

    Rows of one id and one text count as one; other texts of an id are documents of their own. Texts
    without words are linked with nothing, so all of them stay, and all rows of those without an id.
    Ids have any type with an order; those that are no whole numbers are numbered first.
    """
    if not whole(docs, id_col):
        rows_of, _ = with_numbers(docs, id_col)
        return one_of_each(rows_of, "_number", text_col, shingle=shingle, threshold=threshold, bands=bands, rows=rows, seed=seed).select(*(f"`{n}`" for n in docs.columns))
    sketches, classes, found = _grouped(docs, id_col, text_col, shingle, threshold, bands, rows, seed)
    linked = found.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("first"))
    firsts = linked.select("first.*").union(classes.join(found, "node", "left_anti").select("first.*"))
    wordless = sketches.where("n_shingles = 0 and doc_id is not null").select(F.lit(False).alias("nameless"), "doc_id", "hash")
    key = ["nameless", "id", "hash"]
    firsts = cut(firsts.union(wordless.distinct()).select("nameless", F.coalesce("doc_id", F.lit(0)).alias("id"), "hash"))
    nameless, worded = docs.where(F.col(id_col).isNull()), F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    # Copies without an id collapse before the shuffle, as they all have one key.
    some = docs.where(F.col(id_col).isNotNull()).unionByName(nameless.where(worded).dropDuplicates([text_col]))
    held = some.select(F.struct("*").alias("row"), row_key(some)[0].alias("whole"), F.col(id_col).isNull().alias("nameless"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    kept = one_by(held.join(firsts, key, "left_semi"), key, "row", F.col("whole"))
    return kept.select("row.*").unionByName(nameless.where(~worded))
