"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets of similar length. Every query first meets the
longest vectors, which gives it a lower bound of its k-th score. For any other bucket the bound,
divided by both lengths, is a cosine threshold that is local to the bucket: above 1 the bucket is
skipped; high, the query's largest coordinate bounds that coordinate of any answer (coordinate
pruning); else the vectors too short for the bound are left out (length pruning). What stays is
verified by its full product, a block of queries at once. Which blocks of queries need which buckets
is known from bounds and lengths before any vectors move; only those pairs are joined with bodies.
Every row has a key of its own, so rows that repeat are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.llm._spark import cut, named, numbered, whole, with_numbers

#: Vectors in a bucket; queries in a block.
BUCKET_ROWS, QUERY_ROWS = 4096, 512

#: Lengths that the driver holds to tell which buckets a bound allows.
STEPS = 512

#: From this local cosine on, coordinates prune more than lengths do.
COORDINATE_FROM = 0.6

PACKED = "rows int, dim int, width int, ids array<long>, keys array<long>, body binary"


def _pack(ids: np.ndarray, keys: np.ndarray, vectors: list[np.ndarray]) -> dict:
    """Vectors as one block, padded with zeros to the longest, in as few bytes a component as hold all."""
    dim = max((len(x) for x in vectors), default=0)
    body = np.zeros((len(vectors), dim), np.int64)
    for i, x in enumerate(vectors):
        body[i, : len(x)] = x
    width = next(w for w in (2, 4, 8) if w == 8 or not body.size or (-(1 << 8 * w - 1) <= body.min() and body.max() < 1 << 8 * w - 1))
    return {"rows": len(vectors), "dim": dim, "width": width, "ids": ids.tolist(), "keys": keys.tolist(), "body": body.astype(f"<i{width}").tobytes()}


def _blocks(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows (number, vec_id, vector) as blocks of rows whose numbers agree by ``size``; a row's number is its key."""
    held: dict[int, list] = {}
    schema = pa.schema([("block", pa.int64()), ("rows", pa.int32()), ("dim", pa.int32()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("body", pa.binary())])

    def out(number: int) -> pa.RecordBatch:
        rows = held.pop(number)
        keys, ids, vectors = zip(*rows, strict=True)
        return pa.RecordBatch.from_pylist([{"block": number, **_pack(np.array(ids), np.array(keys), vectors)}], schema)

    for batch in batches:
        numbers, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "vec_id"))
        for key, i, x in zip(numbers, ids, batch.column("vector"), strict=True):
            number = key // size
            if number not in held:
                for old in list(held):
                    yield out(old)
                held[number] = []
            held[number].append((key, i, x.values.to_numpy(zero_copy_only=False)))
    for old in list(held):
        yield out(old)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, keys = np.array(row["ids"], np.int64), np.array(row["keys"], np.int64)
    return ids, keys, np.frombuffer(row["body"], f"<i{row['width']}").reshape(row["rows"], row["dim"]).astype(np.int64)


def _fit(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def products(queries: np.ndarray, body: np.ndarray) -> np.ndarray:
    """All inner products, exact; those beyond a 64-bit number count as its end."""
    most = float(queries.shape[1]) * np.abs(queries.astype(float)).max(initial=0) * np.abs(body.astype(float)).max(initial=0)
    if most < 2.0**53:
        return (queries.astype(float) @ body.astype(float).T).astype(np.int64)
    if most < 2.0**62:
        return queries @ body.T
    exact = queries.astype(object) @ body.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64) if exact.size else np.zeros(exact.shape, np.int64)


def candidates(queries: np.ndarray, bounds: np.ndarray, body: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(query, vector): whether a score of at least the query's bound is possible, for vectors by falling length."""
    norms = np.sqrt((queries.astype(float) ** 2).sum(1))
    sure = bounds > 0
    least = np.where(sure, bounds * (1 - 1e-9) / np.maximum(norms, 1e-300), -np.inf)  # the shortest length that may do
    out = lengths[None] >= least[:, None]
    local = least / max(lengths.max(initial=0), 1e-300)  # the cosine that the longest vector would need
    for c in np.unique(np.argmax(np.abs(queries), 1)) if queries.shape[1] and len(body) else ():
        some = np.flatnonzero((np.argmax(np.abs(queries), 1) == c) & sure & (local >= COORDINATE_FROM) & (local <= 1))
        if len(some):
            unit = body[:, c] / np.maximum(lengths, 1e-300)
            q, need = queries[some, c] / norms[some], local[some]
            reach = np.sqrt(np.maximum(0.0, 1 - need * need) * np.maximum(0.0, 1 - q * q)) + 1e-9
            # A unit vector within the angle of a query has its coordinate near that of the query, times cosines from need to 1.
            low, high = np.minimum(q * need, q) - reach, np.maximum(q * need, q) + reach
            out[some] &= (unit[None] >= low[:, None]) & (unit[None] <= high[:, None])
    return out


def best_of(queries: np.ndarray, own: np.ndarray, bounds: np.ndarray, ids: np.ndarray, body: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score): of each query the k best vectors of a bucket, among scores of at least its bound; ties to smaller ids."""
    may = candidates(queries, bounds, body, lengths) & (own[:, None] != ids[None])
    places = np.flatnonzero(may.any(0))
    may = may[:, places]
    scores = products(queries, body[places])
    may &= scores >= np.where(np.isfinite(bounds), bounds, -np.inf)[:, None]
    if len(places) > k:
        floor = np.where(may, scores, np.iinfo(np.int64).min)
        may &= scores >= np.partition(floor, len(places) - k, axis=1)[:, len(places) - k][:, None]
    query, at = np.nonzero(may)
    score, at = scores[query, at], places[at]
    order = np.lexsort((ids[at], np.invert(score), query))  # the highest score first, without the overflow of its negative
    query, at, score = query[order], at[order], score[order]
    count = np.bincount(query, minlength=len(queries))
    nth = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
    return query[nth < k], at[nth < k], score[nth < k]


def _met(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a bucket and a block of queries (with bounds, or null): each query's best of the bucket."""
    held = None
    for batch in batches:
        for row in batch.to_pylist():
            if held is None or held[0] != row["bucket"]:
                ids, keys, body = _unpack(row["b"])
                lengths = np.sqrt((body.astype(float) ** 2).sum(1))
                held = (row["bucket"], ids, keys, body, lengths)
            _, ids, keys, body, lengths = held
            q_ids, q_keys, queries = _unpack(row["q"])
            dim = max(body.shape[1], queries.shape[1])
            bounds = np.array(row["bounds"], float) if row["bounds"] else np.full(len(q_ids), -np.inf)
            query, at, score = best_of(_fit(queries, dim), q_ids, bounds, ids, _fit(body, dim), lengths, k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_keys[query], q_ids[query], keys[at], ids[at], score)], names=["query_key", "query_id", "key", "vec_id", "score"])


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a double; null if the vector or a component is null or not finite. A value beyond a 64-bit number counts as its end."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")
    least, most = float(-(1 << 63)), float(1 << 63)
    fits = lambda x: F.when(F.lit(float(scale)) * x.cast("double") >= most, F.lit((1 << 63) - 1)).when(F.lit(float(scale)) * x.cast("double") < least, F.lit(-(1 << 63))).otherwise(whole(x))
    return F.when(sound, F.transform(embedding, fits))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with all other vectors.

    Queries are the rows for which ``is_query`` holds; ties go to the smaller id. Null vectors, and
    those with null or non-finite components, take no part, nor do rows without an id. Shorter
    vectors count as padded with zeros. A repeated id is a candidate with each of its vectors, but
    never of a query of the same id. Scores are exact; one beyond a 64-bit number counts as its end,
    and so ties with others beyond. Equal rows are answers of their own; a query id that repeats is
    answered by each candidate row's best score over its rows. Ids have any type with an order; those that
    are no whole numbers are numbered first. An empty table gives no rows.
    """
    if not whole(vectors, id_col):
        told, ids = with_numbers(vectors.withColumn("_asks", is_query), id_col)
        return named(top_k(told, F.col("_asks"), k, "_number", vector_col, scale), ids, "query_id", "vec_id")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("vector"), is_query.alias("asks"))
    rows = rows.where("vec_id is not null and vector is not null")
    rows = rows.withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))))
    # Numbers from 0, longest first.
    numbers, total = numbered(rows, F.desc("length"), F.col("vec_id"))
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    packed = f"block long, {PACKED}"
    by_bucket = numbers.withColumn("bucket", F.floor(F.col("number") / BUCKET_ROWS)).repartition("bucket").sortWithinPartitions("number")
    buckets = cut(by_bucket.select("number", "vec_id", "vector").mapInArrow(partial(_blocks, BUCKET_ROWS), packed))
    asked = numbers.where("asks").withColumn("q", F.floor(F.col("number") / (BUCKET_ROWS * 8))).repartition("q").sortWithinPartitions("number")
    asked = asked.select((F.col("q") * QUERY_ROWS * 64 + F.row_number().over(Window.partitionBy("q").orderBy("number")) - 1).alias("number"), "vec_id", "vector")
    queries = cut(asked.mapInArrow(partial(_blocks, QUERY_ROWS), packed))
    q = queries.select(F.col("block").alias("q_block"), F.struct("rows", "dim", "width", "ids", "keys", "body").alias("q"))
    b = buckets.select(F.col("block").alias("bucket"), F.struct("rows", "dim", "width", "ids", "keys", "body").alias("b"))
    n_buckets = -(-total // BUCKET_ROWS)
    answers = "query_key long, query_id long, key long, vec_id long, score long"
    best = lambda by: Window.partitionBy(by).orderBy(F.desc("score"), "vec_id", "key")

    # Exploded, so that the planner sees a join by bucket number here too, and no constant.
    seeds = q.withColumn("bucket", F.explode(F.array(F.lit(0).cast("long")))).withColumn("bounds", F.lit(None).cast("array<double>"))
    # The bucket of the longest vectors is one row of BUCKET_ROWS vectors at most; all blocks of queries meet it where they are.
    first = seeds.join(F.broadcast(b.where("bucket = 0")), "bucket").select("bucket", "b", "q", "bounds").mapInArrow(partial(_met, k), answers)
    bounds = cut(first.withColumn("r", F.row_number().over(best("query_key"))).where(F.col("r") == k).select("query_key", F.col("score").cast("double").alias("bound")))
    # Each block's bounds, in the order of its queries.
    asking = queries.select(F.col("block").alias("q_block"), F.posexplode("keys").alias("at", "query_key"))
    listed = asking.join(bounds, "query_key", "left").groupBy("q_block").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")))).alias("listed"))
    bounded = cut(listed.select("q_block", F.col("listed.bound").alias("bounds")))
    # Which buckets a block of queries may need, before any vectors move: lengths fall with the bucket's number, so each bound
    # allows the buckets up to a last one. It is looked up among at most STEPS lengths, whatever the number of buckets.
    step = -(-n_buckets // STEPS)
    longest = numbers.where(F.col("number") % (BUCKET_ROWS * step) == 0).select("number", "length").orderBy("number").collect()
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")))
    needs = asked.select(F.floor(F.col("number") / QUERY_ROWS).alias("q_block"), F.col("number").alias("query_key"), norm.alias("norm")).join(bounds, "query_key", "left")
    need = F.min(F.when(F.col("bound") > 0, F.col("bound") * (1 - 1e-9) / F.greatest("norm", F.lit(1e-300))).otherwise(float("-inf")))
    reached = F.size(F.filter(F.array(*(F.lit(r.length) for r in longest)), lambda x: x >= F.col("need")))
    last = F.least(reached * step, F.lit(n_buckets)) - 1
    wanted = needs.groupBy("q_block").agg(need.alias("need")).select("q_block", last.cast("long").alias("last")).where("last >= 0")
    wanted = cut(wanted.select("q_block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bucket")))
    pairs = wanted.join(bounded, "q_block").join(q, "q_block")
    met = pairs.join(b.hint("merge"), "bucket").select("bucket", "b", "q", "bounds").mapInArrow(partial(_met, k), answers)
    # The rows of a repeated query id give one answer by candidate row.
    folded = met.groupBy("query_id", "key", "vec_id").agg(F.max("score").alias("score"))
    return folded.withColumn("rank", F.row_number().over(best("query_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
