"""Sharding by rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.llm._spark import cut, spread

#: Buckets of each shard in which slots are counted, so that no task sorts a whole shard.
SLOT_BUCKETS = 256


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (0 ..) with the highest score -weight / ln(u), u a hash of key and shard in (0, 1).

    A shard's share is in proportion to its weight. A further shard, or a higher weight, only draws
    keys to that shard. The key's text counts, so 7 and '7' go the same way; all null keys go to one
    shard. A tie of scores goes to the smaller shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    table = F.array(*(F.lit(float(w)) for w in weights))
    name = F.xxhash64(key.cast("string"), F.lit(seed))

    def scores(hashed: Column) -> Column:
        def one(i: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(hashed, i), 11).cast("double") + 0.5) / float(1 << 53)
            return F.struct((F.element_at(table, i + 1) / -F.ln(u)).alias("score"), (-i).alias("shard"))

        return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), one))["shard"]

    return (-F.transform(F.array(name), scores)[0]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", *, overhead: int = 16, grown_weight: float | None = 1.0, seed: int = 0) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and ``overhead``), text_crc32, shard, slot, grown_shard.

    slot counts each shard's rows from 0 without gaps, in the order of (bucket, doc_id, size,
    text_crc32); rows that agree in all of these get any of their slots. grown_shard is the shard
    after one more of ``grown_weight`` joins. A null text has no bytes, and crc32 of none. Rows with
    the same id share a shard, as the law says. An empty table gives no rows.
    """
    key, text = F.col(id_col), F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    grown = rendezvous(key, [*weights, grown_weight], seed) if grown_weight else F.lit(None).cast("int")
    rows = docs.select(key.alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), rendezvous(key, weights, seed).alias("shard"), grown.alias("grown_shard"))
    rows = cut(rows.withColumn("bucket", spread("doc_id", "size", "text_crc32", parts=SLOT_BUCKETS)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = counts.select("shard", "bucket", before.alias("before"))  # at most shards * SLOT_BUCKETS rows
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    out = rows.join(F.broadcast(offsets) if len(weights) * SLOT_BUCKETS <= 1 << 20 else offsets, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + place - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, id_col: str = "doc_id", *, seed: int = 0) -> None:
    """Write whole rows below ``path``, one folder by shard (shard=0 ...), as Parquet. A column of the rows that has the folders' name is written as it is, and the folders take the next free one (shard_2=0 ...)."""
    taken = {name.lower() for name in docs.columns}
    name = next(x for x in ("shard", *(f"shard_{k}" for k in range(2, len(taken) + 3))) if x not in taken)
    docs.withColumn(name, rendezvous(F.col(id_col), weights, seed)).repartition(name, spread(id_col, parts=16)).write.partitionBy(name).parquet(path)
