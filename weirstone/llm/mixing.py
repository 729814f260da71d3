"""Mixing sources to target weights, in fixed-length token blocks; DataFrame operations only.

Every source's words form a stream that is packed into blocks of ``block`` words. A source gets as
many output slots as come nearest its target. The output is a row of shards with ``per_shard`` slots
each; a draw gives every shard its number of slots by source. It is a multinomial draw conditioned on
the sources' totals (all slots, dealt out by one pseudorandom permutation): free draws would miss the
targets by chance and could take a block of a source at its limit a third time. A source's slots are
numbered shard by shard from the drawn counts; the numbers go through the source's own pseudorandom
permutation to block indices (around again once all blocks are used), and blocks are joined by index.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.llm._spark import before, broadcast_below, cut, numbered, one_by, row_key, spread
from weirstone.llm.feistel import permuted

#: Parts of each source's stream, so that no task sums a whole source; slots that one row is exploded to, and that a task makes.
STREAM_PARTS, CHUNK, SLOTS_BY_TASK = 1024, 4096, 1 << 17

WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """sources: sid, source, source_size, weight, target, n_blocks, n_slots.
    pieces: sid, block, offset (words of the block before the piece), part, place (these two name a row), doc_id, key1, key2, size, lo, hi (words of the row).
    draw: shard, sid, blocks (how many slots of the shard the source has), earlier (how many in the shards before).
    slots: shard, position, sid, epoch, block."""

    sources: DataFrame
    pieces: DataFrame
    draw: DataFrame
    slots: DataFrame


def targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """(source, source_size) with sid, weight, target.

    Sources by code point, null last, take the weights in turn. Targets are in proportion to the
    weights and sum to ``share`` of all sizes; none is above ``limit`` times its source's size, and
    what is cut off goes to the others by weight: the level is raised until no more sources reach their limits.
    """
    ordered, _ = numbered(sizes, F.asc_nulls_last("source"), name="sid")
    table = F.array(*(F.lit(float(w)) for w in weights))
    out = cut(ordered.withColumn("weight", F.element_at(table, F.pmod("sid", F.lit(len(weights))).cast("int") + 1)))
    every, heavy = out.agg(F.sum("source_size"), F.sum("weight")).first()
    all_words, level, capped = float(every or 0) * share, 0.0, -1
    cap = F.col("source_size") * limit
    if heavy:
        level, full = all_words / heavy, 0
        while full != capped:
            capped = full
            over = cap < F.col("weight") * level
            full, held, left = out.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
            if not left:
                level = float("inf")
                break
            level = (all_words - held) / left
    target = cap if level == float("inf") else F.least(cap, F.col("weight") * level)
    return out.select("sid", "source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), *, share: float = 1.5, limit: float = 2.0, block: int = 128, per_shard: int = 8192, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Plan the mix of all rows of ``docs``; see ``taken``, ``packed`` and ``mixed`` for its outcomes.

    Words are runs without white space (0x20, 0x09-0x0D). A null or empty text has none. A null
    source is a source of its own. Repeated rows each add their words. Streams go by a hash of the
    row, so reruns agree. No word is taken more than ceil(limit) times. An empty table gives no slots.
    """
    text = F.col(text_col).cast("string")
    key1, key2 = row_key(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key1.alias("key1"), key2.alias("key2"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = cut(rows.withColumn("part", spread("key1", parts=STREAM_PARTS)))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, limit).withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    wanted = F.round(F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    sources = cut(sources.withColumn("n_slots", F.least(wanted, F.floor(F.col("n_blocks") * limit).cast("long"))))

    known = broadcast_below(sources.select("sid", "source"), 256)
    rows = rows.join(known, rows.source.eqNullSafe(known.source)).select("sid", "part", "doc_id", "key1", "key2", "size")
    sums = rows.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    sums = sums.select("sid", "part", (F.sum("words").over(Window.partitionBy("sid").orderBy("part")) - F.col("words")).alias("before"))  # at most STREAM_PARTS rows of a source
    in_turn = Window.partitionBy("sid", "part").orderBy("key1", "key2")
    rows = rows.join(sums, ["sid", "part"]).withColumn("place", F.row_number().over(in_turn))
    rows = rows.withColumn("start", F.col("before") + F.sum("size").over(in_turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    lo = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    pieces = pieces.select("sid", "block", (F.col("start") + lo - F.col("block") * block).alias("offset"), "part", "place", "doc_id", "key1", "key2", "size", lo.alias("lo"), hi.alias("hi"))

    # Every source's slots, each dealt to a shard and a position there by one permutation: this is the draw.
    lined = before(sources, [], "sid", "n_slots", "slots_before")
    # One number reaches the driver. The planner takes exploded rows for as many as there were before, so it is told how many tasks there are.
    all_slots = sources.agg(F.sum("n_slots")).first()[0] or 0
    chunks = lined.where("n_slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / CHUNK))))
    chunks = chunks.repartition(1 + all_slots // SLOTS_BY_TASK, "sid", "chunk")
    dealt = chunks.withColumn("ticket", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, "n_slots") - 1)))
    dealt = dealt.select("sid", "n_blocks", permuted(F.col("slots_before") + F.col("ticket"), F.lit(all_slots).cast("long"), F.lit(seed)).alias("at"))
    dealt = cut(dealt.select("sid", "n_blocks", F.floor(F.col("at") / per_shard).alias("shard"), F.pmod("at", F.lit(per_shard)).alias("position")))
    draw = dealt.groupBy("shard", "sid").agg(F.count("*").alias("blocks"))
    draw = cut(before(draw, ["sid"], "shard", "blocks", "earlier"))
    # A source's slots in a shard, in order, take the numbers that follow those of the shards before.
    nth = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("position")) - 1
    slots = dealt.withColumn("nth", nth).join(broadcast_below(draw, 32), ["shard", "sid"])
    number = F.col("earlier") + F.col("nth")
    slots = slots.select("shard", "position", "sid", F.floor(number / F.col("n_blocks")).alias("epoch"), permuted(F.pmod(number, F.col("n_blocks")), F.col("n_blocks"), F.col("sid") + (seed << 8)).alias("block"))
    return Mix(sources, pieces, draw, slots)


def taken(plan: Mix) -> DataFrame:
    """Per row of the input: doc_id, size, source_size, target (its source's), taken: the words that its blocks' slots hold of it."""
    held = plan.pieces.join(plan.slots.hint("merge"), ["sid", "block"], "left")
    words = F.when(F.col("position").isNotNull(), F.col("hi") - F.col("lo")).otherwise(0)
    rows = held.groupBy("sid", "part", "place").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum(words).alias("taken"))
    known = broadcast_below(plan.sources.select("sid", "source_size", "target"), 64)
    return rows.join(known, "sid").select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def packed(docs: DataFrame, plan: Mix, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The mix: per slot the pieces of its block, as rows of ``row`` (the columns of ``docs``, with the piece for a text and its
    characters for a length), shard, position, offset (words of the block before the piece).

    In order of offset the pieces of a slot are its block's words, ``block`` of them but in a source's
    last block. White space within a piece is kept. Equal rows of ``docs`` are read once, for all that is taken of them.
    """
    key1, key2 = row_key(docs)
    row = docs.select(key1.alias("key1"), key2.alias("key2"), F.struct("*").alias("row"))
    held = plan.pieces.where("lo is not null").join(plan.slots.hint("merge"), ["sid", "block"])
    held = held.groupBy("key1", "key2", "part", "place").agg(F.collect_list(F.struct("shard", "position", "offset", "lo", "hi")).alias("held"))
    rows = one_by(row, ["key1", "key2"], "row").join(held.hint("merge"), ["key1", "key2"])
    rows = rows.withColumn("words", F.regexp_extract_all(F.col("row")[text_col].cast("string"), F.lit(SPACED_WORD), 0))
    cuts = F.expr("transform(held, p -> struct(p.shard, p.position, p.offset, ltrim(array_join(slice(words, int(p.lo) + 1, int(p.hi - p.lo)), '')) as body))")
    others = [name for name in docs.columns if name not in (text_col, length_col)]
    # The text itself doesn't go along with each of its pieces.
    rows = rows.select(F.struct(*(F.col("row")[name].alias(name) for name in others)).alias("others") if others else F.lit(None).alias("others"), F.explode(cuts).alias("p"))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("p.body").cast(docs.schema[name].dataType).alias(name)
        if name == length_col:
            return F.char_length("p.body").cast(docs.schema[name].dataType).alias(name)
        return F.col("others")[name].alias(name)

    return rows.select(F.struct(*(column(name) for name in docs.columns)).alias("row"), "p.shard", "p.position", "p.offset")


def mixed(docs: DataFrame, plan: Mix, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The pieces of all slots as rows with the columns of ``docs``, shard by shard and in the shards' order."""
    out = packed(docs, plan, text_col, length_col)
    return out.repartition("shard").sortWithinPartitions("shard", "position", "offset").select("row.*")
