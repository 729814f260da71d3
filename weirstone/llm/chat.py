"""Chat formatting in budgeted windows; DataFrame operations only.

Template: each turn is ``<|turn|>`` role ``<|say|>`` text ``<|end|>``. Wherever a role or text holds
what starts like a control string (of this template or of common ones), a backslash goes in after its
first character; where backslashes stand there already, one more. Removing one undoes it exactly.

A conversation's turns are dealt into blocks by turn number, which is known before any text moves; so
all that a block needs (its turns, those just before it, the system turn) meets in one shuffle, and no
task holds a whole conversation. Within a block, prefix sums of turn tokens choose the windows: they
take turns greedily while they fit. A window repeats the system turn and as many of the turns before it
as the history budget allows (from before its block, those of the last ``HISTORY_TURNS`` turn numbers);
only its own assistant texts are targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.llm._spark import broadcast_below, cut, same

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"

#: What follows the last < or [ of a control string. None holds such a character itself, so one escape never hides another.
CONTROL_RESTS = [r"\|", r"/?s>", r"/?SYS>>", r"/?INST\]", r"/?(?:bos|eos|pad|unk)>", r"(?:start|end)_of_turn>", r"endoftext", r"/?(?:SEP|CLS|MASK|PAD|UNK)\]"]
_REST = "(?=" + "|".join(CONTROL_RESTS) + ")"

#: Turn numbers in a block; turn numbers before a block that may be its history; rows from which a block is cut further.
BLOCK_TURNS, HISTORY_TURNS, BLOCK_ROWS = 256, 16, 1024

#: What a member of a block's gathering is: what is known of the block, the system turn, a turn before the block, an own turn.
INFO, SYSTEM, LATE, OWN = range(4)

#: What stands for a token in the default estimate: up to six letters or digits, or one other mark.
PIECE = r"[\p{L}\p{N}]{1,6}|[^\s\p{L}\p{N}]"
MARKER_TOKENS = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2")


def estimate(text: Column) -> Column:
    """Tokens of a text, about; any column of whole numbers may stand in for it."""
    return F.regexp_count(text, F.lit(PIECE)) + MARKER_TOKENS


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their block: b, t, h; blocks: conv, b, t, h, n_before, n_blocks).

    A block is a range of BLOCK_TURNS turn numbers of a conversation. One that repeats numbers to more
    than BLOCK_ROWS rows is cut by turn number, and a number with more rows than that by a hash.
    """
    b = F.floor(F.col("turn") / BLOCK_TURNS)
    rows = rows.withColumn("b", b)
    counts = rows.groupBy("conv", "b").agg(F.count("*").alias("n"))
    full = cut(counts.where(F.col("n") > BLOCK_ROWS).select("conv", "b"))
    none = F.lit(None).cast("long")
    if full.isEmpty():
        rows = rows.withColumn("t", none).withColumn("h", none)
        blocks = counts.select("conv", "b", none.alias("t"), none.alias("h"), "n")
    else:
        by_turn = rows.join(broadcast_below(full, 24), same(rows, full, "conv", "b"), "left_semi").groupBy("conv", "turn").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("k"))
        by_turn = cut(by_turn).select(F.col("conv").alias("c"), F.col("turn").alias("u"), "k")
        rows = rows.join(broadcast_below(by_turn, 32), F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("u")), "left").drop("c", "u")
        rows = rows.withColumn("t", F.when(F.col("k").isNotNull(), F.col("turn"))).withColumn("h", F.pmod(F.xxhash64("role", "said"), F.col("k"))).drop("k")
        blocks = rows.groupBy("conv", "b", "t", "h").agg(F.count("*").alias("n"))
    in_turn = Window.partitionBy("conv").orderBy(*(F.asc_nulls_first(c) for c in "bth"))
    before = F.sum("n").over(in_turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows, cut(blocks.withColumn("n_before", before).withColumn("n_blocks", F.count("*").over(Window.partitionBy("conv"))).drop("n"))


def _system_turns(rows: DataFrame, blocks: DataFrame, system: str) -> DataFrame:
    """The system turn of each conversation, for each of its blocks but the first, where it stands by itself: conv, b, t, h, role, said, tokens."""
    several = blocks.where("n_blocks > 1").select("conv").distinct()
    several = cut(several)
    if several.isEmpty():
        return rows.where("false").select("conv", "b", "t", "h", "role", "said", "tokens")
    known = broadcast_below(several, 16)
    long = rows.join(known, rows.conv.eqNullSafe(known.conv), "left_semi")
    heads = long.groupBy("conv").agg(F.min(F.struct("turn", "role")).alias("head")).where(F.col("head.role") == system).select(F.col("conv").alias("c"), F.col("head.turn").alias("u"))
    heads = long.where(F.col("role") == system).join(broadcast_below(cut(heads), 24), F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("u")), "left_semi")
    heads = heads.groupBy("conv").agg(F.min(F.struct("said", "tokens")).alias("head")).select(F.col("conv").alias("c"), "head.said", "head.tokens")
    return blocks.where("n_blocks > 1 and n_before > 0").join(heads, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "b", "t", "h", F.lit(system).alias("role"), "said", "tokens")


def windows(turns: DataFrame, *, budget: int = 2048, history: int = 512, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens=estimate, system: str = "system", target: str = "assistant") -> DataFrame:
    """One row per window: conv_id, window (number of its first own turn), formatted, n_repeated, n_own,
    tokens, loss_spans (start and length of each target text in ``formatted``, in characters from 0),
    alone (whether the conversation has no other window).

    Turns go by (turn, role, text), nulls first; rows that agree in these are repeated turns. (Of a
    turn number that comes more than ``BLOCK_ROWS`` times, rows go by a hash before role and text.) A
    null role or text is empty; a null conversation id is a conversation of its own. The system turn is
    the first turn, if its role says so; it leads every window. Windows hold at most ``budget`` tokens,
    unless the system turn and one own turn exceed it; such a window has no history. Every turn is
    an own turn of one window. An empty table gives no windows.
    """
    if not 0 <= history < budget:
        raise ValueError("the history budget must be below the budget")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("said"))
    rows = rows.withColumn("tokens", tokens(F.col("said")).cast("long"))
    rows, blocks = _blocks(rows)

    # All that a block needs meets in one shuffle: what is known of it, the system turn, turns just before it, its own turns.
    none = F.lit(None)

    def members(df: DataFrame, kind: int, **held) -> DataFrame:
        said = {"turn": none.cast(rows.schema["turn"].dataType), "role": none.cast("string"), "said": none.cast("string"), "tokens": F.lit(0).cast("long")} | held
        return df.select("conv", "b", "t", "h", F.struct(F.lit(kind).alias("kind"), *(x.alias(c) for c, x in said.items())).alias("m"))

    own = {c: F.col(c) for c in ("turn", "role", "said", "tokens")}
    late = rows.where(F.col("t").isNull() & F.col("h").isNull() & (F.pmod("turn", F.lit(BLOCK_TURNS)) >= BLOCK_TURNS - HISTORY_TURNS)).withColumn("b", F.col("b") + 1)
    met = members(blocks, INFO, turn=F.col("n_before").cast(rows.schema["turn"].dataType), tokens=F.col("n_blocks"))
    met = met.union(members(_system_turns(rows, blocks, system), SYSTEM, **{c: F.col(c) for c in ("role", "said", "tokens")}))
    met = met.union(members(late, LATE, **own)).union(members(rows, OWN, **own))
    held = met.groupBy("conv", "b", "t", "h").agg(F.array_sort(F.collect_list("m")).alias("m")).where(F.col("m")[0]["kind"] == INFO)
    held = held.select(F.col("conv").alias("conv_id"), F.col("m")[0]["turn"].cast("long").alias("n_before"), F.col("m")[0]["tokens"].alias("n_blocks"), F.filter("m", lambda x: x["kind"] == SYSTEM).alias("head"), F.filter("m", lambda x: x["kind"] > SYSTEM).alias("line"))
    # The system turn: sent along, or the conversation's first own turn.
    first = F.col("line")[0]
    leads = (F.size("head") == 0) & (F.col("n_before") == 0) & (first["kind"] == OWN) & (first["role"] == system)
    held = held.withColumn("leads", leads).withColumn("sys", F.when(F.size("head") > 0, F.col("head")[0]["tokens"]).when(F.col("leads"), first["tokens"]).otherwise(F.lit(0).cast("long")))
    # Prefix sums of tokens over the line, then greedy windows of own turns.
    held = held.withColumn("upto", F.expr("aggregate(line, array(0L), (acc, x) -> concat(acc, array(acc[size(acc) - 1] + x.tokens)))"))
    held = held.withColumn("n_late", F.expr(f"size(filter(line, x -> x.kind = {LATE}))"))
    greedy = f"""aggregate(sequence(n_late, size(line) - 1), struct(cast(array() as array<int>) as starts, 0L as from_), (acc, k) -> if(
        size(acc.starts) = 0 or upto[k + 1] - acc.from_ > greatest({budget} - {history} - sys, 1), struct(concat(acc.starts, array(k)) as starts, upto[k] as from_), acc), acc -> acc.starts)"""
    held = held.withColumn("starts", F.expr(greedy))
    # (s, e): own turns of the window; p: the first turn of its history, which the budget and the system turn bound.
    fits = f"if(sys + upto[w.e] - upto[w.s] > {budget} - {history}, {budget} - sys - (upto[w.e] - upto[w.s]), {history})"
    spans = f"""transform(transform(sequence(0, size(starts) - 1), n -> struct(starts[n] as s, if(n + 1 < size(starts), starts[n + 1], size(line)) as e)),
        w -> struct(w.s as s, w.e as e, w.s - size(filter(sequence(int(leads), w.s), k -> k < w.s and upto[w.s] - upto[k] <= {fits})) as p, size(head) > 0 or (leads and w.s > 0) as repeats))"""
    held = held.withColumn("w", F.expr(spans))
    chunk = lambda x: F.concat(F.lit(TURN), escape(x["role"]), F.lit(SAY), escape(x["said"]), F.lit(END))
    part = lambda x: F.struct(
        chunk(x).alias("chunk"), (F.char_length(escape(x["role"])) + len(TURN) + len(SAY)).alias("lead"), F.char_length(escape(x["said"])).alias("length"), (x["role"] == target).alias("targeted"), x["tokens"].alias("tokens")
    )
    held = held.withColumn("parts", F.transform("line", part)).withColumn("head", F.when(F.size("head") > 0, F.transform("head", part)))
    repeated = "concat(if(w.repeats, coalesce(head, slice(parts, 1, 1)), array()), slice(parts, w.p + 1, w.s - w.p))"
    held = held.withColumn("made", F.expr(f"transform(w, w -> struct(w.s - n_late + n_before as window, {repeated} as repeated, slice(parts, w.s + 1, w.e - w.s) as own))"))
    formatted = "concat(array_join(transform(x.repeated, p -> p.chunk), ''), array_join(transform(x.own, p -> p.chunk), ''))"
    loss = """aggregate(x.own, struct(aggregate(x.repeated, 0, (n, p) -> n + char_length(p.chunk)) as upto, cast(array() as array<struct<start:int,length:int>>) as spans), (acc, p) -> struct(
        acc.upto + char_length(p.chunk) as upto, if(p.targeted, concat(acc.spans, array(struct(acc.upto + p.lead as start, p.length as length))), acc.spans) as spans), acc -> acc.spans)"""
    tokens_of = "aggregate(concat(x.repeated, x.own), 0L, (n, p) -> n + p.tokens)"
    # "alone" comes out of the generator like the rest: a filter on it then can't be pushed below, where it would repeat the expressions above.
    every = f"transform(made, x -> struct(x.window as window, {formatted} as formatted, size(x.repeated) as n_repeated, size(x.own) as n_own, {tokens_of} as tokens, {loss} as loss_spans, n_blocks = 1 and size(made) = 1 as alone))"
    return held.select("conv_id", F.explode(F.expr(every)).alias("x")).select("conv_id", "x.*")


def read_back(made: DataFrame) -> DataFrame:
    """The conversations as the windows have them: conv_id, turns (role, text), targets, formatted_chars.

    From the formatted strings and spans alone: own turns follow a window's repeated ones. A window
    that is its conversation's only one is read where it stands; others are gathered.
    """
    turn = lambda x: F.struct(unescape(F.substring_index(x, SAY, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x, SAY, -1), END, 1)).alias("text"))
    pieces = F.split("formatted", r"<\|turn\|>")
    own = F.slice(pieces, F.col("n_repeated") + 2, F.col("n_own"))
    targets = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    parts = lambda df: df.select("conv_id", "window", F.transform(own, turn).alias("turns"), targets.alias("targets"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    several = parts(made.where("not alone")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("formatted_chars").alias("formatted_chars"))
    several = several.select("conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.flatten(F.col("w.targets")).alias("targets"), "formatted_chars")
    return parts(made.where("alone")).drop("window").union(several)
