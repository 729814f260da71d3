"""Sessions of clicks by gaps, final clicks and a longest length.

Timely and late clicks meet in a cogroup. There numpy takes all lines of a group at once: each start
jumps to the next one, which is the first click beyond ``start + longest`` (``searchsorted``) or the
next hard break, whichever comes first; late clicks find their session by ``searchsorted``.

A line is a client's clicks. Lines of few clicks share a group. A client of many clicks is cut where
sessions end whatever came before (a final click or a gap); what is still long then, a line without
such a break, is cut at its session starts, which are found by doubling jumps. So a group holds a
bounded number of clicks, those of one short stretch of time, or a few sessions that nothing cuts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.llm._spark import cut, written

MINUTE = 60_000_000

#: Clicks of a line that is cut further; clicks in a group on average. Neither changes a result.
LINE_ROWS, GROUP_ROWS = 32_768, 8_192

#: Stretches of time that a busy client's clicks are cut by, in the longest length of a session.
STRETCHES = 64

#: Slots of the map of busy clients.
BUSY_SLOTS = 1 << 16

#: Start of the next line where there is none.
NEVER = (1 << 63) - 1

#: Larger amounts count as such, in hundredths, so that sums stay whole numbers.
MOST_CENTS = 1e15


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC; a time without a zone is read as UTC, whatever the session's zone."""
    x = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(x.cast("timestamp"))
    seconds = ((F.unix_date(x.cast("date")).cast("long") * 24 + F.hour(x)) * 60 + F.minute(x)) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(second from `{name}`)") * 1_000_000).cast("long")


def distinct_clicks(clicks: DataFrame, late_after: int, final: Column) -> DataFrame:
    """(client_id, click_id, us, late, final, cents), one row by click_id."""
    value = F.col("value").cast("double")
    cents = F.floor(100 * value + 0.5)
    cents = F.when(F.isnan(value) | value.isNull(), F.lit(0)).when(F.abs(value) > MOST_CENTS / 100, F.signum(value) * MOST_CENTS).otherwise(cents).cast("long")
    late = F.coalesce(micros(clicks, "arrived_at") - micros(clicks, "ts") > late_after, F.lit(False))
    rows = clicks.where("click_id is not null and client_id is not null and ts is not null")
    rows = rows.select(F.col("click_id").cast("long").alias("click_id"), "client_id", micros(clicks, "ts").alias("us"), late.alias("late"), F.coalesce(final, F.lit(False)).alias("final"), cents.alias("cents"))
    # Of rows that differ, the least by all cells. Numbers of one click travel as one, and no row twice.
    packed = (F.col("cents") * 4 + F.col("late").cast("long") * 2 + F.col("final").cast("long")).alias("packed")
    rows = rows.select("click_id", F.struct("us", "client_id", packed).alias("cell"))
    one = Window.partitionBy("click_id").orderBy("cell")
    rows = rows.withColumn("_nth", F.row_number().over(one)).where("_nth = 1")
    bit = lambda n: F.col("cell.packed").bitwiseAND(n) != 0
    return rows.select("cell.client_id", "click_id", "cell.us", bit(2).alias("late"), bit(1).alias("final"), F.shiftright("cell.packed", 2).alias("cents"))


def _marked_busy(clicks: DataFrame, busy: DataFrame) -> DataFrame:
    """``clicks`` with ``busy``: true for the clients of ``busy``, and for those that share a slot with one.

    Who counts as busy changes no result, so a map of fixed size will do in place of a join that shuffles all clicks again.
    """
    slot = F.pmod(F.xxhash64("client_id"), F.lit(BUSY_SLOTS)).cast("int")
    taken = bytearray(BUSY_SLOTS)
    for r in busy.select(slot.alias("slot")).distinct().toLocalIterator():
        taken[r["slot"]] = 1
    return clicks.withColumn("busy", F.substring(F.lit(bytes(taken)), slot + 1, F.lit(1)) == F.lit(b"\x01"))


def _hard_heads(timely: DataFrame, gap: int, width: int) -> DataFrame:
    """(client_id, us, click_id) of clicks that begin a session whatever came before: at most three for each client and ``width`` of time.

    They are the first click of a stretch of time, and the first and last hard start inside it, so
    that no hard break is left between the last one of a stretch and the next head.
    """
    inside = Window.partitionBy("client_id", "bucket").orderBy("us", "click_id")
    marked = timely.withColumn("bucket", F.floor(F.col("us") / width))
    marked = marked.withColumn("hard", F.lag("final").over(inside) | (F.col("us") - F.lag("us").over(inside) >= gap))
    click = F.struct("us", "click_id")
    hard = F.when(F.col("hard"), click)
    ends = marked.groupBy("client_id", "bucket").agg(F.min(click).alias("first"), F.max(F.struct("us", "click_id", "final")).alias("last"), F.min(hard).alias("low"), F.max(hard).alias("high"))
    # One row for a client and stretch: their number is bounded by the calendar, not by clicks.
    line = Window.partitionBy("client_id").orderBy("bucket")
    ends = ends.withColumn("before", F.lag("last").over(line))
    opens = F.col("before").isNull() | F.col("before.final") | (F.col("first.us") - F.col("before.us") >= gap)
    heads = F.array_distinct(F.array_compact(F.array(F.when(opens, F.col("first")), F.col("low"), F.col("high"))))
    return ends.withColumn("heads", heads).select("client_id", F.explode("heads").alias("h")).select("client_id", "h.us", "h.click_id")


def _placed(clicks: DataFrame, heads: DataFrame, width: int) -> DataFrame:
    """``clicks`` (client_id, us, click_id, late, ...) with ``head``, the latest head up to the click, and ``next_us``, the time of the head after that.

    A late click comes after all heads of its time. Clicks before a client's first head have none.
    """
    bucket = F.floor(F.col("us") / width).alias("bucket")
    own = heads.select("client_id", bucket, F.struct("us", "click_id").alias("h")).groupBy("client_id", "bucket").agg(F.array_sort(F.collect_list("h")).alias("own"))
    there = clicks.select("client_id", bucket).distinct()
    up = Window.partitionBy("client_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("client_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    # Joins stay shuffled: what is known of busy clients grows with the input, and nothing that does is broadcast.
    around = there.join(own.hint("merge"), ["client_id", "bucket"], "full").withColumn("carried", F.last(F.element_at("own", -1), ignorenulls=True).over(up))
    around = around.withColumn("following", F.last(F.element_at("own", 1), ignorenulls=True).over(down))
    rows = clicks.withColumn("bucket", F.floor(F.col("us") / width)).join(around.hint("merge"), ["client_id", "bucket"])
    here = F.struct(F.col("us"), F.when(F.col("late"), F.lit(NEVER)).otherwise(F.col("click_id")).alias("click_id"))
    rows = rows.withColumn("_here", here).withColumn("own", F.coalesce("own", F.array().cast("array<struct<us: bigint, click_id: bigint>>")))
    past, ahead = F.expr("filter(own, h -> h <= _here)"), F.expr("filter(own, h -> h > _here)")
    rows = rows.withColumn("head", F.coalesce(F.try_element_at(past, F.lit(-1)), "carried"))
    rows = rows.withColumn("next_us", F.coalesce(F.coalesce(F.try_element_at(ahead, F.lit(1)), "following")["us"], F.lit(NEVER)))
    return rows.drop("bucket", "own", "carried", "following", "_here")


def _starts_by_doubling(line: DataFrame, longest: int) -> DataFrame:
    """(client_id, us, click_id) of all session starts but the first of lines without hard breaks; ``line``: client_id, head, us, click_id.

    Each time of a line points to the first one more than ``longest`` later. Pointers are doubled
    until they leave the lines, and the starts reached so far are sent along them each time.
    """
    key = ["client_id", "head"]
    cell = lambda x: F.floor(x / longest).alias("cell")
    times = written(line.groupBy(*key, "us").agg(F.min("click_id").alias("click_id")))
    asks = times.select(*key, cell(F.col("us") + longest), (F.col("us") + longest).alias("at"), F.col("us").alias("src"))
    both = asks.unionByName(times.select(*key, cell(F.col("us")), F.col("us").alias("at"), F.lit(None).cast("long").alias("src")))
    # Inside a cell of time, the next one is the smallest that is later; else it is the first of the next cell that has any.
    down = Window.partitionBy(*key, "cell").orderBy(F.desc("at"), F.col("src").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("to", F.last(F.when(F.col("src").isNull(), F.col("at")), ignorenulls=True).over(down))
    cells = both.groupBy(*key, "cell").agg(F.min(F.when(F.col("src").isNull(), F.col("at"))).alias("least"))
    later = Window.partitionBy(*key).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*key, "cell", F.last("least", ignorenulls=True).over(later).alias("beyond"))
    jumps = near.where("src is not null").join(cells.hint("merge"), [*key, "cell"]).select(*key, F.col("src").alias("us"), F.coalesce("to", "beyond").alias("to")).where("to is not null")
    jumps = written(jumps)
    reached = written(times.groupBy(*key).agg(F.min("us").alias("us")))
    while not jumps.isEmpty():
        reached = written(reached.union(reached.join(jumps.hint("merge"), [*key, "us"]).select(*key, F.col("to").alias("us"))).distinct())
        jumps = written(jumps.join(jumps.select(*key, F.col("us").alias("to"), F.col("to").alias("beyond")).hint("merge"), [*key, "to"]).select(*key, "us", F.col("beyond").alias("to")))
    return times.join(reached.hint("merge"), [*key, "us"]).select("client_id", "us", "click_id")


def _long_lines(clicks: DataFrame, gap: int, longest: int, line_rows: int) -> DataFrame:
    """``clicks`` of clients with many, with ``head`` and ``next_us`` of the lines they are cut into."""
    timely = clicks.where("not late")
    width = max(longest // STRETCHES, 1)
    heads = cut(_hard_heads(timely, gap, width))
    placed = cut(_placed(clicks, heads, width))
    lines = placed.where("not late").groupBy("client_id", "head").agg(F.count("*").alias("n"), F.max("us").alias("last_us"))
    # What lies within twice the longest length is not cut: it may be one session.
    long = cut(lines.where(F.col("n") > line_rows).where(F.col("last_us") - F.col("head.us") > 2 * longest).select("client_id", "head"))
    if long.isEmpty():
        return placed
    line = placed.where("not late").join(long.hint("merge"), ["client_id", "head"], "left_semi").select("client_id", "head", "us", "click_id")
    more = _starts_by_doubling(line, longest)
    return _placed(clicks, cut(heads.union(more).distinct()), width)


def _grouped(gap: int, longest: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The cogroup's function: the sessions of a group's lines."""

    def run(timely: pd.DataFrame, late: pd.DataFrame) -> pd.DataFrame:
        n, m = len(timely), len(late)
        if not n:
            return pd.DataFrame({name: pd.Series(dtype=object) for name in COLUMNS})
        client, names = pd.factorize(pd.concat([timely["client_id"], late["late_client_id"]], ignore_index=True))
        head = np.concatenate([timely["head"].to_numpy(), late["late_head"].to_numpy()])
        _, line = np.unique(np.column_stack([client, head]), axis=0, return_inverse=True)
        line = line.ravel()
        order = np.lexsort((timely["click_id"].to_numpy(), timely["us"].to_numpy(), line[:n]))
        click, us, final, cents, following = (timely[name].to_numpy()[order] for name in ("click_id", "us", "final", "cents", "next_us"))
        mine, client = line[:n][order], client[:n][order]
        fresh = np.ones(n, bool)
        fresh[1:] = mine[1:] != mine[:-1]
        first = np.flatnonzero(fresh)
        nth = np.cumsum(fresh) - 1
        # One rising axis for all lines, each further than a session from the one before.
        lasts = us[np.append(first[1:], n) - 1] - us[first]
        base = np.concatenate([[0], np.cumsum(lasts + longest + 1)[:-1]])
        at = base[nth] + us - us[first][nth]
        since = np.full(n, NEVER)
        since[1:] = np.where(fresh[1:], NEVER, us[1:] - us[:-1])
        ended = np.zeros(n, bool)
        ended[1:] = final[:-1]
        hard = np.append(np.flatnonzero(fresh | ended | (since >= gap)), n)
        jump = np.minimum(np.searchsorted(at, at + longest, "right"), hard[np.searchsorted(hard, np.arange(n), "right")])
        starts = np.zeros(n, bool)
        here = first
        while len(here):
            starts[here] = True
            here = jump[here]
            here = here[(here < n) & ~fresh[np.minimum(here, n - 1)]]
        start = np.flatnonzero(starts)
        end = np.append(start[1:], n)
        # The next timely click is the next start, in the line or in that which follows.
        after = np.where(np.append(fresh[start[1:]], True), following[end - 1], us[np.minimum(end, n - 1)])
        closed = np.select([final[end - 1], after == NEVER, after - us[end - 1] >= gap], ["end", "none", "gap"], "length")
        n_late = np.zeros(len(start), np.int64)
        if m:
            place = np.full(line.max() + 1, -1)
            place[mine[first]] = np.arange(len(first))
            own, when = place[line[n:]], late["late_us"].to_numpy()
            own, when = own[own >= 0], when[own >= 0]
            own, when = own[when >= us[first][own]], when[when >= us[first][own]]
            when = np.minimum(when - us[first][own], lasts[own])
            n_late = np.bincount(np.searchsorted(at[start], base[own] + when, "right") - 1, minlength=len(start))
        return pd.DataFrame({
            "client_id": names.take(client[start]), "session_id": click[start], "start_us": us[start], "end_us": us[end - 1], "n_clicks": end - start,
            "n_late": n_late, "value_cents": np.add.reduceat(cents, start), "closed_by": closed, "path": np.split(click, start[1:]),
        })

    return run


COLUMNS = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path"]


def sessions(clicks: DataFrame, *, gap: int = 30 * MINUTE, longest: int = 120 * MINUTE, late_after: int = 60 * MINUTE, final: Column | None = None, line_rows: int = LINE_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per session of ``clicks`` (click_id, ts, arrived_at, client_id, kind, value): client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path.

    Times are in microseconds. A client's timely clicks, by ts and click_id, go on with a session
    unless the one before is ``final`` (by default a purchase of 60 or more), or at least ``gap``
    earlier, or the session's first is more than ``longest`` earlier; ``closed_by`` is ``end``,
    ``gap`` or ``length`` accordingly, and ``none`` for a client's last session if its last click is
    not final. Clicks that arrive more than ``late_after`` after their time join no session; each is
    counted by that whose time up to the client's next session holds it, in ``n_late``. ``path`` has the
    click_ids in order; ``value_cents`` sums floor(100 * value + 0.5).

    Rows without click_id, client_id or ts take no part. A click_id counts once; of rows of one id that
    differ, the same one is taken on every run. Without arrived_at a click is timely; a value that is
    null or no number counts as 0 (and is not final), one beyond 10 ** 13 as that. Clicks of one time go by
    click_id. An empty table, or one of late clicks only, gives no rows. Other columns are ignored.
    click_ids are whole numbers; client_id has any type that can be grouped.
    """
    if gap <= 0 or longest <= 0:
        raise ValueError("gap and longest must be positive")
    if final is None:
        final = (F.col("kind") == "purchase") & (F.col("value").cast("double") >= 60) & ~F.isnan(F.col("value").cast("double"))
    client_type = clicks.schema["client_id"].dataType.simpleString()
    once = distinct_clicks(clicks, late_after, final)
    key = F.struct(F.lit(0).cast("long").alias("us"), F.lit(0).cast("long").alias("click_id"))
    whole = lambda df: df.select("*", key.alias("head"), F.lit(NEVER).alias("next_us"))
    # Counted with repeated rows: who counts as busy changes no result.
    busy = cut(clicks.groupBy("client_id").agg(F.count("*").alias("n")).where((F.col("n") > line_rows) & F.col("client_id").isNotNull()).select("client_id"))
    if busy.isEmpty():
        told = written(once)
        rows = whole(told)
    else:
        told = written(_marked_busy(once, busy))
        long = _long_lines(told.where("busy").drop("busy"), gap, longest, line_rows)
        rows = whole(told.where("not busy").drop("busy")).unionByName(long)
    groups = 1 + told.count() // group_rows
    rows = rows.where("head is not null").withColumn("head", F.col("head.click_id")).withColumn("bin", F.pmod(F.xxhash64("client_id", "head"), F.lit(groups)))
    timely = rows.where("not late").drop("late").groupBy("bin")
    # New names, as both sides come of the same rows.
    late = rows.where("late").select(*(F.col(name).alias(f"late_{name}") for name in ("bin", "client_id", "head", "us"))).groupBy("late_bin")
    schema = f"client_id {client_type}, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path array<long>"
    return timely.cogroup(late).applyInPandas(_grouped(gap, longest), schema)
