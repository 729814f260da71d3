"""How the terms of each source differ from those of its language's other sources.

A byte-level tokenizer runs over whole slices: a lookup table over the concatenated UTF-8 buffer
finds where terms begin and end, XXH64 of all terms groups them, and equal hashes are verified byte
by byte. Spark sums the counts. Divergences between sources come from blocks of terms: each is a
compressed sparse matrix of sources by terms, and one ``reduceat`` gives a source against all others.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirstone.llm._spark import cut, written
from weirstone.llm._text import LOWER, per_slice, text_buffer

#: Bytes of a term: letters (upper case becomes lower) and all of other scripts.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True

#: Shares are counted in parts of this.
SCALE = 1_000_000_000

#: Counts in a block of terms on average; sources in a tile of a language's sources on average.
BLOCK_ROWS, TILE_SOURCES = 65_536, 256

#: Bytes of the table of sources that may be broadcast; it is measured.
SMALL = 8 << 20

# The primes of XXH64 (fixed values).
PRIME_1 = np.uint64(11400714785074694791)
PRIME_2 = np.uint64(14029467366897019727)
PRIME_3 = np.uint64(1609587929392839161)
PRIME_4 = np.uint64(9650029242287828579)
PRIME_5 = np.uint64(2870177450012600261)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _gather(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The bytes of slices of one length, a row each."""
    return np.lib.stride_tricks.sliding_window_view(data, length)[starts]


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of many slices of a buffer; those below 32 bytes, which have no stripes, a length at a time."""
    out = np.zeros(len(starts), np.uint64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        if length >= 32:
            out[at] = [xxhash.xxh64_intdigest(data[s : s + length].tobytes()) for s in starts[at]]
            continue
        begin, h = starts[at], np.full(len(at), PRIME_5 + np.uint64(length))
        for k in range(0, length - 7, 8):
            lane = _gather(data, begin + k, 8).view("<u8").ravel()
            h = _turn(h ^ (_turn(lane * PRIME_2, 31) * PRIME_1), 27) * PRIME_1 + PRIME_4
        k = length // 8 * 8
        if length - k >= 4:
            h = _turn(h ^ (_gather(data, begin + k, 4).view("<u4").ravel().astype(np.uint64) * PRIME_1), 23) * PRIME_2 + PRIME_3
            k += 4
        for k in range(k, length):
            h = _turn(h ^ (data[begin + k].astype(np.uint64) * PRIME_5), 11) * PRIME_1
        h = (h ^ (h >> np.uint64(33))) * PRIME_2
        h = (h ^ (h >> np.uint64(29))) * PRIME_3
        out[at] = h ^ (h >> np.uint64(32))
    return out


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes of all rows, starts and lengths of the terms, row of each term)."""
    data, offsets = text_buffer(column)
    data = LOWER[data]
    n = len(data)
    mask = TERM[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin, end = mask.copy(), mask.copy()
    if n:
        begin[1:] &= ~mask[:-1] | edge[1:n]
        end[:-1] &= ~mask[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return data, starts, np.flatnonzero(end) + 1 - starts, np.searchsorted(offsets, starts, "right") - 1


def same_as_last(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For the asked places (not 0): whether a slice has the bytes of the slice before it."""
    out = lengths[asked] == lengths[asked - 1]
    for length in np.unique(lengths[asked[out]]):
        at = np.flatnonzero(out & (lengths[asked] == length))
        a, b = starts[asked[at]], starts[asked[at] - 1]
        if length >= 32:
            out[at] = [np.array_equal(data[x : x + length], data[y : y + length]) for x, y in zip(a, b, strict=True)]
        else:
            out[at] = (_gather(data, a, length) == _gather(data, b, length)).all(1)
    return out


def grouped_terms(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal terms together and else keeps their order; where in it a new term begins)."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    asked = np.flatnonzero(~new)
    differs = asked[~same_as_last(data, starts[order], lengths[order], asked)]
    if len(differs):
        # Terms of one hash: put each hash's terms in order by their bytes.
        run = np.cumsum(new) - 1
        bounds = np.append(np.flatnonzero(new), len(order))
        for k in np.unique(run[differs]):
            own = order[bounds[k] : bounds[k + 1]]
            spelt = [data[starts[i] : starts[i] + lengths[i]].tobytes() for i in own]
            by = sorted(range(len(own)), key=spelt.__getitem__)
            order[bounds[k] : bounds[k + 1]] = own[by]
            new[bounds[k] + 1 : bounds[k + 1]] = [spelt[a] != spelt[b] for a, b in zip(by[1:], by[:-1], strict=True)]
    return order, new


def _term_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a slice."""
    lang, source = (batch.column(name).dictionary_encode() for name in ("lang", "source"))
    n_sources = len(source.dictionary)
    both = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
    by = np.argsort(both, kind="stable")
    batch, both = batch.take(pa.array(by)), both[by]
    data, starts, lengths, row = terms(batch.column("text"))
    order, new = grouped_terms(data, starts, lengths, xxh64(data, starts, lengths))
    row = row[order]
    # Rows are in the order of their groups, so a term's places go by group and row.
    group = both[row]
    new_group, new_row = new.copy(), new.copy()
    new_group[1:] |= group[1:] != group[:-1]
    new_row[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new_group)
    count = np.diff(np.append(first, len(order)))
    docs = np.add.reduceat(new_row.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    begin, size = starts[order[first]], lengths[order[first]]
    bounds = np.zeros(len(first) + 1, np.int32)
    np.cumsum(size, out=bounds[1:])
    body = data[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])]
    spelt = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(body))
    of = group[first]
    columns = [lang.dictionary.take(pa.array(of // n_sources)), source.dictionary.take(pa.array(of % n_sources)), spelt, pa.array(count), pa.array(docs)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(text, lang, source), nulls as empty ones."""
    return docs.select(*(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(to) for name, to in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and rows that hold it."""
    counted = _texts(docs, text_col, lang_col, source_col).mapInArrow(per_slice(_term_counts, "text"), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def against_all(a: tuple[np.ndarray, np.ndarray, int], pointers: np.ndarray, cols: np.ndarray, data: np.ndarray, zeros: np.ndarray, width: int) -> np.ndarray:
    """What the terms of a block add for one source (columns, shares, share without a count) against each row of a compressed sparse matrix.

    Only terms that either has count; a term that neither has would give ``divergence`` of the two shares without a count, which is left out everywhere.
    """
    own_cols, own, zero = a
    line, has = np.full(width, zero), np.zeros(width, bool)
    line[own_cols], has[own_cols] = own, True
    row = np.repeat(np.arange(len(zeros)), np.diff(pointers))
    none = divergence(np.int64(zero), zeros)
    # Terms of the other: in place of what the last sum has for them, and of none.
    here = divergence(line[cols], data) - none[row] - has[cols] * (divergence(line[cols], zeros[row]) - none[row])
    out = np.zeros(len(zeros), np.int64)
    full = np.flatnonzero(np.diff(pointers))
    if len(full):
        out[full] = np.add.reduceat(here, pointers[full])
    shares, times = np.unique(own, return_counts=True)
    return out + ((divergence(shares[:, None], zeros[None]) - none[None]) * times[:, None]).sum(0)


def _compare(key: tuple, group: pa.Table) -> pa.Table:
    """(lang, a, b, part): what a block of terms adds to each pair of sources of two tiles, or of one."""
    spelt = group["term"].combine_chunks()
    # A row without a term has each source of the tiles take part, whether it has terms of the block or not.
    term = pc.fill_null(pc.index_in(spelt, value_set=pc.unique(spelt).drop_null()), -1).to_numpy().astype(np.int64)
    name = group["source"].combine_chunks().dictionary_encode()
    side, zero = group["side"].to_numpy(), group["zero"].to_numpy()
    share = pc.fill_null(group["p"], 0).to_numpy()
    code = name.indices.to_numpy()
    order = np.lexsort((term, code, side))
    term, share, zero, code, side = term[order], share[order], zero[order], code[order], side[order]
    width = max(int(term.max()) + 1, 1)
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (side[1:] != side[:-1])))
    code, side, zero = code[first], side[first], zero[first]
    pointers = np.append(first, len(term)) - np.arange(len(first) + 1)
    term, share = term[term >= 0], share[term >= 0]
    split = int(np.searchsorted(side, 1))
    one_tile = key[2].as_py() == key[3].as_py()
    a, b, part = [], [], []
    for i in range(split):
        lo, hi = (i + 1, len(code)) if one_tile else (split, len(code))
        at = slice(pointers[i], pointers[i + 1])
        inside = slice(pointers[lo], pointers[hi])
        part.append(against_all((term[at], share[at], int(zero[i])), pointers[lo : hi + 1] - pointers[lo], term[inside], share[inside], zero[lo:hi], width))
        a.append(np.full(hi - lo, code[i]))
        b.append(code[lo:hi])
    a, b, part = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, part))
    names = name.dictionary
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": names.take(pa.array(a, pa.int64())), "b": names.take(pa.array(b, pa.int64())), "part": pa.array(part, pa.int64())})


def _share(n: str, total: str) -> str:
    """Exact at any size: the product has up to 38 digits."""
    return f"1 + cast((cast({SCALE} as decimal(38, 0)) * ({n} + 2)) div {total} as bigint)"


def _divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, min_docs: int = 10, top: int = 10, block_rows: int = BLOCK_ROWS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language, part ``term`` the ``top`` terms that stand out.

    Terms are runs of letters and of bytes above 0x7F, with A-Z lower-cased. A language keeps the V
    terms that at least ``min_docs`` of its rows hold. A group's (or language's) share of a kept term
    is p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), N its count of all kept terms, and two shares
    differ by floor((p - q) ** 2 / (p + q)). A pair's value sums this over all kept terms (0 without
    any); a term's value holds the group's share against the language's, where it is larger and the
    group has the term. Ranks go by value, then by item in UTF-8 order.

    Null texts, languages and sources count as empty ones; a group without terms has its pairs all the
    same; repeated rows count again. An empty table gives no rows. Other columns are ignored.
    """
    # One row by source meets in a window; only kept terms are written.
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, text_col, lang_col, source_col).withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term)})
    mine = written(counts.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"))
    there = cut(_texts(docs, text_col, lang_col, source_col).select("lang", "source").distinct())
    # Every kept term is in some source, so a language's sums come from its sources.
    in_lang = mine.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    in_group = mine.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    tiles = there.groupBy("lang").agg(F.ceil(F.count("*") / tile_sources).cast("int").alias("tiles"))
    groups = there.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").join(tiles, "lang")
    groups = groups.na.fill(0, ["group_total", "v", "lang_total"])
    groups = groups.withColumns({"total": F.expr("group_total + 2 * v"), "lang_total": F.expr("lang_total + 2 * v")})
    groups = cut(groups.withColumn("zero", F.expr(f"case when v > 0 then {_share('0', 'total')} end")).drop("group_total"))
    held = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0
    shared = mine.join(F.broadcast(groups) if held <= SMALL else groups.hint("merge"), ["lang", "source"])
    shared = written(shared.select("lang", "source", "term", "zero", "tiles", F.expr(_share("n", "total")).alias("p"), F.expr(_share("lang_n", "lang_total")).alias("q")))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    standing = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_divergence("p", "q")).alias("value"))
    standing = standing.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    blocks = 1 + shared.count() // block_rows
    meetings = F.expr("transform(sequence(0, tiles - 1), o -> struct(least(tile, o) as t1, greatest(tile, o) as t2, int(tile > o) as side))")
    dealt = shared.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")).withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    every = groups.where("v > 0").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.unionByName(every, allowMissingColumns=True)
    dealt = dealt.select("lang", "block", "source", "term", "p", "zero", F.explode(meetings).alias("m")).select("lang", "block", "source", "term", "p", "zero", "m.*")
    parts = dealt.groupBy("lang", "block", "t1", "t2").applyInArrow(_compare, "lang string, a string, b string, part long")
    sums = cut(parts.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("part").alias("parts")))
    sums = sums.union(sums.select("lang", "b", "a", "parts"))
    # The result itself lists all other sources of each source.
    left = groups.select("lang", F.col("source").alias("a"), "v", F.col("zero").alias("p"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("q"))
    pairs = left.join(right, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce(F.expr(f"v * ({_divergence('p', 'q')})"), F.lit(0)) + F.coalesce("parts", F.lit(0))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(standing)


