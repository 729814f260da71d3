import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from brute import low

from weirstone.llm import divergence, oracles, queries

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, term string, n long"
MADE = ["", "a", "Ab", "é日本", "x" * 31, "y" * 32, "Z" * 100, "the", "QUICK", "ab1cd_ef", "ß", "\U0001f600ok"]


def brute(rows, min_docs=10, top=10):
    """``rows``: text, lang, source. All in Python's whole numbers."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(low(text))
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out, share = [], lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    ranked = lambda rows: [(*row, k) for k, row in enumerate(sorted(rows, key=lambda x: (-x[4], x[3].encode())), 1)]
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for x in groups:
            if x[0] == lang:
                whole.update(count[x])
        shares = {x: {t: share(count[x][t], sum(count[x][k] for k in kept), len(kept)) for t in kept} for x in groups if x[0] == lang}
        q = {t: share(whole[t], sum(whole[k] for k in kept), len(kept)) for t in kept}
        for x, p in shares.items():
            out += ranked((*x, "pair", y[1], sum(f(p[t], r[t]) for t in kept)) for y, r in shares.items() if y != x)
            out += ranked((*x, "term", t, f(p[t], q[t])) for t in kept if count[x][t] and p[t] > q[t])[:top]
    return sorted(out)


def given(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_the_hash_is_xxh64():
    chance = np.random.default_rng(1)
    data = chance.integers(0, 256, 5000, dtype=np.uint8)
    lengths = np.repeat(np.arange(1, 70), 3)
    starts = chance.integers(0, 4900, len(lengths))
    assert divergence.xxh64(data, starts, lengths).tolist() == [xxhash.xxh64_intdigest(data[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_equal_hashes_are_verified(bits):
    chance = random.Random(2)
    texts = [" ".join(chance.choices(MADE, k=30)) for _ in range(20)] + ["", None]
    data, starts, lengths, row = divergence.terms(pa.array(texts))
    hashes = divergence.xxh64(data, starts, lengths) >> np.uint64(64 - bits) if bits else np.zeros(len(starts), np.uint64)
    order, new = divergence.grouped_terms(data, starts, lengths, hashes)
    spelt = [data[s : s + n].tobytes().decode() for s, n in zip(starts, lengths, strict=True)]
    assert spelt == [t for text in texts for t in TERM.findall(low(text))]
    bounds = [*np.flatnonzero(new), len(order)]
    found = {spelt[order[a]]: b - a for a, b in zip(bounds, bounds[1:], strict=False)}
    assert found == Counter(spelt) and len(bounds) - 1 == len(found)
    for a, b in zip(bounds, bounds[1:], strict=False):
        assert len({spelt[k] for k in order[a:b]}) == 1 and list(row[order[a:b]]) == sorted(row[order[a:b]])


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 20, "tile_sources": 2}])
def test_against_brute_force(spark, sizes):
    chance = random.Random(3)
    rows = []
    for k in range(150):
        lang = chance.choice(["en", "de", None, ""])
        source = chance.choice(["s1", "s2", "S3", "é", "日", None])
        rows.append((" ".join(chance.choices(MADE[:8] if source == "s1" else MADE, k=chance.randint(0, 40))), lang, source, "clash", k))
    rows += [(None, "en", "only null", None, None), ("", "fr", "a", None, None), ("12 34", "fr", "b", None, None), ("the " * 9, "xx", "one source", None, None)]
    rows += rows[:30]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = given(divergence.audit(docs, **sizes))
    assert found == brute(rows)
    assert {x[0] for x in found} == {"en", "de", "", "fr"}  # a lone source without kept terms has no row
    assert given(divergence.audit(docs.limit(0))) == []


def test_one_long_text_and_many_tiles(spark):
    rows = [("ab " * 50_000 + "cd" * 30_000, "en", f"s{k % 7}", None, None) for k in range(2)] + [(f"ab ef{k % 3}", "en", f"s{k % 7}", None, None) for k in range(80)]
    assert given(divergence.audit(spark.createDataFrame(rows, SCHEMA), block_rows=3, tile_sources=1)) == brute(rows)


def test_query_its_sql_and_brute_force(spark):
    found = queries.op12_source_divergence(spark, DATA)
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = db.sql(oracles.DIVERGENCE)
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    got = given(found)
    assert got == sorted(want.select("lang, source, part, item, value, rank").fetchall())
    assert got == brute(db.sql("select text, lang, source from documents").fetchall())
