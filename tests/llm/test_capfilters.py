import duckdb
import numpy as np
import pytest

from weirstone.llm import capfilters, oracles, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, node string, filters string"


def brute(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    kept = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for n in {len(rows[k][1]) for k in kept}:
        own = [k for k in kept if len(rows[k][1]) == n]
        x = np.array([rows[k][1] for k in own], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= cosine
        same = (np.array([rows[k][1] for k in own], np.float32)[:, None] == np.array([rows[k][1] for k in own], np.float32)[None]).all(2) if len(own) < 400 else np.eye(len(own), dtype=bool)
        for a, b in zip(*np.nonzero(near | same), strict=True):
            if a != b:
                links[own[a]].add(own[b])
    root = list(range(len(rows)))
    least = [rows[k][0] for k in range(len(rows))]
    for k in range(len(rows)):
        todo, seen = [k], {k}
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        ids = [least[x] for x in seen if least[x] is not None]
        root[k] = min(ids) if ids else None
    return sorted(((rows[k][0], len(links[k]), root[k], rows[k][0] is not None and rows[k][0] == root[k]) for k in range(len(rows))), key=str)


def given(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "n", "f") for i, v in rows], SCHEMA)


def unit(chance, n, dim=64):
    x = chance.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def partner(chance, x, cosine):
    z = chance.standard_normal(x.shape)
    z -= np.einsum("ij,ij->i", z, x)[:, None] * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1)[:, None]


def test_list_decoding_finds_all_filters_over_the_threshold():
    chance = np.random.default_rng(1)
    for blocks, words in ((1, 50), (2, 30), (3, 12), (4, 6)):
        code = capfilters.Code(2.0, 1, blocks, words)
        products = capfilters.word_products(unit(chance, 40, 16), code, 0, 5)
        every = products[0]
        for x in products[1:]:
            every = (every[:, :, None] + x[:, None]).reshape(40, -1)
        row, number = capfilters.list_decode(products, code.threshold)
        want = np.nonzero(every >= code.threshold)
        assert row.tolist() == want[0].tolist() and number.tolist() == want[1].tolist() and len(row) > 20


@pytest.mark.parametrize("n", [1_000, 100_000, 10_000_000])
def test_pairs_at_the_threshold_share_filters(n):
    """What is missed of pairs at the threshold itself, and of closer ones, with the code for n vectors."""
    chance = np.random.default_rng(2)
    code = capfilters.choose_code(n, 0.95, 64)
    x = unit(chance, 2000)
    for cosine, most in ((0.9501, 0.01), (0.97, 0.001)):
        sides = [{(r, f) for r, f in zip(*map(np.ndarray.tolist, capfilters.filters_of(v, code, 11)), strict=True)} for v in (x, partner(chance, x, cosine))]
        shared = np.bincount([r for r, _ in sides[0] & sides[1]], minlength=len(x))
        assert (shared == 0).mean() <= most
        assert 0.8 * capfilters.COMMON <= shared.mean()


@pytest.mark.parametrize("block", [1024, 8])
def test_clusters_copies_and_strangers(spark, block):
    chance = np.random.default_rng(3)
    base = unit(chance, 120)
    rows = [*base, *partner(chance, base[:60], 0.96), *np.repeat(base[:1], 30, 0), *partner(chance, np.repeat(base[1:2], 50, 0), 0.99), *partner(chance, base[60:100], 0.93), *(3 * base[5:9])]
    rows = [(int(k), v) for k, v in zip(chance.permutation(len(rows)), rows, strict=True)]
    assert given(capfilters.near_vectors(made(spark, rows), block=block)) == brute(rows)


def test_edges_nulls_lengths_and_repeats(spark):
    chance = np.random.default_rng(4)
    x = unit(chance, 6)
    rows = [(1, x[0]), (2, x[0]), (2, x[1]), (None, x[1]), (None, x[2]), (4, None), (5, []), (6, [0.0] * 64), (7, [None, *x[0][1:]]), (8, [float("nan"), *x[0][1:]]), (9, [float("inf"), *x[0][1:]]), (10, [1.0, 0.0]), (11, [2.0, 0.0]), (12, [0.0, 1.0]), (13, [1e-30] * 64), (14, [1e30] * 64), (15, [3.0]), (16, [4.0]), (17, [-4.0])]
    rows += rows[:1]
    assert given(capfilters.near_vectors(made(spark, rows))) == brute(rows)
    assert given(capfilters.near_vectors(made(spark, rows).limit(0))) == []
    assert given(capfilters.near_vectors(made(spark, rows).where("vec_id = 4"))) == [(4, 0, 4, True)]


def test_a_pair_counts_once_however_blocks_meet():
    """Two blocks, and one with itself, give each link once over all filters."""
    chance = np.random.default_rng(5)
    units = partner(chance, np.repeat(unit(chance, 1), 40, 0), 0.995)
    filters = [np.sort(chance.choice(9, 6, replace=False)) for _ in range(40)]
    sums, tied = np.zeros(40, np.int64), []
    for own in range(9):
        at = np.array([k for k in range(40) if own in filters[k]])
        halves = [(x, np.ones(len(x), np.int64), units[x], [filters[k] for k in x]) for x in (at[at % 2 == 0], at[at % 2 == 1])]
        for left, right in ((halves[0], None), (halves[1], None), (halves[0], halves[1])):
            for a, b, edge in capfilters.meet(0.95, own, left, right):
                tied += [(x, y) for x, y in zip(a, b, strict=True)] if edge else []
                np.add.at(sums, a, 0 if edge else b)
    want = [[(units[i] @ units[j] >= 0.95) and i != j and bool(set(filters[i]) & set(filters[j])) for j in range(40)] for i in range(40)]
    assert sums.tolist() == [sum(x) for x in want]
    seen, todo = {0}, [0]
    while todo:
        k = todo.pop()
        more = {b for a, b in tied if a == k} | {a for a, b in tied if b == k}
        todo += more - seen
        seen |= more
    assert seen == set(range(40))


def test_query_and_its_sql(spark):
    found = queries.op13_near_vectors(spark, DATA)
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = db.sql(oracles.NEAR_VECTORS)
    assert sorted(found.columns) == sorted(want.columns)
    assert given(found.select("vec_id", "n_links", "component_id", "kept")) == sorted(want.select("vec_id, n_links, component_id, kept").fetchall(), key=str)
