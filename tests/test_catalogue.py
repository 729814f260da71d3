"""Every query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from weirstone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    held = duckdb.connect()
    for t in TABLES:
        held.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return held


def plain(rows):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        return repr(round(x, 9)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    columns = sorted(found.columns)
    ran = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in ran.fetchall()]
    assert plain(found.select(*columns).collect()) == plain(expected)


def test_every_sql_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
