"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from foliant.plans import oracles, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value + 0.0, 5))
    return str(value)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    cursor = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = got.select(*names).collect()
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(oracles.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
