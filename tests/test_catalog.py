import math

import duckdb
import pytest

from tessella.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_oracle(spark, sf, oracle, name):
    got = catalog.QUERIES[name](spark, sf)
    rows = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name in catalog.ORACLE_SQL:
        want = oracle.sql(catalog.ORACLE_SQL[name])
        order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert rows
