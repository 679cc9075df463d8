import os

import duckdb
import pytest

from lodestone.plans.filing_queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    told = tables.sql(ORACLE[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in told.fetchall()), key=repr)
