import duckdb
import pytest

from lodestone.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    told = c.execute(ORACLE[name])
    columns = [x[0] for x in told.description]
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert sorted(map(plain, told.fetchall())) == sorted(plain(r) for r in QUERIES[name](spark, SF).select(*columns).collect())
