"""The registered corpus queries: those with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from halocline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    cur = c.execute(registry.ORACLE_SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[x] for x in cols) for r in df.collect()))) == sorted(map(str, cur.fetchall()))


def test_one_query_per_operator():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}
