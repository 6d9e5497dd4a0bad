"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from halocline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v if isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    rows = sorted(([norm(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=str)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in registry.ORACLE_SQL:
        cur = duck.execute(registry.ORACLE_SQL[name])
        cols = [x[0] for x in cur.description]
        assert sorted(cols) == sorted(df.columns)
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        assert rows == sorted(([norm(r[i]) for i in order] for r in cur.fetchall()), key=str)


def test_what_is_not_built_is_not_claimed():
    """What README's list names is in no query's lines."""
    readme = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md"), encoding="utf-8").read()
    listed = readme.split("## Not built")[1].split("\n## ")[0]
    missing = {x for line in listed.split("\n") if line.startswith("* ") for x in re.findall(r"\b[AGJMOSTU]\d+\b", line.split(":")[0])}
    assert not missing & {x for covers in registry.COVERS.values() for x in covers.split()}


def test_flagship(spark):
    assert registry.FLAGSHIP in registry.QUERIES and registry.FLAGSHIP in registry.ORACLE_SQL
