"""Geo-observation inputs derived from the star-schema tables. Each is one SELECT that Spark and DuckDB both read, so
that a query and its oracle start from the same rows; Spark applies it to the Parquet tables of a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LONLAT = """CAST((user_id % 5) * 37 - 90 AS DOUBLE) + CAST(event_id % 10 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon,
    CAST((user_id % 5) * 17 - 30 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat"""

# name: (SELECT for both, with {epoch:column} and {year:column} where the two write a timestamp function differently)
TABLES = {
    "positions": f"SELECT event_id AS pos_id, user_id AS mmsi, {{epoch:ts}} AS r_t, ts, value AS sog, {LONLAT} FROM events WHERE event_type <> 'purchase'",
    "detections": f"SELECT event_id AS det_id, {{epoch:ts}} AS t, ts, {LONLAT} FROM events WHERE event_type = 'purchase'",
    "boxes": """SELECT n_nationkey AS zone_id, n_name AS zone_name, CAST((n_nationkey % 5) * 37 - 90 AS DOUBLE) AS mx, CAST((n_nationkey % 5) * 17 - 30 AS DOUBLE) AS my,
    CAST(2 AS DOUBLE) / CAST(1000 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) * CAST(2 AS DOUBLE) / CAST(10000 AS DOUBLE) AS half FROM nation""",
    "occurrences": """SELECT l_orderkey * 8 + l_linenumber AS occ_id, CAST(l_partkey * 37 % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon, CAST(l_suppkey * 53 % 1800 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat,
    l_returnflag AS grp, CASE WHEN l_linenumber = 7 THEN NULL ELSE {year:l_shipdate} END AS year, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity * 40 END AS depth, l_linestatus = 'F' AS edna,
    l_partkey % 50 AS species_no, l_partkey, l_suppkey, l_linenumber FROM lineitem""",
    "levels": "SELECT l_orderkey AS cast_id, CAST(l_linenumber * 50 AS DOUBLE) AS depth, l_extendedprice AS raw, l_linenumber % 3 + 2 AS flag, l_linenumber AS level_no, CASE WHEN l_linenumber % 3 + 2 IN (3, 4, 9) THEN NULL ELSE l_extendedprice END AS value FROM lineitem",
    "requests": "SELECT event_id, ts, user_id % 20 AS key_id, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, event_id % 1000 AS bytes, event_type AS label, event_id % 7 AS agent FROM events",
    "stored": "SELECT o_orderkey AS id, o_custkey % 7 AS dataset, o_totalprice AS value, o_orderstatus AS state FROM orders",
    "seen": "SELECT o_orderkey AS id, o_custkey % 7 AS dataset, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS value, o_orderstatus AS state FROM orders WHERE o_orderkey % 10 <> 0 AND o_custkey % 7 <> 3",
    "field": "SELECT CAST(l_partkey % 60 AS INT) AS i, CAST(l_suppkey % 40 AS INT) AS j, CASE WHEN min(l_quantity) < 2 THEN NULL ELSE CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) END AS value FROM lineitem GROUP BY CAST(l_partkey % 60 AS INT), CAST(l_suppkey % 40 AS INT)",
    "columns": "SELECT o_custkey AS col_id, CAST(o_orderkey % 40 * 100 AS DOUBLE) AS depth, max(CAST(o_orderkey % 13 AS DOUBLE)) / CAST(4 AS DOUBLE) AS value FROM orders GROUP BY o_custkey, o_orderkey % 40",
}
TABLES |= {
    # Raw finds: ranks, coordinates with gaps and zeros, depths of both signs, dates written in several ways.
    "finds": """SELECT l_orderkey * 8 + l_linenumber AS occ_id, l_suppkey % 6 AS dataset, l_linenumber, l_partkey, l_suppkey,
    CASE l_partkey % 23 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(200 AS DOUBLE) ELSE CAST(l_partkey * 37 % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) END AS lon,
    CASE l_partkey % 23 WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(l_suppkey * 53 % 1800 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(90 AS DOUBLE) END AS lat,
    CASE l_partkey % 11 WHEN 0 THEN 'Copepoda' WHEN 1 THEN 'Dinophyceae' WHEN 2 THEN 'Bacillariophyceae' WHEN 3 THEN 'Coccolithophyceae' WHEN 4 THEN 'Prymnesiophyceae' WHEN 5 THEN 'Malacostraca' WHEN 6 THEN NULL ELSE 'Maxillopoda' END AS class,
    CASE WHEN l_partkey % 7 = 0 THEN 'Copepoda' END AS subclass, CASE l_suppkey % 5 WHEN 0 THEN 'Harpacticoida' WHEN 1 THEN 'Euphausiacea' WHEN 2 THEN 'Phaeocystales' WHEN 3 THEN NULL ELSE 'Calanoida' END AS ord,
    CASE l_suppkey % 3 WHEN 0 THEN 'Microsetella' WHEN 1 THEN 'Tisbe' END AS genus, CASE l_suppkey % 8 WHEN 0 THEN 'Bacillariophyta' WHEN 1 THEN 'Dinoflagellata' END AS phylum,
    l_linenumber = 7 AS absence, CASE WHEN l_quantity < 2 THEN true WHEN l_quantity < 3 THEN NULL ELSE false END AS dropped, l_quantity > 48 AS on_land,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN -l_quantity ELSE l_quantity * 300 END AS depth, CASE WHEN l_linenumber % 2 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity END AS dmin,
    CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN -l_quantity * 2 ELSE l_quantity * 3 END AS dmax, CASE l_suppkey % 9 WHEN 0 THEN 'Arctic 18S amplicons' WHEN 1 THEN 'eDNA survey' ELSE 'Net tows' END AS title,
    CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linenumber % 4 - 1 END AS n_dna, CAST(year(l_shipdate) AS INT) AS y, CAST(month(l_shipdate) AS INT) AS m, CAST(day(l_shipdate) AS INT) AS d, l_partkey % 10 AS style FROM lineitem""",
    "tags": "SELECT o_orderkey AS tag_id, o_custkey % 60 AS site, o_custkey, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS seen_at, CAST(o_custkey % 60 * 3 - 90 AS DOUBLE) AS lon, CAST(o_custkey % 60 - 80 AS DOUBLE) AS lat, 'Species ' || CAST(o_custkey % 37 AS STRING) AS name, o_orderkey % 9 AS cat_no FROM orders",
}
MARK = re.compile(r"\{(epoch|year):(\w+)\}")
SPARK = {"epoch": "unix_seconds(CAST({0} AS TIMESTAMP))", "year": "year({0})"}
DUCK = {"epoch": "CAST(floor(epoch({0})) AS BIGINT)", "year": "CAST(year({0}) AS INT)"}
#: A box as a closed ring, corners in order.
RING = "array(struct(mx - half AS x, my - half AS y), struct(mx + half AS x, my - half AS y), struct(mx + half AS x, my + half AS y), struct(mx - half AS x, my + half AS y), struct(mx - half AS x, my - half AS y))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in, or a table of the folder; timestamps as TIMESTAMP (session time zone)."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = MARK.sub(lambda m: SPARK[m[1]].format(m[2]), TABLES[name])
    source = re.search(r"FROM (\w+)", text)[1]
    out = spark.sql(re.sub(r"FROM (\w+)", "FROM {src}", text, count=1), src=spark.read.parquet(f"{sf_dir}/{source}.parquet"))
    return out.withColumn("ts", out["ts"].cast("timestamp")) if "ts" in out.columns else out


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "boxes").selectExpr("zone_id", "zone_name", "mx - half AS x0", "my - half AS y0", "mx + half AS x1", "my + half AS y1", f"{RING} AS ring")


def with_tables(sql: str) -> str:
    """DuckDB SQL with a CTE for each stand-in that it names."""
    names = [n for n in TABLES if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({MARK.sub(lambda m: DUCK[m[1]].format(m[2]), TABLES[n])})" for n in names]
    sql = sql.strip()
    if not ctes:
        return sql
    return "WITH " + ", ".join(ctes) + (", " + sql[5:] if sql.upper().startswith("WITH ") else " " + sql)
