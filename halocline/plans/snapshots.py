"""Queries on snapshot reconciliation."""

from pyspark.sql import functions as F

from halocline.operators import snapshots as N
from halocline.plans.book import query
from halocline.plans.standins import table


@query("S17 U3", "SELECT id, dataset FROM stored WHERE id NOT IN (SELECT id FROM seen)")
def purge_set(spark, d):
    return N.purge_set(table(spark, d, "stored"), table(spark, d, "seen"), "id").select("id", "dataset")


@query("S18", """
WITH m AS (SELECT s.*, n.id IS NULL AS gone FROM stored s LEFT JOIN seen n ON n.id = s.id), k AS (SELECT dataset, count(*) FILTER (gone) AS orphans, count(*) FILTER (NOT gone) AS live FROM m GROUP BY dataset),
t AS (SELECT (SELECT count(*) FROM stored) AS total, (SELECT count(DISTINCT id) FROM seen) AS seen, sum(orphans)::BIGINT AS orphans, (sum(orphans) FILTER (live = 0))::BIGINT AS absent FROM k)
SELECT *, CASE WHEN absent > total * 0.12 OR orphans > total * 0.35 OR seen < total * 0.5 THEN 'refuse' WHEN orphans = 0 THEN 'nothing' ELSE 'purge' END AS verdict,
 concat_ws('; ', CASE WHEN seen < total * 0.5 THEN 'too few seen' END, CASE WHEN absent > total * 0.12 THEN 'absent datasets over the ceiling' END, CASE WHEN orphans > total * 0.35 THEN 'all orphans over the ceiling' END) AS reasons FROM t""")
def purge_verdict(spark, d):
    return N.purge_verdict(table(spark, d, "stored").select("id", "dataset"), table(spark, d, "seen").select("id"), "id", "dataset", F.lit(True))


@query("A48", "SELECT s.dataset, count(*) FILTER (n.id IS NULL) AS orphans, count(*) FILTER (n.id IS NOT NULL) AS live FROM stored s LEFT JOIN seen n ON n.id = s.id GROUP BY s.dataset HAVING count(*) FILTER (n.id IS NULL) > 0")
def orphan_split(spark, d):
    return N.orphan_split(table(spark, d, "stored"), table(spark, d, "seen"), "id", "dataset")


@query("S13", "SELECT s.id, s.dataset, coalesce(n.value, s.value) AS value, coalesce(n.state, s.state) AS state FROM stored s LEFT JOIN (SELECT id, nullif(value, 0) AS value, CASE WHEN state = 'P' THEN NULL ELSE state END AS state FROM seen) n ON n.id = s.id")
def coalescing_upsert(spark, d):
    new = table(spark, d, "seen").selectExpr("id", "dataset", "nullif(value, 0D) AS value", "CASE WHEN state = 'P' THEN NULL ELSE state END AS state")
    return N.coalescing_upsert(table(spark, d, "stored"), new, "id")


@query("S14", "SELECT dataset, sum(n)::BIGINT AS n FROM (SELECT dataset, count(*) AS n FROM stored GROUP BY dataset UNION ALL SELECT dataset, count(*) FROM seen GROUP BY dataset) GROUP BY dataset")
def additive_upsert(spark, d):
    a, b = (table(spark, d, t).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")) for t in ("stored", "seen"))
    return N.additive_upsert(a, b, ["dataset"], ["n"])


@query("S15", "WITH r AS (SELECT dataset, value, state FROM stored UNION ALL SELECT dataset, value, state FROM seen) SELECT dataset, max(value) AS value, max_by(state, value) AS state FROM r GROUP BY dataset")
def widening_upsert(spark, d):
    return N.widening_upsert(table(spark, d, "stored"), table(spark, d, "seen"), ["dataset"], "value", "state")


@query("S16", "SELECT n.id, CASE WHEN s.id IS NULL THEN 'insert' WHEN s.value IS NOT DISTINCT FROM n.value AND s.state IS NOT DISTINCT FROM n.state THEN 'noop' ELSE 'update' END AS op FROM seen n LEFT JOIN stored s ON s.id = n.id AND s.dataset <> 5")
def change_only_upsert(spark, d):
    return N.change_only_upsert(table(spark, d, "stored").where("dataset <> 5"), table(spark, d, "seen"), "id", ["value", "state"])


@query("S29", """
SELECT CASE WHEN s.id IS NULL THEN 'not_in_table' WHEN s.v IS NOT DISTINCT FROM n.v THEN 'unchanged' WHEN s.v IS NULL THEN 'null_to_value' WHEN n.v IS NULL THEN 'value_to_null' WHEN s.v = 0 THEN 'zero_to_value' WHEN s.v * n.v < 0 THEN 'sign_flip' ELSE 'other' END AS change, count(*) AS n
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 - 2 END AS v FROM seen) n LEFT JOIN (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 4 - 1 END AS v FROM stored WHERE dataset <> 5) s ON s.id = n.id GROUP BY ALL""")
def change_report(spark, d):
    old = table(spark, d, "stored").where("dataset <> 5").selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 4 - 1 END AS v")
    return N.change_report(old, table(spark, d, "seen").selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 - 2 END AS v"), "id", "v")


@query("S25", """
WITH r AS (SELECT id, id % 9 AS revision FROM seen WHERE id % 11 <> 0), s AS (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE 4 END AS stamp, id % 17 <> 0 AS has_values FROM stored WHERE dataset <> 2), k AS (SELECT id, 5 AS judged FROM stored WHERE dataset = 2 AND id % 2 = 0)
SELECT coalesce(r.id, s.id) AS id, CASE WHEN r.id IS NULL THEN 'vanished' WHEN s.id IS NULL AND judged >= revision THEN 'skip' WHEN s.id IS NULL THEN 'new' WHEN NOT has_values THEN 'broken' WHEN stamp IS NOT NULL AND revision > stamp THEN 'corrected' WHEN stamp IS NULL THEN 'stamp_only' ELSE 'keep' END AS action
FROM r FULL JOIN s ON r.id = s.id LEFT JOIN k ON k.id = r.id""")
def revision_plan(spark, d):
    stored, seen = table(spark, d, "stored"), table(spark, d, "seen")
    remote = seen.where("id % 11 <> 0").selectExpr("id", "id % 9 AS revision")
    return N.revision_plan(remote, stored.where("dataset <> 2").selectExpr("id", "CASE WHEN id % 13 = 0 THEN NULL ELSE 4 END AS stamp", "id % 17 <> 0 AS has_values"), stored.where("dataset = 2 AND id % 2 = 0").selectExpr("id", "5 AS judged"))


@query("S27", """
WITH g AS (SELECT dataset, count(*) AS g FROM stored WHERE id NOT IN (SELECT id FROM seen) GROUP BY dataset), s AS (SELECT dataset, count(*) AS s FROM stored GROUP BY dataset)
SELECT sum(coalesce(g, 0))::BIGINT AS gone, sum(s)::BIGINT AS stored, sum(coalesce(g, 0)) > greatest(100, sum(s) * 0.5) OR bool_or(coalesce(g, 0) > s * 0.8) AS hold FROM s LEFT JOIN g ON g.dataset = s.dataset""")
def held_deletions(spark, d):
    stored = table(spark, d, "stored")
    return N.held_deletions(N.purge_set(stored, table(spark, d, "seen"), "id"), stored, "dataset", 100, 0.5, 0.8)


@query("", """
WITH a AS (SELECT l_orderkey AS k, 't' || (l_suppkey % 4) AS taxon, sum(l_quantity) AS n FROM lineitem GROUP BY ALL), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' ELSE 'both' END AS side, count(*) AS n, round(coalesce(sum(a.n), 0), 2) AS total FROM a FULL JOIN b ON a.k = b.k GROUP BY ALL""")
def two_file_consistency(spark, d):
    """A map of abundances per sample is packed, unpivoted again and held against the second file's keys."""
    wide = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.concat(F.lit("t"), F.col("l_suppkey") % 4).alias("taxon")).agg(F.sum("l_quantity").alias("n"))
    packed = wide.groupBy("k").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("taxon", "n")))).alias("json"))
    a = packed.select("k", F.explode(F.from_json("json", "map<string, double>")).alias("taxon", "n"))
    b = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("b_k"))
    both = a.join(b, F.col("k") == F.col("b_k"), "full")
    return both.groupBy(F.when(F.col("k").isNull(), "only_b").when(F.col("b_k").isNull(), "only_a").otherwise("both").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("n"), F.lit(0.0)), 2).alias("total"))


@query("S33", """
SELECT DISTINCT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate > TIMESTAMP '1998-01-01')""")
def pending_lookups(spark, d):
    answers = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_orderstatus") == "P").alias("found"), F.col("o_orderdate").cast("timestamp").alias("checked_at"))
    return N.pending(table(spark, d, "customer").select(F.col("c_custkey").alias("name")), answers, "name", F.expr("TIMESTAMP '1998-01-31'"), 30)


@query("S23", """SELECT n_nationkey AS id, CASE WHEN n_name LIKE 'I%' THEN '''' || n_name ELSE n_name END AS name, 'POLYGON((' || x0 || ' ' || y0 || ',' || x1 || ' ' || y0 || ',' || x1 || ' ' || y1 || ',' || x0 || ' ' || y1 || ',' || x0 || ' ' || y0 || '))' AS wkt
FROM (SELECT *, n_nationkey * 3 AS x0, n_nationkey AS y0, n_nationkey * 3 + 2 AS x1, n_nationkey + 1 AS y1 FROM nation)""")
def export_rows(spark, d):
    from halocline.sources.sinks import guard_formula, wkt

    rows = table(spark, d, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "n_nationkey * 3 AS x0", "n_nationkey AS y0", "n_nationkey * 3 + 2 AS x1", "n_nationkey + 1 AS y1")
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    return rows.select("id", guard_formula(F.col("name"), "I").alias("name"), wkt(ring).alias("wkt"))
