"""Queries on gridded fields and on models."""

from pyspark.sql import functions as F

from halocline.operators import grids as G
from halocline.operators import models as M
from halocline.plans.book import query
from halocline.plans.standins import table


@query("G1 G10 J30", """
WITH p AS (SELECT occ_id, floor((lon + 180) / 5 + 0.5)::INT AS i, floor((lat + 90) / 4 + 0.5)::INT AS j FROM occurrences)
SELECT p.occ_id, f.value, CASE WHEN f.i IS NULL THEN 'not_covered' WHEN f.value IS NULL THEN 'no_data' ELSE 'ok' END AS status FROM p LEFT JOIN field f ON f.i = p.i AND f.j = p.j""")
def field_sample(spark, d):
    points = table(spark, d, "occurrences").select("occ_id", (F.col("lon") / 5 * 4).alias("lon"), "lat")
    return G.sample(points, table(spark, d, "field"), (-144.0, -90.0), 4.0).select("occ_id", "value", "status")


@query("G4", "SELECT i // 6 AS bi, j // 6 AS bj, round(avg(value), 6) AS mean, count(value) AS valid FROM field GROUP BY ALL")
def block_means(spark, d):
    return G.block_mean(table(spark, d, "field")).withColumn("mean", F.round("mean", 6))


@query("G4", "SELECT (i - 57 + 60) % 60 // 6 AS bi, j // 6 AS bj, round(avg(value), 6) AS mean, count(value) AS valid FROM field GROUP BY ALL")
def seam_blocks(spark, d):
    """Blocks on a closed circle of 60 columns counted from column 57: the first one lies over the seam."""
    return G.block_mean(table(spark, d, "field"), 6, 60, 57).withColumn("mean", F.round("mean", 6))


@query("G2", """
WITH m AS (SELECT i, j, i % 12 + 1 AS month, value FROM field WHERE j % 3 = 0), p AS (SELECT i, j, j % 12 + 1 AS month, CASE WHEN i % 2 = 0 THEN 100 ELSE 2000 END::DOUBLE AS depth FROM field)
SELECT p.i, p.j, p.month, coalesce(CASE WHEN p.depth <= 1500 THEN m.value END, a.value) AS value FROM p LEFT JOIN m ON m.i = p.i AND m.j = p.j AND m.month = p.month LEFT JOIN field a ON a.i = p.i AND a.j = p.j""")
def climatology_fallback(spark, d):
    f = table(spark, d, "field")
    points = f.select("i", "j", (F.col("j") % 12 + 1).alias("month"), F.when(F.col("i") % 2 == 0, 100.0).otherwise(2000.0).alias("depth"))
    return G.with_fallback(points, f.where("j % 3 = 0").select("i", "j", (F.col("i") % 12 + 1).alias("month"), "value"), f, ["i", "j"]).select("i", "j", "month", "value")


@query("G6", "SELECT a.i, a.j, a.value - b.value AS anomaly FROM field a JOIN (SELECT i, j, avg(value) OVER (PARTITION BY i) AS value FROM field) b ON a.i = b.i AND a.j = b.j")
def field_anomaly(spark, d):
    f = table(spark, d, "field")
    means = f.groupBy("i").agg(F.avg("value").alias("value"))
    climate = f.select("i", "j").join(means, "i")
    return G.anomaly(f, climate, ["i", "j"]).select("i", "j", "anomaly")


@query("G7 G8", """
WITH l AS (SELECT *, lag(depth) OVER w AS d0, lag(value) OVER w AS v0 FROM columns WINDOW w AS (PARTITION BY col_id ORDER BY depth)), c AS (SELECT col_id, min_by(CASE WHEN d0 IS NULL THEN depth ELSE d0 + (1 - v0) / (value - v0) * (depth - d0) END, depth) AS h FROM l WHERE value < 1 GROUP BY col_id)
SELECT DISTINCT k.col_id, round(c.h, 6) AS horizon FROM columns k LEFT JOIN c ON c.col_id = k.col_id""")
def saturation_horizon(spark, d):
    out = G.crossing_depth(table(spark, d, "columns"), ["col_id"])
    return out.select("col_id", F.when(F.col("horizon") < float("inf"), F.round("horizon", 6)).alias("horizon"))


@query("", "SELECT a.i, a.j, round(avg(abs(a.value - b.value)), 6) AS tri, count(*) AS neighbours FROM field a JOIN field b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL")
def ruggedness(spark, d):
    return G.ruggedness(table(spark, d, "field")).withColumn("tri", F.round("tri", 6))


@query("")
def track_back(spark, d):
    """Particles of the events traced back three days through a field of the lineitems; tested on a small field."""
    f = table(spark, d, "field").where("value IS NOT NULL").select("i", "j", ((F.col("value") % 7 - 3) / 4).alias("u"), ((F.col("value") % 5 - 2) / 4).alias("v"))
    start = table(spark, d, "positions").select(F.col("pos_id").alias("id"), F.pmod("lon", F.lit(60.0)).alias("lon"), F.pmod("lat", F.lit(40.0)).alias("lat"))
    return G.track_back(start, f, 3, (0.0, 0.0), 1.0).select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "age")


@query("M1 M3", "SELECT DISTINCT round(lon, 1) AS rlon, round(lat, 1) AS rlat, species_no, (((floor(lat / 5) + floor(lon / 5)) % 5 + 5) % 5)::INT AS fold FROM occurrences")
def thinned_folds(spark, d):
    thin = M.thin(table(spark, d, "occurrences").select("lon", "lat", "species_no"), "species_no", 1)
    return thin.withColumn("fold", M.block_fold(F.col("lon"), F.col("lat"), 5)).select(F.round("lon", 1).alias("rlon"), F.round("lat", 1).alias("rlat"), "species_no", "fold").distinct()


@query("", "SELECT grp, min(depth) AS lo, max(depth) AS hi, count(*) FILTER (depth NOT BETWEEN 100 AND 1500) AS outside FROM occurrences GROUP BY grp")
def training_envelope(spark, d):
    return table(spark, d, "occurrences").groupBy("grp").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.count_if(~F.col("depth").between(100, 1500)).alias("outside"))


@query("M4")
def habitat_model(spark, d):
    """Presence-background logistic regression with spatial folds: AUC per fold, and a gate on AUC and rows."""
    o = table(spark, d, "occurrences").where("depth IS NOT NULL")
    rows = o.select("lon", "lat", F.col("depth"), F.col("edna").cast("double").alias("label"), M.block_fold(F.col("lon"), F.col("lat"), 3).alias("fold"))
    return M.evaluate_folds(rows, ["depth", "lat"], 3)


@query("M4")
def habitat_surface(spark, d):
    """Models of spatial folds, presences against weighted background, applied together to a grid of cells: mean and spread of
    what they say (tested against a plain fit of the same folds)."""
    o = table(spark, d, "occurrences").where("depth IS NOT NULL")
    rows = o.select("depth", "lat", F.col("edna").cast("double").alias("label"), M.block_fold(F.col("lon"), F.col("lat"), 3).alias("fold"))
    cells = o.groupBy(F.floor(F.col("lon") / 5).cast("int").alias("cx"), F.floor(F.col("lat") / 5).cast("int").alias("cy")).agg(F.avg("depth").alias("depth"), F.avg("lat").alias("lat"))
    out = M.predict_ensemble(M.fold_models(rows, ["depth", "lat"], 3), cells, ["depth", "lat"])
    return out.select("cx", "cy", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))
