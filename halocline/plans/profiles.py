"""Queries on profiles, tracks and series."""

from pyspark.sql import functions as F

from halocline.functions import classify
from halocline.operators import profiles as P
from halocline.plans.book import query
from halocline.plans.standins import table

LEVELS = "levels"


@query("W1", "SELECT mmsi, max_by(pos_id, (r_t, pos_id)) AS pos_id, max(r_t) AS r_t FROM positions GROUP BY mmsi")
def latest_positions(spark, d):
    return P.latest(table(spark, d, "positions").select("mmsi", "pos_id", "r_t"), "mmsi", [F.col("r_t"), F.col("pos_id")])


@query("W2", """
WITH r AS (SELECT pos_id, mmsi, row_number() OVER (PARTITION BY mmsi ORDER BY r_t, pos_id) AS rn, count(*) OVER (PARTITION BY mmsi) AS total FROM positions)
SELECT mmsi, pos_id FROM r WHERE rn % greatest(1, total // 5) = 0""")
def track_stride(spark, d):
    return P.stride(table(spark, d, "positions").select("mmsi", "pos_id", "r_t"), "mmsi", ["r_t", "pos_id"], 5).select("mmsi", "pos_id")


@query("W8", """
WITH r AS (SELECT pos_id, mmsi, row_number() OVER (PARTITION BY mmsi ORDER BY r_t, pos_id) - 1 AS i, count(*) OVER (PARTITION BY mmsi) AS total FROM positions)
SELECT mmsi, pos_id FROM r WHERE i % greatest(1, ceil((total - 1) / 6.0))::INT = 0 OR i = total - 1""")
def even_thinning(spark, d):
    return P.thin_evenly(table(spark, d, "positions").select("mmsi", "pos_id", "r_t"), "mmsi", ["r_t", "pos_id"], 7).select("mmsi", "pos_id")


@query("W6", """
WITH s AS (SELECT mmsi, r_t, lon, CASE WHEN r_t - lag(r_t) OVER w > 21600 OR abs(lon - lag(lon) OVER w) > 180 OR lag(r_t) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY r_t, lon, lat))
SELECT mmsi, sum(fresh)::BIGINT AS segments, count(*) AS points FROM s GROUP BY mmsi""")
def gap_segments(spark, d):
    s = P.segments(table(spark, d, "positions").select("mmsi", F.col("r_t").alias("t"), "lon", "lat"), "mmsi")
    return s.groupBy("mmsi").agg(F.max("segment").alias("segments"), F.count(F.lit(1)).alias("points"))


@query("W6")
def bounded_segments(spark, d):
    """Segments that also end at a span or a number of rows: a walk in order, tested against plain Python."""
    return P.bounded_segments(table(spark, d, "positions").select("mmsi", F.col("r_t").alias("t"), "lon", "lat"), "mmsi", gap_s=30 * 86400, limit=16)


@query("W11 P7", """
WITH t AS (SELECT unnest([{'t': 0.0, 'h': 60.0}, {'t': 100.0, 'h': 50.0}, {'t': 250.0, 'h': 100.0}]) AS w), n AS (SELECT cast_id, w.t AS target, depth, value, row_number() OVER (PARTITION BY cast_id, w.t ORDER BY abs(depth - w.t), depth, value) AS rn FROM levels, t WHERE value IS NOT NULL AND abs(depth - w.t) <= w.h)
SELECT cast_id, target::DOUBLE AS target, depth, value FROM n WHERE rn = 1""")
def standard_depths(spark, d):
    levels = table(spark, d, LEVELS).withColumn("value", classify.good_value(F.col("raw"), F.col("flag")))
    return P.standard_depths(levels, "cast_id", [(0.0, 60.0), (100.0, 50.0), (250.0, 100.0)])


@query("W18 A27", """
SELECT cast_id, min(depth) FILTER (depth <= 100 AND value IS NOT NULL) AS surface_depth, min_by(value, depth) FILTER (depth <= 100 AND value IS NOT NULL) AS surface_value, max(depth) AS deep_depth, max_by(value, depth) FILTER (value IS NOT NULL) AS deep_value FROM (SELECT cast_id, depth, min(value) AS value FROM levels GROUP BY ALL) GROUP BY cast_id""")
def surface_and_deep(spark, d):
    # A depth may come twice in a cast; the smaller value stands for it.
    one = table(spark, d, LEVELS).groupBy("cast_id", "depth").agg(F.min("value").alias("value"))
    return P.surface_and_deep(one, "cast_id", 100.0)


@query("W12", """
WITH b AS (SELECT cast_id, depth, raw, flag, row_number() OVER (PARTITION BY cast_id, floor(depth / 100) ORDER BY flag, depth, raw) AS rn FROM levels), c AS (SELECT *, row_number() OVER (PARTITION BY cast_id ORDER BY depth) AS nth FROM b WHERE rn = 1)
SELECT cast_id, depth, raw AS value FROM c WHERE nth <= 2""")
def thinned_levels(spark, d):
    levels = table(spark, d, LEVELS).select("cast_id", "depth", F.col("raw").alias("value"), F.col("flag").alias("rank"))
    return P.thin_bins(levels, "cast_id", 100.0, 2).select("cast_id", "depth", "value")


@query("W10", """
WITH r AS (SELECT o_custkey % 100 AS series, o_orderdate AS ts, o_orderkey, count(*) OVER (PARTITION BY o_custkey % 100, o_orderdate) - 1 AS losers, row_number() OVER (PARTITION BY o_custkey % 100, o_orderdate ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 99 END, o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT series, ts, o_orderkey AS kept, losers FROM r WHERE rn = 1""")
def best_instances(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("series"), F.col("o_orderdate").alias("ts"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return P.best_instance(rows, ["series", "ts"], {"F": 0, "O": 1}, "o_orderstatus", "o_totalprice", "o_orderkey").select("series", "ts", F.col("o_orderkey").alias("kept"), "losers")


@query("A49", """
WITH s AS (SELECT mmsi, r_t, 2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lat)) * cos(radians(lag(lat) OVER w)) * power(sin(radians(lon - lag(lon) OVER w) / 2), 2)))) AS km FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY r_t, lon, lat))
SELECT mmsi, count(*) AS points, round(coalesce(sum(km), 0), 4) AS km, min(r_t) AS t0, max(r_t) AS t1 FROM s GROUP BY mmsi""")
def trail_summary(spark, d):
    return P.trail(table(spark, d, "positions").select("mmsi", F.col("r_t").alias("t"), "lon", "lat"), "mmsi").withColumn("km", F.round("km", 4))


@query("A50", """
WITH s AS (SELECT mmsi, r_t, lon, lat, coalesce(((lon - lag(lon) OVER w + 540) % 360) - 180, 0) AS delta, first_value(lon) OVER w AS f FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY r_t, lon, lat)),
u AS (SELECT mmsi, f + sum(delta) OVER (PARTITION BY mmsi ORDER BY r_t, lon, lat ROWS UNBOUNDED PRECEDING) AS u FROM s)
SELECT mmsi, round((min(u) + 540) % 360 - 180, 6) AS west, round((max(u) + 540) % 360 - 180, 6) AS east, floor((min(u) + 180) / 360) <> floor((max(u) + 180) / 360) AS crosses FROM u GROUP BY mmsi""")
def cruise_extents(spark, d):
    return P.cruise_extent(table(spark, d, "positions").select("mmsi", F.col("r_t").alias("t"), "lon", "lat"), "mmsi").select("mmsi", F.round("west", 6).alias("west"), F.round("east", 6).alias("east"), "crosses")


@query("W14", """SELECT o_custkey % 300 AS leg, CASE WHEN bool_and(day(o_orderdate) = 1 AND date_trunc('day', o_orderdate) = o_orderdate) AND count(DISTINCT o_orderdate) > 1 THEN 'month' ELSE 'time' END AS precision FROM orders WHERE day(o_orderdate) < 1 + o_custkey % 300 GROUP BY ALL""")
def month_stamps(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 300).alias("leg"), F.col("o_orderdate").alias("ts")).where(F.dayofmonth("ts") < 1 + F.col("leg"))
    return P.month_stamped(rows, "leg")


@query("A28", """
SELECT 'set' || (o_custkey % 3) AS set_name, 'st' || (o_custkey % 50) AS station, o_orderdate::DATE AS day, count(*) AS samples, min(o_totalprice) AS min_depth, max(o_totalprice) AS max_depth, bool_or(k > 0) AS has_value, substr(sha1('set' || (o_custkey % 3) || '|' || 'st' || (o_custkey % 50) || '|' || strftime(o_orderdate, '%Y-%m-%d')), 1, 16) AS cast_key
FROM (SELECT *, o_orderkey % 5 - 2 AS k FROM orders) GROUP BY ALL""")
def cast_derivation(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("set"), F.col("o_custkey") % 3).alias("set_name"), F.concat(F.lit("st"), F.col("o_custkey") % 50).alias("station"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("depth"), (F.col("o_orderkey") % 5 - 2).alias("value"))
    return P.casts(rows)


@query("", """
SELECT cast_id, array_to_string(list_transform(list_sort(list({'d': depth, 'v': raw})), lambda x: x.d::INT::VARCHAR), ',') AS depths, count(depth) - count(DISTINCT depth) AS repeated, round(list_sum(list_transform(list_sort(list({'d': depth, 'v': raw})), lambda x: x.v)), 2) AS total FROM levels GROUP BY cast_id""")
def level_arrays(spark, d):
    out = P.level_arrays(table(spark, d, LEVELS).select("cast_id", "depth", F.col("raw").alias("value")), "cast_id")
    return out.select("cast_id", F.array_join(F.transform("depths", lambda x: x.cast("int").cast("string")), ",").alias("depths"), "repeated", F.round(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))
