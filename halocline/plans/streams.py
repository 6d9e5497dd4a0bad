"""Queries on the stream operators, run over the tables as one batch; tests run them as a stream too."""

from pyspark.sql import functions as F

from halocline.plans.book import query
from halocline.plans.standins import table
from halocline.streaming import vessels as V


def frames(spark, d):
    e = table(spark, d, "positions")
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.lit("NAME ").alias("ShipName"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_utc"))
    body = F.struct(F.col("lat").alias("Latitude"), F.when(F.col("pos_id") % 50 == 0, 191.0).otherwise(F.col("lon")).alias("Longitude"), F.col("sog").alias("Sog"), F.when(F.col("pos_id") % 3 == 0, 511).otherwise(F.col("pos_id") % 360).cast("int").alias("TrueHeading"))
    return e.select(F.to_json(F.struct(F.lit("PositionReport").alias("MessageType"), meta.alias("MetaData"), body.alias("Message"))).alias("value"))


@query("S9 T1 T2", """
SELECT mmsi, count(*) AS positions, count(heading) AS headings FROM (SELECT DISTINCT ON (mmsi, sec) mmsi, sec, heading FROM (SELECT mmsi, date_trunc('second', ts) AS sec, CASE WHEN pos_id % 3 = 0 THEN NULL ELSE pos_id % 360 END AS heading FROM positions WHERE pos_id % 50 <> 0)) GROUP BY mmsi""")
def decoded_positions(spark, d):
    pos, _ = V.decode(frames(spark, d))
    return V.once(pos).groupBy("mmsi").agg(F.count(F.lit(1)).alias("positions"), F.count("heading").alias("headings"))


@query("T5 S24", "SELECT date_trunc('hour', ts) AS hour, count(*) AS messages, round(avg(sog), 6) AS speed FROM positions GROUP BY ALL")
def hourly_positions(spark, d):
    return V.hourly(table(spark, d, "positions")).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "messages", F.round("speed", 6).alias("speed"))


@query("T8", "WITH l AS (SELECT mmsi, max_by(lon, (r_t, pos_id)) AS lon, max_by(lat, (r_t, pos_id)) AS lat FROM positions GROUP BY mmsi) SELECT mmsi, round(lon - 0.5, 6) AS x0, round(lat - 0.5, 6) AS y0, round(lon + 0.5, 6) AS x1, round(lat + 0.5, 6) AS y1 FROM l")
def watch_boxes(spark, d):
    last = table(spark, d, "positions").groupBy("mmsi").agg(F.max_by(F.struct("lon", "lat"), F.struct("r_t", "pos_id")).alias("p")).select("mmsi", "p.*")
    return V.watch_boxes(last, 0.5).select("mmsi", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("T8", """
WITH l AS (SELECT o_custkey AS mmsi, max_by(lon, (r_t, o_orderkey)) AS lon, max_by(lat, (r_t, o_orderkey)) AS lat FROM (SELECT o_custkey, o_orderkey, o_orderdate AS r_t, CAST(o_orderkey * 7 % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST(o_orderkey * 11 % 1800 AS DOUBLE) / 10 - 90 AS lat FROM orders) GROUP BY o_custkey),
b AS (SELECT *, 100.0 / (pi() * 6371.0 / 180) AS r FROM l), c AS (SELECT *, abs(lat) + r >= 90 AS polar, greatest(lat - r, -90) AS y0, least(lat + r, 90) AS y1, degrees(asin(least(sin(radians(r)) / cos(radians(lat)), 1))) AS half FROM b),
p AS (SELECT mmsi, 0 AS part, CASE WHEN polar THEN -180 WHEN lon - half < -180 THEN lon - half + 360 ELSE lon - half END AS x0, y0, CASE WHEN polar OR lon + half > 180 OR lon - half < -180 THEN 180 ELSE lon + half END AS x1, y1 FROM c
 UNION ALL SELECT mmsi, 1, -180, y0, CASE WHEN lon + half > 180 THEN lon + half - 360 ELSE lon + half END, y1 FROM c WHERE NOT polar AND (lon + half > 180 OR lon - half < -180))
SELECT mmsi, part, round(x0, 6)::DOUBLE AS x0, round(y0, 6)::DOUBLE AS y0, round(x1, 6)::DOUBLE AS x1, round(y1, 6)::DOUBLE AS y1 FROM p""")
def buffered_boxes(spark, d):
    """Boxes around 100 km of the newest place of each customer's orders, over the date line and at the poles too."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("mmsi"), "o_orderkey", "o_orderdate", ((F.col("o_orderkey") * 7 % 3600).cast("double") / 10 - 180).alias("lon"), ((F.col("o_orderkey") * 11 % 1800).cast("double") / 10 - 90).alias("lat"))
    last = o.groupBy("mmsi").agg(F.max_by(F.struct("lon", "lat"), F.struct("o_orderdate", "o_orderkey")).alias("p")).select("mmsi", "p.*")
    return V.buffered_boxes(last, 100.0).select("mmsi", "part", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])
