"""Queries on request logs, place summaries, areas and alerts."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.functions import classify, geo, parse
from halocline.operators import rollup as R
from halocline.operators import spatial as S
from halocline.plans.book import query
from halocline.plans.standins import RING, table, zones

HAV = "2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians({1} - {3}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * power(sin(radians({0} - {2}) / 2), 2))))"


@query("A15 A16", """
WITH n AS (SELECT max(ts) AS t FROM requests), a AS (SELECT key_id, agent, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'C' || (event_id // 7 % 9) END AS country, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id // 3 % 11 END AS asn, epoch_us(n.t) - epoch_us(ts) AS age FROM requests, n),
s AS (SELECT key_id, count(*) AS recent, count(DISTINCT country) AS countries, count(DISTINCT asn) AS asns, count(DISTINCT agent) AS agents, string_agg(DISTINCT country, ',' ORDER BY country) AS names FROM a WHERE age < 172800000000 GROUP BY key_id), b AS (SELECT key_id, count(*) / 6.0::DOUBLE AS baseline FROM a WHERE age >= 172800000000 AND age < 1209600000000 GROUP BY key_id),
f AS (SELECT s.*, b.baseline, unnest([CASE WHEN countries >= 8 THEN 'multi_country:critical' WHEN countries >= 4 THEN 'multi_country:warn' END, CASE WHEN asns >= 5 THEN 'multi_asn:warn' END, CASE WHEN agents >= 6 THEN 'multi_agent:warn' WHEN agents >= 3 THEN 'multi_agent:info' END, CASE WHEN baseline > 0 AND recent >= 5 AND recent > baseline * 1.05 THEN 'spike:warn' END]) AS flag FROM s LEFT JOIN b ON b.key_id = s.key_id)
SELECT key_id, recent, countries, asns, agents, names, round(baseline, 6) AS baseline, split_part(flag, ':', 1) AS flag, split_part(flag, ':', 2) AS severity FROM f WHERE flag IS NOT NULL""")
def leak_report(spark, d):
    """Per key the last window's requests, countries, networks and agents (unknown ones aside), the mean day before, and the flags
    that they raise."""
    r = table(spark, d, "requests").withColumn("country", F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("C"), F.floor(F.col("event_id") / 7) % 9))).withColumn("asn", F.when(F.col("event_id") % 5 != 0, F.floor(F.col("event_id") / 3) % 11))
    r = r.withColumn("now", r.agg(F.max("ts")).scalar())
    stats = R.leak_statistics(r, F.col("now"), window_h=48, days=6)
    return R.leak_rules(stats, countries=4, asns=5, agents=3, factor=1.05, least=5).withColumn("baseline", F.round("baseline", 6))


@query("A23", """
WITH k AS (SELECT *, 's' || species_no AS species, CASE grp WHEN 'A' THEN 'cc0' WHEN 'N' THEN 'cc-by' ELSE 'cc-by-nc' END AS licence FROM occurrences WHERE lon BETWEEN -60 AND 60), s AS (SELECT species, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, species) AS place FROM k GROUP BY species)
SELECT 'all' AS part, NULL AS name, count(*) AS n, min(year) AS first_year, max(year) FILTER (year <= 1999) AS last_year, count(*) FILTER (year IS NULL) AS undated, count(*) FILTER (depth IS NULL) AS no_depth FROM k UNION ALL SELECT 'species', species, n, NULL, NULL, NULL, NULL FROM s WHERE place <= 10 UNION ALL SELECT 'licence', licence, count(*), min(year), max(year) FILTER (year <= 1999), count(*) FILTER (year IS NULL), count(*) FILTER (depth IS NULL) FROM k GROUP BY licence
UNION ALL SELECT 'dataset', l_suppkey::VARCHAR, count(*), min(year), max(year) FILTER (year <= 1999), count(*) FILTER (year IS NULL), count(*) FILTER (depth IS NULL) FROM k GROUP BY l_suppkey""")
def place_summary(spark, d):
    """A place in full: totals and years, the ten commonest species, licences and datasets."""
    k = table(spark, d, "occurrences").where("lon BETWEEN -60 AND 60").withColumn("species", F.concat(F.lit("s"), "species_no")).withColumn("licence", F.when(F.col("grp") == "A", "cc0").when(F.col("grp") == "N", "cc-by").otherwise("cc-by-nc"))
    facts = [F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max(F.when(F.col("year") <= 1999, F.col("year"))).alias("last_year"), F.count_if(F.col("year").isNull()).alias("undated"), F.count_if(F.col("depth").isNull()).alias("no_depth")]
    shape = lambda df, part: df.select(F.lit(part).alias("part"), "name", "n", "first_year", "last_year", "undated", "no_depth")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("first_year", "int"), ("last_year", "int"), ("undated", "long"), ("no_depth", "long"))]
    top = k.groupBy(F.col("species").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(10).select("name", "n", *none)
    out = shape(k.agg(*facts).withColumn("name", F.lit(None).cast("string")), "all").unionByName(shape(top, "species"))
    for part, c in (("licence", "licence"), ("dataset", "l_suppkey")):
        out = out.unionByName(shape(k.groupBy(F.col(c).cast("string").alias("name")).agg(*facts), part))
    return out


@query("A24", """
WITH o AS (SELECT floor(lon / 20)::INT AS cx, floor(lat / 20)::INT AS cy, year, grp, depth FROM occurrences), y AS (SELECT cx, cy, string_agg(year || '=' || n, ';' ORDER BY year) FILTER (year IS NOT NULL) AS years FROM (SELECT cx, cy, year, count(*) AS n FROM o GROUP BY ALL) GROUP BY cx, cy)
SELECT o.cx, o.cy, any_value(years) AS years, count(*) FILTER (year IS NULL) AS undated, min(depth) AS min_depth, max(depth) AS max_depth, string_agg(DISTINCT grp, ', ' ORDER BY grp) AS labels FROM o JOIN y ON y.cx = o.cx AND y.cy = o.cy GROUP BY o.cx, o.cy""")
def year_maps(spark, d):
    """Counts by year as a map per position, beside undated rows, ranges and the labels found there."""
    o = table(spark, d, "occurrences").withColumn("cx", geo.degree_cell(F.col("lon"), 20.0)).withColumn("cy", geo.degree_cell(F.col("lat"), 20.0))
    years = o.where("year IS NOT NULL").groupBy("cx", "cy", "year").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("cx").alias("y_cx"), F.col("cy").alias("y_cy")).agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("m"))
    g = o.groupBy("cx", "cy").agg(F.count_if(F.col("year").isNull()).alias("undated"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.array_join(F.array_sort(F.collect_set("grp")), ", ").alias("labels"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return g.join(years, (F.col("cx") == F.col("y_cx")) & (F.col("cy") == F.col("y_cy")), "left").select("cx", "cy", text.alias("years"), "undated", "min_depth", "max_depth", "labels")


@query("A57", "SELECT o_custkey AS dataset, CASE WHEN count(v) >= 2 AND stddev_pop(v) > 0 THEN round(avg(v), 7) END AS mean, CASE WHEN count(v) >= 2 AND stddev_pop(v) > 0 THEN round(stddev_pop(v), 5) END AS std FROM (SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 7.0::DOUBLE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) GROUP BY o_custkey")
def dataset_spread(spark, d):
    """Mean and spread; null with fewer than two values or no spread."""
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("dataset"), F.when(F.col("o_custkey") % 5 == 0, 7.0).when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("v"))
    ok = (F.count("v") >= 2) & (F.stddev_pop("v") > 0)
    return v.groupBy("dataset").agg(F.when(ok, F.round(F.avg("v"), 7)).alias("mean"), F.when(ok, F.round(F.stddev_pop("v"), 5)).alias("std"))


@query("P9 P10 F17", """
WITH r AS (SELECT l_orderkey, l_linenumber AS line, l_suppkey % 6 AS kind, CASE l_partkey % 9 WHEN 0 THEN -9999 WHEN 1 THEN -1 ELSE l_quantity END AS v, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_quantity * 40 END AS depth, 7.4 + l_quantity / 100 AS ph FROM lineitem),
k AS (SELECT *, CASE WHEN v = -9999 OR v < 0 THEN NULL ELSE v END AS value, CASE WHEN depth >= 1000 THEN 7.6 WHEN depth >= 200 THEN 7.75 ELSE 7.95 END AS base FROM r)
SELECT kind, count(value) AS kept, count(*) FILTER (CASE kind WHEN 0 THEN value BETWEEN -2.5 AND 40 WHEN 1 THEN value BETWEEN 2 AND 41 WHEN 2 THEN value BETWEEN -5 AND 5 WHEN 3 THEN value BETWEEN -500 AND 500 END) AS inside, count(*) FILTER (kind < 4 AND value IS NOT NULL) AS tested, count(*) FILTER (ph < base) AS ph_below, round(avg(ph - base), 6) AS ph_delta FROM k GROUP BY kind""")
def measured_tests(spark, d):
    """Fill codes and negative amounts go; values are tested only in a unit that is known; pH against its depth's baseline."""
    names = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(u).alias("u")) for n, u in (("sea_surface_temperature", "deg_C"), ("sea_water_salinity", "psu"), ("eastward_sea_water_velocity", "m/s"), ("northward_sea_water_velocity", "cm/s"), ("sea_water_salinity", "g/kg"), ("sea_water_temperature", None))])
    part = F.col("l_partkey")
    v = F.when(part % 9 == 0, -9999.0).when(part % 9 == 1, -1.0).otherwise(F.col("l_quantity"))
    r = table(spark, d, "lineitem").select((F.col("l_suppkey") % 6).alias("kind"), classify.concentration(v, (-9999.0, -999.0)).alias("value"), F.when(part % 4 != 0, F.col("l_quantity") * 40).alias("depth"), (7.4 + F.col("l_quantity") / 100).alias("ph")).withColumn("s", F.element_at(names, (F.col("kind") + 1).cast("int")))
    lo, hi = parse.range_limits(F.col("s.n"), F.col("s.u"))
    base = parse.ph_baseline(F.col("depth"))
    return r.groupBy("kind").agg(F.count("value").alias("kept"), F.count_if(F.col("value").between(lo, hi)).alias("inside"), F.count_if(lo.isNotNull() & F.col("value").isNotNull()).alias("tested"), F.count_if(F.col("ph") < base).alias("ph_below"), F.round(F.avg(F.col("ph") - base), 6).alias("ph_delta"))


@query("P14", """
WITH k AS (SELECT * FROM occurrences WHERE lon BETWEEN -180 AND 180) SELECT 'box' AS area, count(*) AS n FROM k WHERE lon BETWEEN -90 AND 45 AND lat BETWEEN -50 AND 20 UNION ALL SELECT 'ring', count(*) FROM k WHERE lat BETWEEN -80 AND 0 AND abs(lon) * 2 <= lat + 80 UNION ALL SELECT 'cells', count(*) FROM k WHERE (floor(lon / 30), floor(lat / 30)) IN ((0, -2), (1, -3), (-2, -2), (4, -3))""")
def areas_of_interest(spark, d):
    """One of a box, a ring or a list of cells; two at once are an error."""
    o = table(spark, d, "occurrences")
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, -80.0), (40.0, 0.0), (-40.0, 0.0), (0.0, -80.0))])
    kinds = {"box": {"box": (-90, -50, 45, 20)}, "ring": {"ring": ring}, "cells": {"cells": [(0, -2), (1, -3), (-2, -2), (4, -3)], "step": 30.0}}
    parts = [S.in_area(o, **a).agg(F.lit(name).alias("area"), F.count(F.lit(1)).alias("n")) for name, a in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("J27", "SELECT count(*) AS n, sum(occ_id)::BIGINT AS ids FROM occurrences WHERE lon BETWEEN -77 AND 31 AND lat BETWEEN -66 AND -12")
def area_by_key_ranges(spark, d):
    """An area as a few ranges of Morton keys, asked of a table that is stored in order of its key, then row by row."""
    from halocline.sources import scratch

    path = scratch.folder(spark, "keyed")
    keyed = table(spark, d, "occurrences").select("occ_id", "lon", "lat", geo.morton(F.col("lon"), F.col("lat")).alias("key"))
    keyed.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
    near = F.lit(False)
    for low, high in geo.area_key_ranges(-77, -66, 31, -12, most=16):
        near = near | ((F.col("key") >= low) & (F.col("key") < high))
    return spark.read.parquet(path).where(near).where("lon BETWEEN -77 AND 31 AND lat BETWEEN -66 AND -12").agg(F.count(F.lit(1)).alias("n"), F.sum("occ_id").alias("ids"))


@query("J20", """
SELECT t.target, count(*) AS n, max(e.event_id) AS newest FROM requests e, (VALUES ('mail', 2), ('hook', 3)) t(target, k) WHERE e.status = 500 AND e.ts > (SELECT max(ts) FROM requests) - INTERVAL 240 HOUR AND e.event_id % t.k <> 0 GROUP BY t.target""")
def unalerted_events(spark, d):
    """Events of the look-back window that a target has not been told of yet."""
    r = table(spark, d, "requests")
    newest = r.agg(F.max("ts")).scalar()
    events = r.where("status = 500").withColumn("now", newest).where("ts > now - INTERVAL 240 HOURS").select("event_id", F.explode(F.array(F.lit("mail"), F.lit("hook"))).alias("target"))
    told = r.where("status = 500").select("event_id", F.explode(F.array_compact(F.array(F.when(F.col("event_id") % 2 == 0, "mail"), F.when(F.col("event_id") % 3 == 0, "hook")))).alias("target"))
    return events.join(told, ["event_id", "target"], "left_anti").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest"))


@query("J17", f"""
WITH p AS (SELECT c_custkey AS id, CAST((c_custkey % 25 % 5) * 37 - 90 AS DOUBLE) + (c_custkey % 40 - 20) / 50.0::DOUBLE AS lon, CAST((c_custkey % 25 % 5) * 17 - 30 AS DOUBLE) AS lat, c_custkey % 3 AS len FROM customer),
b AS (SELECT p.id, z.zone_id, least(p.lon, p.lon + len * 0.2::DOUBLE) <= z.mx + z.half AND greatest(p.lon, p.lon + len * 0.2::DOUBLE) >= z.mx - z.half AND abs(p.lat - z.my) <= z.half AS crosses, CASE WHEN abs(p.lon - z.mx) <= z.half AND abs(p.lat - z.my) <= z.half THEN 0 ELSE {HAV.format('p.lon', 'p.lat', 'greatest(z.mx - z.half, least(p.lon, z.mx + z.half))', 'greatest(z.my - z.half, least(p.lat, z.my + z.half))')} END AS km FROM p, boxes z WHERE abs(p.lat - z.my) < 1 AND abs(p.lon - z.mx) < 2),
c AS (SELECT id, min(zone_id) FILTER (crosses) AS crossed, min_by(zone_id, (round(km, 3), zone_id)) FILTER (km <= 50) AS near FROM b GROUP BY id)
SELECT id, coalesce(crossed, near) AS zone_id, crossed IS NULL AS fallback FROM c WHERE crossed IS NOT NULL OR near IS NOT NULL""")
def paths_to_zones(spark, d):
    """The zone that a path crosses, else the one nearest to its origin within 50 km."""
    c = F.col("c_custkey")
    p = table(spark, d, "customer").select(c.alias("id"), ((c % 25 % 5) * 37 - 90 + (c % 40 - 20) / 50).cast("double").alias("lon"), ((c % 25 % 5) * 17 - 30).cast("double").alias("lat"), (c % 3 * 0.2).alias("len"))
    paths = p.withColumn("path", F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")), F.struct((F.col("lon") + F.col("len")).alias("x"), F.col("lat").alias("y"))))
    return S.path_zone(paths, zones(spark, d), 50.0).select("id", "zone_id", "fallback")
