"""Queries on parsers, range tests, file links, freshness and the incremental stream steps."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.functions import classify, parse
from halocline.functions.geo import haversine_km
from halocline.plans.book import query
from halocline.plans.standins import table


@query("F9 F10 F11 F20", """
WITH t AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderkey % 2500 AS hhmm, CASE WHEN o_custkey % 5 = 0 THEN 'unknown' ELSE year(o_orderdate) - o_custkey % 400 || ' cruise' END AS text, o_custkey % 100 AS a FROM orders)
SELECT id, CASE WHEN text = 'unknown' THEN NULL WHEN left(text, 4)::INT >= 1750 THEN left(text, 4)::INT END AS year, CASE WHEN hhmm // 100 <= 23 AND hhmm % 100 <= 59 THEN day::TIMESTAMP + to_minutes((hhmm // 100 * 60 + hhmm % 100)::BIGINT) END AS at,
 (day - (a % 7)::INT) AS lo, (day + (a % 3)::INT) AS hi, CASE WHEN a % 10 = 0 THEN (a // 10)::VARCHAR ELSE (a / 10.0)::DECIMAL(9,1)::VARCHAR END || '-' || (a // 10 + 1)::VARCHAR || 'cm' AS horizon FROM t""")
def parsed_stamps(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")).withColumn("a", (F.col("o_custkey") % 100).cast("int"))
    text = F.when(F.col("o_custkey") % 5 == 0, "unknown").otherwise(F.concat((F.year("o_orderdate") - F.col("o_custkey") % 400).cast("string"), F.lit(" cruise")))
    # Written the wrong way round, to be swapped.
    lo, hi = parse.window_bounds(F.concat_ws("/", F.date_add("day", F.col("a") % 3), F.date_sub("day", F.col("a") % 7)))
    label = F.concat(F.lit("L_"), F.lpad(F.col("a").cast("string"), 3, "0"), F.lit("_"), F.lpad(((F.floor(F.col("a") / 10) + 1) * 10).cast("string"), 3, "0"))
    at = parse.clock_instant(F.col("day"), (F.col("o_orderkey") % 2500).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), parse.leading_year(text, 2026).alias("year"), at.cast("timestamp_ntz").alias("at"), lo.alias("lo"), hi.alias("hi"), parse.horizon_label(label).alias("horizon"))


@query("F18", """
SELECT o_orderkey AS id, round(-(o_custkey % 9) + ((o_orderkey % 100) % 10) * 0.1 + 0.05, 3)::DOUBLE AS lon, round(36.0 + (o_custkey % 30) * 0.5 + ((o_orderkey % 100) // 10) * 0.05 + 0.025, 3)::DOUBLE AS lat FROM orders""")
def subrectangles(spark, d):
    code = F.concat(F.lpad((F.col("o_custkey") % 30 + 1).cast("string"), 2, "0"), F.char(F.col("o_custkey") % 9 + 65), F.when(F.col("o_orderkey") % 100 < 9, "0").otherwise(""), (F.col("o_orderkey") % 100 + 1).cast("string"))
    lon, lat = parse.subrectangle(code)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), lon.alias("lon"), lat.alias("lat"))


@query("P25", """
SELECT flag, count(*) AS n, count(*) FILTER (raw BETWEEN 2000 AND 41000) AS in_range, count(*) FILTER (raw / 400 > 86) AS implausible, count(*) FILTER (raw / 400 < CASE WHEN depth < 200 THEN 150 WHEN depth < 1000 THEN 90 ELSE 60 END) AS below, count(*) FILTER (level_no <> 4) AS kept FROM levels GROUP BY flag""")
def value_tests(spark, d):
    v = table(spark, d, "levels")
    lo, hi = parse.range_limits(F.lit("sea_water_practical_salinity"), F.lit("1"))
    oxygen = F.col("raw") / 400
    return v.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("raw") / 1000).between(lo, hi)).alias("in_range"), F.count_if(oxygen / 10 > 8.6).alias("implausible"), F.count_if(parse.below_baseline(oxygen, F.col("depth"))).alias("below"), F.count(classify.no_data(F.col("level_no"), (4,))).alias("kept"))


@query("P8 P22", """
WITH r AS (SELECT CASE WHEN o_custkey % 13 = 0 THEN '' ELSE o_orderstatus END AS key, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey % 200 END AS lon, o_custkey % 100 AS lat, 1996 AS y, o_orderkey % 14 AS m, o_orderkey % 33 AS d, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 5 END AS flag FROM orders),
p AS (SELECT *, CASE WHEN key = '' THEN 'key' WHEN lon IS NULL OR lon > 180 OR lat > 90 THEN 'position' WHEN NOT (m BETWEEN 1 AND 12 AND d BETWEEN 1 AND CASE WHEN m IN (4, 6, 9, 11) THEN 30 WHEN m = 2 THEN 29 ELSE 31 END) THEN 'date' END AS problem FROM r)
SELECT problem, count(*) AS n, count(*) FILTER (flag IS NULL OR flag NOT IN (3, 4, 9)) AS good_position FROM p GROUP BY problem""")
def row_problems(spark, d):
    o = table(spark, d, "orders")
    r = o.select(F.when(F.col("o_custkey") % 13 == 0, "").otherwise(F.col("o_orderstatus")).alias("key"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey") % 200).alias("lon"), (F.col("o_custkey") % 100).alias("lat"), (F.col("o_orderkey") % 14).cast("int").alias("m"), (F.col("o_orderkey") % 33).cast("int").alias("dd"), F.nullif(F.col("o_orderkey") % 5, F.lit(0)).alias("flag"))
    why = parse.row_problem(F.col("key"), F.col("lon"), F.col("lat"), F.lit(1996), F.col("m"), F.col("dd"))
    return r.groupBy(why.alias("problem")).agg(F.count(F.lit(1)).alias("n"), F.count_if(classify.good_position(F.col("flag"))).alias("good_position"))


@query("F22", """
WITH r AS (SELECT o_custkey AS site, ['exact', 'like', 'near_2', 'odd'][(o_orderkey % 4 + 1)::INT] AS kind, o_orderkey AS id FROM orders)
SELECT site, min_by(id, (CASE kind WHEN 'exact' THEN 1 WHEN 'like' THEN 2 WHEN 'near_2' THEN 5 ELSE 99 END, id)) AS best, count(DISTINCT kind) > 1 AS collided, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM r GROUP BY site""")
def best_candidates(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("exact", "like", "near_2", "odd")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("site"), kind.alias("kind"), F.col("o_orderkey").alias("id"))
    return r.groupBy("site").agg(F.min_by("id", F.struct(parse.match_rank(F.col("kind")), "id")).alias("best"), (F.count_distinct("kind") > 1).alias("collided"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("P27", "SELECT max(o_orderdate) AS newest, (SELECT max(l_shipdate) FROM lineitem) AS own, (SELECT max(l_shipdate) FROM lineitem) > max(o_orderdate) AS fresh FROM orders")
def freshness(spark, d):
    own = table(spark, d, "lineitem").agg(F.max("l_shipdate")).scalar()
    return table(spark, d, "orders").agg(F.max("o_orderdate").alias("newest")).withColumn("own", own).withColumn("fresh", F.col("own") > F.col("newest"))


@query("A11 A39 S3", """
WITH k AS (SELECT o.*, s.species_no IS NOT NULL AS listed FROM occurrences o LEFT JOIN (SELECT DISTINCT species_no FROM occurrences WHERE grp = 'N' AND species_no < 30) s ON s.species_no = o.species_no)
SELECT floor(lon / 45)::INT AS cx, floor(lat / 45)::INT AS cy, round(avg(lon), 6) AS lon, round(avg(depth), 6) AS depth, count(DISTINCT species_no) AS species, count(*) FILTER (edna) AS present, string_agg(DISTINCT species_no, ',' ORDER BY species_no) FILTER (listed AND depth >= 1800) AS deep_species FROM k WHERE listed OR depth >= 50 GROUP BY ALL""")
def locality_rollup(spark, d):
    """Rows of a curated list, or deep enough; then localities with their species."""
    o = table(spark, d, "occurrences")
    listed = o.where("grp = 'N' AND species_no < 30").select(F.col("species_no").alias("list_no")).distinct()
    k = o.join(listed, F.col("species_no") == F.col("list_no"), "left").where("list_no IS NOT NULL OR depth >= 50")
    deep = F.array_sort(F.collect_set(F.when(F.col("list_no").isNotNull() & (F.col("depth") >= 1800), F.col("species_no"))))
    g = k.groupBy(F.floor(F.col("lon") / 45).cast("int").alias("cx"), F.floor(F.col("lat") / 45).cast("int").alias("cy")).agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("depth"), 6).alias("depth"), F.count_distinct("species_no").alias("species"), F.count_if("edna").alias("present"), deep.alias("deep"))
    return g.withColumn("deep_species", F.when(F.size("deep") > 0, F.array_join(F.transform("deep", lambda x: x.cast("string")), ","))).drop("deep")


@query("A45", """
WITH s AS (SELECT c_custkey AS station, 'st' || (c_custkey % 50) AS name, CAST(c_custkey % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey % 120 - 60 AS DOUBLE) AS lat FROM customer),
f AS (SELECT o_orderkey AS file, 'st' || (o_custkey % 50) || '-' || o_orderstatus AS title, CAST(o_custkey % 360 - 180 AS DOUBLE) + 0.1::DOUBLE AS lon, CAST(o_custkey % 120 - 60 AS DOUBLE) AS lat, o_orderdate AS started FROM orders),
l AS (SELECT s.station, f.file, f.started FROM s JOIN f ON s.name = split_part(f.title, '-', 1) AND abs(s.lon - f.lon) < 2 AND abs(s.lat - f.lat) < 2 WHERE 2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(f.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(f.lat)) * power(sin(radians(f.lon - s.lon) / 2), 2)))) <= 50)
SELECT s.station, count(l.file) AS files, min(l.started) AS first_start, max(l.started) AS last_start FROM s LEFT JOIN l ON l.station = s.station GROUP BY s.station""")
def file_links(spark, d):
    """Files linked to stations by the first token of the title and at most 50 km; an equi join on the name comes first. Stations
    and files of one name and place are one row each before they meet."""
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("station"), F.concat(F.lit("st"), F.col("c_custkey") % 50).alias("name"), (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"), (F.col("c_custkey") % 120 - 60).cast("double").alias("lat"))
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.concat(F.lit("st"), F.col("o_custkey") % 50, F.lit("-"), "o_orderstatus").alias("title"), ((F.col("o_custkey") % 360 - 180).cast("double") + 0.1).alias("f_lon"), (F.col("o_custkey") % 120 - 60).cast("double").alias("f_lat"), F.col("o_orderdate").alias("started"))
    cell = lambda c: F.floor(F.col(c) / 2)
    places = s.select("name", "lon", "lat").distinct()
    f = f.groupBy(F.split("title", "-")[0].alias("token"), "f_lon", "f_lat").agg(F.count(F.lit(1)).alias("n"), F.min("started").alias("first_start"), F.max("started").alias("last_start"))
    near = places.withColumn("cx", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: cell("lon") + i))).withColumn("cy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: cell("lat") + i)))
    pairs = near.join(f, (F.col("name") == F.col("token")) & (F.col("cx") == cell("f_lon")) & (F.col("cy") == cell("f_lat")))
    links = pairs.where(haversine_km(F.col("lon"), F.col("lat"), F.col("f_lon"), F.col("f_lat")) <= 50).groupBy(*[F.col(c).alias(f"l_{c}") for c in ("name", "lon", "lat")]).agg(F.sum("n").alias("files"), F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start"))
    return s.join(links, (F.col("name") == F.col("l_name")) & (F.col("lon") == F.col("l_lon")) & (F.col("lat") == F.col("l_lat")), "left").select("station", F.coalesce("files", F.lit(0)).alias("files"), "first_start", "last_start")


@query("W9", """
WITH k AS (SELECT DISTINCT cast_id, depth FROM levels), m AS (SELECT cast_id, min(depth) AS lo, max(depth) AS hi, median(depth) AS mid FROM k GROUP BY cast_id), r AS (SELECT k.*, m.lo, m.hi, row_number() OVER (PARTITION BY k.cast_id ORDER BY abs(depth - mid), depth) AS rn FROM k JOIN m ON m.cast_id = k.cast_id WHERE depth > lo AND depth < hi)
SELECT m.cast_id, m.lo, r.depth AS mid, m.hi FROM m LEFT JOIN r ON r.cast_id = m.cast_id AND r.rn = 1""")
def shown_depths(spark, d):
    """Shallowest, deepest, and of the rest the depth nearest to the median."""
    k = table(spark, d, "levels").groupBy("cast_id").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.percentile("depth", 0.5).alias("p"), F.collect_set("depth").alias("all"))
    exact = F.element_at(F.array_sort("all"), (F.floor((F.size("all") + 1) / 2)).cast("int"))
    other = F.element_at(F.array_sort("all"), (F.floor(F.size("all") / 2) + 1).cast("int"))
    mid = (exact + other) / 2
    rest = F.filter("all", lambda x: (x > F.col("lo")) & (x < F.col("hi")))
    return k.select("cast_id", "lo", F.array_min(F.transform(rest, lambda x: F.struct(F.abs(x - mid).alias("off"), x.alias("depth"))))["depth"].alias("mid"), "hi")


@query("F16", """
WITH l AS (SELECT cast_id, depth, min(value) FILTER (level_no % 2 = 0) AS n, min(value) FILTER (level_no % 2 = 1) AS p FROM (SELECT l_orderkey AS cast_id, l_linenumber % 3 AS depth, l_linenumber AS level_no, l_extendedprice AS value FROM lineitem) GROUP BY ALL)
SELECT cast_id, depth, round(n - 16 * p, 4) AS nstar FROM l WHERE n IS NOT NULL AND p IS NOT NULL""")
def nitrate_excess(spark, d):
    """N - 16 P from the same level, where both are given."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cast_id"), (F.col("l_linenumber") % 3).alias("depth"), "l_linenumber", "l_extendedprice")
    even = F.col("l_linenumber") % 2 == 0
    g = l.groupBy("cast_id", "depth").agg(F.min(F.when(even, F.col("l_extendedprice"))).alias("n"), F.min(F.when(~even, F.col("l_extendedprice"))).alias("p"))
    return g.where("n IS NOT NULL AND p IS NOT NULL").select("cast_id", "depth", F.round(F.col("n") - 16 * F.col("p"), 4).alias("nstar"))


@query("T7", """
WITH f AS (SELECT DISTINCT key_id, label AS flag FROM requests WHERE status >= 400 OR event_id % 97 = 0), o AS (SELECT DISTINCT key_id, label AS flag FROM requests WHERE key_id % 3 = 0)
SELECT key_id, flag FROM f WHERE (key_id, flag) NOT IN (SELECT key_id, flag FROM o)""")
def debounced_flags(spark, d):
    from halocline.streaming.vessels import open_flags

    r = table(spark, d, "requests")
    existing = r.where("key_id % 3 = 0").select("key_id", F.col("label").alias("flag"), F.lit(None).cast("timestamp").alias("acknowledged_at")).distinct()
    return open_flags(r.where("status >= 400 OR event_id % 97 = 0").select("key_id", F.col("label").alias("flag")), existing)


@query("T9", "SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n FROM positions WHERE date_trunc('week', ts) >= (SELECT date_trunc('week', max(ts)) - INTERVAL 14 DAY FROM positions) GROUP BY ALL")
def retained_weeks(spark, d):
    from halocline.sources.sinks import retained

    p = table(spark, d, "positions").withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    return retained(p, p.agg(F.max("ts")).scalar(), 2).groupBy("week").agg(F.count(F.lit(1)).alias("n"))


@query("S8", """
WITH h AS (SELECT l_linenumber AS var, l_orderkey AS cast_no, count(*) AS row_size, sum(l_suppkey) AS total FROM lineitem GROUP BY ALL) SELECT var, cast_no, row_size AS n, total::BIGINT AS total FROM h""")
def ragged_arrays(spark, d):
    """Flat values per variable are packed again by row sizes alone."""
    from halocline.sources.scans import ragged

    l = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("var"), F.col("l_orderkey").alias("cast_no"), "l_suppkey", "l_partkey")
    header = l.groupBy("var", "cast_no").agg(F.count(F.lit(1)).alias("row_size"))
    values = l.withColumn("at", F.row_number().over(W.partitionBy("var").orderBy("cast_no", "l_suppkey", "l_partkey")) - 1).select("var", "at", F.col("l_suppkey").alias("value"))
    return ragged(header, values).select("var", "cast_no", F.size("vals").cast("long").alias("n"), F.aggregate("vals", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
