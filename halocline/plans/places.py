"""Queries on zones, names, neighbourhoods and read-outs of places."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.functions import classify, geo, occurrence
from halocline.operators import spatial as S
from halocline.operators import zones as Z
from halocline.operators.ordered import quantiles
from halocline.plans.book import query
from halocline.plans.rollups import CATEGORY
from halocline.plans.standins import RING, table, zones
from halocline.sources import scratch

HAV = "2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians({1} - {3}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * power(sin(radians({0} - {2}) / 2), 2))))"
#: Small boxes around the zones, a few thousandths of a degree off their middles.
AREAS = """SELECT c_custkey AS a_id, c_custkey % 25 AS near, CAST((c_custkey % 25 % 5) * 37 - 90 AS DOUBLE) + (c_custkey % 7 - 3) / 1000.0 AS mx, CAST((c_custkey % 25 % 5) * 17 - 30 AS DOUBLE) + (c_custkey % 11 - 5) / 1000.0 AS my, 0.0011 AS half FROM customer"""
AREAS_DUCK = AREAS.replace("/ 1000.0", "/ 1000.0::DOUBLE").replace("0.0011", "0.0011::DOUBLE")
GAP = "abs(a.mx - z.mx) {0} z.half {1} a.half AND abs(a.my - z.my) {0} z.half {1} a.half"


def areas_and_zones(spark, d):
    a = spark.sql(AREAS.replace("FROM customer", "FROM {src}"), src=table(spark, d, "customer")).selectExpr("a_id", f"{RING} AS a_ring", "mx - half AS a_x0", "my - half AS a_y0", "mx + half AS a_x1", "my + half AS a_y1")
    z = zones(spark, d).select(F.col("zone_id").alias("b_id"), F.col("ring").alias("b_ring"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    return a, S.zone_pairs(a, z)


@query("J18", f"""
WITH a AS ({AREAS_DUCK}) SELECT a_id, CASE WHEN bool_or({GAP.format('<=', '-')}) THEN 'eez' WHEN bool_or({GAP.format('<=', '+')}) THEN 'overlap' END AS tag, coalesce(count(*) FILTER ({GAP.format('<=', '+')}), 0) AS zones FROM a, boxes z GROUP BY a_id""")
def jurisdictions(spark, d):
    """Areas within a zone, overlapping one, or outside all."""
    a, pairs = areas_and_zones(spark, d)
    tags = pairs.withColumn("tag", S.rings_relation(F.col("a_ring"), F.col("b_ring"))).where("tag IS NOT NULL").groupBy(F.col("a_id").alias("t_id")).agg(F.bool_or(F.col("tag") == "within").alias("inside"), F.count(F.lit(1)).alias("zones"))
    out = a.select("a_id").join(tags, F.col("a_id") == F.col("t_id"), "left")
    return out.select("a_id", F.when(F.col("inside"), "eez").when(F.col("inside").isNotNull(), "overlap").alias("tag"), F.coalesce("zones", F.lit(0)).alias("zones"))


@query("J4", f"""
WITH a AS ({AREAS_DUCK}), p AS (SELECT a_id, zone_id AS b_id, greatest(a.mx - a.half, z.mx - z.half) AS x0, least(a.mx + a.half, z.mx + z.half) AS x1, greatest(a.my - a.half, z.my - z.half) AS y0, least(a.my + a.half, z.my + z.half) AS y1 FROM a, boxes z WHERE {GAP.format('<=', '+')})
SELECT a_id, b_id, round(6371.0 * 6371.0 * radians(x1 - x0) * (sin(radians(y1)) - sin(radians(y0))), 5) AS km2 FROM p""")
def shared_areas(spark, d):
    """Square kilometres that areas and zones share: rings on the equal-area plane, clipped and measured; the SQL has the boxes' formula."""
    pairs = areas_and_zones(spark, d)[1]
    return pairs.select("a_id", "b_id", F.round(Z.clipped_area(Z.equal_area(F.col("a_ring")), Z.equal_area(F.col("b_ring"))), 5).alias("km2"))


@query("J16", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 <> 0 THEN c_custkey END AS accepted FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def name_crosswalk(spark, d):
    """Names with stray white space and case against accepted names; what has none stays, with null."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    accepted = table(spark, d, "customer").where("c_custkey % 7 <> 0").select(clean(F.concat(F.lit("Taxon "), "c_name")).alias("name"), F.col("c_custkey").alias("accepted"))
    names = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("  taxon\t \n"), F.format_string("CUSTOMER#%09d ", "o_custkey")).alias("text"))
    return names.join(accepted, clean(F.col("text")) == F.col("name"), "left").select("id", "accepted")


@query("J25", """
WITH a AS (SELECT 'X' || o_custkey % 120 AS code, count(*) AS casts, min(o_orderdate) AS first_at FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 120 < 90 GROUP BY ALL), b AS (SELECT 'X' || o_custkey % 120 AS code, count(*) AS bottles, max(o_orderdate) AS last_at FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 120 >= 30 GROUP BY ALL)
SELECT coalesce(a.code, b.code) AS code, casts, bottles, first_at, last_at, CASE WHEN b.code IS NULL THEN 'casts' WHEN a.code IS NULL THEN 'bottles' ELSE 'both' END AS sources FROM a FULL JOIN b ON a.code = b.code""")
def cruises_of_two_sources(spark, d):
    """Cruises that either source knows, by expedition code (blanks and case aside)."""
    o = table(spark, d, "orders").withColumn("no", F.col("o_custkey") % 120)
    code = lambda form: F.upper(F.trim(F.format_string(form, "no")))
    a = o.where("o_orderstatus = 'F' AND no < 90").groupBy(code(" x%d").alias("code")).agg(F.count(F.lit(1)).alias("casts"), F.min("o_orderdate").alias("first_at"))
    b = o.where("o_orderstatus = 'O' AND no >= 30").groupBy(code("X%d ").alias("b_code")).agg(F.count(F.lit(1)).alias("bottles"), F.max("o_orderdate").alias("last_at"))
    both = a.join(b, F.col("code") == F.col("b_code"), "full")
    return both.select(F.coalesce("code", "b_code").alias("code"), "casts", "bottles", "first_at", "last_at", F.when(F.col("b_code").isNull(), "casts").when(F.col("code").isNull(), "bottles").otherwise("both").alias("sources"))


@query("J26", "SELECT count(*) AS n, sum(occ_id)::BIGINT AS ids FROM occurrences WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -45 AND 30")
def area_by_segments(spark, d):
    """Segments of rows with their boxes: one inside the area counts whole, one outside is skipped, others row by row."""
    rows = table(spark, d, "occurrences").where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("segment", F.floor(F.col("lon") / 20) * 1000 + F.floor(F.col("lat") / 20))
    seg = rows.groupBy("segment").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    inside = (F.col("x0") >= -60) & (F.col("x1") <= 60) & (F.col("y0") >= -45) & (F.col("y1") <= 30)
    meets = (F.col("x1") >= -60) & (F.col("x0") <= 60) & (F.col("y1") >= -45) & (F.col("y0") <= 30)
    # 20 degrees to a segment: 18 by 9 verdicts and the edges of the world, whatever the number of rows; the rows stay where they are.
    verdicts = F.broadcast(seg.where(meets).select(F.col("segment").alias("s_segment"), inside.alias("whole")))
    kept = rows.join(verdicts, F.col("segment") == F.col("s_segment")).where(F.col("whole") | (F.col("lon").between(-60, 60) & F.col("lat").between(-45, 30)))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("occ_id").alias("ids"))


@query("J29 A25", f"""
WITH s AS (SELECT DISTINCT site, lon, lat FROM tags), p AS (SELECT DISTINCT occ_id, lon, lat, year FROM occurrences), k AS (SELECT s.site, p.occ_id, p.year, round({HAV.format('s.lon', 's.lat', 'p.lon', 'p.lat')}, 6) AS km FROM s JOIN p ON abs(s.lat - p.lat) < 12 WHERE {HAV.format('s.lon', 's.lat', 'p.lon', 'p.lat')} <= 1200),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, occ_id) AS rn FROM k) SELECT site, count(*) AS n, min(year) AS min_year, max(year) AS max_year, median(year) AS median_year, count(*) FILTER (year IS NULL) AS undated, string_agg(occ_id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 3) AS nearest FROM r GROUP BY site""")
def site_neighbourhoods(spark, d):
    """What lies within 1,200 km of a site: counts and years, and the three nearest in order."""
    sites = table(spark, d, "tags").select("site", "lon", "lat").distinct()
    places = table(spark, d, "occurrences").select("occ_id", "lon", "lat", "year").distinct()
    pairs = S.within_distance(sites, places, 1200.0)
    top = S.nearest(pairs.withColumn("km", F.round("km", 6)), ["site"], "occ_id", 3).groupBy(F.col("site").alias("t_site")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "occ_id"))), lambda x: x["occ_id"].cast("string")), ",").alias("nearest"))
    g = pairs.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.percentile("year", 0.5).alias("median_year"), F.count_if(F.col("year").isNull()).alias("undated"))
    return g.join(top, F.col("site") == F.col("t_site")).drop("t_site")


@query("A9 A10", f"""
WITH p AS (SELECT lon, lat, (det_id % 9) AS species_no FROM detections), b AS (SELECT zone_id, {CATEGORY} AS category, 's' || species_no AS species FROM p JOIN boxes z ON p.lon BETWEEN z.mx - z.half AND z.mx + z.half AND p.lat BETWEEN z.my - z.half AND z.my + z.half),
c AS (SELECT zone_id, species, count(*) AS n, bool_or(coalesce(category IN ('CR', 'EN', 'VU'), false)) AS endangered, min(CASE category WHEN 'CR' THEN 1 WHEN 'EN' THEN 2 WHEN 'VU' THEN 3 WHEN 'NT' THEN 4 WHEN 'LC' THEN 5 ELSE 6 END) AS best FROM b GROUP BY ALL)
SELECT zone_id, count(*) AS species, sum(n)::BIGINT AS records, count(*) FILTER (best = 1) AS critical, count(*) FILTER (endangered) AS threatened, min(best)::INT AS best FROM c GROUP BY zone_id""")
def zone_species(spark, d):
    """Species of each zone with their records and best category, then species per class of risk."""
    p = table(spark, d, "detections").withColumn("species_no", F.col("det_id") % 9).selectExpr("lon", "lat", f"{CATEGORY} AS category", "concat('s', species_no) AS species")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in ("CR", "EN", "VU", "NT", "LC")]), F.col("category")), F.lit(0)), F.lit(6))
    c = S.point_in_zone(p, zones(spark, d)).groupBy("zone_id", "species").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("category").isin("CR", "EN", "VU"), F.lit(False))).alias("endangered"), F.min(rank).alias("best"))
    return c.groupBy("zone_id").agg(F.count(F.lit(1)).alias("species"), F.sum("n").alias("records"), F.count_if(F.col("best") == 1).alias("critical"), F.count_if("endangered").alias("threatened"), F.min("best").cast("int").alias("best"))


WEIGHTS = {"CR": 2.0, "EN": 1.5, "VU": 1.2}


@query("A32 A33 J15 F21", f"""
WITH s AS (SELECT floor(lon / 10)::INT AS cx, floor(lat / 10)::INT AS cy, *, {CATEGORY} AS category FROM occurrences), w AS (SELECT *, CASE category WHEN 'CR' THEN 2.0 WHEN 'EN' THEN 1.5 WHEN 'VU' THEN 1.2 ELSE 1.0 END AS weight FROM s),
c AS (SELECT cx, cy, count(*) AS sightings, max(weight)::DOUBLE AS weight, min_by(species_no, (-weight, species_no)) AS species FROM w WHERE edna GROUP BY ALL), n AS (SELECT cx, cy, max(depth) AS level, max_by(year, (depth, year)) FILTER (depth IS NOT NULL AND year IS NOT NULL) AS level_year, min(year) AS first_year, max(year) AS last_year FROM w WHERE NOT edna GROUP BY ALL)
SELECT n.cx, n.cy, n.level, n.level_year, n.first_year, n.last_year, c.sightings, c.weight, c.species FROM n LEFT JOIN c ON c.cx = n.cx AND c.cy = n.cy""")
def noise_and_sightings(spark, d):
    """Cells of noise (the loudest value, its year and the span of years) with the sightings of the same cell, if any."""
    o = table(spark, d, "occurrences").selectExpr("*", f"{CATEGORY} AS category").withColumns({"cx": geo.degree_cell(F.col("lon"), 10.0), "cy": geo.degree_cell(F.col("lat"), 10.0)})
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("category")], F.lit(1.0))
    o = o.withColumn("weight", weight)
    seen = o.where("edna").groupBy(F.col("cx").alias("s_cx"), F.col("cy").alias("s_cy")).agg(F.count(F.lit(1)).alias("sightings"), F.max("weight").alias("weight"), F.min_by("species_no", F.struct(-F.col("weight"), "species_no")).alias("species"))
    year = F.max_by("year", F.when(F.col("depth").isNotNull() & F.col("year").isNotNull(), F.struct("depth", "year")))
    loud = o.where("NOT edna").groupBy("cx", "cy").agg(F.max("depth").alias("level"), year.alias("level_year"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return loud.join(seen, (F.col("cx") == F.col("s_cx")) & (F.col("cy") == F.col("s_cy")), "left").drop("s_cx", "s_cy")


@query("A14", """
WITH g AS (SELECT label, count(*) AS n, count(*) FILTER (status >= 400) AS errors, sum(bytes)::BIGINT AS bytes, max(ts) FILTER (status >= 400) AS latest_error FROM requests GROUP BY label), a AS (SELECT label, agent, count(*) AS n FROM requests GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, agent) AS rn FROM a)
SELECT g.*, (SELECT string_agg(agent || ':' || t.n, ',' ORDER BY rn) FROM t WHERE t.label = g.label AND rn <= 3) AS top_agents FROM g""")
def usage_report(spark, d):
    """By endpoint: requests, errors with the latest one, bytes, and the busiest agents."""
    r = table(spark, d, "requests")
    error = F.col("status") >= 400
    g = r.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(error).alias("errors"), F.sum("bytes").alias("bytes"), F.max(F.when(error, F.col("ts"))).cast("timestamp_ntz").alias("latest_error"))
    t = r.groupBy("label", "agent").agg(F.count(F.lit(1)).alias("k")).withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy(F.desc("k"), "agent"))).where("rn <= 3")
    t = t.groupBy(F.col("label").alias("t_label")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "agent", "k"))), lambda x: F.concat_ws(":", x["agent"], x["k"])), ",").alias("top_agents"))
    return g.join(t, F.col("label") == F.col("t_label"), "left").drop("t_label")


@query("A21 O1 O4", """
WITH k AS (SELECT * FROM occurrences WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45), s AS (SELECT species_no, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, species_no) AS place FROM k GROUP BY species_no), r AS (SELECT occ_id, species_no, depth, row_number() OVER (ORDER BY depth DESC NULLS LAST, year NULLS LAST, occ_id) AS place FROM k)
SELECT 'total' AS part, 0 AS place, NULL::BIGINT AS id, count(*) AS n, max(depth) AS depth FROM k UNION ALL SELECT 'species', place, species_no, n, NULL FROM s WHERE place <= 5 UNION ALL SELECT 'record', place, occ_id, NULL, depth FROM r WHERE place <= 20""")
def cell_drilldown(spark, d):
    """A cell in detail: exact totals, its commonest species, and its deepest records in a fixed order, nulls last."""
    k = table(spark, d, "occurrences").where("lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45")
    none = F.lit(None).cast("long")
    total = k.agg(F.lit("total").alias("part"), F.lit(0).alias("place"), none.alias("id"), F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))

    def numbered(df, part, *order):
        """The rows of a short top list with their places."""
        top = df.orderBy(*order).limit(20 if part == "record" else 5)
        return top.withColumn("place", F.row_number().over(W.orderBy(*order))).withColumn("part", F.lit(part)).select("part", "place", "id", "n", "depth")

    species = numbered(k.groupBy(F.col("species_no").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("depth")), "species", F.desc("n"), F.asc("id"))
    records = numbered(k.select(F.col("occ_id").alias("id"), none.alias("n"), "depth", "year"), "record", F.desc_nulls_last("depth"), F.asc_nulls_last("year"), F.asc("id"))
    return total.unionByName(species).unionByName(records)


@query("A41", f"""
WITH z AS (SELECT zone_id, mx, my FROM boxes WHERE zone_id % 3 = 0), d AS (SELECT p.det_id, z.zone_id, {HAV.format('p.lon', 'p.lat', 'z.mx', 'z.my')} AS km FROM detections p, z), n AS (SELECT det_id, min_by(zone_id, (round(km, 6), zone_id)) AS zone_id, min(round(km, 6)) AS km FROM d GROUP BY det_id)
SELECT zone_id, count(*) AS profiles, round(min(km), 4) AS nearest_km, count(*) FILTER (km <= 50) AS within_50, count(*) FILTER (det_id % 100 < 20) AS below, count(*) FILTER (det_id % 50 = 0) AS plume FROM n GROUP BY zone_id""")
def zone_dossiers(spark, d):
    """Every detection goes to its nearest zone, however far; zones are then summed up."""
    z = table(spark, d, "boxes").where("zone_id % 3 = 0").select(F.lit(1).alias("all"), "zone_id", F.col("mx").alias("lon"), F.col("my").alias("lat"))
    det = table(spark, d, "detections").select("det_id", "lon", "lat")
    places = det.groupBy("lon", "lat").agg(F.min("det_id").alias("first"))
    near = S.nearest_of_each(places, z, "first", "all", "zone_id").select("first", "zone_id", "km").join(places.withColumnsRenamed({"lon": "p_lon", "lat": "p_lat"}), "first")
    n = det.join(near, (F.col("lon") == F.col("p_lon")) & (F.col("lat") == F.col("p_lat"))).withColumn("km", F.round("km", 6))
    return n.groupBy("zone_id").agg(F.count(F.lit(1)).alias("profiles"), F.round(F.min("km"), 4).alias("nearest_km"), F.count_if(F.col("km") <= 50).alias("within_50"), F.count_if(F.col("det_id") % 100 < 20).alias("below"), F.count_if(F.col("det_id") % 50 == 0).alias("plume"))


# Type codes of soundings that were measured, are indirect, or of unknown origin; 11 is multibeam, 0 land.
MEASURED, INDIRECT, UNKNOWN = range(10, 18), range(40, 47), range(70, 73)


@query("A42", """
WITH c AS (SELECT l_suppkey % 30 AS aoi, CASE WHEN l_partkey % 10 < l_suppkey % 30 % 11 THEN 10 + l_partkey % 3 WHEN l_partkey % 10 = 9 THEN 0 WHEN l_partkey % 2 = 0 THEN 40 ELSE 71 END AS tid, l_extendedprice / 20 - 200 AS depth FROM lineitem), k AS (SELECT aoi, count(*) AS n, count(*) FILTER (tid < 20) AS m, count(*) FILTER (tid = 40) AS i, count(*) FILTER (tid = 71) AS u, count(*) FILTER (tid = 11) AS b, min(depth) FILTER (depth > 0) AS lo, median(depth) FILTER (depth > 0) AS mid, max(depth) FILTER (depth > 0) AS hi FROM c WHERE tid <> 0 GROUP BY aoi)
SELECT aoi, n AS cells, round(100.0 * m / n, 6)::DOUBLE AS measured, round(100.0 * i / n, 6)::DOUBLE AS indirect, round(100.0 * u / n, 6)::DOUBLE AS unknown, round(100.0 * b / n, 6)::DOUBLE AS multibeam, CASE WHEN 100.0 * m / n >= 80 THEN 'high' WHEN 100.0 * m / n < 20 THEN 'low' ELSE 'medium' END AS confidence, round(lo, 6) AS depth_min, round(mid, 6) AS depth_median, round(hi, 6) AS depth_max FROM k""")
def sounding_confidence(spark, d):
    part = F.col("l_partkey")
    tid = F.when(part % 10 < F.col("l_suppkey") % 30 % 11, 10 + part % 3).when(part % 10 == 9, 0).when(part % 2 == 0, 40).otherwise(71)
    c = table(spark, d, "lineitem").select((F.col("l_suppkey") % 30).alias("aoi"), tid.alias("tid"), (F.col("l_extendedprice") / 20 - 200).alias("depth")).where("tid <> 0")
    share = lambda codes: F.round(100.0 * F.count_if(F.col("tid").isin(*codes)) / F.count(F.lit(1)), 6)
    below = F.when(F.col("depth") > 0, F.col("depth"))
    g = c.groupBy("aoi").agg(F.count(F.lit(1)).alias("cells"), share(MEASURED).alias("measured"), share(INDIRECT).alias("indirect"), share(UNKNOWN).alias("unknown"), share([11]).alias("multibeam"), F.round(F.min(below), 6).alias("depth_min"), F.round(F.percentile(below, 0.5), 6).alias("depth_median"), F.round(F.max(below), 6).alias("depth_max"))
    return g.withColumn("confidence", F.when(F.col("measured") >= 80, "high").when(F.col("measured") < 20, "low").otherwise("medium"))


@query("A43 A44", """
WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 4000 END AS v FROM orders), j AS (SELECT a.v - b.v AS diff, b.v FROM b LEFT JOIN a ON a.k = b.k)
SELECT count(diff) AS compared, round(median(diff), 6) AS middle, round(quantile_cont(diff, 0.75) - quantile_cont(diff, 0.25), 6) AS iqr, round(max(abs(diff)), 6) AS farthest, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99, count(v) AS valid, count(*) - count(v) AS gaps FROM j""")
def field_comparison(spark, d):
    """Two fields on one key: median, spread and greatest of their differences; quantiles and gaps of the second one."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("a_k")).agg(F.sum("l_quantity").alias("a"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 4000).alias("v"))
    j = b.join(a, F.col("k") == F.col("a_k"), "left").withColumn("diff", F.col("a") - F.col("v"))
    j = scratch.written(j, "compared")
    q = quantiles(j, "diff", [0.25, 0.5, 0.75]).select("q", "value").withColumn("of", F.lit("diff")).unionByName(quantiles(j, "v", [0.01, 0.5, 0.99]).select("q", "value").withColumn("of", F.lit("v")))
    at = lambda of, p: F.max(F.when((F.col("of") == of) & (F.col("q") == p), F.col("value")))
    picked = q.agg(F.round(at("diff", 0.5), 6).alias("middle"), F.round(at("diff", 0.75) - at("diff", 0.25), 6).alias("iqr"), *[F.round(at("v", p), 6).alias(n) for n, p in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99))])
    out = j.agg(F.count("diff").alias("compared"), F.round(F.max(F.abs("diff")), 6).alias("farthest"), F.count("v").alias("valid"), F.count_if(F.col("v").isNull()).alias("gaps"))
    return out.select("*", *[picked.select(c).scalar().alias(c) for c in picked.columns])


@query("A47 P24", "SELECT status AS sovereign, count(*) AS n, count(DISTINCT site) AS sites FROM tags WHERE cat_no IN (1, 4, 7) AND name NOT IN ('Species 0', 'Species 5') GROUP BY status")
def sovereign_counts(spark, d):
    """Served rows of a table of many types: whitelisted types and named rows only."""
    t = table(spark, d, "tags").withColumn("name", F.when(F.col("name").isin("Species 0"), "").when(F.col("name") != "Species 5", F.col("name")))
    served = t.where(F.col("cat_no").isin(1, 4, 7) & F.col("name").isNotNull() & (F.trim("name") != ""))
    return served.groupBy(F.col("status").alias("sovereign")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("site").alias("sites"))


@query("A56 F24", """
SELECT cat_no, count(DISTINCT name) AS names, count(DISTINCT name) FILTER (o_custkey % 37 % 4 <> 0) AS other_names, min(tag_id) FILTER (name LIKE '%s 1%') AS found_id, count(DISTINCT name) FILTER (name LIKE '%s 1%') AS found FROM tags GROUP BY cat_no""")
def name_census(spark, d):
    """Names of a category, those that are not two words, and a search that ignores case with a row per name."""
    t = table(spark, d, "tags").withColumn("shown", F.when(F.col("o_custkey") % 37 % 4 != 0, F.concat("name", F.lit(" sp."))).otherwise(F.regexp_replace("name", r"\d+", "alba")))
    other = ~F.col("shown").rlike(r"^[A-Z][a-z]+ [a-z-]+$")
    hit = F.lower("name").contains("S 1".lower())
    return t.groupBy("cat_no").agg(F.count_distinct("name").alias("names"), F.count_distinct(F.when(other, F.col("name"))).alias("other_names"), F.min(F.when(hit, F.col("tag_id"))).alias("found_id"), F.count_distinct(F.when(hit, F.col("name"))).alias("found"))


@query("O3", """
WITH r AS (SELECT tag_id, status = 'P' AS critical, row_number() OVER (PARTITION BY status = 'P' ORDER BY price DESC, tag_id) AS place FROM tags) SELECT tag_id, critical FROM r WHERE place <= CASE WHEN critical THEN 10 ELSE 25 END""")
def priority_batch(spark, d):
    """Critical rows first, up to their cap, then others up to theirs."""
    t = table(spark, d, "tags").withColumn("critical", F.col("status") == "P")
    top = lambda rows, cap: rows.orderBy(F.desc("price"), "tag_id").limit(cap).select("tag_id", "critical")
    return top(t.where("critical"), 10).unionByName(top(t.where("NOT critical"), 25))


@query("U2", "SELECT site FROM tags WHERE cat_no < 3 UNION SELECT o_custkey % 90 FROM orders WHERE o_orderstatus = 'P'")
def known_sites(spark, d):
    a = table(spark, d, "tags").where("cat_no < 3").select("site")
    return a.union(table(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 90).alias("site"))).distinct()


@query("U4", """
WITH b AS (SELECT o_custkey % 200 AS id, min(o_custkey % 360 - 180)::DOUBLE AS x0, min(o_orderkey % 60)::DOUBLE AS y0, min(o_custkey % 360 - 180) + count(*) AS x1, max(o_orderkey % 60) + 1.0::DOUBLE AS y1 FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS place FROM b)
SELECT least(place, 50) AS box, min(x0) AS x0, min(y0) AS y0, max(x1)::DOUBLE AS x1, max(y1) AS y1, count(*) AS held FROM r GROUP BY least(place, 50)""")
def capped_boxes(spark, d):
    """At most fifty boxes: the largest stay, the others are merged into the last."""
    k = F.col("o_custkey") % 360 - 180
    b = table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("id")).agg(F.min(k).cast("double").alias("x0"), F.min(F.col("o_orderkey") % 60).cast("double").alias("y0"), (F.min(k) + F.count(F.lit(1))).cast("double").alias("x1"), (F.max(F.col("o_orderkey") % 60) + 1).cast("double").alias("y1"))
    return S.merge_boxes(b, "id", 50)


@query("U5 G11", """
SELECT z.zone_id, tx, ty, count(*) AS nodes FROM (SELECT *, unnest(range(floor((mx - 3) / 2)::INT, ceil((mx + 3) / 2)::INT)) AS tx FROM boxes) z, (SELECT unnest(range(-30, 45)) AS ty) t, (SELECT unnest(range(4)) AS i) a, (SELECT unnest(range(4)) AS j) b
WHERE ty >= floor((my - 1.7) / 2) AND ty < ceil((my + 1.7) / 2) AND tx * 2 + i * 0.5 + 0.25 BETWEEN mx - 3 AND mx + 3 AND ty * 2 + j * 0.5 + 0.25 BETWEEN my - 1.7 AND my + 1.7 GROUP BY ALL""")
def area_tiles(spark, d):
    """Boxes cut into square tiles, and the grid nodes of each tile that lie in the box."""
    z = table(spark, d, "boxes").select("zone_id", (F.col("mx") - 3).alias("x0"), (F.col("my") - 1.7).alias("y0"), (F.col("mx") + 3).alias("x1"), (F.col("my") + 1.7).alias("y1"))
    tiles = S.box_tiles(z, 2.0)
    four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i * 0.5 + 0.25)
    nodes = tiles.withColumn("gx", F.explode(four)).withColumn("gy", F.explode(four)).withColumns({"gx": F.col("tx") * 2 + F.col("gx"), "gy": F.col("ty") * 2 + F.col("gy")})
    return nodes.where(F.col("gx").between(F.col("x0"), F.col("x1")) & F.col("gy").between(F.col("y0"), F.col("y1"))).groupBy("zone_id", "tx", "ty").agg(F.count(F.lit(1)).alias("nodes"))


@query("P23 F23", """
WITH r AS (SELECT site, tag_id, ['oxygen_uncorrected', 'oxygen_corrected', 'seawatertemperature_raw', 'battery voltage', 'salinity'][(cat_no % 5 + 1)::INT] AS code FROM tags), k AS (SELECT site, split_part(code, '_', 1) AS prop, code, tag_id FROM r WHERE code <> 'battery voltage')
SELECT site, prop, CASE WHEN bool_or(code = 'oxygen_corrected') THEN 'oxygen_corrected' ELSE min_by(code, tag_id) END AS code, count(DISTINCT code) > 1 AS collided, CASE prop WHEN 'seawatertemperature' THEN 0 WHEN 'salinity' THEN 1 ELSE 2 END AS rank FROM k GROUP BY site, prop""")
def sensor_choice(spark, d):
    """Housekeeping channels go; of sensors of one property a corrected one stays, else the first; properties have a rank."""
    names = F.array(*[F.lit(x) for x in ("oxygen_uncorrected", "oxygen_corrected", "seawatertemperature_raw", "battery voltage", "salinity")])
    r = table(spark, d, "tags").select("site", "tag_id", F.element_at(names, (F.col("cat_no") % 5 + 1).cast("int")).alias("code"))
    kept = r.where(~classify.housekeeping(F.col("code"))).withColumn("prop", F.split("code", "_")[0])
    best = kept.groupBy("site", "prop").agg(F.min_by("code", F.struct(~classify.corrected(F.col("code")), "tag_id")).alias("code"), (F.count_distinct("code") > 1).alias("collided"))
    return best.withColumn("rank", classify.priority(F.col("prop"), ("seawatertemperature", "salinity")))


@query("P26", """
WITH h AS (SELECT species_no, year, count(*) AS n FROM occurrences GROUP BY ALL) SELECT species_no, sum(n)::BIGINT AS whole, coalesce(sum(n) FILTER (year BETWEEN 1994 AND 1996), 0)::BIGINT AS ranged FROM h GROUP BY species_no""")
def ranged_year_maps(spark, d):
    """Maps from year to count: without a range all count, undated ones too; a range leaves only its years."""
    o = table(spark, d, "occurrences").groupBy("species_no", "year").agg(F.count(F.lit(1)).alias("n"))
    m = o.groupBy("species_no").agg(F.map_from_entries(F.collect_list(F.when(F.col("year").isNotNull(), F.struct("year", "n")))).alias("years"), F.coalesce(F.sum(F.when(F.col("year").isNull(), F.col("n"))), F.lit(0)).alias("undated"))
    return m.select("species_no", classify.years_count(F.col("years"), F.col("undated"), None, None).alias("whole"), classify.years_count(F.col("years"), F.col("undated"), 1994, 1996).alias("ranged"))


@query("F26 G14", """
SELECT o_orderstatus AS status, max(date_trunc('month', o_orderdate))::DATE AS newest, array_to_string(list_transform(range(6), lambda i: strftime(max(date_trunc('month', o_orderdate)) - to_months(i::INT), '%Y-%m')), ',') AS months, max(CASE WHEN year(o_orderdate) BETWEEN 1970 AND 2029 THEN (year(o_orderdate) - 1970) // 10 END)::INT AS decade FROM orders GROUP BY o_orderstatus""")
def newest_months(spark, d):
    """The newest six months of a group, and its decade as an index from the 1970s."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.max(F.trunc("o_orderdate", "month")).alias("newest"), F.max(classify.decade_index(F.year("o_orderdate"))).alias("decade"))
    months = F.sequence(F.col("newest"), F.add_months("newest", -5), F.expr("INTERVAL -1 MONTH"))
    return g.withColumn("months", F.array_join(F.transform(months, lambda m: F.date_format(m, "yyyy-MM")), ","))
