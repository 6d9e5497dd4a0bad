"""Queries on roll-ups and classifiers."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.functions import classify, geo
from halocline.operators import rollup as R
from halocline.operators.ordered import quantiles
from halocline.plans.book import query
from halocline.plans.standins import table

CUTOFF = 1999
DECADE = f"CASE WHEN year IS NULL OR year > {CUTOFF} THEN -1 WHEN year < 1950 THEN 1940 ELSE year // 10 * 10 END"
BAND = "CASE WHEN depth IS NULL THEN 3 WHEN depth <= 200 THEN 0 WHEN depth <= 1000 THEN 1 ELSE 2 END"
CUBE = f"SELECT lon, lat, grp, {DECADE} AS decade, {BAND} AS depth_band, edna, count(*) AS n FROM occurrences GROUP BY ALL"
MX, MY = "6378137.0 * radians(lon)", "6378137.0 * ln(tan(pi() / 4 + radians(greatest(least(lat, 85.0511287798066), -85.0511287798066)) / 2))"
WORLD = repr(geo.WORLD)
CX = "CAST(least(greatest(floor(({x} + {w}) / (2 * {w}) * {n}), 0), {n} - 1) AS BIGINT)"


def cell_sql(bits: int) -> tuple[str, str]:
    return CX.format(x=MX, w=WORLD, n=1 << bits), CX.format(x=f"(-{MY})", w=WORLD, n=1 << bits)


def morton_sql(bits: int) -> str:
    x, y = cell_sql(bits)
    return " + ".join(f"(({x} >> {i}) & 1) * {1 << 2 * i} + (({y} >> {i}) & 1) * {1 << 2 * i + 1}" for i in range(bits))


def cube(spark, d):
    return R.facet_cube(table(spark, d, "occurrences"), CUTOFF)


@query("A1 P5 P6", f"SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, grp, decade, depth_band, edna, n FROM ({CUBE})")
def facet_cube(spark, d):
    return cube(spark, d).select(F.round(F.col("rlon").cast("double"), 6).alias("lon"), F.round(F.col("rlat").cast("double"), 6).alias("lat"), "grp", "decade", "depth_band", "edna", "n")


@query("A2", "SELECT row_number() OVER (ORDER BY round(lon, 6), round(lat, 6)) AS site_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT DISTINCT lon, lat FROM occurrences)")
def site_dimension(spark, d):
    places = table(spark, d, "occurrences").select(F.col("lon").cast("decimal(9,6)").alias("rlon"), F.col("lat").cast("decimal(8,6)").alias("rlat"))
    return R.site_ids(places).select("site_id", F.col("rlon").cast("double").alias("lon"), F.col("rlat").cast("double").alias("lat"))


@query("A3 A4", f"""
WITH c AS ({CUBE}), g AS (SELECT least(floor(round(lon, 6)), 179)::INT AS cx, least(floor(round(lat, 6)), 89)::INT AS cy, grp, sum(n) AS n, bool_and(edna) AS e FROM c GROUP BY ALL)
SELECT cx, cy, sum(n)::BIGINT AS total, min_by(grp, (-n, grp)) AS top_group, bit_or(CASE grp WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END) AS groups, bool_and(e) AS edna_only FROM g GROUP BY cx, cy""")
def grid_rollup(spark, d):
    return R.cell_rollup(R.grid_facets(cube(spark, d), 1.0), ["A", "N", "R"])


@query("A5", "SELECT name, count(*) AS held, count(*) AS expected, true AS ok FROM lineitem, (VALUES ('cube'), ('quarter'), ('whole')) t(name) GROUP BY name")
def facet_conservation(spark, d):
    c = cube(spark, d)
    return R.conservation(table(spark, d, "occurrences"), {"cube": c, "whole": R.grid_facets(c, 1.0), "quarter": R.grid_facets(c, 0.25)})


@query("A6 F3 F6 S10 U1")
def hex_density(spark, d):
    """Hexagons by cube rounding; halves on hexagon edges make a SQL twin depend on the last bit, so tests hold it against
    the nearest hexagon centre instead."""
    points = table(spark, d, "occurrences").select("lon", "lat", F.col("grp").alias("src")).unionByName(table(spark, d, "detections").select("lon", "lat", F.lit("detection").alias("src")))
    q, r = geo.hex_cell(F.col("lon"), F.col("lat"), 137_000.0)
    return R.hex_density(points.select(q.alias("q"), r.alias("r"), "src"))


@query("A7 F25", """
WITH o AS (SELECT floor(lon / 10)::INT AS cx, floor(lat / 10)::INT AS cy, year FROM occurrences), k AS (SELECT cx, cy, year // 10 * 10 AS decade, count(*) AS k, min(year) AS lo, max(year) AS hi FROM o GROUP BY ALL)
SELECT cx, cy, sum(k)::BIGINT AS n, min(lo) AS min_year, max(hi) AS max_year, coalesce(sum(k) FILTER (decade IS NULL), 0)::BIGINT AS undated, string_agg(decade || ':' || k, ',' ORDER BY decade) FILTER (decade IS NOT NULL) AS decades FROM k GROUP BY cx, cy""")
def decade_histogram(spark, d):
    rows = table(spark, d, "occurrences").select(geo.degree_cell(F.col("lon"), 10.0).alias("cx"), geo.degree_cell(F.col("lat"), 10.0).alias("cy"), "year")
    return R.histogram_map(rows, ["cx", "cy"])


CATEGORY = "CASE species_no % 9 WHEN 0 THEN 'CR' WHEN 1 THEN 'EN' WHEN 2 THEN 'VU' WHEN 3 THEN 'NT' WHEN 4 THEN 'LC' WHEN 5 THEN NULL ELSE 'DD' END"


@query("A8 W3", f"""
WITH s AS (SELECT round_even(lon / 20, 0) * 20 AS cell_lon, round_even(lat / 20, 0) * 20 AS cell_lat, 's' || species_no AS species, coalesce({CATEGORY}, 'NE') AS category, count(*) AS records FROM occurrences GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_lon, cell_lat ORDER BY CASE category WHEN 'CR' THEN 1 WHEN 'EN' THEN 2 WHEN 'VU' THEN 3 WHEN 'NT' THEN 4 WHEN 'LC' THEN 5 ELSE 6 END, records DESC, species) AS rn FROM s)
SELECT cell_lon, cell_lat, sum(records)::BIGINT AS total, count(DISTINCT species) AS species_count, count(DISTINCT species) FILTER (category IN ('CR', 'EN', 'VU')) AS endangered, count(DISTINCT species) FILTER (category IN ('CR', 'EN')) AS critical, string_agg(species, '|' ORDER BY rn) FILTER (rn <= 5) AS top_species FROM r GROUP BY cell_lon, cell_lat""")
def hotspots(spark, d):
    rows = table(spark, d, "occurrences").selectExpr("lon", "lat", "concat('s', species_no) AS species", f"{CATEGORY} AS category")
    return R.hotspot_grid(rows, 20.0)


@query("A13", "SELECT key_id, date_trunc('hour', ts) AS hour, label, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, sum(bytes)::BIGINT AS bytes FROM requests GROUP BY ALL")
def hourly_usage(spark, d):
    return R.usage(table(spark, d, "requests")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("", """
WITH n AS (SELECT max(ts) AS t FROM requests), a AS (SELECT key_id, agent, epoch_us(n.t) - epoch_us(ts) AS age FROM requests, n),
s AS (SELECT key_id, count(*) FILTER (age < 86400000000) AS recent, count(DISTINCT agent) FILTER (age < 86400000000) AS agents, count(*) FILTER (age >= 86400000000 AND age < 604800000000) / 6.0 AS baseline FROM a GROUP BY key_id)
SELECT key_id, 'multi_agent' AS flag, CASE WHEN agents >= 6 THEN 'warn' ELSE 'info' END AS severity FROM s WHERE agents >= 3
UNION ALL SELECT key_id, 'spike', 'warn' FROM s WHERE baseline > 0 AND recent >= 10 AND recent > baseline * 1.05""")
def leak_flags(spark, d):
    rows = table(spark, d, "requests")
    return R.leak_flags(rows.withColumn("now", rows.agg(F.max("ts")).scalar()), F.col("now"), factor=1.05, least=10)


@query("A17 A18 A19 F4", f"""
WITH p AS (SELECT ({morton_sql(8)}) AS key, {MX} AS x, {MY} AS y, year, depth, occ_id FROM occurrences WHERE year IS NOT NULL),
k AS (SELECT key >> 12 AS cell, * FROM p WHERE year BETWEEN 1996 AND 1999)
SELECT cell, count(*) AS n, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy, round(avg(depth), 6) AS mean_depth FROM k GROUP BY cell""")
def lod_pyramid(spark, d):
    """Three levels, each from the next finer one, then a read-out with a range of years."""
    o = table(spark, d, "occurrences").where("year IS NOT NULL")
    points = o.select(geo.morton(F.col("lon"), F.col("lat"), 8).alias("key"), "year", F.col("occ_id").alias("id"), geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"), "depth")
    level = R.lod_base(points, 8, 6, ["depth"])
    for _ in range(2):
        level = R.lod_coarser(level, ["depth"])
    return R.lod_read(level, ["depth"], (1996, 1999)).select("cell", "n", F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"), F.round("mean_depth", 6).alias("mean_depth"))


@query("A22 F5", f"""
WITH t AS (SELECT {cell_sql(6)[0]} AS tx, {cell_sql(6)[1]} AS ty FROM occurrences), z AS (SELECT unnest([3, 4, 5, 6]) AS zoom)
SELECT zoom, tx >> (6 - zoom) AS tx, ty >> (6 - zoom) AS ty, count(*) AS n FROM t, z GROUP BY ALL HAVING count(*) >= 50""")
def heavy_tiles(spark, d):
    x, y = geo.tile(F.col("lon"), F.col("lat"), 6)
    return R.heavy_tiles(table(spark, d, "occurrences").select(x.alias("tx"), y.alias("ty")), 6, 3, 50)


@query("A20", """
WITH k AS (SELECT floor(lon / 30)::INT AS cx, floor(lat / 30)::INT AS cy, * FROM occurrences)
SELECT cx, cy, count(*) AS n, min_by(occ_id, (year, occ_id)) AS first_id, count(DISTINCT species_no) AS species, round(avg(depth), 6) AS depth FROM k WHERE year IS NOT NULL GROUP BY cx, cy""")
def cell_readout(spark, d):
    k = table(spark, d, "occurrences").where("year IS NOT NULL").groupBy(geo.degree_cell(F.col("lon"), 30.0).alias("cx"), geo.degree_cell(F.col("lat"), 30.0).alias("cy"))
    return k.agg(F.count(F.lit(1)).alias("n"), F.min_by("occ_id", F.struct("year", "occ_id")).alias("first_id"), F.count_distinct("species_no").alias("species"), F.round(F.avg("depth"), 6).alias("depth"))


@query("A38 W4", f"""
WITH g AS (SELECT grp, count(*) AS n, count(*) FILTER (edna) AS edna, count(*) FILTER (year IS NULL) AS undated, count(*) FILTER (depth IS NULL) AS no_depth, min(year) AS min_year, max(year) FILTER (year <= {CUTOFF}) AS max_year, median(year) AS median_year FROM occurrences GROUP BY grp)
SELECT *, sum(n) OVER ()::BIGINT AS total FROM g""")
def place_profile(spark, d):
    o = table(spark, d, "occurrences")
    g = o.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if("edna").alias("edna"), F.count_if(F.col("year").isNull()).alias("undated"), F.count_if(F.col("depth").isNull()).alias("no_depth"), F.min("year").alias("min_year"), F.max(F.when(F.col("year") <= CUTOFF, F.col("year"))).alias("max_year"), F.percentile("year", 0.5).alias("median_year"))
    return g.withColumn("total", o.agg(F.count(F.lit(1))).scalar())


@query("A26", """
WITH m AS (SELECT l_suppkey, median(l_extendedprice) FILTER (l_extendedprice > 0) AS med FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey)
SELECT l.l_suppkey, count(*) AS n, count(*) FILTER (coalesce(med >= 35000 AND l_extendedprice >= 35000, false)) AS flagged FROM lineitem l LEFT JOIN m ON m.l_suppkey = l.l_suppkey GROUP BY l.l_suppkey""")
def median_flag(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_returnflag")
    return R.median_flag(rows, "l_suppkey", "l_extendedprice", 35000.0, F.col("l_returnflag") != "R").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"))


@query("A34", """
WITH c AS (SELECT floor(lon / 5)::INT AS cx, floor(lat / 5)::INT AS cy, count(*) FILTER (edna)::DOUBLE AS k, max(CAST(species_no AS DOUBLE)) / 50 AS noise, 1 + (min(species_no) % 3)::DOUBLE / 2 AS weight FROM occurrences GROUP BY ALL),
d AS (SELECT *, CASE WHEN cy < 0 THEN 'south' ELSE 'north' END AS region, nullif(k, 0) AS cnt FROM c), p AS (SELECT region, quantile_cont(cnt, 0.95) AS p95 FROM d GROUP BY region),
i AS (SELECT d.*, least(1.0, CASE WHEN cnt IS NULL THEN noise * 0.5 ELSE noise * least(1.0, cnt / p95) * weight END) AS idx FROM d JOIN p ON d.region = p.region)
SELECT cx, cy, region, round(idx, 6) AS risk, CASE WHEN round(idx, 9) >= 0.8 THEN 'critical' WHEN round(idx, 9) >= 0.6 THEN 'high' WHEN round(idx, 9) >= 0.4 THEN 'moderate' WHEN round(idx, 9) >= 0.2 THEN 'low' ELSE 'minimal' END AS level FROM i""")
def noise_risk(spark, d):
    o = table(spark, d, "occurrences")
    cells = o.groupBy(geo.degree_cell(F.col("lon"), 5.0).alias("cx"), geo.degree_cell(F.col("lat"), 5.0).alias("cy")).agg(F.nullif(F.count_if("edna").cast("double"), F.lit(0.0)).alias("count"), (F.max("species_no") / 50).alias("noise"), (1 + F.min("species_no") % 3 / 2).alias("weight"))
    out = R.risk_index(cells.withColumn("region", F.when(F.col("cy") < 0, "south").otherwise("north")))
    return out.select("cx", "cy", "region", F.round("index", 6).alias("risk"), classify.risk_level(F.round("index", 9), F.col("noise").isNull()).alias("level"))


@query("A35 G9", """
WITH c AS (SELECT l_partkey, CASE WHEN l_quantity IS NULL OR l_quantity < 3 THEN 'no_data' WHEN l_quantity <= l_suppkey % 20 THEN 'supersaturated' WHEN l_quantity <= l_suppkey % 20 + l_linenumber THEN 'newly_corrosive' ELSE 'corrosive_preindustrial' END AS class, l_linenumber::DOUBLE AS weight, l_quantity / 50 AS s FROM lineitem), t AS (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS cutoff)
SELECT cutoff, round(sum(CASE WHEN class IN ('newly_corrosive', 'corrosive_preindustrial') THEN weight ELSE 0 END) / sum(weight), 6) AS exposed_share FROM c, t WHERE class <> 'no_data' AND s >= cutoff GROUP BY cutoff""")
def exposure_shares(spark, d):
    rows = table(spark, d, "lineitem")
    today = (F.col("l_suppkey") % 20).cast("double")
    cells = rows.select(classify.exposure(F.when(F.col("l_quantity") >= 3, F.col("l_quantity")), today, today + F.col("l_linenumber")).alias("class"), F.col("l_linenumber").cast("double").alias("weight"), (F.col("l_quantity") / 50).alias("suitability"))
    return R.weighted_exposure(cells, [0.2, 0.5, 0.8]).select("cutoff", F.round("exposed_share", 6).alias("exposed_share"))


@query("A36", """
SELECT o_custkey % 7 AS dataset, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers, round(quantile_cont(o_totalprice, 0.01), 4) AS p1, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders GROUP BY ALL""")
def segment_statistics(spark, d):
    o = table(spark, d, "orders").withColumn("dataset", F.col("o_custkey") % 7)
    g = o.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("customers"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"))
    q = quantiles(o, "o_totalprice", [0.01, 0.5, 0.99], ["dataset"]).groupBy(F.col("dataset").alias("q_dataset")).agg(*[F.round(F.max(F.when(F.col("q") == p, F.col("value"))), 4).alias(x) for x, p in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99))])
    return g.join(q, F.col("dataset") == F.col("q_dataset"), "left").drop("q_dataset")


@query("A37", """SELECT date_trunc('month', o_orderdate)::DATE AS month, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(*) AS n FROM orders GROUP BY ALL""")
def monthly_means(spark, d):
    return table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("std"), F.count(F.lit(1)).alias("n"))


@query("A52", """
SELECT o_custkey % 40 / 100.0::DOUBLE AS rlon, o_custkey % 9 / 100.0::DOUBLE AS rlat, max_by(o_orderstatus || o_custkey, (o_orderdate, o_orderstatus || o_custkey)) AS device, min(o_orderdate) AS started, CASE WHEN bool_or(o_totalprice < 1200) THEN NULL ELSE max(o_orderdate + INTERVAL 30 DAY) END AS ended FROM orders GROUP BY o_custkey % 40, o_custkey % 9""")
def deployments(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 40 / 100).alias("lon"), (F.col("o_custkey") % 9 / 100).alias("lat"), F.concat("o_orderstatus", F.col("o_custkey").cast("string")).alias("device"), F.col("o_orderdate").alias("started"), F.when(F.col("o_totalprice") >= 1200, F.expr("o_orderdate + INTERVAL 30 DAY")).alias("ended"))
    return R.deployments(rows)


@query("", """SELECT dataset, pattern, count(*) AS n, count(*) FILTER (a > 12) AS first_over_12, count(*) FILTER (b > 12) AS second_over_12 FROM (SELECT o_custkey % 5 AS dataset, CASE WHEN o_orderkey % 2 = 0 THEN 'slash' ELSE 'dot' END AS pattern, day(o_orderdate) AS a, month(o_orderdate) AS b FROM orders) GROUP BY ALL""")
def date_order_evidence(spark, d):
    text = F.concat(F.date_format("o_orderdate", "dd"), F.when(F.col("o_orderkey") % 2 == 0, "/").otherwise("."), F.date_format("o_orderdate", "MM"))
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("dataset"), text.alias("t"))
    a, b = (F.regexp_extract("t", r"^(\d+)([/.])(\d+)", i).cast("int") for i in (1, 3))
    return rows.groupBy("dataset", F.when(F.col("t").contains("/"), "slash").otherwise("dot").alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.count_if(a > 12).alias("first_over_12"), F.count_if(b > 12).alias("second_over_12"))


@query("P11 P18", """
WITH o AS (SELECT occ_id, CASE WHEN l_linenumber = 5 THEN lon * 2 ELSE lon END AS lon, lat, grp, edna FROM occurrences),
c AS (SELECT *, CASE WHEN grp = 'R' AND edna THEN 'dropped' WHEN lon NOT BETWEEN -180 AND 180 THEN 'out_of_range' ELSE NULL END AS reason,
 CASE WHEN lon NOT BETWEEN -180 AND 180 THEN NULL WHEN lat >= 66.5 THEN 'Arctic Ocean' WHEN lat <= -60 THEN 'Southern Ocean' WHEN lat BETWEEN 30 AND 46 AND lon BETWEEN -6 AND 36 THEN 'Mediterranean Sea' WHEN lat > 30 AND lon >= 20 AND lon < 100 THEN NULL WHEN lat > -10 AND lon BETWEEN 100 AND 130 THEN NULL
 WHEN lon >= CASE WHEN lat >= 15 THEN -100 WHEN lat >= 0 THEN -83 ELSE -70 END AND lon <= 20 THEN 'Atlantic Ocean' WHEN lon > 20 AND lon <= CASE WHEN lat <= -10 THEN 146.82 ELSE 130 END THEN 'Indian Ocean' ELSE 'Pacific Ocean' END AS basin FROM o)
SELECT reason, basin, count(*) AS n FROM c GROUP BY ALL""")
def drop_reasons_and_basins(spark, d):
    o = table(spark, d, "occurrences").withColumn("lon", F.when(F.col("l_linenumber") == 5, F.col("lon") * 2).otherwise(F.col("lon")))
    status = classify.position_status(F.col("lon"), F.col("lat"))
    reason = F.when((F.col("grp") == "R") & F.col("edna"), "dropped").when(status != "ok", status)
    return o.groupBy(reason.alias("reason"), classify.basin(F.col("lon"), F.col("lat")).alias("basin")).agg(F.count(F.lit(1)).alias("n"))


@query("P17", """
SELECT CASE WHEN regexp_matches(t, '(^|[^a-z])nc([^a-z]|$)|non-?commercial') THEN 'cc-by-nc' WHEN regexp_matches(t, '(^|[^a-z])nd([^a-z]|$)|no-?deriv') THEN 'unknown' WHEN t LIKE '%cc0%' THEN 'cc0' WHEN t LIKE '%by-sa%' OR t LIKE '%sharealike%' THEN 'cc-by-sa' WHEN t LIKE '%cc-by%' THEN 'cc-by' ELSE 'unknown' END AS licence, count(*) AS n
FROM (SELECT regexp_replace(trim(lower(coalesce(text, ''))), '[\\s_]+', '-', 'g') AS t FROM documents) GROUP BY ALL""")
def licence_classes(spark, d):
    return table(spark, d, "documents").groupBy(classify.licence(F.col("text")).alias("licence")).agg(F.count(F.lit(1)).alias("n"))


@query("P13", """
WITH k AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN make_date(1900 + (o_custkey % 20)::INT, 1, 1) WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE END AS day, count(*) AS n FROM orders WHERE o_orderkey % 3 < 2 GROUP BY ALL), w AS (SELECT *, lag(day) OVER (ORDER BY day) AS a, lead(day) OVER (ORDER BY day) AS b FROM k)
SELECT day, n FROM w WHERE n >= 5 AND (a IS NULL OR day - a > 1) AND (b IS NULL OR b - day > 1)""")
def date_spikes(spark, d):
    """Days with many records and none on the days around: what a filled-in date looks like."""
    o = table(spark, d, "orders").where("o_orderkey % 3 < 2")
    filled = F.when(F.col("o_orderkey") % 3 == 0, F.make_date(F.lit(1900) + (F.col("o_custkey") % 20).cast("int"), F.lit(1), F.lit(1))).otherwise(F.to_date("o_orderdate"))
    days = o.groupBy(filled.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    around = days.select(F.explode(F.array(F.date_add("day", -1), F.date_add("day", 1))).alias("near")).distinct()
    return days.where("n >= 5").join(around, F.col("day") == F.col("near"), "left_anti")


@query("P21", "SELECT occ_id FROM occurrences WHERE (occ_id // 8 * 7 + occ_id % 8) % 16 = 0")
def thinned_points(spark, d):
    """Ids without gaps are thinned: the order times seven and the line."""
    row = F.expr("occ_id div 8 * 7") + F.col("occ_id") % 8
    return table(spark, d, "occurrences").where(classify.thinning(row, 3)).select("occ_id")


@query("F1 F13 F15 F19", """
SELECT occ_id, round(2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(0 - lat) / 2), 2) + cos(radians(lat)) * power(sin(radians(0 - lon) / 2), 2)))), 6) AS km,
 round(CASE WHEN depth <= 0 THEN 0 ELSE ((((-1.82e-15 * depth + 2.279e-10) * depth - 2.2512e-5) * depth + 9.72659) * depth) / (9.780318 * (1.0 + (5.2788e-3 + 2.36e-5 * power(sin(radians(lat)), 2)) * power(sin(radians(lat)), 2)) + 1.092e-6 * depth) END, 6) AS metres,
 least(greatest(round_even(lat * 100, 0), -32767), 32767)::INT AS packed, 'occ_' || substr(sha1_hex, 1, 16) AS stable_id FROM (SELECT *, sha1(occ_id || ':' || grp) AS sha1_hex FROM occurrences)""")
def scalar_functions(spark, d):
    o = table(spark, d, "occurrences")
    return o.select("occ_id", F.round(geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(0.0), F.lit(0.0)), 6).alias("km"), F.round(geo.depth_from_pressure(F.col("depth"), F.col("lat")), 6).alias("metres"), classify.small_int(F.col("lat"), 100).alias("packed"), classify.stable_id("occ_", F.col("occ_id"), F.col("grp")).alias("stable_id"))
