"""Queries on the cleaning of raw occurrence records."""

from pyspark.sql import functions as F

from halocline.functions import classify, geo, occurrence
from halocline.operators import rollup as R
from halocline.plans.book import query
from halocline.plans.rollups import BAND, CUTOFF, DECADE, MX, MY, cell_sql, cube, morton_sql
from halocline.plans.standins import table
from halocline.sources import scratch

COPEPOD = "(class IS NOT DISTINCT FROM 'Copepoda' OR subclass IS NOT DISTINCT FROM 'Copepoda')"
GROUP = f"""CASE WHEN {COPEPOD} THEN 'copepoda' WHEN ord = 'Euphausiacea' THEN 'euphausiacea' WHEN phylum = 'Bacillariophyta' OR class = 'Bacillariophyceae' THEN 'diatoms'
 WHEN class IN ('Coccolithophyceae', 'Prymnesiophyceae') AND coalesce(ord, '') NOT IN ('Prymnesiales', 'Phaeocystales') THEN 'coccolithophores' WHEN class = 'Dinophyceae' OR phylum = 'Dinoflagellata' THEN 'dinoflagellates' END"""
REASON = f"""CASE WHEN dataset = 4 THEN 'excluded_dataset' WHEN absence THEN 'absence' WHEN coalesce(dropped, false) THEN 'dropped' WHEN lon IS NULL OR abs(lon) > 180 OR (lon = 0 AND lat = 0) THEN 'bad_coords' WHEN on_land THEN 'on_land'
 WHEN {COPEPOD} AND ord = 'Harpacticoida' AND coalesce(genus, '') <> 'Microsetella' THEN 'excluded_order' END"""


def cleaned(spark, d):
    c = F.col
    f = table(spark, d, "finds").withColumn("grp", occurrence.taxon_group(c("class"), c("subclass"), c("ord"), c("phylum"))).withColumn("edna", occurrence.is_edna(c("n_dna"), c("title")))
    return f.withColumn("reason", occurrence.drop_reason(c("absence"), c("dropped"), c("dataset") == 4, c("lon"), c("lat"), c("on_land"), occurrence.is_copepod(c("class"), c("subclass")), c("ord"), c("genus")))


@query("P1 P3 P4 S2", f"""SELECT occ_id, {GROUP} AS grp, CASE WHEN n_dna IS NULL THEN regexp_matches(lower(title), '18s|edna|amplicon') ELSE n_dna > 0 END AS edna, ({REASON}) IS NULL AS keep FROM finds WHERE {GROUP} IS NOT NULL""")
def extracted_occurrences(spark, d):
    """Records of a known group; what the keep rule drops stays in, marked, so that drops can be counted."""
    return cleaned(spark, d).where("grp IS NOT NULL").select("occ_id", "grp", "edna", F.col("reason").isNull().alias("keep"))


@query("P2", f"SELECT dataset, {REASON} AS reason, count(*) AS n FROM finds GROUP BY ALL")
def drop_census(spark, d):
    return cleaned(spark, d).groupBy("dataset", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("P20", """
WITH v AS (SELECT occ_id, depth, dmin, dmax, coalesce(greatest(depth, dmin, dmax) <= 0 AND least(depth, dmin, dmax) < 0, false) AS turned FROM finds),
r AS (SELECT occ_id, CASE WHEN turned THEN -1 ELSE 1 END * CASE WHEN depth IS NOT NULL THEN depth WHEN dmin IS NOT NULL AND dmax IS NOT NULL THEN (dmin + dmax) / 2 WHEN dmin IS NOT NULL THEN dmin ELSE dmax END AS v FROM v)
SELECT occ_id, CASE WHEN v BETWEEN 0 AND 11000 THEN round(v, 4) + 0.0::DOUBLE END AS depth FROM r""")
def resolved_depths(spark, d):
    v = occurrence.resolved_depth(F.col("depth"), F.col("dmin"), F.col("dmax"))
    return table(spark, d, "finds").select("occ_id", (F.round(v, 4) + F.lit(0.0)).alias("depth"))


@query("F7 F8 A46", """
WITH p AS (SELECT dataset FROM finds WHERE style = 4 GROUP BY dataset HAVING dataset <> 5 AND count(*) FILTER (d > 12) >= 3),
k AS (SELECT f.*, p.dataset IS NOT NULL AS proven, l_linenumber % 2 = 0 AS even FROM finds f LEFT JOIN p ON p.dataset = f.dataset),
r AS (SELECT occ_id, CASE WHEN style = 9 THEN NULL ELSE y END AS year,
 CASE WHEN style IN (0, 1, 2, 3, 5, 6, 8) THEN m WHEN style = 4 AND dataset <> 5 AND (d > 12 OR proven) THEN m WHEN style = 4 AND dataset = 5 AND m > 12 THEN d WHEN style = 7 AND even THEN m END AS month,
 CASE WHEN style IN (0, 2, 5, 6, 8) THEN d WHEN style = 4 AND dataset <> 5 AND (d > 12 OR proven) THEN d END AS day,
 CASE style WHEN 8 THEN 'reader' WHEN 7 THEN 'fields' WHEN 9 THEN 'none' ELSE 'text' END AS source FROM k) SELECT * FROM r""")
def resolved_dates(spark, d):
    """Dates in ten spellings; a dataset vouches for day before month if enough of its first numbers are over 12 and no
    second one is. Texts and fields are read once for each form in which they come, not once a record."""
    c = F.col
    two = lambda x: F.lpad(c(x).cast("string"), 2, "0")
    iso = F.concat_ws("-", c("y").cast("string"), two("m"), two("d"))
    spelled = [iso, F.concat_ws("-", c("y"), two("m")), F.concat_ws("/", "y", "m", "d"), F.concat(c("y"), F.lit("-"), two("m"), F.lit("-01/"), c("y"), F.lit("-"), two("m"), F.lit("-15")),
               F.when(c("dataset") == 5, F.concat_ws(".", "m", "d", "y")).otherwise(F.concat_ws(".", "d", "m", "y")), F.concat(iso, F.lit("T24:00")), F.concat(iso, F.lit("T12:30:00Z")), F.lit("unknown"), F.lit(None).cast("string"), F.concat(c("y"), F.lit("-13-01"))]
    f = table(spark, d, "finds").withColumn("text", F.element_at(F.array(*spelled), (c("style") + 1).cast("int"))).withColumn("own", F.make_date("y", "m", "d"))
    pair = [F.regexp_extract("text", occurrence.YEAR_LAST, i).try_cast("int") for i in (1, 3)]
    over = lambda n: F.coalesce(F.sum(F.when(n > 12, F.col("n"))), F.lit(0))
    proof = f.groupBy("dataset", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset").agg(over(pair[0]).alias("firsts"), over(pair[1]).alias("seconds")).where("firsts >= 3 AND seconds = 0").select(c("dataset").alias("proven"))
    f = f.join(proof, c("dataset") == c("proven"), "left")
    start = F.when(c("style") == 8, c("own")).when(c("style") == 5, F.date_add("own", 1))
    fields = c("style") == 7
    f = f.select("occ_id", "text", c("proven").isNotNull().alias("vouched"), start.alias("start"), F.when(fields, c("y")).alias("own_y"), F.when(fields & (c("l_linenumber") % 2 == 0), c("m")).alias("own_m"))
    said = ["text", "vouched", "start", "own_y", "own_m"]
    out = occurrence.resolved_date(c("text"), c("vouched"), c("start"), c("start"), c("own_y"), c("own_m"), F.lit(None).cast("int"))
    forms = scratch.written(f.select(*said).distinct().select(*[c(x).alias(f"s_{x}") for x in said], out.alias("r")), "forms")
    alike = F.lit(True)
    for x in said:
        alike = alike & c(x).eqNullSafe(c(f"s_{x}"))
    return f.join(forms, alike).select("occ_id", c("r.y").alias("year"), c("r.m").alias("month"), c("r.d").alias("day"), "r.source")


@query("P12", """SELECT o_orderkey AS id, o_custkey % 4 AS source, CASE WHEN o_custkey % 4 = 1 AND o_orderdate::DATE IN (DATE '1995-01-01', DATE '1996-06-15') OR o_custkey % 4 = 2 AND o_orderdate::DATE = DATE '1997-03-03' THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""")
def without_placeholder_dates(spark, d):
    """A fill date of one source is a real day in another."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("source"), F.to_date("o_orderdate").alias("day"))
    fill = occurrence.placeholder_date(F.col("day"), F.col("source").cast("string"), {"1": ("1995-01-01", "1996-06-15"), "2": ("1997-03-03",)})
    return o.select("id", "source", F.when(~fill, F.col("day")).alias("day"))


@query("P19", """SELECT CASE WHEN lon BETWEEN -30 AND 40 AND lat BETWEEN 20 AND 80 THEN 'north_atlantic' WHEN lon BETWEEN -100 AND -30 AND lat BETWEEN -60 AND 80 THEN 'atlantic' WHEN lat BETWEEN 0 AND 80 AND (lon BETWEEN 40 AND 180 OR lon BETWEEN -180 AND -80) THEN 'pacific_north' ELSE 'global' END AS region, count(*) AS n, count(DISTINCT species_no) AS species FROM occurrences GROUP BY ALL""")
def region_counts(spark, d):
    return table(spark, d, "occurrences").groupBy(occurrence.region(F.col("lon"), F.col("lat")).alias("region")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("species_no").alias("species"))


@query("P16", f"""
WITH c AS (SELECT lon, lat, grp, {DECADE} AS decade, {BAND} AS band, edna FROM occurrences) SELECT floor(lon / 10)::INT AS cx, floor(lat / 10)::INT AS cy, count(*) AS n FROM c WHERE grp IN ('A', 'R') AND decade IN (1990, -1) AND band IN (1, 2) AND NOT edna GROUP BY ALL""")
def filtered_facets(spark, d):
    """All facets are asked of one row of the cube, never of different rows of a place."""
    c = R.facet_filter(cube(spark, d), grp=["A", "R"], decade=[1990, -1], depth_band=[1, 2], edna=[False])
    return c.groupBy(geo.degree_cell(F.col("rlon").cast("double"), 10.0).alias("cx"), geo.degree_cell(F.col("rlat").cast("double"), 10.0).alias("cy")).agg(F.sum("n").alias("n"))


@query("F14", "SELECT l_linenumber AS line, CASE WHEN l_suppkey % 7 < 4 THEN (l_suppkey % 10)::INT END AS flag, count(*) AS n FROM lineitem GROUP BY ALL")
def text_flags(spark, d):
    """Flags as '2', ' 2.0', '2.0' with NUL bytes, '2e0', and what is none: '', 'x', '2.5'."""
    v = (F.col("l_suppkey") % 10).cast("string")
    forms = F.array(v, F.concat(F.lit(" "), v, F.lit(".0")), F.concat(v, F.lit(".0\x00\x00")), F.concat(v, F.lit("e0")), F.lit(" \x00"), F.lit("x"), F.concat(v, F.lit(".5")))
    flag = occurrence.flag_number(F.element_at(forms, (F.col("l_suppkey") % 7 + 1).cast("int")))
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("line"), flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("F2 F3 F4 F15 F12", f"""
WITH k AS (SELECT *, ({morton_sql(10)}) AS code, {cell_sql(10)[0]} AS tx, {cell_sql(10)[1]} AS ty FROM occurrences)
SELECT occ_id, CASE WHEN lon >= 180 THEN -180 ELSE round(lon, 6) END::DOUBLE AS folded, round(lon, 6) AS lon, round(greatest(least(lat, 85.0511287798066), -85.0511287798066), 6) AS lat, tx, ty, round_even(lat * 100, 0)::DOUBLE / 100 AS unpacked, TIMESTAMP '1999-12-31 23:59:00' + to_seconds(CASE WHEN l_linenumber = 1 THEN 60 ELSE l_linenumber END::BIGINT) AS at FROM k""")
def inverse_functions(spark, d):
    """There and back: longitudes from 0..360, Mercator, interleaved keys, packed numbers; a 60th second carries."""
    o = table(spark, d, "occurrences")
    lon, lat = geo.inverse_mercator(geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat")))
    tx, ty = geo.deinterleave(geo.morton(F.col("lon"), F.col("lat"), 10), 10)
    from halocline.functions.parse import carried_seconds

    at = carried_seconds(F.lit("1999-12-31 23:59:00").cast("timestamp"), F.when(F.col("l_linenumber") == 1, 60).otherwise(F.col("l_linenumber")))
    return o.select("occ_id", F.round(geo.fold_lon(F.pmod("lon", F.lit(360.0))), 6).alias("folded"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), tx.alias("tx"), ty.alias("ty"), classify.small_int_value(classify.small_int(F.col("lat"), 100), 100).alias("unpacked"), at.cast("timestamp_ntz").alias("at"))
