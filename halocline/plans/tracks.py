"""Queries on tracks, casts and stations: pieces, ordinals, thinning, merging of fragments."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.functions.geo import haversine_km
from halocline.operators import ordered
from halocline.operators import profiles as P
from halocline.plans.book import query
from halocline.plans.standins import table

HAV = "2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians({1} - {3}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * power(sin(radians({0} - {2}) / 2), 2))))"


@query("W7")
def drawn_pieces(spark, d):
    """Pieces of vessel tracks for drawing: a walk in order, tested against plain Python."""
    track = table(spark, d, "positions").select(F.col("mmsi").cast("long").alias("mmsi"), F.col("r_t").alias("t"), "lon", "lat", F.col("sog").alias("value"))
    return P.track_pieces(track, "mmsi", 0.002, gap_s=20 * 86400, jump=3, most=8).select("mmsi", "year", "piece", "n", F.round("mean", 6).alias("mean"), F.size("vertices").alias("vertices"))


@query("W13", """
WITH l AS (SELECT l_orderkey AS cast_id, l_extendedprice AS depth, l_linenumber AS level_no, bool_or(l_discount > 0.07) AS must FROM lineitem GROUP BY ALL), a AS (SELECT *, count(*) OVER c AS n, row_number() OVER (PARTITION BY cast_id ORDER BY depth, level_no) AS up, row_number() OVER (PARTITION BY cast_id ORDER BY depth DESC, level_no DESC) AS down, min(depth) OVER c AS lo, max(depth) OVER c AS hi FROM l WINDOW c AS (PARTITION BY cast_id)),
h AS (SELECT *, n <= 4 OR must OR up = 1 OR down = 1 AS held FROM a), b AS (SELECT cast_id, any_value(lo) AS lo, any_value(hi) AS hi, 4 - count(*) FILTER (held) AS budget FROM h WHERE n > 4 GROUP BY cast_id),
t AS (SELECT cast_id, budget, lo + (hi - lo) * i / (budget + 1) AS target FROM (SELECT *, unnest(range(1, budget + 1)) AS i FROM b WHERE budget > 0)),
p AS (SELECT t.cast_id, l.depth, l.level_no, row_number() OVER (PARTITION BY t.cast_id, target ORDER BY abs(depth - target), depth, l.level_no) AS rn FROM t JOIN l ON l.cast_id = t.cast_id)
SELECT cast_id, depth, level_no FROM h WHERE held UNION SELECT cast_id, depth, level_no FROM p WHERE rn = 1""")
def evenly_thinned_levels(spark, d):
    levels = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cast_id"), F.col("l_extendedprice").alias("depth"), F.col("l_linenumber").alias("level_no"), "l_discount")
    return P.thin_levels(levels, "cast_id", F.col("l_discount") > 0.07, 4).select("cast_id", "depth", "level_no")


@query("W5", "SELECT mmsi, count(*) AS n, max_by(pos_id, (r_t, pos_id)) AS pos_id, max_by(sog, (r_t, pos_id)) AS sog FROM positions GROUP BY mmsi")
def counted_latest(spark, d):
    """The latest row of each vessel beside the number of its rows, in one pass."""
    g = table(spark, d, "positions").groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("r_t", "pos_id", "sog")).alias("r"))
    return g.select("mmsi", "n", "r.pos_id", "r.sog")


def ordinals(spark, d):
    """Positions with their place in the track of their vessel; a track of any length lies in many tasks."""
    return ordered.numbered(table(spark, d, "positions").select("mmsi", F.col("r_t").alias("t"), "lon", "lat", "pos_id"), ["mmsi"], ["t", "lon", "lat", "pos_id"])


@query("W15", "SELECT pos_id, mmsi || '~' || (row_number() OVER (PARTITION BY mmsi ORDER BY r_t, lon, lat, pos_id)) AS key FROM positions")
def observation_keys(spark, d):
    return ordinals(spark, d).select("pos_id", F.concat_ws("~", "mmsi", F.col("pos") + 1).alias("key"))


@query("W17", "SELECT mmsi, pos_id FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY r_t, lon, lat, pos_id) - 1 AS nth FROM positions) WHERE nth % 6 = 0")
def every_sixth_observation(spark, d):
    return ordinals(spark, d).where(F.col("pos") % 6 == 0).select("mmsi", "pos_id")


@query("W16", """
WITH r AS (SELECT mmsi, list(pos_id ORDER BY r_t, pos_id) AS a FROM positions GROUP BY mmsi), k AS (SELECT mmsi, a, len(a) AS n FROM r) SELECT DISTINCT mmsi, a[i * n // 9 + 1] AS pos_id FROM (SELECT *, unnest(range(9)) AS i FROM k WHERE n > 9) UNION ALL SELECT mmsi, unnest(a) FROM k WHERE n <= 9""")
def indexed_subsample(spark, d):
    """Nine rows of each track, at places floor(k total / 9); short tracks whole. The test per row needs no list of places."""
    w = W.partitionBy("mmsi")
    i, n = F.col("i").cast("long"), F.col("n")
    rows = table(spark, d, "positions").withColumn("i", F.row_number().over(w.orderBy("r_t", "pos_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.where((n <= 9) | (F.ceil(i * 9 / n) * n < (i + 1) * 9)).select("mmsi", "pos_id")


@query("W19", """
WITH e AS (SELECT cast_id, unnest([{'level': 'surface', 's': min_by({'d': depth, 'f': flag, 'r': raw}, (depth, raw, flag))}, {'level': 'deep', 's': max_by({'d': depth, 'f': flag, 'r': raw}, (depth, raw, flag))}]) AS x FROM levels GROUP BY cast_id),
v AS (SELECT cast_id, x.level AS level, x.s.d AS depth, unnest([{'p': 'flag', 'v': x.s.f::DOUBLE}, {'p': 'price', 'v': x.s.r}]) AS y FROM e) SELECT cast_id, level, depth, y.p AS parameter, y.v AS value FROM v""")
def long_form_values(spark, d):
    """A row per parameter at the shallowest and the deepest level of a cast."""
    order = F.struct("depth", "raw", "flag")
    values = F.create_map(F.lit("flag"), F.col("flag").cast("double"), F.lit("price"), F.col("raw"))
    level = lambda name, pick, ends: F.struct(F.lit(name).alias("level"), ends("depth").alias("depth"), pick(values, order).alias("values"))
    ends = table(spark, d, "levels").groupBy("cast_id").agg(F.array(level("surface", F.min_by, F.min), level("deep", F.max_by, F.max)).alias("two"))
    return ends.select("cast_id", F.inline("two")).select("cast_id", "level", "depth", F.explode("values").alias("parameter", "value"))


@query("W20", """
WITH p AS (SELECT o_custkey % 200 AS cycle, o_orderkey AS entry, o_orderstatus = 'F' AS drawable, o_orderkey % 4 AS good, o_custkey % 3 AS levels FROM orders)
SELECT cycle, min_by(entry, (NOT drawable, -good, -levels, entry)) AS kept, count(*) - 1 AS losers FROM p GROUP BY cycle""")
def preferred_profiles(spark, d):
    """Of profiles under one key the drawable one, then the one with more good levels, then more levels; ties keep the first."""
    p = table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("cycle"), F.col("o_orderkey").alias("entry"), (F.col("o_orderstatus") != "F").alias("hidden"), (-(F.col("o_orderkey") % 4)).alias("good"), (-(F.col("o_custkey") % 3)).alias("levels"))
    return p.groupBy("cycle").agg(F.min(F.struct("hidden", "good", "levels", "entry"))["entry"].alias("kept"), (F.count(F.lit(1)) - 1).alias("losers"))


@query("A40", "SELECT o_custkey % 300 AS station, min_by(o_totalprice, o_orderkey) AS value, min(o_orderkey) AS row_no, max(o_orderdate) AS newest FROM orders GROUP BY ALL")
def first_rows(spark, d):
    """What the first row of a station says stands for it; other columns are aggregated."""
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 300).alias("station")).agg(F.min_by("o_totalprice", "o_orderkey").alias("value"), F.min("o_orderkey").alias("row_no"), F.max("o_orderdate").alias("newest"))


@query("A53 A54", """
WITH c AS (SELECT o.o_custkey AS cruise, o.o_orderkey AS cast_id, o.o_orderdate AS seen, min(l.l_linenumber) AS lo, max(l.l_linenumber) AS hi, bool_or(l.l_linenumber % 3 + 2 = 2) AS good, (o.o_custkey % 360 - 180)::DOUBLE + o.o_orderkey % 10 / 100.0 AS lon FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, o.o_orderkey, o.o_orderdate)
SELECT cruise, count(*) AS casts, min(lo) * 50.0::DOUBLE AS min_depth, max(hi) * 50.0::DOUBLE AS max_depth, bool_or(good) AS any_good, min(seen) AS first_at, max(seen) AS last_at, round(min_by(lon, (seen, cast_id)), 4)::DOUBLE AS first_lon FROM c GROUP BY cruise""")
def cruise_profiles(spark, d):
    """Casts with arrays of depths and flags, folded by cruise: depth range, whether any flag is good, first and last day, and
    where the first cast was."""
    levels = table(spark, d, "levels").groupBy("cast_id").agg(F.collect_list("depth").alias("depths"), F.collect_list("flag").alias("flags"))
    casts = table(spark, d, "orders").select(F.col("o_orderkey").alias("cast_id"), F.col("o_custkey").alias("cruise"), F.col("o_orderdate").alias("at"), ((F.col("o_custkey") % 360 - 180).cast("double") + F.col("o_orderkey") % 10 / 100).alias("lon")).join(levels, "cast_id")
    first = F.min(F.struct("at", "cast_id", "lon"))["lon"]
    return casts.groupBy("cruise").agg(F.count(F.lit(1)).alias("casts"), F.min(F.array_min("depths")).alias("min_depth"), F.max(F.array_max("depths")).alias("max_depth"), F.bool_or(F.array_contains("flags", F.lit(2).cast("int"))).alias("any_good"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.round(first, 4).alias("first_lon"))


@query("A55", f"""
WITH b AS (SELECT o_custkey % 90 AS station, CASE WHEN o_orderkey % 5 < 2 THEN 'nc' ELSE (o_orderkey % 5)::VARCHAR END AS cast_no, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 7 * 100)::DOUBLE END AS depth, o_totalprice AS value, o_custkey % 90 / 100.0::DOUBLE AS lon, o_orderkey % 3 / 100.0::DOUBLE AS lat FROM orders),
k AS (SELECT station, cast_no, count(*) FILTER (depth IS NULL) AS no_depth, count(depth) AS levels, count(depth) - count(DISTINCT depth) AS repeated, avg(lon) FILTER (depth IS NOT NULL) AS mlon, avg(lat) FILTER (depth IS NOT NULL) AS mlat, string_agg(depth::INT, ',' ORDER BY depth) FILTER (depth IS NOT NULL) AS depths FROM b GROUP BY ALL HAVING count(depth) > 0)
SELECT k.station, k.cast_no, any_value(no_depth) AS no_depth, any_value(levels) AS levels, any_value(repeated) AS repeated, any_value(depths) AS depths, round(max({HAV.format('b.lon', 'b.lat', 'mlon', 'mlat')}), 4) AS spread_km FROM k JOIN b ON b.station = k.station AND b.cast_no = k.cast_no AND b.depth IS NOT NULL GROUP BY ALL""")
def bottle_casts(spark, d):
    """Bottles to casts: a missing number is a group of its own, bottles without depth are counted and left out, and the spread
    is the distance of the farthest bottle from the mean place."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 90).alias("station"), F.when(F.col("o_orderkey") % 5 >= 2, (F.col("o_orderkey") % 5).cast("string")).alias("cast_no"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 7 * 100).cast("double")).alias("depth"), (F.col("o_custkey") % 90 / 100).alias("lon"), (F.col("o_orderkey") % 3 / 100).alias("lat"))
    return P.bottle_casts(o.withColumn("cast_no", F.coalesce("cast_no", F.lit("nc"))), ["station", "cast_no"]).select("station", "cast_no", "no_depth", "levels", "repeated", F.array_join(F.transform("depths", lambda x: x.cast("int").cast("string")), ",").alias("depths"), F.round("spread_km", 4).alias("spread_km"))


@query("A29", """
WITH s AS (SELECT o_custkey % 120 AS station, o_orderdate AS seen, o_orderkey % 40 * 25 AS depth, CASE o_orderkey % 3 WHEN 0 THEN 'Fe' WHEN 1 THEN 'Zn' ELSE 'Cd' END AS metal, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders)
SELECT station, min(seen) AS first_at, min(depth) AS min_depth, max(depth) AS max_depth, count(value) FILTER (metal = 'Fe') > 0 AS has_fe, max(value) FILTER (metal = 'Fe') AS max_fe, count(value) FILTER (metal = 'Zn') > 0 AS has_zn, max(value) FILTER (metal = 'Zn') AS max_zn FROM s GROUP BY station""")
def station_metals(spark, d):
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select((F.col("o_custkey") % 120).alias("station"), F.col("o_orderdate").alias("at"), (k % 40 * 25).alias("depth"), F.when(k % 3 == 0, "Fe").when(k % 3 == 1, "Zn").otherwise("Cd").alias("metal"), F.when(k % 4 != 0, F.col("o_totalprice")).alias("value"))
    top = {m: F.max(F.when(F.col("metal") == m, F.col("value"))) for m in ("Fe", "Zn")}
    return s.groupBy("station").agg(F.min("at").alias("first_at"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), *[x for m, v in top.items() for x in (v.isNotNull().alias(f"has_{m.lower()}"), v.alias(f"max_{m.lower()}"))])


@query("A30", """
WITH f AS (SELECT o_custkey % 500 AS sample, o_custkey % 25 AS core, o_orderkey AS row_no, (o_custkey % 500) // 25 * 2 AS depth, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS toc, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS d13c FROM orders),
m AS (SELECT sample, any_value(core) AS core, any_value(depth) AS depth, min_by(toc, row_no) FILTER (toc IS NOT NULL) AS toc, min_by(d13c, row_no) FILTER (d13c IS NOT NULL) AS d13c FROM f GROUP BY sample)
SELECT core, count(*) AS samples, min_by(toc, (depth, sample)) FILTER (toc IS NOT NULL) AS top_toc, min_by(d13c, (depth, sample)) FILTER (d13c IS NOT NULL) AS top_d13c FROM m GROUP BY core""")
def merged_cores(spark, d):
    """Fragments of one analysis each, merged by sample (the first value given stays), then the shallowest value by core."""
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("sample"), k.alias("row_no"), F.when(k % 3 == 0, F.col("o_totalprice")).alias("toc"), F.when(k % 3 == 1, F.col("o_totalprice")).alias("d13c"))
    merged = P.merge_fragments(f, "sample", "row_no", ["toc", "d13c"]).withColumn("core", F.col("sample") % 25).withColumn("depth", F.floor(F.col("sample") / 25) * 2)
    at = F.struct("depth", "sample")
    top = lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), at)).alias(f"top_{v}")
    return merged.groupBy("core").agg(F.count(F.lit(1)).alias("samples"), top("toc"), top("d13c"))


@query("A31", """
WITH s AS (SELECT CASE WHEN o_custkey % 4 = 0 THEN 'st' || (o_custkey % 40) WHEN o_custkey % 4 = 1 THEN 'ev' || (o_custkey % 30) ELSE 'p' || (o_custkey % 360 - 180) || '_' || (o_custkey % 120 - 60) END AS station, (o_custkey % 360 - 180)::DOUBLE AS lon, (o_custkey % 120 - 60)::DOUBLE AS lat, 'Taxon ' || (o_orderkey % 13) AS taxon, o_orderkey % 5 AS horizon FROM orders),
t AS (SELECT station, taxon, count(*) AS n, row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, taxon) AS rn FROM s GROUP BY station, taxon), p AS (SELECT station, string_agg(taxon || ' (' || n || ')', '; ' ORDER BY rn) AS taxa FROM t WHERE rn <= 3 GROUP BY station)
SELECT s.station, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) AS records, any_value(p.taxa) AS taxa, array_to_string(list_sort(list(DISTINCT horizon)), ',') AS horizons FROM s JOIN p ON p.station = s.station GROUP BY s.station""")
def stations_of_records(spark, d):
    """Records to stations: the key is the station id, else the event, else the place; the commonest taxa with their counts."""
    c = F.col("o_custkey")
    lon, lat = (c % 360 - 180).cast("double"), (c % 120 - 60).cast("double")
    ids = F.when(c % 4 == 0, F.concat(F.lit("station:st"), c % 40)), F.when(c % 4 == 1, F.concat(F.lit("EVENT=ev"), c % 30))
    key = F.coalesce(F.nullif(F.regexp_extract(ids[0], r"^station:(\w+)$", 1), F.lit("")), F.nullif(F.regexp_extract(ids[1], r"^EVENT=(\w+)$", 1), F.lit("")), F.concat(F.lit("p"), c % 360 - 180, F.lit("_"), c % 120 - 60))
    s = table(spark, d, "orders").select(key.alias("station"), lon.alias("lon"), lat.alias("lat"), F.concat(F.lit("Taxon "), F.col("o_orderkey") % 13).alias("taxon"), (F.col("o_orderkey") % 5).alias("horizon"))
    best = P.top_labels(s, "station", "taxon", 3).select(F.col("station").alias("t_station"), "taxa")
    g = s.groupBy("station").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.count(F.lit(1)).alias("records"), F.array_join(F.array_sort(F.collect_set("horizon")).cast("array<string>"), ",").alias("horizons"))
    return g.join(best, F.col("station") == F.col("t_station")).drop("t_station")


@query("A51", f"""
WITH r AS (SELECT o_custkey % 60 AS site, o_custkey % 180 AS platform, o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey % 60 * 3 - 90 + o_custkey % 180 // 60 * CASE WHEN o_custkey % 60 < 20 THEN 2 ELSE 0.1 END + o_orderkey % 4 / 100.0 END::DOUBLE AS lon, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_custkey % 60 - 30)::DOUBLE END AS lat FROM orders),
k AS (SELECT site, platform, lon, lat FROM r WHERE lat IS NOT NULL), m AS (SELECT site, platform, median(lon) AS mlon, median(lat) AS mlat FROM k GROUP BY ALL UNION ALL SELECT site, -1, median(lon), median(lat) FROM k GROUP BY site),
g AS (SELECT m.site, m.platform, any_value(mlon) AS mlon, any_value(mlat) AS mlat FROM m JOIN k ON k.site = m.site AND (m.platform = -1 OR k.platform = m.platform) GROUP BY m.site, m.platform HAVING count(*) FILTER ({HAV.format('k.lon', 'k.lat', 'm.mlon', 'm.mlat')} <= 50) >= 0.9 * count(*))
SELECT r.id, CASE WHEN r.lat IS NOT NULL THEN 'measured' WHEN p.site IS NOT NULL THEN 'platform' WHEN s.site IS NOT NULL THEN 'site' END AS source, round(coalesce(r.lon, p.mlon, s.mlon), 4) AS lon FROM r LEFT JOIN g p ON p.site = r.site AND p.platform = r.platform LEFT JOIN g s ON s.site = r.site AND s.platform = -1""")
def borrowed_positions(spark, d):
    """Rows without a place take the median of their platform, else of their site, if the places there agree."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    lon = c % 60 * 3 - 90 + F.floor(c % 180 / 60) * F.when(c % 60 < 20, 2.0).otherwise(0.1) + k % 4 / 100
    r = table(spark, d, "orders").select((c % 60).alias("site"), (c % 180).alias("platform"), k.alias("id"), F.when(k % 6 != 0, lon).alias("lon"), F.when(k % 6 != 0, (c % 60 - 30).cast("double")).alias("lat"))
    by_platform = P.median_position(r, ["site", "platform"]).select(F.col("site").alias("p_site"), F.col("platform").alias("p_platform"), F.col("lon").alias("p_lon"))
    by_site = P.median_position(r, ["site"]).select(F.col("site").alias("s_site"), F.col("lon").alias("s_lon"))
    out = r.join(by_platform, (F.col("site") == F.col("p_site")) & (F.col("platform") == F.col("p_platform")), "left").join(by_site, F.col("site") == F.col("s_site"), "left")
    source = F.when(F.col("lat").isNotNull(), "measured").when(F.col("p_site").isNotNull(), "platform").when(F.col("s_site").isNotNull(), "site")
    return out.select("id", source.alias("source"), F.round(F.coalesce("lon", "p_lon", "s_lon"), 4).alias("lon"))
