"""Queries on spatial joins, each with DuckDB SQL that compares naively."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.functions import geo
from halocline.operators import spatial as S
from halocline.plans.book import query
from halocline.plans.standins import table, zones

KM = "2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}lon) / 2), 2))))"
AB = KM.format(a="a.", b="b.")
IN = "p.lon BETWEEN z.mx - z.half AND z.mx + z.half AND p.lat BETWEEN z.my - z.half AND z.my + z.half"
#: Distance to a box on the plane scaled at the point's latitude.
BOX_KM = "sqrt(power(greatest(abs(p.lon - z.mx) - z.half, 0) * cos(radians(p.lat)), 2) + power(greatest(abs(p.lat - z.my) - z.half, 0), 2)) * (pi() * 6371.0 / 180)"


@query("J11 J12 J13 J14", f"""
WITH m AS (SELECT det_id, mmsi, abs(t - r_t) AS gap, row_number() OVER (PARTITION BY det_id ORDER BY round({AB}, 9), mmsi, r_t) AS rn FROM detections a JOIN positions b ON abs(t - r_t) <= 600 AND {AB} <= 0.5),
h AS (SELECT det_id, count(DISTINCT mmsi) AS n FROM detections a JOIN positions b ON abs(t - r_t) <= 3600 AND {AB} <= 50 GROUP BY det_id)
SELECT d.det_id, CASE WHEN m.det_id IS NOT NULL THEN 'matched' WHEN coalesce(h.n, 0) >= 1 THEN 'dark' ELSE 'ambiguous' END AS class, m.mmsi, m.gap AS gap_s, CASE WHEN m.det_id IS NULL THEN coalesce(h.n, 0) END AS neighbours
FROM detections d LEFT JOIN m ON m.det_id = d.det_id AND m.rn = 1 LEFT JOIN h ON h.det_id = d.det_id""")
def vessel_match(spark, d):
    return S.match_detections(table(spark, d, "detections").select("det_id", "t", "lon", "lat"), table(spark, d, "positions").select("mmsi", "r_t", "lon", "lat"))


@query("J1 J21 J28", f"SELECT p.pos_id, count(z.zone_id) AS zones, min_by(z.zone_id, z.half) AS smallest FROM positions p LEFT JOIN boxes z ON {IN} GROUP BY p.pos_id")
def point_in_zone(spark, d):
    pos, z = table(spark, d, "positions").select("pos_id", "lon", "lat"), zones(spark, d)
    held = S.point_in_zone(pos, z).groupBy("pos_id").agg(F.count("zone_id").alias("zones"), F.min_by("zone_id", F.col("x1") - F.col("x0")).alias("smallest"))
    return pos.select("pos_id").join(held, "pos_id", "left").select("pos_id", F.coalesce("zones", F.lit(0)).alias("zones"), "smallest")


@query("J2 A12", f"""
WITH i AS (SELECT p.mmsi, p.r_t, z.zone_name FROM positions p JOIN boxes z ON {IN})
SELECT mmsi, min(r_t) AS first_seen, max(r_t) AS last_seen, max_by(zone_name, (r_t, zone_name)) AS last_zone FROM i GROUP BY mmsi HAVING max(r_t) - min(r_t) > 86400""")
def loiter(spark, d):
    held = S.point_in_zone(table(spark, d, "positions").select("mmsi", "r_t", "lon", "lat"), zones(spark, d))
    seen = held.groupBy("mmsi").agg(F.min("r_t").alias("first_seen"), F.max("r_t").alias("last_seen"), F.max_by("zone_name", F.struct("r_t", "zone_name")).alias("last_zone"))
    return seen.where(F.col("last_seen") - F.col("first_seen") > 86400)


@query("J3", f"SELECT z.zone_id, EXISTS (SELECT 1 FROM detections p WHERE {IN}) AS has_detection FROM boxes z")
def zone_has_detection(spark, d):
    z = zones(spark, d)
    hit = S.point_in_zone(table(spark, d, "detections").select("lon", "lat"), z).select(F.col("zone_id").alias("hit_id")).distinct()
    return z.join(hit, F.col("zone_id") == F.col("hit_id"), "left").select("zone_id", F.col("hit_id").isNotNull().alias("has_detection"))


@query("", """
SELECT a.zone_id AS zone_a, b.zone_id AS zone_b, abs(a.mx - b.mx) + a.half <= b.half AND abs(a.my - b.my) + a.half <= b.half AS inside
FROM boxes a JOIN boxes b ON a.zone_id <> b.zone_id AND abs(a.mx - b.mx) <= a.half + b.half AND abs(a.my - b.my) <= a.half + b.half""")
def zone_overlap(spark, d):
    cells = S.zone_cells(zones(spark, d).drop("ring"))
    b = cells.select(*[F.col(c).alias(f"b_{c}") for c in cells.columns])
    meet = (F.col("x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("x1")) & (F.col("y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("y1"))
    pairs = cells.join(b, (F.col("zx") == F.col("b_zx")) & (F.col("zy") == F.col("b_zy")) & (F.col("zone_id") != F.col("b_zone_id"))).where(meet)
    inside = (F.col("x0") >= F.col("b_x0")) & (F.col("x1") <= F.col("b_x1")) & (F.col("y0") >= F.col("b_y0")) & (F.col("y1") <= F.col("b_y1"))
    return pairs.select(F.col("zone_id").alias("zone_a"), F.col("b_zone_id").alias("zone_b"), inside.alias("inside")).distinct()


@query("J5", f"""
SELECT a.det_id, count(b.pos_id) FILTER (WHERE {AB} <= 0.4) AS within_400m, count(b.pos_id) FILTER (WHERE {AB} <= 0.8 AND b.sog > 50) AS fast_within_800m, round(coalesce(max({AB}) FILTER (WHERE {AB} <= 0.8), 0), 6) AS farthest_km
FROM detections a LEFT JOIN positions b ON b.lon BETWEEN a.lon - 1 AND a.lon + 1 AND b.lat BETWEEN a.lat - 1 AND a.lat + 1 GROUP BY a.det_id""")
def multi_radius_counts(spark, d):
    det, pos = table(spark, d, "detections").select("det_id", "lon", "lat"), table(spark, d, "positions")
    # Positions are counted per place first, so a busy place is one row of the join.
    places = pos.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sog") > 50).alias("fast"))
    pairs = S.within_distance(det, places, 0.8).groupBy("det_id").agg(F.sum(F.when(F.col("km") <= 0.4, F.col("n"))).alias("a"), F.sum("fast").alias("b"), F.max("km").alias("km"))
    zero = F.lit(0)
    return det.select("det_id").join(pairs, "det_id", "left").select("det_id", F.coalesce("a", zero).alias("within_400m"), F.coalesce("b", zero).alias("fast_within_800m"), F.round(F.coalesce("km", F.lit(0.0)), 6).alias("farthest_km"))


def site(key):
    """Stand-in coordinates from a key: two expressions of either SQL."""
    return f"CAST({key} % 360 - 180 AS DOUBLE) AS lon", f"CAST({key} % 120 - 60 AS DOUBLE) AS lat"


@query("J7", f"""
WITH c AS (SELECT c_custkey AS site, {', '.join(site('c_custkey'))} FROM customer), s AS (SELECT DISTINCT lon, lat FROM c),
v AS (SELECT {', '.join(site('(s_suppkey * 7)'))}, s_acctbal FROM supplier), f AS (SELECT {', '.join(site('(o_custkey * 5)'))}, o_custkey, o_orderdate FROM orders),
n1 AS (SELECT a.lon, a.lat, count(*) AS n FROM s a JOIN v b ON {AB} <= 50 GROUP BY ALL), n2 AS (SELECT a.lon, a.lat, count(*) AS n FROM s a JOIN occurrences b ON abs(a.lat - b.lat) < 1 AND {AB} <= 10 GROUP BY ALL),
n3 AS (SELECT a.lon, a.lat, count(DISTINCT o_custkey) AS n FROM s a JOIN f b ON abs(a.lat - b.lat) < 3 AND o_orderdate >= DATE '1998-05-01' AND {AB} <= 200 GROUP BY ALL),
n4 AS (SELECT a.lon, a.lat, count(*) AS n FROM s a JOIN v b ON s_acctbal > 0 AND {AB} <= 200 GROUP BY ALL), n5 AS (SELECT a.lon, a.lat, count(*) AS n FROM s a JOIN occurrences b ON abs(a.lat - b.lat) < 6 AND edna AND {AB} <= 500 GROUP BY ALL)
SELECT site, coalesce(n1.n, 0)::BIGINT AS vents_50km, coalesce(n2.n, 0)::BIGINT AS finds_10km, coalesce(n3.n, 0)::BIGINT AS floats_200km, coalesce(n4.n, 0)::BIGINT AS sensors_200km, coalesce(n5.n, 0)::BIGINT AS edna_500km
FROM c LEFT JOIN n1 USING (lon, lat) LEFT JOIN n2 USING (lon, lat) LEFT JOIN n3 USING (lon, lat) LEFT JOIN n4 USING (lon, lat) LEFT JOIN n5 USING (lon, lat)""")
def site_surroundings(spark, d):
    """Five targets around every site, each with its radius and its filter; floats are counted once each."""
    sites = table(spark, d, "customer").selectExpr("c_custkey AS site", *site("c_custkey"))
    vents = table(spark, d, "supplier").selectExpr(*site("(s_suppkey * 7)"), "s_acctbal")
    floats = table(spark, d, "orders").where("o_orderdate >= DATE '1998-05-01'").selectExpr(*site("(o_custkey * 5)"), "o_custkey")
    finds = table(spark, d, "occurrences")
    targets = {"vents_50km": (vents, 50.0, None), "finds_10km": (finds, 10.0, None), "floats_200km": (floats, 200.0, "o_custkey"), "sensors_200km": (vents.where("s_acctbal > 0"), 200.0, None), "edna_500km": (finds.where("edna"), 500.0, None)}
    return S.counts_near(sites, targets).select("site", *targets)


@query("J6 J9", f"""
WITH k AS (SELECT DISTINCT p.lon, p.lat, z.zone_id, z.zone_name, {BOX_KM} AS km FROM detections p JOIN boxes z ON abs(p.lat - z.my) < 1 AND abs(p.lon - z.mx) < 1 WHERE {BOX_KM} <= 0.5)
SELECT round(lon, 3) AS rlon, round(lat, 3) AS rlat, count(*) AS zones, min_by(zone_id, (round(km, 9), zone_id)) AS nearest, round(min(km), 6) AS km, string_agg(zone_id::VARCHAR, ',' ORDER BY zone_id) AS all_zones FROM k GROUP BY lon, lat""")
def zones_near_points(spark, d):
    points = table(spark, d, "detections").select("lon", "lat").distinct()
    near = S.near_zone(points, zones(spark, d), 0.5)
    ids = F.array_join(F.array_sort(F.collect_list("zone_id")).cast("array<string>"), ",")
    return near.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("zones"), F.min_by("zone_id", F.struct(F.round("km", 9), "zone_id")).alias("nearest"), F.round(F.min("km"), 6).alias("km"), ids.alias("all_zones")).select(F.round("lon", 3).alias("rlon"), F.round("lat", 3).alias("rlat"), "zones", "nearest", "km", "all_zones")


@query("", f"""
WITH p AS (SELECT DISTINCT grp AS src, lon, lat FROM occurrences), z AS (SELECT zone_id, mx AS lon, my AS lat FROM boxes),
k AS (SELECT a.zone_id, b.src, {AB} AS km FROM z a JOIN p b ON true)
SELECT zone_id, src, round(min(km), 1) AS km FROM k GROUP BY zone_id, src HAVING min(km) <= 500""")
def nearest_per_source(spark, d):
    """Within 500 km only; nearest_of_every_source has no radius."""
    centres = table(spark, d, "boxes").select("zone_id", F.col("mx").alias("lon"), F.col("my").alias("lat"))
    points = table(spark, d, "occurrences").select(F.col("grp").alias("src"), "lon", "lat").distinct()
    near = S.within_distance(centres, points, 500.0)
    return near.groupBy("zone_id", "src").agg(F.round(F.min("km"), 1).alias("km"))


@query("J10", f"""
WITH p AS (SELECT DISTINCT grp AS src, lon, lat FROM occurrences UNION ALL SELECT 'far' AS src, CAST(179.5 AS DOUBLE) AS lon, CAST(-80 AS DOUBLE) AS lat),
z AS (SELECT zone_id, mx AS lon, my AS lat FROM boxes), k AS (SELECT a.zone_id, b.src, {AB} AS km FROM z a JOIN p b ON true)
SELECT zone_id, src, round(min(km), 1) AS km FROM k GROUP BY zone_id, src""")
def nearest_of_every_source(spark, d):
    """The nearest place of every source, however far; a source of one remote place is added."""
    centres = table(spark, d, "boxes").select("zone_id", F.col("mx").alias("lon"), F.col("my").alias("lat"))
    points = table(spark, d, "occurrences").select(F.col("grp").alias("src"), "lon", "lat", F.col("occ_id").cast("long").alias("place"))
    far = spark.range(1).select(F.lit("far").alias("src"), F.lit(179.5).alias("lon"), F.lit(-80.0).alias("lat"), F.lit(0).cast("long").alias("place"))
    return S.nearest_of_each(centres, points.unionByName(far), "zone_id", "src", "place").select("zone_id", "src", F.round("km", 1).alias("km"))


@query("J8", f"""
WITH z AS (SELECT zone_id, mx AS lon, my AS lat FROM boxes WHERE zone_id % 5 = 1)
SELECT a.det_id, min_by(b.zone_id, (round({AB}, 6), b.zone_id)) AS zone_id, round(min({AB}), 6) AS km FROM detections a JOIN z b ON true GROUP BY a.det_id""")
def nearest_zone(spark, d):
    """The zone with the nearest centre for every detection, however far, ties by id."""
    det = table(spark, d, "detections").select("det_id", "lon", "lat")
    places = det.groupBy("lon", "lat").agg(F.min("det_id").alias("first"))
    z = table(spark, d, "boxes").where("zone_id % 5 = 1").select(F.lit(1).alias("all"), "zone_id", F.col("mx").alias("lon"), F.col("my").alias("lat"))
    near = S.nearest_of_each(places, z, "first", "all", "zone_id").join(places.withColumnsRenamed({"lon": "p_lon", "lat": "p_lat"}), "first")
    return det.join(near, (F.col("lon") == F.col("p_lon")) & (F.col("lat") == F.col("p_lat"))).select("det_id", "zone_id", F.round("km", 6).alias("km"))


@query("J23", f"""
WITH k AS (SELECT a.det_id, b.pos_id, {AB} AS km FROM detections a JOIN positions b ON a.t // 3600 = b.r_t // 3600 AND {AB} <= 5),
l AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY round(km, 9), pos_id) AS rn FROM k)
SELECT pos_id, min_by(det_id, (round(km, 9), det_id)) AS det_id FROM l WHERE rn = 1 GROUP BY pos_id""")
def one_claim_per_target(spark, d):
    """Every detection claims the nearest position of its hour. Detections at one place in one hour claim the same one, and of
    positions there the least id is nearest, so a place and hour is one row on each side of the join."""
    det = table(spark, d, "detections").select("det_id", F.floor(F.col("t") / 3600).alias("hour"), "lon", "lat")
    pos = table(spark, d, "positions").select("pos_id", F.floor(F.col("r_t") / 3600).alias("r_hour"), "lon", "lat")
    det = det.groupBy("hour", "lon", "lat").agg(F.min("det_id").alias("det_id"))
    pos = pos.groupBy("r_hour", "lon", "lat").agg(F.min("pos_id").alias("pos_id"))
    pairs = S.within_distance(det, pos, 5.0, {"hour": "r_hour"})
    best = S.nearest(pairs, ["det_id"], "pos_id")
    return best.groupBy("pos_id").agg(F.min_by("det_id", F.struct(F.round("km", 9), "det_id")).alias("det_id"))


@query("", """
WITH w AS (SELECT mmsi, lon, lat, lag(lon) OVER w AS x, lag(lat) OVER w AS y FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY r_t, pos_id))
SELECT z.zone_id, count(DISTINCT w.mmsi) AS vessels FROM w JOIN boxes z ON w.x IS NOT NULL AND abs(w.x - w.lon) <= 1
  AND greatest(w.x, w.lon) >= z.mx - z.half AND least(w.x, w.lon) <= z.mx + z.half AND greatest(w.y, w.lat) >= z.my - z.half AND least(w.y, w.lat) <= z.my + z.half
  AND NOT (((z.mx - z.half - w.x) * (w.lat - w.y) - (z.my - z.half - w.y) * (w.lon - w.x) > 0 AND (z.mx + z.half - w.x) * (w.lat - w.y) - (z.my - z.half - w.y) * (w.lon - w.x) > 0 AND (z.mx - z.half - w.x) * (w.lat - w.y) - (z.my + z.half - w.y) * (w.lon - w.x) > 0 AND (z.mx + z.half - w.x) * (w.lat - w.y) - (z.my + z.half - w.y) * (w.lon - w.x) > 0)
  OR ((z.mx - z.half - w.x) * (w.lat - w.y) - (z.my - z.half - w.y) * (w.lon - w.x) < 0 AND (z.mx + z.half - w.x) * (w.lat - w.y) - (z.my - z.half - w.y) * (w.lon - w.x) < 0 AND (z.mx - z.half - w.x) * (w.lat - w.y) - (z.my + z.half - w.y) * (w.lon - w.x) < 0 AND (z.mx + z.half - w.x) * (w.lat - w.y) - (z.my + z.half - w.y) * (w.lon - w.x) < 0))
GROUP BY z.zone_id""")
def paths_crossing_zones(spark, d):
    """Vessels with a step between positions that meets a zone: boxes overlap, and the corners are not all on one side."""
    w = W.partitionBy("mmsi").orderBy("r_t", "pos_id")
    steps = table(spark, d, "positions").withColumn("x", F.lag("lon").over(w)).withColumn("y", F.lag("lat").over(w)).where("x IS NOT NULL AND abs(x - lon) <= 1")
    steps = steps.select("mmsi", "lon", "lat", "x", "y").distinct()
    xs = F.sequence(F.floor(F.least("x", "lon")), F.floor(F.greatest("x", "lon")))
    steps = steps.withColumn("sx", F.explode(xs)).withColumn("sy", F.explode(F.sequence(F.floor(F.least("y", "lat")), F.floor(F.greatest("y", "lat")))))
    pairs = steps.join(S.zone_cells(zones(spark, d)), (F.col("sx") == F.col("zx")) & (F.col("sy") == F.col("zy")))
    side = [(F.col(a) - F.col("x")) * (F.col("lat") - F.col("y")) - (F.col(b) - F.col("y")) * (F.col("lon") - F.col("x")) for a in ("x0", "x1") for b in ("y0", "y1")]
    meets = (F.greatest("x", "lon") >= F.col("x0")) & (F.least("x", "lon") <= F.col("x1")) & (F.greatest("y", "lat") >= F.col("y0")) & (F.least("y", "lat") <= F.col("y1"))
    return pairs.where(meets & ~((F.least(*side) > 0) | (F.greatest(*side) < 0))).groupBy("zone_id").agg(F.count_distinct("mmsi").alias("vessels"))


@query("J24", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY r_t DESC, pos_id DESC) AS rn FROM positions)
SELECT r.mmsi, r.pos_id, c.c_name AS name FROM r LEFT JOIN customer c ON c.c_custkey = r.mmsi WHERE rn = 1""")
def latest_with_identity(spark, d):
    last = table(spark, d, "positions").groupBy("mmsi").agg(F.max(F.struct("r_t", "pos_id")).alias("p"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return last.join(names, F.col("mmsi") == F.col("id"), "left").select("mmsi", "p.pos_id", "name")


@query("P15 O2", """
WITH k AS (SELECT occ_id, lon, lat FROM occurrences WHERE lon BETWEEN -20 AND 20 AND lat BETWEEN -10 AND 30), r AS (SELECT *, row_number() OVER (ORDER BY occ_id) AS rn FROM k)
SELECT occ_id, round(lon, 6) AS lon, round(lat, 6) AS lat, (SELECT count(*) FROM k) > 500 AS capped FROM r WHERE rn <= 500""")
def area_export(spark, d):
    """Rows in a box, capped with a flag, by the box and the Morton range of the tiles over it, in one pass: the row behind the
    cap tells whether there are more."""
    rows = table(spark, d, "occurrences").select("occ_id", "lon", "lat")
    ranges = [geo.tile_key_range(3, x, y) for x in range(3, 5) for y in range(3, 5)]
    key = geo.morton(F.col("lon"), F.col("lat"))
    near = F.lit(False)
    for lo, hi in ranges:
        near = near | ((key >= lo) & (key < hi))
    # The box is two comparisons, the key many steps, so it is made for rows in the box only.
    part = rows.where(F.col("lon").between(-20, 20) & F.col("lat").between(-10, 30)).where(near)
    top = part.orderBy("occ_id").limit(501).withColumn("place", F.row_number().over(W.orderBy("occ_id"))).withColumn("total", F.count(F.lit(1)).over(W.partitionBy()))
    return top.where("place <= 500").select("occ_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), (F.col("total") > 500).alias("capped"))


#: Zones of suppliers: a box with a hole, and (but for the first, which is nearly the world) a second box 30 degrees
#: east, which runs on over the date line for some. Edges lie
#: between the places of occurrences.
HOLED = """SELECT s_suppkey AS zone_id, CAST(s_suppkey * 37 % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) + CAST(5 AS DOUBLE) / CAST(100 AS DOUBLE) AS mx, CAST(s_suppkey * 53 % 1200 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(60 AS DOUBLE) + CAST(5 AS DOUBLE) / CAST(100 AS DOUBLE) AS my,
  CASE WHEN s_suppkey = 1 THEN CAST(170 AS DOUBLE) ELSE CAST(1 + s_suppkey % 5 * 2 AS DOUBLE) END AS half, CASE WHEN s_suppkey = 1 THEN CAST(80 AS DOUBLE) ELSE CAST(1 + s_suppkey % 5 * 2 AS DOUBLE) END AS tall FROM supplier"""


def holed_zones(spark, d):
    box = lambda x, half, tall: F.array(*[F.struct((x + i * half).alias("x"), (F.col("my") + j * tall).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    mx, half, tall = F.col("mx"), F.col("half"), F.col("tall")
    z = spark.sql(HOLED.replace("FROM supplier", "FROM {src}"), src=table(spark, d, "supplier"))
    z = z.withColumn("my", F.when(F.col("zone_id") == 1, 0.05).otherwise(F.col("my"))).withColumn("mx", F.when(F.col("zone_id") == 1, 0.05).otherwise(mx))
    holed = F.array(box(mx, half, tall), box(mx, half / 2, tall / 2))
    rings = F.when(F.col("zone_id") == 1, holed).otherwise(F.concat(holed, F.array(box(mx + 2 * half + 30, half, tall))))
    return z.select("zone_id", rings.alias("rings"), (half * tall).alias("extent"))


@query("J1 J2 J21", f"""
WITH h AS (SELECT * REPLACE (CASE WHEN zone_id = 1 THEN 0.05 ELSE mx END AS mx, CASE WHEN zone_id = 1 THEN 0.05 ELSE my END AS my) FROM ({HOLED})),
p AS (SELECT zone_id, half * tall AS extent, mx AS x, my, half, tall, half / 2 AS hole, tall / 2 AS low FROM h UNION ALL SELECT zone_id, half * tall, mx + 2 * half + 30, my, half, tall, -1, -1 FROM h WHERE zone_id <> 1),
o AS (SELECT *, lon + 360 * t AS at FROM occurrences, (SELECT unnest([-1, 0, 1]) AS t)),
m AS (SELECT DISTINCT o.occ_id, o.lon, o.lat, p.zone_id, extent FROM o JOIN p ON abs(o.at - p.x) < p.half AND abs(o.lat - p.my) < p.tall AND NOT (abs(o.at - p.x) < p.hole AND abs(o.lat - p.my) < p.low))
SELECT occ_id, lon, lat, count(*) AS zones, arg_min(zone_id, (extent, zone_id)) AS smallest FROM m GROUP BY occ_id, lon, lat""")
def points_in_holed_zones(spark, d):
    """Zones with holes, two parts and the date line, one of them nearly as large as the world: how many hold a point, and the smallest."""
    from halocline.operators import zones as Z
    from halocline.operators.ordered import numbered
    from halocline.sources import scratch

    # Zones by extent, then id: the least number among those that hold a place is the smallest zone. Zones of the same rings
    # are covered once and count as so many.
    z = scratch.written(numbered(holed_zones(spark, d), [], ["extent", "zone_id"]), "zones")
    shapes = scratch.written(z.groupBy("rings").agg(F.min("pos").alias("zone_id"), F.count(F.lit(1)).alias("alike")), "shapes")
    covered = Z.cover(shapes).join(shapes.select(F.col("zone_id").alias("pos"), "alike"), F.col("zone_id") == F.col("pos"))
    rows = table(spark, d, "occurrences").where("lon IS NOT NULL AND lat IS NOT NULL").select("occ_id", "lon", "lat")
    places = scratch.written(rows.select("lon", "lat").distinct(), "places")
    found = Z.least_of(places, scratch.written(covered, "cover"), "pos", "alike")
    found = found.join(z.select("pos", F.col("zone_id").alias("smallest")), F.col("least") == F.col("pos")).select(F.col("lon").alias("f_lon"), F.col("lat").alias("f_lat"), "zones", "smallest")
    # Rows are shuffled once, by place: equal rows lie in one partition then, and so does what was found for them.
    points = rows.withColumn("place", F.xxhash64("lon", "lat")).repartition("place").distinct()
    same = (F.col("place") == F.col("f_place")) & (F.col("lon") - F.col("f_lon") == 0) & (F.col("lat") - F.col("f_lat") == 0)
    return points.join(found.withColumn("f_place", F.xxhash64("f_lon", "f_lat")), same).select("occ_id", "lon", "lat", "zones", "smallest")
