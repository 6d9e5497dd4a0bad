"""Queries on gridded fields, models and the stream side."""

from pyspark.sql import functions as F

from halocline.functions import geo
from halocline.operators import grids as G
from halocline.operators import models as M
from halocline.plans.book import query
from halocline.plans.standins import table
from halocline.sources import scratch
from halocline.streaming import vessels as V


@query("G5", """
WITH t AS (SELECT DISTINCT (o_orderkey % 50) + 0.3::DOUBLE AS lon, (o_custkey % 45) - 0.4::DOUBLE AS lat FROM orders) SELECT round(t.lon, 4) AS lon, round(t.lat, 4) AS lat, CASE WHEN t.lat BETWEEN 5 AND 35 THEN f.value END AS value FROM t LEFT JOIN field f ON f.i = floor(t.lon + 0.5) AND f.j = floor(t.lat + 0.5)""")
def regridded(spark, d):
    """A field on other axes: the nearest node, nothing outside its latitudes."""
    t = table(spark, d, "orders").select((F.col("o_orderkey") % 50 + 0.3).alias("lon"), (F.col("o_custkey") % 45 - 0.4).alias("lat")).distinct()
    return G.regrid(table(spark, d, "field"), t, (0.0, 0.0), 1.0, 5.0, 35.0).select(F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), "value")


@query("G12", """
WITH s AS (SELECT a.i, a.j, degrees(atan(sqrt(power(e.value - w.value, 2) + power(n.value - s.value, 2)) / 2000)) AS slope FROM field a JOIN field e ON e.i = a.i + 1 AND e.j = a.j JOIN field w ON w.i = a.i - 1 AND w.j = a.j JOIN field n ON n.i = a.i AND n.j = a.j + 1 JOIN field s ON s.i = a.i AND s.j = a.j - 1)
SELECT i // 20 AS block, round(median(slope), 6) AS slope, count(*) AS nodes FROM s WHERE slope IS NOT NULL GROUP BY ALL""")
def median_slopes(spark, d):
    s = G.slope(table(spark, d, "field"), 1000.0).where("slope IS NOT NULL")
    return s.groupBy(F.floor(F.col("i") / 20).cast("int").alias("block")).agg(F.round(F.percentile("slope", 0.5), 6).alias("slope"), F.count(F.lit(1)).alias("nodes"))


CLIMATE = """c AS (SELECT v.name AS variable, l_suppkey % 20 AS cell, l_linenumber * 100 AS depth, l_partkey % 12 + 1 AS month, max(l_extendedprice / v.k) AS value FROM lineitem, (VALUES ('oxygen', 10), ('nitrate', 7)) v(name, k) GROUP BY ALL), a AS (SELECT variable, cell, depth, max(value) AS value FROM c GROUP BY ALL),
p AS (SELECT o_orderkey AS id, o_custkey % 20 AS cell, o_custkey % 12 + 1 AS month, (o_orderkey % 3 + 1) * 100 AS surface, (o_orderkey % 5 + 3) * 100 AS deepest FROM orders),
f AS (SELECT p.id, x.v AS variable, x.l AS level, coalesce(CASE WHEN x.d <= 500 THEN c.value END, a.value) AS value FROM (SELECT *, unnest([{'v': 'oxygen', 'l': 'surface', 'd': surface}, {'v': 'oxygen', 'l': 'deep', 'd': deepest}, {'v': 'nitrate', 'l': 'surface', 'd': surface}, {'v': 'nitrate', 'l': 'deep', 'd': deepest}]) AS x FROM p) p LEFT JOIN c ON c.variable = x.v AND c.cell = p.cell AND c.depth = x.d AND c.month = p.month LEFT JOIN a ON a.variable = x.v AND a.cell = p.cell AND a.depth = x.d),
e AS (SELECT id, max(value) FILTER (variable = 'oxygen' AND level = 'surface') AS oxygen_surface, max(value) FILTER (variable = 'oxygen' AND level = 'deep') AS oxygen_deep, max(value) FILTER (variable = 'nitrate' AND level = 'surface') AS nitrate_surface, max(value) FILTER (variable = 'nitrate' AND level = 'deep') AS nitrate_deep FROM f GROUP BY id)"""


def enriched(spark, d):
    two = F.array(*[F.struct(F.lit(n).alias("variable"), F.lit(k).alias("k")) for n, k in (("oxygen", 10), ("nitrate", 7))])
    c = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_suppkey") % 20).alias("cell"), (F.col("l_linenumber") * 100).alias("depth"), (F.col("l_partkey") % 12 + 1).alias("month"), F.inline(two))
    monthly = c.groupBy("variable", "cell", "depth", "month").agg(F.max(F.col("l_extendedprice") / F.col("k")).alias("value"))
    annual = monthly.groupBy("variable", "cell", "depth").agg(F.max("value").alias("value"))
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("cell"), (F.col("o_custkey") % 12 + 1).alias("month"), ((F.col("o_orderkey") % 3 + 1) * 100).alias("surface"), ((F.col("o_orderkey") % 5 + 3) * 100).alias("deepest"))
    return G.enrich_profiles(p, monthly, annual, ["oxygen", "nitrate"])


@query("G3", "WITH " + CLIMATE.replace("<= 500", "<= 1500") + " SELECT id, round(oxygen_surface, 4) AS oxygen_surface, round(oxygen_deep, 4) AS oxygen_deep, round(nitrate_surface, 4) AS nitrate_surface, round(nitrate_deep, 4) AS nitrate_deep FROM e")
def profile_enrichment(spark, d):
    e = enriched(spark, d)
    return e.select("id", *[F.round(c, 4).alias(c) for c in e.columns if c != "id"])


@query("G17", "WITH " + CLIMATE.replace("<= 500", "<= 1500") + " SELECT o.o_orderkey AS id, round(CASE WHEN o.o_orderkey % 3 = 0 THEN e.oxygen_deep ELSE o.o_totalprice END, 4) AS oxygen_deep FROM orders o LEFT JOIN e ON e.id = o.o_orderkey")
def backfilled(spark, d):
    """Only what is missing is filled."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("oxygen_deep"))
    return G.backfill(rows, ["oxygen_deep"], enriched(spark, d)).select("id", F.round("oxygen_deep", 4).alias("oxygen_deep"))


@query("G13", """
SELECT o_custkey % 100 AS place, CASE o_orderkey % 3 WHEN 0 THEN 'carbon' WHEN 1 THEN 'oxygen' ELSE 'model' END AS section, count(*) AS n, string_agg('v' || (o_orderkey % 4) || '=' || o_totalprice::INT, ';' ORDER BY o_orderkey % 4, o_totalprice::INT, o_orderkey) AS values FROM orders WHERE o_custkey % 7 = 1 GROUP BY ALL""")
def grouped_readout(spark, d):
    """All variables of a place by section, side by side and never fused."""
    rows = table(spark, d, "orders").where("o_custkey % 7 = 1").select((F.col("o_custkey") % 100).alias("place"), F.when(F.col("o_orderkey") % 3 == 0, "carbon").when(F.col("o_orderkey") % 3 == 1, "oxygen").otherwise("model").alias("section"), F.struct((F.col("o_orderkey") % 4).alias("v"), F.rint("o_totalprice").cast("int").alias("x"), F.col("o_orderkey").alias("k")).alias("r"))
    text = F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat(F.lit("v"), r["v"], F.lit("="), r["x"]))
    return rows.groupBy("place", "section").agg(F.count(F.lit(1)).alias("n"), F.array_join(text, ";").alias("values"))


@query("G16", """
WITH h AS (SELECT DISTINCT floor((lon + 180) / 6)::INT AS i, floor((lat + 90) / 4.5)::INT AS j FROM occurrences), c AS (SELECT DISTINCT l_partkey % 60 AS i, l_suppkey % 40 AS j FROM lineitem WHERE l_linenumber = 3) SELECT h.i, h.j, f.value, c.i IS NOT NULL AS covered FROM h LEFT JOIN field f ON f.i = h.i AND f.j = h.j LEFT JOIN c ON c.i = h.i AND c.j = h.j WHERE f.value IS NOT NULL OR c.i IS NOT NULL""")
def one_variable_by_cell(spark, d):
    """Cells with a value of the chosen variable, or without one but covered by the climatology."""
    cells = table(spark, d, "occurrences").select(F.floor((F.col("lon") + 180) / 6).cast("int").alias("ci"), F.floor((F.col("lat") + 90) / 4.5).cast("int").alias("cj")).distinct()
    sampled = G.sample(cells.select(F.col("ci").cast("double").alias("lon"), F.col("cj").cast("double").alias("lat")), table(spark, d, "field"), (0.0, 0.0), 1.0)
    covered = table(spark, d, "lineitem").where("l_linenumber = 3").select((F.col("l_partkey") % 60).cast("int").alias("c_i"), (F.col("l_suppkey") % 40).cast("int").alias("c_j")).distinct()
    out = sampled.join(covered, (F.col("i") == F.col("c_i")) & (F.col("j") == F.col("c_j")), "left")
    return out.where("value IS NOT NULL OR c_i IS NOT NULL").select("i", "j", "value", F.col("c_i").isNotNull().alias("covered"))


@query("G15")
def drift_back(spark, d):
    """Particles traced back by Runge-Kutta steps; tested against plain Python."""
    f = table(spark, d, "field").select("i", "j", (F.col("value") % 7 / 50 - 0.05).alias("u"), (F.col("value") % 5 / 60 - 0.03).alias("v"))
    p = table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 58 + 0.5).alias("lon"), (F.col("o_orderkey") % 38 + 0.25).alias("lat"))
    out = G.drift_back(p, f, 6, (0.0, 0.0), 1.0, every=2, hold=lambda df: scratch.written(df, "drift"))
    return out.select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "age", F.round("speed", 6).alias("speed"))


@query("M6", """
WITH r AS (SELECT o_orderkey AS id, o_totalprice AS price, o_custkey % 40 AS depth, o_orderstatus AS kind, o_orderkey % 5 = 0 AS training FROM orders), e AS (SELECT min(price) AS a, max(price) AS b, min(depth) AS c, max(depth) AS d FROM r WHERE training AND depth < 30 AND kind <> 'P')
SELECT id, NOT (price BETWEEN a AND b AND depth BETWEEN c AND d AND kind IN (SELECT kind FROM r WHERE training AND depth < 30 AND kind <> 'P')) AS outside FROM r, e""")
def extrapolation(spark, d):
    """Rows outside what the training rows span, in a range or in a set."""
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 40).alias("depth"), F.col("o_orderstatus").alias("kind"))
    return M.envelope(r.where("id % 5 = 0 AND depth < 30 AND kind <> 'P'"), r, ["price", "depth"], ["kind"]).select("id", "outside")


def scored(spark, d):
    """Rows with a score that rises with price and a label that mostly follows it."""
    o = table(spark, d, "orders")
    price = F.least(F.greatest(F.col("o_totalprice") / 500000, F.lit(0.0)), F.lit(0.999))
    return o.select(F.col("o_orderkey").alias("row_id"), price.alias("price"), (F.col("o_custkey") % 10 / 10).alias("noise"), F.when(F.col("o_orderkey") % 10 / 10 < price, 1).otherwise(0).alias("label")).withColumn("score", F.round(0.9 * F.col("price") + 0.1 * F.col("noise"), 3))


SCORED = "s AS (SELECT o_orderkey AS row_id, least(greatest(o_totalprice / 500000, 0), 0.999) AS price, o_custkey % 10 / 10.0::DOUBLE AS noise, CASE WHEN (o_orderkey % 10) / 10.0::DOUBLE < least(greatest(o_totalprice / 500000, 0), 0.999) THEN 1 ELSE 0 END AS label FROM orders), k AS (SELECT *, round(0.9 * price + 0.1 * noise, 3) AS score FROM s)"


@query("M7", f"""
WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM k), a AS (SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc, count(*) AS n FROM r),
b AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM k GROUP BY ALL), c AS (SELECT bin, p / nullif(q, 0) AS ratio FROM b), e AS (SELECT row_number() OVER (ORDER BY bin) AS b, rank() OVER (ORDER BY ratio) + (count(*) OVER (PARTITION BY ratio) - 1) / 2.0 AS r FROM c WHERE ratio IS NOT NULL), f AS (SELECT CASE WHEN count(*) >= 3 THEN corr(b, r) END AS boyce FROM e)
SELECT round(auc, 6) AS auc, round(boyce, 6) AS boyce, n, coalesce(auc >= 0.7 AND boyce > 0 AND n >= 50, false) AS publish FROM a, f""")
def publish_verdict(spark, d):
    """Rank measures of a model and whether it may be published; what is missing closes the gate."""
    s = scored(spark, d)
    auc = M.rank_auc(s).withColumn("boyce", M.boyce_index(s).scalar()).withColumn("n", s.agg(F.count(F.lit(1))).scalar())
    return auc.select(F.round("auc", 6).alias("auc"), F.round("boyce", 6).alias("boyce"), "n", M.publish_gate(F.col("auc"), F.col("boyce"), F.col("n")).alias("publish"))


@query("M5")
def feature_importance(spark, d):
    """How much rank accuracy falls when a feature's values are dealt anew; by a seeded hash, so tests hold the order only."""
    score_of = lambda df: df.withColumn("score", F.round(0.9 * F.col("price") + 0.1 * F.col("noise"), 3))
    return M.importance(scored(spark, d), score_of, ["price", "noise"]).withColumn("loss", F.round("loss", 6))


@query("M2")
def background_sample(spark, d):
    """A repeatable sample of 500 target-group places beside the presences (the limit is the sample's size)."""
    o = table(spark, d, "occurrences")
    presence = o.where("species_no = 7").select("lon", "lat", F.lit(1).alias("label"))
    group = o.where("species_no BETWEEN 5 AND 15").select("lon", "lat").distinct()
    return presence.unionByName(M.background(group, 500, 3).withColumn("label", F.lit(0))).groupBy("label", geo.degree_cell(F.col("lon"), 30.0).alias("cx")).agg(F.count(F.lit(1)).alias("n"))


@query("T3", """
WITH p AS (SELECT pos_id, pos_id % 6 AS batch, date_trunc('week', ts) AS week FROM positions WHERE pos_id % 6 < 4 OR ts < (SELECT max(ts) FROM positions) - INTERVAL 20 DAY), m AS (SELECT batch, max(week) AS newest FROM p GROUP BY batch), o AS (SELECT a.batch, max(b.newest) AS open FROM m a LEFT JOIN m b ON b.batch < a.batch GROUP BY a.batch)
SELECT p.batch, count(*) AS n, count(*) FILTER (week < open - INTERVAL 7 DAY) AS late FROM p JOIN o ON o.batch = p.batch GROUP BY p.batch""")
def late_rows(spark, d):
    """Per micro-batch the rows whose week is closed: the newest week of earlier batches and the one before are open."""
    p = table(spark, d, "positions").select("pos_id", (F.col("pos_id") % 6).alias("batch"), "ts")
    newest = p.agg(F.max("ts")).scalar()
    p = p.withColumn("newest", newest).where("batch < 4 OR ts < newest - INTERVAL 20 DAYS")
    return V.split_late(p, "batch").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))


@query("T1 T4", "SELECT mmsi, max(ts) AS ts, max_by(pos_id, (ts, pos_id)) AS pos_id, count(DISTINCT pos_id) AS rows_seen FROM positions GROUP BY mmsi")
def streamed_latest(spark, d):
    """Positions as a stream of files, a micro-batch for each, merged into the table of latest states; every batch writes a new
    version of the table."""
    folder = scratch.folder(spark, "stream")
    p = table(spark, d, "positions").select(F.col("mmsi").cast("long").alias("mmsi"), "ts", F.col("pos_id").cast("long").alias("pos_id"), F.lit(1).cast("long").alias("rows_seen"))
    p.repartition(4, "pos_id").write.parquet(f"{folder}/in")
    schema = p.schema
    state = {"path": None}

    def merge(batch, number):
        own = batch.groupBy("mmsi").agg(F.max(F.struct("ts", "pos_id")).alias("r"), F.sum("rows_seen").alias("rows_seen")).select("mmsi", "r.ts", "r.pos_id", "rows_seen")
        if state["path"]:
            own = V.merge_counted(spark.read.schema(schema).parquet(state["path"]), own)
        path = f"{folder}/latest-{number}"
        own.write.mode("overwrite").parquet(path)  # a batch that runs again writes the same version
        state["path"] = path

    V.run_to_end(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/checkpoint", merge)
    return spark.read.schema(schema).parquet(state["path"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("T5", "SELECT date_trunc('hour', ts) AS hour, count(*) AS messages, round(avg(sog), 6) AS speed FROM positions GROUP BY ALL")
def streamed_hours(spark, d):
    """An hourly roll-up of a stream; its checkpoint is the high-water mark, so that a row counts once."""
    folder = scratch.folder(spark, "hours")
    p = table(spark, d, "positions").select("ts", "sog")
    p.repartition(3).write.parquet(f"{folder}/in")
    hours = V.hourly(spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "4000 days")
    last = {}

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out-{number}")
        last["path"] = f"{folder}/out-{number}"

    hours.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(last["path"]).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "messages", F.round("speed", 6).alias("speed"))


@query("T6")
def incremental_matches(spark, d):
    """Detections in two instalments: those that have a result keep it, only the pending ones are matched. In the end all have the
    result of one whole run (tested)."""
    from halocline.operators.spatial import records

    det, pos = table(spark, d, "detections"), table(spark, d, "positions")
    said = scratch.written(records(pos, 600), "records")
    none = spark.createDataFrame([], "det_id long, class string")
    first = V.correlate_pending(det.where("det_id % 2 = 0"), none, pos, said)
    return V.correlate_pending(det, scratch.written(first, "results"), pos, said)


@query("T10")
def reclassified_matches(spark, d):
    """Results of half of the positions are judged again where they were ambiguous, once the other half is there (tested)."""
    from halocline.operators.spatial import match_detections

    det, pos = table(spark, d, "detections"), table(spark, d, "positions")
    early = scratch.written(match_detections(det, pos.where("mmsi % 2 = 0")).select("det_id", "class"), "early")
    return V.reclassify(early, det, pos)
