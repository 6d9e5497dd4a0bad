"""Queries on registries of sources and layers, and on the merged latest state of a stream of messages."""

from functools import partial

from pyspark.sql import functions as F

from halocline.plans.book import query
from halocline.plans.incremental import in_order
from halocline.plans.standins import table
from halocline.sources import scratch
from halocline.sources.registry import Layer, Source, export, points
from halocline.streaming.latest import Latest, messages

#: Points of fifteen sources; rules are read by Spark and by DuckDB alike.
SOURCES = (
    {f"record_{g.lower()}": Source("occurrences", where=f"grp = '{g}'") for g in "ANR"}
    | {f"survey_{k}": Source("finds", where=f"dataset = {k}") for k in range(6)}
    | {"vessel": Source("positions"), "detection": Source("detections"), "tag": Source("tags"), "zone": Source("boxes", "mx", "my")}
    | {"station": Source("customer", "c_custkey % 360 - 180", "c_custkey % 120 - 60", "c_custkey % 5 > 0"), "office": Source("supplier", "s_suppkey * 7 % 500 - 180", "s_suppkey * 3 % 180 - 90")}
)


@query("S10 U1", "WITH p AS (" + " UNION ALL ".join(f"SELECT '{n}' AS src, CAST({s.lon} AS DOUBLE) AS lon, CAST({s.lat} AS DOUBLE) AS lat FROM {s.table} WHERE {s.where}" for n, s in SOURCES.items()) + """)
SELECT floor(lon / 5)::INT AS cx, floor(lat / 5)::INT AS cy, count(*) AS n, count(DISTINCT src) AS sources FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 GROUP BY ALL""")
def source_density(spark, d):
    """Points of fifteen registered sources by cell, and how many sources a cell has; a table is scanned once for all its sources."""
    p = points(partial(table, spark, d), SOURCES).select(F.floor(F.col("lon") / 5).cast("int").alias("cx"), F.floor(F.col("lat") / 5).cast("int").alias("cy"), "src")
    by_source = p.groupBy("cx", "cy", "src").agg(F.count(F.lit(1)).alias("n"))
    return by_source.groupBy("cx", "cy").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"))


LAYERS = {
    "stations": Layer("vector", "customer", "c_custkey", "c_custkey % 360 - 180", "c_custkey % 120 - 60"),
    "records": Layer("observations", "occurrences", "occ_id", value="depth"),
    "ships": Layer("observations", "positions", "pos_id", value="sog"),
    "oxygen": Layer("field", "field", "concat(i, ':', j)", "i * 6 - 177", "j * 4.5 - 87.75", "value"),
    "life": Layer("composite", parts=("records", "stations")),
    "atlas": Layer("composite", parts=("life", "oxygen", "ships", "records")),
}


@query("M8", """
WITH p AS (SELECT 'stations' AS part, 'vector' AS kind, c_custkey::VARCHAR AS id, (c_custkey % 360 - 180)::DOUBLE AS lon, (c_custkey % 120 - 60)::DOUBLE AS lat, NULL::DOUBLE AS value FROM customer
 UNION ALL SELECT 'records', 'observations', occ_id::VARCHAR, lon, lat, depth FROM occurrences UNION ALL SELECT 'ships', 'observations', pos_id::VARCHAR, lon, lat, sog FROM positions
 UNION ALL SELECT 'oxygen', 'field', i || ':' || j, i * 6 - 177, j * 4.5 - 87.75, value FROM field WHERE value IS NOT NULL)
SELECT 'atlas' AS layer, part, kind, count(*) AS n, count(DISTINCT id) AS ids, count(value) AS valued, round(sum(value), 2) AS total FROM p WHERE (lon >= 150 OR lon <= -60) AND lat BETWEEN -40 AND 40 GROUP BY part, kind""")
def layer_exports(spark, d):
    """A composite of a composite, fields and observations by name, in a box over the date line; a part named twice comes once."""
    rows = export(partial(table, spark, d), LAYERS, "atlas", (150.0, -40.0, -60.0, 40.0))
    return rows.groupBy("layer", "part", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count("value").alias("valued"), F.round(F.sum("value"), 2).alias("total"))


def both_frames(spark, d):
    """Position reports (one in fifty off the globe) and static reports (one in twenty rows, half of them blank) as JSON."""
    p = table(spark, d, "positions")
    frame = lambda kind, name, lon: F.to_json(F.struct(F.lit(kind).alias("MessageType"), F.struct(F.col("mmsi").alias("MMSI"), name.alias("ShipName"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_utc")).alias("MetaData"), F.struct(F.col("lat").alias("Latitude"), lon.alias("Longitude"), F.col("sog").alias("Sog")).alias("Message")))
    at = frame("PositionReport", F.lit("?"), F.when(F.col("pos_id") % 50 == 0, 191.0).otherwise(F.col("lon")))
    who = frame("ShipStaticData", F.when(F.col("pos_id") % 40 == 0, "  ").otherwise(F.concat(F.lit(" SHIP "), F.col("pos_id") % 7)), F.lit(0.0))
    return p.select("pos_id", F.explode(F.array_compact(F.array(at, F.when(F.col("pos_id") % 20 == 0, who)))).alias("value"))


@query("T4 S9", """
WITH p AS (SELECT mmsi, date_trunc('second', ts) AS sec, lon, lat, pos_id FROM positions), l AS (SELECT mmsi, max({'s': sec, 'x': lon, 'y': lat}) AS r FROM p WHERE pos_id % 50 <> 0 GROUP BY mmsi),
w AS (SELECT mmsi, max({'s': sec, 'n': 'SHIP ' || (pos_id % 7)}) AS r FROM p WHERE pos_id % 20 = 0 AND pos_id % 40 <> 0 GROUP BY mmsi)
SELECT coalesce(l.mmsi, w.mmsi) AS mmsi, l.r.s AS ts, l.r.x AS lon, l.r.y AS lat, w.r.s AS named_at, w.r.n AS name FROM l FULL JOIN w ON l.mmsi = w.mmsi""")
def merged_identities(spark, d):
    """The newest place and the newest name that is not blank of every vessel, from one stream of both kinds of messages. One batch
    is replayed after a compaction that holds it, and one comes twice: the state is the same."""
    folder = scratch.folder(spark, "latest")
    frames = both_frames(spark, d)
    files = in_order(frames, f"{folder}/in", "pos_id", 4)
    stream = messages(spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"))
    book = Latest(spark, folder, "mmsi", {"at": (["ts"], ["lon", "lat", "sog"]), "who": (["ts"], ["name"])})
    book.run(stream, f"{folder}/checkpoint", every=3)
    some = messages(spark.read.schema(frames.schema).parquet(f"{folder}/in").where("pos_id % 2 = 0"))
    book.add(some, 1)  # in the base already
    book.add(some, 99)
    state = book.read(some)
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return state.select("mmsi", ntz("at.ts").alias("ts"), "at.lon", "at.lat", ntz("who.ts").alias("named_at"), "who.name")
