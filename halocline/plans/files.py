"""Queries that write files from a table into the shared folder and scan them again, and the snapshot rules around them."""

from pyspark.sql import functions as F

from halocline.operators import snapshots as N
from halocline.plans.book import query
from halocline.plans.standins import table
from halocline.sources import scans, scratch, sinks


@query("S1", """SELECT occ_id::VARCHAR AS id, class, ord, CASE WHEN greatest(dmin, dmax) IS NULL THEN NULL WHEN coalesce((dmin + dmax) / 2, dmin, dmax) BETWEEN 0 AND 11000 THEN coalesce((dmin + dmax) / 2, dmin, dmax) END AS depth, NULL::VARCHAR AS genus, coalesce(dropped, false) AS dropped FROM finds WHERE lon IS NOT NULL""")
def nested_scan(spark, d):
    """Nested records, of which some fields are not in the file: they read as null. Rows without coordinates go."""
    i = F.struct(F.col("class"), F.col("ord").alias("order"), F.col("dmin").alias("minimumDepthInMeters"), F.col("dmax").alias("maximumDepthInMeters"), F.col("lat").alias("decimalLatitude"), F.col("lon").alias("decimalLongitude"))
    path = scratch.folder(spark, "nested")
    table(spark, d, "finds").select(F.col("occ_id").cast("string").alias("_id"), i.alias("interpreted"), "dropped").write.parquet(path)
    return scans.occurrences(spark, path).where("lon IS NOT NULL").select(F.col("_id").alias("id"), "class", F.col("order").alias("ord"), "depth", "genus", "dropped")


@query("S4", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS value, o_orderstatus AS flag FROM orders WHERE o_orderkey % 50 <> 0")
def measured_scan(spark, d):
    """Text with a preamble, one of whose lines has as many fields as the data, an exact header, and lines that are cut short."""
    o = table(spark, d, "orders")
    line = F.when(F.col("o_orderkey") % 50 == 0, F.concat_ws("\t", "o_orderkey", F.lit("cut"))).otherwise(F.concat_ws("\t", "o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.col("o_totalprice").cast("string")), "o_orderstatus"))
    head = ["Data set of orders", "a\tb\tc", "Expocode\tvalue\tflag"]
    path = scratch.folder(spark, "measured")
    # Each file begins with the preamble and the header.
    files = 3
    text = spark.range(files).select(F.lit("\n".join(head)).alias("value"), F.col("id").cast("int").alias("file"), F.lit(0).alias("first"))
    body = o.select(line.alias("value"), F.pmod(F.xxhash64(line), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("first"))
    text.unionByName(body).repartition("file").sortWithinPartitions("file", "first").select("value", "file").write.partitionBy("file").text(path)
    rows, rejects = scans.measured_text(spark, path, ["Expocode", "value", "flag"], {"Expocode": "bigint", "value": "double"})
    return rows.select(F.col("Expocode").alias("id"), F.round("value", 2).alias("value"), "flag")


@query("S4", """
SELECT 'X' || k AS code, CASE WHEN k IN (3, 4) THEN 'unlisted' WHEN k = 5 THEN 'repeated' END AS reason, count(*) AS rows FROM (SELECT o_custkey % 12 AS k FROM orders) WHERE k IN (3, 4, 5) GROUP BY k UNION ALL SELECT 'X99', 'missing', 0""")
def sectioned_scan(spark, d):
    """Texts with a table of datasets between preamble and data: codes that the table lacks, lists twice, or has no rows for. A
    file holds some orders of one code and that code's lines of the table, and one file has no data, so no task writes more
    than a file."""
    o = table(spark, d, "orders")
    listed = (0, 1, 2, 5, 5, 6, 7, 8, 9, 10, 11, 99)
    # Orders of one code whose keys are in one range of this many are a file.
    keys = 2_000_000
    rows = o.select((F.col("o_custkey") % 12).cast("int").alias("k"), F.floor(F.col("o_orderkey") / keys).alias("range"), F.col("o_orderkey").cast("long").alias("n"), F.concat_ws("\t", F.concat(F.lit("X"), F.col("o_custkey") % 12), "o_orderkey", F.col("o_totalprice").cast("string")).alias("value"))
    known = F.transform(F.filter(F.array(*map(F.lit, listed)), lambda k: k == F.col("k")), lambda k: F.concat(F.lit("X"), k, F.lit("\tv"), k, F.lit("\tcruise "), k))
    above, below = (F.array(*map(F.lit, x)) for x in (["Collection of orders", "X3\tv1\tnot in the table", "Code\tversion\tname"], ["", "X4\tv2\ta note below the table", "code\tid\tvalue"]))
    empty = spark.range(1).select(F.lit(99).alias("k"), F.lit(0).cast("long").alias("range"))
    text = rows.select("k", "range").distinct().unionByName(empty).select("k", "range", F.posexplode(F.concat(above, known, below)).alias("n", "value")).select("k", "range", F.lit(0).alias("part"), F.col("n").cast("long").alias("n"), "value")
    path = scratch.folder(spark, "sections")
    both = text.unionByName(rows.select("k", "range", F.lit(1).alias("part"), "n", "value"))
    both.repartition("k", "range").sortWithinPartitions("k", "range", "part", "n").select("k", "range", "value").write.partitionBy("k", "range").text(path)
    problems = scans.sectioned_text(spark, path, ["Code", "version", "name"], ["code", "id", "value"], {"id": "bigint", "value": "double"}, "code")[3]
    return problems.groupBy("code", "reason").agg(F.sum("rows").alias("rows"))


@query("S5", "SELECT 'Series ' || (o_custkey % 5) AS title, o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS depth, NULL::DOUBLE AS salinity FROM orders")
def commented_scan(spark, d):
    """Tab files with a comment block: typed columns, text that does not fit is null, and a column that no file has."""
    o = table(spark, d, "orders").withColumn("series", F.col("o_custkey") % 5)
    line = F.concat_ws("\t", "o_orderkey", F.lit("x"), F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")))
    block = F.concat(F.lit("/* DATA DESCRIPTION\nTitle: Series "), "series", F.lit("\nDepth: none\n*/\nid\tother\tdepth\n"))
    path = scratch.folder(spark, "commented")
    files = o.groupBy("series", F.floor(F.col("o_orderkey") / 2000).alias("part")).agg(F.array_join(F.collect_list(line), "\n").alias("lines")).select(F.concat(block, "lines").alias("value"), "series", "part")
    files.repartition("series", "part").write.partitionBy("series", "part").text(path)
    return scans.commented_table(spark, path, {"id": "bigint", "depth": "double", "salinity": "double"}).select("title", "id", F.round("depth", 2).alias("depth"), "salinity")


INDEX = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey - 41 ELSE o_orderkey END AS key_no, o_orderkey % 37 = 0 AS broken, o_orderkey % 29 = 0 AS dropped, o_orderkey % 3 AS rev FROM orders WHERE o_orderkey % 10 <> 1 AND o_orderkey > 41"""


def index_files(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 10 <> 1 AND o_orderkey > 41")
    k = F.when(F.col("o_orderkey") % 41 == 0, F.col("o_orderkey") - 41).otherwise(F.col("o_orderkey"))
    file = F.concat(F.lit("aoml/"), k % 1000, F.lit("/profiles/SR"), k % 1000, F.lit("_"), k, F.lit(".nc"))
    names = F.when(F.col("o_orderkey") % 29 == 0, "PRES TEMP").otherwise("PRES DOXY TEMP")
    whole = F.concat_ws(",", file, F.lit("19990101000000"), F.lit("10.5"), F.lit(""), F.lit("A"), F.lit("846"), F.lit("AO"), names, F.lit("RAD"), F.concat(F.lit("2000010100000"), F.col("o_orderkey") % 3))
    line = F.when(F.col("o_orderkey") % 37 == 0, F.concat_ws(",", file, F.lit("19990101000000"))).otherwise(whole)
    path = scratch.folder(spark, "index")
    spark.createDataFrame([("# Title: index",), ("file,date,latitude,longitude,ocean,profiler_type,institution,parameters,parameter_data_mode,date_update",)], "value string").unionByName(o.select(line.alias("value"))).write.text(path)
    return scans.profile_index(spark, path, "DOXY")


@query("S6", f"""SELECT 'aoml_' || key_no % 1000 || '_' || key_no AS key, CASE WHEN broken THEN 'fields' ELSE 'ok' END AS state, CASE WHEN broken THEN NULL ELSE 'A' END AS mode FROM ({INDEX}) WHERE broken OR NOT dropped""")
def index_scan(spark, d):
    """Lines of a profile index that list a parameter with its mode letter, and malformed ones by name."""
    rows, rejects = index_files(spark, d)
    return rows.select("key", F.lit("ok").alias("state"), "mode").unionByName(rejects.select("key", F.col("reason").alias("state"), F.lit(None).cast("string").alias("mode")))


@query("S26", f"""
WITH i AS ({INDEX}), g AS (SELECT key_no, count(*) AS n, max(rev) AS rev FROM i WHERE NOT broken AND NOT dropped GROUP BY key_no), u AS (SELECT key_no FROM g WHERE n > 1 UNION SELECT key_no FROM i WHERE broken),
s AS (SELECT o_orderkey AS key_no, o_orderkey % 2 AS rev, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 2 END AS rules FROM orders WHERE o_orderkey % 7 <> 0), k AS (SELECT key_no FROM g UNION SELECT key_no FROM s UNION SELECT key_no FROM u)
SELECT 'aoml_' || k.key_no % 1000 || '_' || k.key_no AS key, CASE WHEN u.key_no IS NOT NULL THEN 'untrusted' WHEN g.key_no IS NULL THEN 'gone' WHEN s.key_no IS NULL OR s.rev <> g.rev OR s.rules < 2 THEN 'need' ELSE 'keep' END AS action FROM k LEFT JOIN g ON g.key_no = k.key_no LEFT JOIN s ON s.key_no = k.key_no LEFT JOIN u ON u.key_no = k.key_no""")
def index_plan(spark, d):
    """What to fetch and what is gone, by an index in which some keys cannot be trusted."""
    rows, rejects = index_files(spark, d)
    k = F.col("o_orderkey")
    stored = table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.concat_ws("_", F.lit("aoml"), k % 1000, k).alias("key"), F.try_to_timestamp(F.concat(F.lit("2000010100000"), k % 2), F.lit("yyyyMMddHHmmss")).alias("stamp"), F.when(k % 17 == 0, 1).otherwise(2).alias("rules"))
    return N.index_plan(rows, rejects, stored, 2)


@query("S7 S21", "SELECT c_custkey AS id, 'Point' AS kind, (c_custkey % 360 - 180)::DOUBLE AS lon, c_mktsegment AS segment, 'true' AS capped FROM customer ORDER BY c_custkey LIMIT 100")
def geojson_round_trip(spark, d):
    """A feature collection with metadata, capped, written and scanned again."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"), (F.col("c_custkey") % 120 - 60).cast("double").alias("lat"), F.col("c_mktsegment").alias("segment"))
    path = scratch.folder(spark, "geojson")
    sinks.write_geojson(rows, path, 100, {"source": "customers", "licence": "CC0"})
    meta = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.metadata.capped").alias("capped")).scalar()
    f = scans.geojson(spark, path)
    return f.select(F.col("properties")["id"].cast("long").alias("id"), "kind", F.get_json_object("coordinates", "$[0]").cast("double").alias("lon"), F.col("properties")["segment"].alias("segment")).withColumn("capped", meta)


@query("S22", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '''=' || o_custkey ELSE 'n' || o_custkey END AS note, -o_custkey AS delta, 'own' AS licence, 'CC0' AS source_licence, 'orders' AS source FROM orders")
def csv_round_trip(spark, d):
    """Texts that a spreadsheet would run are guarded, numbers are not; a provenance column that collides is renamed."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.when(F.col("o_orderkey") % 4 == 0, "=").otherwise("n"), "o_custkey").alias("note"), (-F.col("o_custkey")).alias("delta"), F.lit("own").alias("licence"))
    path = scratch.folder(spark, "csv")
    sinks.write_csv(rows, path, {"licence": "CC0", "source": "orders"})
    return spark.read.csv(path, header=True, schema="id long, note string, delta long, licence string, source_licence string, source string")


@query("S24 T9", "SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n FROM positions WHERE date_trunc('week', ts) >= (SELECT date_trunc('week', max(ts)) - INTERVAL 21 DAY FROM positions) GROUP BY ALL")
def weekly_partitions(spark, d):
    """Positions written by week, and the same batch again; old weeks are left out by their partition."""
    p = table(spark, d, "positions").select("pos_id", "mmsi", "ts")
    path = scratch.folder(spark, "weeks")
    for _ in range(2):
        sinks.write_weekly(p, path, 0, ["pos_id"])
    return sinks.retained(sinks.read_weekly(spark, path), p.agg(F.max("ts")).scalar(), 3).groupBy("week").agg(F.count(F.lit(1)).alias("n"))


@query("S12 J19", "SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def appended_rows(spark, d):
    """New rows whose key is stored already, or came twice, change nothing."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    new = o.where("id % 2 = 0").select("id", F.lit("new").alias("state"))
    stored = o.where("id % 3 <> 0")
    return stored.unionByName(N.append_new(stored, new.unionByName(new), ["id"]))


@query("S19", """
WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM customer) AS c) SELECT 'v1' AS version, o AS orders, c AS customers, true AS first, false AS second FROM n""")
def published_version(spark, d):
    """Two tables go live together or not at all: the second version, which lacks rows, leaves readers on the first."""
    folder = scratch.folder(spark, "published")
    tables = {"orders": table(spark, d, "orders").select("o_orderkey"), "customers": table(spark, d, "customer").select("c_custkey")}
    whole = {k: df.count() for k, df in tables.items()}
    valid = lambda read: all(read[k].count() == n for k, n in whole.items())
    first = sinks.publish(tables, folder, "v1", valid)
    second = sinks.publish({**tables, "orders": tables["orders"].where("o_orderkey % 2 = 0")}, folder, "v2", valid)
    live = spark.read.schema("version string, at timestamp").json(f"{folder}/versions").agg(F.max_by("version", "at").alias("version"))
    n = {k: spark.read.parquet(f"{folder}/v1/{k}").agg(F.count(F.lit(1))).scalar() for k in tables}
    return live.select("version", n["orders"].alias("orders"), n["customers"].alias("customers"), F.lit(first).alias("first"), F.lit(second).alias("second"))


@query("S20", "SELECT dataset, count(*) AS rows_to_load FROM seen WHERE dataset NOT IN (SELECT dataset FROM stored WHERE id % 10 <> 0 AND dataset % 2 = 0) GROUP BY dataset")
def resumed_datasets(spark, d):
    """Datasets without a ledger row, that is, not loaded whole."""
    ledger = table(spark, d, "stored").where("id % 10 <> 0 AND dataset % 2 = 0").select("dataset")
    return N.resume(table(spark, d, "seen"), ledger, "dataset").groupBy("dataset").agg(F.count(F.lit(1)).alias("rows_to_load"))


@query("S28", """
WITH s AS (SELECT id FROM stored WHERE id % 10 <> 0), few AS (SELECT id FROM seen WHERE id % 5 = 0), n AS (SELECT (SELECT count(*) FROM s) AS stored, (SELECT count(*) FROM seen) AS seen, (SELECT count(*) FROM few) AS few)
SELECT 'whole' AS walk, count(*) FILTER (s.id NOT IN (SELECT id FROM seen) AND n.seen >= 0.6 * n.stored) AS removed FROM s, n UNION ALL SELECT 'short', count(*) FILTER (s.id NOT IN (SELECT id FROM few) AND n.few >= 0.6 * n.stored) FROM s, n""")
def minimum_share(spark, d):
    """A walk that saw too little removes nothing."""
    stored, seen = table(spark, d, "stored").where("id % 10 <> 0").select("id"), table(spark, d, "seen").select("id")
    removed = lambda walk, name: N.minimum_share(walk, stored, "id", 0.6).agg(F.lit(name).alias("walk"), F.count(F.lit(1)).alias("removed"))
    return removed(seen, "whole").unionByName(removed(seen.where("id % 5 = 0"), "short"))


CAT = "['CR', 'NE', 'DD', 'LC', NULL][({0} % 5 + 1)::INT]"


@query("S30", f"""
WITH k AS (SELECT o_orderkey AS id, {CAT.format('o_orderkey')} AS old, CASE WHEN o_orderkey % 3 <> 0 THEN {CAT.format('(o_orderkey + o_custkey)')} END AS new FROM orders), f AS (SELECT *, (old IS NULL OR old IN ('NE', 'DD')) AND new IS NOT NULL AND new IS DISTINCT FROM old AS filled FROM k)
SELECT id, CASE WHEN filled THEN new ELSE old END AS category, filled FROM f""")
def filled_categories(spark, d):
    names = F.array(*[F.lit(x) for x in ("CR", "NE", "DD", "LC", None)])
    at = lambda c: F.element_at(names, (c % 5 + 1).cast("int"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return N.fill_category(o.select("id", at(F.col("id")).alias("category")), o.where("id % 3 <> 0").select("id", at(F.col("id") + F.col("o_custkey")).alias("category")), "id")


@query("S31", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN 2 WHEN o_orderkey % 4 = 0 THEN 2 ELSE 3 END AS counted, (CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 5 + o_orderkey % 7 WHEN 2 THEN 5 + o_orderkey % 7 ELSE 5 END)::DOUBLE AS total, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 1 ELSE 0 END AS not_counted, CASE WHEN o_orderkey % 4 = 2 THEN 1 ELSE 0 END AS collisions FROM orders""")
def abundance_maps(spark, d):
    """Maps of abundance with a null, a negative number, and two names that are one once trimmed."""
    k = F.col("o_orderkey")
    third = F.when(k % 4 == 0, F.lit('"c":null')).when(k % 4 == 1, F.concat(F.lit('"c":'), k % 7)).when(k % 4 == 2, F.concat(F.lit('" a":'), k % 7)).otherwise(F.lit('"c":-1'))
    samples = table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit('{"a":5,"b":0,'), third, F.lit("}")).alias("json"))
    rows, tally = N.unpivot_abundance(samples, "id", "json")
    sums = rows.groupBy(F.col("id").alias("r_id")).agg(F.count(F.lit(1)).alias("counted"), F.sum("abundance").alias("total"))
    return tally.join(sums, F.col("id") == F.col("r_id")).select("id", "counted", "total", "not_counted", "collisions")


@query("S32", """
WITH a AS (SELECT o_orderkey AS k, o_custkey % 50 AS lat, o_totalprice AS v FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 99 ELSE o_custkey % 50 END AS lat, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS v FROM orders WHERE o_orderkey % 17 <> 0),
j AS (SELECT CASE WHEN a.k IS NULL THEN 'missing_in_a' WHEN b.k IS NULL THEN 'missing_in_b' WHEN a.lat <> b.lat THEN 'place_differs' END AS violation, b.v FROM a FULL JOIN b ON a.k = b.k) SELECT violation, count(*) AS n, round(count(*) FILTER (v = 0) / count(v), 6) AS zero_share FROM j GROUP BY violation""")
def file_violations(spark, d):
    """Keys of two files held against each other: missing on a side, at another place, and the share of zeros."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    a = o.where(k % 11 != 0).select(k.alias("a_k"), (F.col("o_custkey") % 50).alias("a_lat"))
    b = o.where(k % 17 != 0).select(k.alias("b_k"), F.when(k % 13 == 0, 99).otherwise(F.col("o_custkey") % 50).alias("b_lat"), F.when(k % 5 == 0, 0).otherwise(1).alias("v"))
    both = a.join(b, F.col("a_k") == F.col("b_k"), "full")
    why = F.when(F.col("a_k").isNull(), "missing_in_a").when(F.col("b_k").isNull(), "missing_in_b").when(F.col("a_lat") != F.col("b_lat"), "place_differs")
    return both.groupBy(why.alias("violation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.try_divide(F.count_if(F.col("v") == 0), F.count("v")), 6).alias("zero_share"))


@query("S11", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents WHERE text IS NOT NULL")
def inventory(spark, d):
    """A count per table, some with a filter of their own."""
    wanted = {"customer": None, "orders": "o_orderstatus <> 'P'", "lineitem": None, "documents": "text IS NOT NULL"}
    counts = [table(spark, d, name).where(rule or "true").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, rule in wanted.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("M8", "SELECT 'customers' AS layer, 'vector' AS kind, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer WHERE c_custkey % 360 - 180 BETWEEN -90 AND 90 UNION ALL SELECT 'occurrences', 'observations', count(*), sum(occ_id)::BIGINT FROM occurrences WHERE lon BETWEEN -90 AND 90 UNION ALL SELECT 'both', 'composite', (SELECT count(*) FROM customer WHERE c_custkey % 360 - 180 BETWEEN -90 AND 90) + count(*), (SELECT sum(c_custkey)::BIGINT FROM customer WHERE c_custkey % 360 - 180 BETWEEN -90 AND 90) + sum(occ_id)::BIGINT FROM occurrences WHERE lon BETWEEN -90 AND 90")
def registered_exports(spark, d):
    """Layers by name in a registry, each with its kind and builder; a composite is built of others."""
    layers = {
        "customers": ("vector", lambda: table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"))),
        "occurrences": ("observations", lambda: table(spark, d, "occurrences").select(F.col("occ_id").alias("id"), "lon")),
        "both": ("composite", lambda: layers["customers"][1]().unionByName(layers["occurrences"][1]())),
    }
    parts = [build().where(F.col("lon").between(-90, 90)).agg(F.lit(name).alias("layer"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")) for name, (kind, build) in layers.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
