"""Scans: nested Parquet occurrences, measured-header text, tab files with a comment block, profile indexes, GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCCURRENCE = (
    "_id string, dataset_id string, interpreted struct<scientificName: string, phylum: string, class: string, subclass: string, `order`: string, genus: string, eventDate: string, date_year: long, "
    "depth: double, minimumDepthInMeters: double, maximumDepthInMeters: double, decimalLatitude: double, decimalLongitude: double>, flags array<string>, dropped boolean, absence boolean"
)


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Flat occurrence rows of nested Parquet; a field that a file lacks reads as null. Only the fields named are read."""
    i = F.col("interpreted")
    d = F.coalesce(i["depth"], (i["minimumDepthInMeters"] + i["maximumDepthInMeters"]) / 2, i["minimumDepthInMeters"], i["maximumDepthInMeters"])
    return spark.read.schema(OCCURRENCE).parquet(path).select(
        "_id", "dataset_id", i["scientificName"].alias("species"), i["class"].alias("class"), i["order"].alias("order"), i["genus"].alias("genus"), i["date_year"].alias("year"),
        F.when(d.between(0, 11000), d).alias("depth"), i["decimalLongitude"].alias("lon"), i["decimalLatitude"].alias("lat"), "flags", F.coalesce("dropped", F.lit(False)).alias("dropped"), F.coalesce("absence", F.lit(False)).alias("absence"),
    )


def measured_text(spark: SparkSession, path: str, header: list[str], types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of tab-separated text whose header must be exactly header. All lines before it are a preamble, whatever
    they look like; a line after it with another number of fields is a reject. A file without just one header fails the read."""
    head = "\t".join(header)
    # Lines of a split come in order, and splits of a file by their start.
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    heads = lines.groupBy("file").agg(F.count_if(F.col("value") == head).alias("n"), F.min(F.when(F.col("value") == head, F.struct("block", "line"))).alias("at"))
    bad = heads.where("n <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file} has {bad[0].n} lines with the expected header")
    parts = F.split("value", "\t", -1)
    data = lines.join(heads.select(F.col("file").alias("h_file"), "at"), F.col("file") == F.col("h_file")).where(F.struct("block", "line") > F.col("at")).where("value <> ''")
    rows = data.where(F.size(parts) == len(header)).select("file", *[F.nullif(parts[i], F.lit("")).try_cast(types.get(c, "string")).alias(c) for i, c in enumerate(header)])
    return rows, data.where(F.size(parts) != len(header)).select("file", "value")


def sectioned_text(spark: SparkSession, path: str, sets: list[str], header: list[str], types: dict[str, str], code: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, rejects, datasets, problems) of tab-separated text in sections: a preamble, a table of datasets (its header is sets;
    it ends at the first empty line), notes, and the data below header. Every data row's code (the first column of the table,
    the column code of the data) is held against its file's table: problems has file, code and reason, which is unlisted (rows
    of a dataset that the table lacks, with their number), missing (a dataset without rows) or repeated (listed twice)."""
    rows, rejects = measured_text(spark, path, header, types)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), "value")
    first = lambda test: F.min(F.when(test, F.col("at")))
    top = lines.where(F.col("value") == "\t".join(sets)).groupBy("file").agg(F.min("at").alias("top"))
    below = lines.join(top.withColumnRenamed("file", "t_file"), F.col("file") == F.col("t_file")).where(F.col("at") > F.col("top")).drop("t_file")
    end = below.groupBy("file").agg(first((F.col("value") == "") | (F.col("value") == "\t".join(header))).alias("end")).withColumnRenamed("file", "e_file")
    parts = F.split("value", "\t", -1)
    listed = below.join(end, F.col("file") == F.col("e_file")).where("end IS NULL OR at < end").where(F.size(parts) == len(sets))
    datasets = listed.select("file", *[F.nullif(parts[i], F.lit("")).alias(c) for i, c in enumerate(sets)])
    named = datasets.groupBy("file", F.col(sets[0]).alias("code")).agg(F.count(F.lit(1)).alias("listed"))
    seen = rows.groupBy("file", F.col(code).cast("string").alias("code")).agg(F.count(F.lit(1)).alias("rows"))
    both = named.join(seen.select(F.col("file").alias("s_file"), F.col("code").alias("s_code"), "rows"), (F.col("file") == F.col("s_file")) & F.col("code").eqNullSafe(F.col("s_code")), "full")
    reason = F.when(F.col("listed").isNull(), "unlisted").when(F.col("listed") > 1, "repeated").when(F.col("rows").isNull(), "missing")
    problems = both.select(F.coalesce("file", "s_file").alias("file"), F.coalesce("code", "s_code").alias("code"), reason.alias("reason"), F.coalesce("rows", F.lit(0)).alias("rows")).where("reason IS NOT NULL")
    return rows, rejects, datasets, problems


def commented_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """file, title, columns of tab files that begin with a comment block between /* and */ and a header. The block's 'Title:'
    line is kept; a value that does not fit its column's type is null; a column that a file lacks is null."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    body = F.regexp_replace("value", r"(?s)^/\*.*?\*/\r?\n", "")
    split = whole.select("file", F.nullif(F.regexp_extract("value", r"(?m)^Title:\s*(.*?)\s*$", 1), F.lit("")).alias("title"), F.filter(F.split(body, r"\r?\n"), lambda x: x != "").alias("lines"))
    rows = split.select("file", "title", F.split(F.col("lines")[0], "\t", -1).alias("names"), F.explode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line")).withColumn("parts", F.split("line", "\t", -1))
    value = lambda c: F.get("parts", F.array_position("names", c).cast("int") - 1)
    return rows.select("file", "title", *[F.when(F.array_contains("names", c), F.nullif(F.trim(value(c)), F.lit(""))).try_cast(t).alias(c) for c, t in columns.items()])


def profile_index(spark: SparkSession, path: str, parameter: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a profile index: key, file, date, lon, lat, updated and the mode letter of parameter of the lines that
    list it (blank coordinates are null), and the lines that cannot be read, each with its reason and, if the path tells, its key."""
    c = F.split("value", ",", -1)
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("file,") & (F.col("value") != ""))
    key = F.regexp_extract(c[0], r"^(\w+)/(\d+)/profiles/[SBMR]*[RD]?\d+_(\d+D?)\.nc$", 1)
    full = F.concat_ws("_", key, F.regexp_extract(c[0], r"^(\w+)/(\d+)/", 2), F.regexp_extract(c[0], r"_(\d+D?)\.nc$", 1))
    listed, at = F.size(c) == 10, F.array_position(F.split(F.get(c, F.lit(7)), " "), parameter)
    stamp = lambda i: F.try_to_timestamp(F.get(c, F.lit(i)), F.lit("yyyyMMddHHmmss"))
    modes = F.length(F.get(c, F.lit(8)))
    reason = F.when(~listed, "fields").when(key == "", "path").when(stamp(9).isNull(), "update").when((at > 0) & (modes < at), "mode")
    rows = lines.withColumns({"key": F.when(key != "", full), "reason": reason, "place": at})
    good = rows.where("reason IS NULL AND place > 0")
    return good.select("key", c[0].alias("file"), stamp(1).alias("date"), c[3].try_cast("double").alias("lon"), c[2].try_cast("double").alias("lat"), stamp(9).alias("updated"), F.substr(c[8], F.col("place").cast("int"), F.lit(1)).alias("mode")), rows.where("reason IS NOT NULL").select("key", "reason", "value")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """id (sha1 of the feature), kind of the geometry, its coordinates and properties as JSON text, a row per feature."""
    schema = "features array<struct<type: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select(F.sha1(F.to_json("f")).alias("id"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def ragged(header: DataFrame, values: DataFrame, chunk: int = 65_536) -> DataFrame:
    """Per (var, cast_no): its values in order. header (var, cast_no, row_size) and values (var, at, value) meet on the offset
    that the running sum of row sizes gives each variable; a variable whose lengths disagree is left out. Sums run inside
    chunks of cast numbers and then over a row per chunk, so that one variable is not one task."""
    from pyspark.sql import Window as W

    rows = header.withColumn("chunk", F.floor(F.col("cast_no") / chunk))
    sums = rows.groupBy("var", "chunk").agg(F.sum("row_size").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("var").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = W.partitionBy("var", "chunk").orderBy("cast_no")
    spans = rows.withColumn("run", F.sum("row_size").over(inside)).join(sums.select("var", "chunk", before.alias("before")), ["var", "chunk"])
    spans = spans.select("var", "cast_no", "row_size", (F.col("before") + F.col("run")).alias("end")).withColumn("start", F.col("end") - F.col("row_size"))
    held = values.groupBy("var").agg(F.count(F.lit(1)).alias("have"))
    fits = spans.groupBy("var").agg(F.max("end").alias("need")).join(held, "var").where("have = need").select("var")
    at = spans.join(fits, "var").where("row_size > 0").select("var", "cast_no", F.explode(F.sequence("start", F.col("end") - 1)).alias("at"))
    return at.join(values, ["var", "at"]).groupBy("var", "cast_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("vals"))
