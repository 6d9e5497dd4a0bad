"""Sinks: GeoJSON and CSV exports with provenance, WKT, tables in weekly partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

FORMULA = "=+-@"


def wkt(ring: Column) -> Column:
    """A closed ring array<struct<x, y>> as a WKT polygon."""
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"], p["y"])), ","), F.lit("))"))


def guard_formula(text: Column, starts: str = FORMULA) -> Column:
    """An apostrophe before a text that a spreadsheet would take for a formula."""
    return F.when(F.substring(text, 1, 1).isin(*starts), F.concat(F.lit("'"), text)).otherwise(text)


def geojson_features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One column, value: a GeoJSON point feature per row; other columns are its properties, nulls kept."""
    rest = [F.col(c) for c in df.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def write_csv(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """CSV with a header; provenance columns are renamed where they collide; texts are guarded against formulas."""
    columns = [guard_formula(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    extra = [F.lit(v).alias(f"source_{k}" if k in df.columns else k) for k, v in provenance.items()]
    df.select(*columns, *extra).write.mode("overwrite").option("header", True).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: Rows that a task writes at least, in one file or many.
TASK_ROWS = 500_000
WEEKS = "week date, version long, n long"


def _weeks(spark: SparkSession, path: str) -> DataFrame:
    """week, version, n: where the rows of each week are (a row per week)."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], WEEKS)
    return spark.read.schema(WEEKS).json(f"{path}/manifest/*").groupBy("week").agg(F.max(F.struct("version", "n")).alias("r")).select("week", "r.version", "r.n")


def write_weekly(batch: DataFrame, path: str, number: int, key: list[str], ts: str = "ts", open_weeks: int = 1, rows_per_file: int = 4_000_000) -> None:
    """Adds a batch (its number, so that it may run again) to a table in weekly partitions. The newest stored week, the open_weeks
    before it and all later ones are open: their stored rows and the new ones (by key; what is stored stays) become a new
    version of the week, in files of about rows_per_file rows by range of time; a week without new rows stays as it is. A task
    writes files of TASK_ROWS rows, however small they are. Rows of closed weeks go to a side table. The
    manifest row that readers follow is written last, so a week is seen before or after the batch, never between."""
    spark = batch.sparkSession
    rows = batch.withColumn("week", F.to_date(F.date_trunc("week", ts)))
    known = {r.week: r for r in _weeks(spark, path).collect()}  # a row per week
    still = F.col("week").isNull()
    if known:
        still |= F.col("week") < F.date_sub(F.lit(max(known)), 7 * open_weeks)
    touched = {r.week for r in rows.where(~still).select("week").distinct().collect()} & set(known)  # the stored open weeks of a batch
    stored = lambda weeks: spark.read.schema(batch.schema).parquet(*[f"{path}/data/version={known[w].version}/week={w}" for w in weeks])
    new = rows.dropDuplicates(key).withColumn("closed_", still)
    if touched:
        old = stored(touched).select(*[F.col(k).alias(f"old_{i}") for i, k in enumerate(key)])
        new = new.join(old, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"old_{i}") for i, k in enumerate(key)], ~F.col("closed_")), "left_anti")
    # Written once, so that all that follows sees the same rows; the next batch writes over it.
    new.write.mode("overwrite").parquet(f"{path}/staged")
    new = spark.read.schema(new.schema).parquet(f"{path}/staged")
    new.where("closed_").drop("closed_").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
    new = new.where("NOT closed_").drop("closed_")
    n = {r.week: r["count"] + (known[r.week].n if r.week in known else 0) for r in new.groupBy("week").count().collect()}
    if not n:
        return
    both = new
    if again := n.keys() & known.keys():
        both = stored(again).withColumn("week", F.to_date(F.date_trunc("week", ts))).select(new.columns).unionByName(new)
    version = max((r.version for r in known.values()), default=0) + 1
    files = max(len(n), sum(-(-x // rows_per_file) for x in n.values()))
    tasks = min(files, max(spark.sparkContext.defaultParallelism, -(-sum(n.values()) // max(rows_per_file, TASK_ROWS))))
    most = rows_per_file if tasks < files else 2 * rows_per_file
    both.repartitionByRange(tasks, "week", ts).sortWithinPartitions("week", ts).write.mode("overwrite").option("maxRecordsPerFile", most).partitionBy("week").parquet(f"{path}/data/version={version}")
    rows_of = [(w, version, x) for w, x in n.items()]
    spark.createDataFrame(rows_of, WEEKS).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{version}")


def read_weekly(spark: SparkSession, path: str, weeks: list | None = None) -> DataFrame:
    """The table as of now, or only some of its weeks (dates)."""
    at = _weeks(spark, path).collect()  # a row per week
    parts = [f"{path}/data/version={r.version}/week={r.week}" for r in at if weeks is None or r.week in weeks]
    return spark.read.parquet(*parts).withColumn("week", F.to_date(F.date_trunc("week", "ts")))


def read_rejected(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that came for weeks that were closed, with their week and batch."""
    if not _exists(spark, f"{path}/rejected"):
        return spark.createDataFrame([], StructType([*schema.fields, StructField("week", DateType())]))
    return spark.read.schema(StructType([*schema.fields, StructField("week", DateType()), StructField("batch", LongType())])).parquet(f"{path}/rejected")


def retained(table: DataFrame, now: Column, weeks: int) -> DataFrame:
    """The rows of the newest weeks; the filter is on the partition column."""
    return table.where(F.col("week") >= F.date_sub(F.to_date(F.date_trunc("week", now)), 7 * weeks))


def publish(tables: dict[str, DataFrame], folder: str, version: str, valid) -> bool:
    """Write all tables under folder/version, then let valid(tables read back) decide; the pointer row that readers follow
    is written last, so all tables go live or none."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    if not valid({name: spark.read.parquet(f"{folder}/{version}/{name}") for name in tables}):
        return False
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").json(f"{folder}/versions")
    return True


def write_geojson(df: DataFrame, path: str, cap: int, provenance: dict[str, str]) -> None:
    """One feature collection of at most cap rows (in order of their columns), with metadata: provenance, count and capped. The
    cap bounds the one file."""
    part = df.orderBy(*df.columns).limit(cap + 1)
    total = part.agg(F.count(F.lit(1))).scalar()
    rows = geojson_features(df.orderBy(*df.columns).limit(cap)).agg(F.collect_list("value").alias("f"))
    meta = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in provenance.items()], F.size("f").alias("count"), (F.col("total") > cap).alias("capped")))
    text = F.concat(F.lit('{"type":"FeatureCollection","metadata":'), meta, F.lit(',"features":['), F.array_join("f", ","), F.lit("]}"))
    rows.withColumn("total", total).select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)
