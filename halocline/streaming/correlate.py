"""Detections and positions as two streams: an interval join with watermarks finds pairs, a table of results takes them in.

The streams are joined on cell and time bucket (an equi join), with the exact window of event time beside it, so Spark drops
state that no later row can meet. Pairs are appended batch by batch (a batch that runs again writes the same place). Results
follow from the pairs: a detection is classified when the watermark has passed its window, and judged again when a pair
arrives later. Who was heard around matters only without a match, so that stream may leave out the detections that have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.functions.geo import haversine_km
from halocline.operators.spatial import _cell, _neighbours, cell_side

PAIRS = "det_id long, mmsi long, gap double, km double, r_t long"


def pair_stream(detections: DataFrame, positions: DataFrame, radius_km: float, seconds: int, late: str) -> DataFrame:
    """det_id, mmsi, gap, km, r_t of all pairs of two streams within a radius and a time. detections: det_id, ts, lon, lat;
    positions: mmsi, ts, lon, lat. late is how far behind the newest row a row may come."""
    side = cell_side(radius_km)
    bucket = lambda c: F.floor(F.unix_seconds(c) / seconds)
    whole = lambda c: F.date_trunc("second", c)  # noqa: E731  times count in whole seconds
    left = detections.withColumn("ts", whole("ts")).withWatermark("ts", late)
    left = _neighbours(left, radius_km, side).withColumn("tb", F.explode(F.sequence(bucket(F.col("ts")) - 1, bucket(F.col("ts")) + 1)))
    right = positions.select("mmsi", whole("ts").alias("r_ts"), "lon", "lat").withWatermark("r_ts", late)
    right = _cell(right, side).select("mmsi", "r_ts", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), F.col("cx").alias("r_cx"), F.col("cy").alias("r_cy"), bucket(F.col("r_ts")).alias("r_tb"))
    window = (F.col("r_ts") >= F.col("ts") - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col("r_ts") <= F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS"))
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))
    pairs = left.join(right, (F.col("cx") == F.col("r_cx")) & (F.col("cy") == F.col("r_cy")) & (F.col("tb") == F.col("r_tb")) & window & (km <= radius_km))
    gap = F.abs(F.unix_seconds("ts") - F.unix_seconds("r_ts")).cast("double")
    return pairs.select("det_id", "mmsi", gap.alias("gap"), km.alias("km"), F.unix_seconds("r_ts").alias("r_t"))


def collect_pairs(pairs: DataFrame, folder: str, checkpoint: str, nearest: bool = False):
    """Run a pair stream over what there is now; every batch's pairs are a table of their own, one row per detection and vessel
    (the nearest, then the earliest), or the nearest only, one per detection (ties by vessel, then time)."""

    def keep(batch: DataFrame, number: int) -> None:
        if nearest:
            best = batch.groupBy("det_id").agg(F.min(F.struct(F.round("km", 9).alias("km"), "mmsi", "r_t", "gap")).alias("b"))
            best.select("det_id", "b.mmsi", "b.km", "b.r_t", "b.gap").write.mode("overwrite").parquet(f"{folder}/batch={number}")
            return
        best = batch.groupBy("det_id", "mmsi").agg(F.min(F.struct(F.round("km", 9).alias("km"), "r_t", "gap")).alias("b"))
        best.select("det_id", "mmsi", "b.km", "b.r_t", "b.gap").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = pairs.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def classify(detections: DataFrame, close: DataFrame, heard: DataFrame) -> DataFrame:
    """det_id, class, mmsi, gap_s, neighbours from the pairs that have come (of any number of batches): matched by the nearest,
    dark if another vessel was heard around, else ambiguous."""
    best = close.groupBy("det_id").agg(F.min(F.struct(F.col("km"), F.col("mmsi"), F.col("r_t"), F.col("gap"))).alias("m"))
    around = heard.groupBy("det_id").agg(F.count_distinct("mmsi").alias("n"))
    out = detections.select("det_id").join(best, "det_id", "left").join(around, "det_id", "left")
    matched, n = F.col("m").isNotNull(), F.coalesce("n", F.lit(0)).cast("long")
    return out.select("det_id", F.when(matched, "matched").when(n >= 1, "dark").otherwise("ambiguous").alias("class"), F.col("m.mmsi").alias("mmsi"), F.floor("m.gap").alias("gap_s"), F.when(~matched, n).alias("neighbours"))


def judge_again(results: DataFrame, detections: DataFrame, close: DataFrame, heard: DataFrame) -> DataFrame:
    """results where those that have pairs now are classified anew (a later pair may be nearer than the one that matched); all
    others stay as they are."""
    again = results.select("det_id").join(close.select("det_id").unionByName(heard.select("det_id")).distinct(), "det_id", "left_semi")
    fresh = classify(detections.join(again, "det_id", "left_semi"), close, heard)
    return results.join(fresh.select("det_id"), "det_id", "left_anti").unionByName(fresh)
