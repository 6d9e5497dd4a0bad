"""The position stream: message decoding, duplicate suppression, hourly roll-up, latest state, retention."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halocline.operators.spatial import KM_PER_DEGREE

MESSAGE = "MessageType string, MetaData struct<MMSI: long, ShipName: string, time_utc: string>, Message struct<Latitude: double, Longitude: double, Sog: double, Cog: double, TrueHeading: int, NavigationalStatus: int>"


def decode(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, identities) of JSON frames in column value. Out-of-range coordinates are dropped, heading 511 is null."""
    m = frames.select(F.from_json("value", MESSAGE).alias("m"))
    ts = F.try_to_timestamp(F.col("m.MetaData.time_utc"))
    pos = m.where("m.MessageType = 'PositionReport'").select(F.col("m.MetaData.MMSI").alias("mmsi"), ts.alias("ts"), F.col("m.Message.Longitude").alias("lon"), F.col("m.Message.Latitude").alias("lat"), F.col("m.Message.Sog").alias("sog"), F.nullif(F.col("m.Message.TrueHeading"), F.lit(511)).alias("heading"))
    who = m.where("m.MessageType = 'ShipStaticData'").select(F.col("m.MetaData.MMSI").alias("mmsi"), ts.alias("ts"), F.trim("m.MetaData.ShipName").alias("name"))
    return pos.where("lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90"), who


def once(positions: DataFrame, late: str = "7 days") -> DataFrame:
    """Positions without repeats of (mmsi, ts); state is kept as long as a repeat may come late."""
    if positions.isStreaming:
        return positions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts"])
    return positions.dropDuplicates(["mmsi", "ts"])


def hourly(positions: DataFrame, late: str = "7 days") -> DataFrame:
    """hour, vessels (messages) and mean speed per hour; on a stream a window closes when the watermark passes it."""
    rows = positions.withWatermark("ts", late) if positions.isStreaming else positions
    return rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("messages"), F.avg("sog").alias("speed")).select(F.col("w.start").alias("hour"), "messages", "speed")


def merge_latest(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The newest row per mmsi of a table and a micro-batch, ties by the other columns in order (for foreachBatch; the table is written to a new version)."""
    rows = old.unionByName(batch)
    others = [c for c in rows.columns if c != "mmsi"]
    return rows.groupBy("mmsi").agg(F.max(F.struct("ts", *[c for c in others if c != "ts"])).alias("r")).select("mmsi", *[F.col("r")[c].alias(c) for c in others])


def watch_boxes(latest: DataFrame, degrees: float) -> DataFrame:
    """A box around each vessel's newest position."""
    return latest.select("mmsi", (F.col("lon") - degrees).alias("x0"), (F.col("lat") - degrees).alias("y0"), (F.col("lon") + degrees).alias("x1"), (F.col("lat") + degrees).alias("y1"))


def buffered_boxes(latest: DataFrame, km: float) -> DataFrame:
    """mmsi, part, x0, y0, x1, y1: the boxes around all that lies within km of a vessel's newest position (lon, lat). A circle that
    holds a pole has a box all round; one over the date line has two (part 0 west of the line, part 1 east of it)."""
    reach = km / KM_PER_DEGREE
    south, north = F.greatest(F.col("lat") - reach, F.lit(-90.0)), F.least(F.col("lat") + reach, F.lit(90.0))
    polar = F.abs("lat") + reach >= 90
    half = F.degrees(F.asin(F.least(F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians("lat")), F.lit(1.0))))
    x0, x1 = F.col("lon") - half, F.col("lon") + half
    box = lambda part, west, east: F.struct(F.lit(part).alias("part"), west.alias("x0"), east.alias("x1"))
    whole = F.array(box(0, F.lit(-180.0), F.lit(180.0)))
    over_east, over_west = F.array(box(0, x0, F.lit(180.0)), box(1, F.lit(-180.0), x1 - 360)), F.array(box(0, x0 + 360, F.lit(180.0)), box(1, F.lit(-180.0), x1))
    boxes = F.when(polar, whole).when(x1 > 180, over_east).when(x0 < -180, over_west).otherwise(F.array(box(0, x0, x1)))
    known = latest.where("lon IS NOT NULL AND lat IS NOT NULL").select("mmsi", south.alias("y0"), north.alias("y1"), F.explode(boxes).alias("b"))
    return known.select("mmsi", "b.part", "b.x0", "y0", "b.x1", "y1")


def open_flags(flags: DataFrame, existing: DataFrame) -> DataFrame:
    """New (key_id, flag) rows without an open flag of the same kind."""
    return flags.dropDuplicates(["key_id", "flag"]).join(existing.where("acknowledged_at IS NULL").select("key_id", "flag"), ["key_id", "flag"], "left_anti")


def split_late(rows: DataFrame, batch: str, weeks: int = 1) -> DataFrame:
    """rows (ts and the number of their micro-batch) with late: whether their week is older than the weeks that stay open before
    the newest week of earlier batches. Only one row per batch is put in order."""
    week = F.date_trunc("week", F.col("ts"))
    marks = rows.groupBy(F.col(batch).alias("m_batch")).agg(F.max(week).alias("newest"))
    before = Window.orderBy("m_batch").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("open", F.max("newest").over(before))
    return rows.join(marks.select("m_batch", "open"), F.col(batch) == F.col("m_batch")).withColumn("late", F.coalesce(week < F.col("open") - F.expr(f"INTERVAL {7 * weeks} DAYS"), F.lit(False))).drop("m_batch", "open")


def correlate_pending(detections: DataFrame, results: DataFrame, positions: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """results with those of detections that have none yet, matched against positions (said: their records, if there are some)."""
    from halocline.operators.spatial import match_detections

    pending = detections.join(results.select("det_id"), "det_id", "left_anti")
    return results.unionByName(match_detections(pending, positions, said=said).select(results.columns))


def reclassify(results: DataFrame, detections: DataFrame, positions: DataFrame) -> DataFrame:
    """results where ambiguous ones are judged again with the positions that came since; others stay."""
    from halocline.operators.spatial import match_detections

    again = detections.join(results.where("class = 'ambiguous'").select("det_id"), "det_id", "left_semi")
    return results.where("class <> 'ambiguous'").unionByName(match_detections(again, positions).select(results.columns))


def run_to_end(source: DataFrame, checkpoint: str, each) -> None:
    """Run a stream over what there is now, in micro-batches as its source limits them; each(batch, number) gets every one once."""
    source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_counted(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Per mmsi the newest (ts, pos_id) of both, and the sum of rows_seen."""
    both = old.unionByName(batch).groupBy("mmsi").agg(F.max(F.struct("ts", "pos_id")).alias("r"), F.sum("rows_seen").alias("rows_seen"))
    return both.select("mmsi", "r.ts", "r.pos_id", "rows_seen")
