"""Queries on streams that are killed, replayed and late: a ledgered roll-up, a stream-stream correlation, open weeks."""

from pyspark.sql import functions as F

from halocline.plans.book import query
from halocline.plans.spatial import AB
from halocline.plans.standins import table
from halocline.sources import scratch, sinks
from halocline.streaming import correlate, ledger


#: Rows of a stream's file.
FILE_ROWS = 250_000


def in_order(df, folder: str, by: str, parts: int) -> int:
    """df as parts in order of a number, written one after the other, so that a stream reads them in that order. A part is files
    of about FILE_ROWS rows; their number in a part, to be read at a time, is returned. (If a part has a file less, a batch
    reads one of the next part early; the order stays.)"""
    low, high = df.agg(F.min(by), F.max(by)).first()
    if low is None:
        return 1
    cuts = [low + (high + 1 - low) * k / parts for k in range(parts + 1)]
    inside = [(F.col(by) >= a) & (F.col(by) < b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    files = max(1, -(-max(df.agg(*[F.count_if(x) for x in inside]).first()) // FILE_ROWS))
    for part in inside:
        df.where(part).repartition(files, by).write.mode("append").parquet(folder)
    return files


@query("T1 T5", "SELECT date_trunc('hour', ts) AS hour, key_id, count(*) AS n, count(*) FILTER (status >= 400) AS errors, sum(bytes)::BIGINT AS bytes FROM requests GROUP BY ALL")
def ledgered_hours(spark, d):
    """Requests as a stream of files, rolled up by hour and key. The second batch is killed between its sums and its ledger row and
    runs again, one batch is replayed, the rows are compacted, and in the end the whole stream is read anew without its
    checkpoint: every row counts once."""
    folder = scratch.folder(spark, "ledger")
    rows = table(spark, d, "requests").select(F.col("event_id").cast("long").alias("event_id"), "ts", "key_id", "status", "bytes")
    files = in_order(rows, f"{folder}/in", "event_id", 4)
    book = ledger.Ledger(spark, folder, "event_id", {"hour": F.date_trunc("hour", "ts"), "key_id": F.col("key_id")}, {"n": F.lit(1).cast("long"), "errors": (F.col("status") >= 400).cast("long"), "bytes": F.col("bytes").cast("long")})
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    second = rows.where(F.col("event_id") >= 0)
    book.add(second, 1, commit=False)  # killed; what it wrote counts for nothing
    ledger.run_batches(source(), f"{folder}/checkpoint", book).awaitTermination()
    book.add(rows, 2)  # replayed
    book.compact()
    ledger.run_batches(source(), f"{folder}/other", book).awaitTermination()  # the checkpoint was lost
    return book.total().withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("T6 T10", f"""
WITH m AS (SELECT det_id, mmsi, abs(t - r_t) AS gap, row_number() OVER (PARTITION BY det_id ORDER BY round({AB}, 9), mmsi, r_t) AS rn FROM detections a JOIN positions b ON abs(t - r_t) <= 600 AND {AB} <= 0.5),
h AS (SELECT det_id, count(DISTINCT mmsi) AS n FROM detections a JOIN positions b ON abs(t - r_t) <= 3600 AND {AB} <= 50 GROUP BY det_id)
SELECT d.det_id, CASE WHEN m.det_id IS NOT NULL THEN 'matched' WHEN coalesce(h.n, 0) >= 1 THEN 'dark' ELSE 'ambiguous' END AS class, m.mmsi, m.gap AS gap_s, CASE WHEN m.det_id IS NULL THEN coalesce(h.n, 0) END AS neighbours
FROM detections d LEFT JOIN m ON m.det_id = d.det_id AND m.rn = 1 LEFT JOIN h ON h.det_id = d.det_id""")
def streamed_correlation(spark, d):
    """Detections and positions as two streams; first results are made from the first half of the pairs and judged again with all."""
    folder = scratch.folder(spark, "correlation")
    det = table(spark, d, "detections").select(F.col("det_id").cast("long").alias("det_id"), "ts", "lon", "lat", F.col("t").alias("at"))
    pos = table(spark, d, "positions").select(F.col("mmsi").cast("long").alias("mmsi"), "ts", "lon", "lat", F.col("r_t").alias("at"))
    files = {name: in_order(rows, f"{folder}/{name}", "at", 3) for name, rows in (("det", det), ("pos", pos))}
    stream = lambda name, rows: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files[name]).parquet(f"{folder}/{name}").drop("at")
    read = lambda name: spark.read.schema("batch int, det_id long, mmsi long, km double, r_t long, gap double").parquet(f"{folder}/{name}")
    # Files are a third of the time span each and in order, so no row comes later than a third.
    run = lambda name, asked, km, seconds, nearest: correlate.collect_pairs(correlate.pair_stream(asked, stream("pos", pos), km, seconds, "40 days"), f"{folder}/{name}", f"{folder}/{name}-checkpoint", nearest)
    run("close", stream("det", det), 0.5, 600, True)
    run("heard", stream("det", det).join(read("close").select("det_id").distinct(), "det_id", "left_anti"), 50.0, 3600, False)
    early = correlate.classify(det, read("close").where("batch < 2"), read("heard").where("batch < 2"))
    return correlate.judge_again(scratch.written(early, "early"), det, read("close"), read("heard"))


@query("S24 T3", """
WITH p AS (SELECT pos_id, ts, date_trunc('week', ts)::DATE AS week, pos_id % 4 AS batch FROM positions), n AS (SELECT max(week) AS newest FROM p),
o AS (SELECT week, batch, week < newest - 14 AND batch = 3 AS closed FROM p, n)
SELECT week, count(*) FILTER (NOT closed) AS stored, count(*) FILTER (closed) AS rejected FROM o GROUP BY week""")
def open_weeks(spark, d):
    """Positions come in four batches, and each again. The first three find all weeks open (nothing is closed while the bound is
    years back), the fourth only the newest three: its rows of older weeks go to the side table, those of open weeks join what
    is stored."""
    path = scratch.folder(spark, "weeks")
    p = table(spark, d, "positions").select("pos_id", "mmsi", "ts")
    for number in range(4):
        batch = p.where(F.col("pos_id") % 4 == number)
        for _ in range(2):
            sinks.write_weekly(batch, path, number, ["pos_id"], open_weeks=2 if number == 3 else 1000, rows_per_file=5000)
    stored = sinks.read_weekly(spark, path).groupBy("week").agg(F.count(F.lit(1)).alias("stored"))
    closed = sinks.read_rejected(spark, path, p.schema).groupBy("week").agg(F.count(F.lit(1)).alias("rejected"))
    return stored.join(closed, "week", "full").select("week", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("rejected", F.lit(0)).alias("rejected"))
