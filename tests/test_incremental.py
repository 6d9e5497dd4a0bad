"""Kill, replay and late rows: ledgered roll-ups, stream-stream correlation, weekly partitions."""

import datetime

import pytest
from pyspark.sql import functions as F

from halocline.operators.spatial import match_detections
from halocline.plans import incremental
from halocline.plans.incremental import in_order
from halocline.sources import sinks
from halocline.streaming import correlate, ledger

T0 = datetime.datetime(2024, 3, 4)  # a Monday


def log(spark, ids):
    return spark.createDataFrame([(i, T0 + datetime.timedelta(minutes=7 * i), i % 3, i * 10) for i in ids], "id long, ts timestamp, key long, bytes long")


def book_of(spark, folder):
    return ledger.Ledger(spark, str(folder), "id", {"hour": F.date_trunc("hour", "ts"), "key": F.col("key")}, {"n": F.lit(1).cast("long"), "bytes": F.col("bytes")})


def rows_of(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def whole(spark, ids):
    return rows_of(log(spark, ids).groupBy(F.date_trunc("hour", "ts").alias("hour"), "key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")))


def test_a_killed_batch_and_replays_count_once(spark, tmp_path):
    book = book_of(spark, tmp_path)
    assert book.mark() is None
    with pytest.raises(ValueError):
        book.total()
    assert book.add(log(spark, range(50)), 0)
    book.add(log(spark, range(50, 90)), 1, commit=False)  # killed before its ledger row
    assert rows_of(book.total()) == whole(spark, range(50)) and book.mark() == 49
    assert book.add(log(spark, range(50, 100)), 1)  # it runs again, with more rows now
    assert not book.add(log(spark, range(50, 100)), 1)  # replayed after it was committed
    assert rows_of(book.total()) == whole(spark, range(100))
    book.compact()
    assert book.committed().count() == 0 and book.mark() == 99
    assert not book.add(log(spark, range(50, 100)), 1)
    assert not book.add(log(spark, range(100)), 7)  # another checkpoint: other numbers, the same ids
    assert book.add(log(spark, range(90, 130)), 8)
    book.compact()
    book.compact()
    assert rows_of(book.total()) == whole(spark, range(130))


def test_parts_of_a_stream_are_many_files(spark, tmp_path, monkeypatch):
    """A part is written by many tasks, and a batch is still a part, in order."""
    monkeypatch.setattr(incremental, "FILE_ROWS", 10)
    df = log(spark, range(90))
    files = in_order(df, str(tmp_path / "in"), "id", 3)
    assert files == 3 and len(list((tmp_path / "in").glob("*.parquet"))) == 9
    seen = []
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
    each = lambda batch, number: seen.append(sorted(r.id for r in batch.collect()))
    source.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [list(range(k, k + 30)) for k in (0, 30, 60)]


def test_batches_by_size_or_interval(spark, tmp_path):
    in_order(log(spark, range(60)), str(tmp_path / "in"), "id", 3)
    book = book_of(spark, tmp_path / "book")
    source = spark.readStream.schema(log(spark, [1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger.run_batches(source, str(tmp_path / "check"), book).awaitTermination()
    assert book.committed().count() == 3
    in_order(log(spark, range(60, 80)), str(tmp_path / "in"), "id", 1)
    query = ledger.run_batches(source, str(tmp_path / "check"), book, "1 second")
    query.processAllAvailable()
    query.stop()
    assert book.committed().count() == 4 and rows_of(book.total()) == whole(spark, range(80))


def test_stream_join_equals_one_run_with_bounded_state(spark, tmp_path):
    hours = datetime.timedelta(hours=1)
    det = spark.createDataFrame([(i, T0 + 3 * i * hours, 10.0 + (i % 5), 20.0) for i in range(120)], "det_id long, ts timestamp, lon double, lat double").withColumn("at", F.unix_seconds("ts"))
    pos = spark.createDataFrame([(i % 7, T0 + 2 * i * hours + datetime.timedelta(minutes=i % 40), 10.0 + (i % 4) + 0.002, 20.0) for i in range(180)], "mmsi long, ts timestamp, lon double, lat double").withColumn("at", F.unix_seconds("ts"))
    for name, df in (("det", det), ("pos", pos)):
        in_order(df, str(tmp_path / name), "at", 8)
    stream = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)).drop("at")
    held = []
    for name, km, seconds in (("close", 0.5, 600), ("heard", 150.0, 3600)):
        q = correlate.collect_pairs(correlate.pair_stream(stream("det", det), stream("pos", pos), km, seconds, "2 days"), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check"))
        held.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]])
    read = lambda name: spark.read.schema("batch int, det_id long, mmsi long, km double, r_t long, gap double").parquet(str(tmp_path / f"{name}-out"))
    want = rows_of(match_detections(det.select("det_id", "lon", "lat", F.col("at").alias("t")), pos.select("mmsi", "lon", "lat", F.col("at").alias("r_t")), 0.5, 600, 150.0, 3600))
    assert rows_of(correlate.classify(det, read("close"), read("heard"))) == want
    assert {"matched", "dark", "ambiguous"} & {r["class"] for r in correlate.classify(det, read("close"), read("heard")).collect()}
    # State is dropped behind the watermark: at the end it holds far less than all rows (each stands in several cells and buckets).
    assert all(h[-1] < max(h) for h in held)
    early = correlate.classify(det, read("close").where("batch < 3"), read("heard").where("batch < 3"))
    assert rows_of(correlate.judge_again(early, det, read("close"), read("heard"))) == want


def week(spark, days, start=0):
    return spark.createDataFrame([(start + i, T0 + datetime.timedelta(days=d), float(d)) for i, d in enumerate(days)], "pos_id long, ts timestamp, v double")


def test_late_rows_add_and_closed_weeks_reject(spark, tmp_path):
    path = str(tmp_path)
    sinks.write_weekly(week(spark, [0.01 * i for i in range(100)]), path, 0, ["pos_id"], rows_per_file=30)
    assert len({f.rpartition("/")[2] for f in sinks.read_weekly(spark, path).inputFiles()}) >= 3
    sinks.write_weekly(week(spark, [8, 9, 2], 100), path, 1, ["pos_id"])  # one late row of the open week before
    got = {str(r.week): r["count"] for r in sinks.read_weekly(spark, path).groupBy("week").count().collect()}
    assert got == {"2024-03-04": 101, "2024-03-11": 2}
    before = rows_of(sinks.read_weekly(spark, path))
    sinks.write_weekly(week(spark, [8, 9, 2], 100), path, 1, ["pos_id"])  # replayed
    assert rows_of(sinks.read_weekly(spark, path)) == before
    sinks.write_weekly(week(spark, [30], 200), path, 2, ["pos_id"])
    sinks.write_weekly(week(spark, [1, 31], 300), path, 3, ["pos_id"])  # day 1 is closed now
    assert sinks.read_weekly(spark, path).count() == 105
    assert [r.pos_id for r in sinks.read_rejected(spark, path, week(spark, [0]).schema).collect()] == [300]
    assert sinks.read_weekly(spark, path, [datetime.date(2024, 3, 11)]).count() == 2


def test_small_files_of_a_week_share_tasks_and_replays_write_nothing(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.sql("SELECT id, timestamp_seconds(1709510400 + id * 60) AS ts FROM range(100)")
    for _ in range(2):
        sinks.write_weekly(rows, path, 0, ["id"], rows_per_file=2)
    assert [p.name for p in (tmp_path / "w" / "data").glob("version=*")] == ["version=1"]
    files = [p.name for p in (tmp_path / "w" / "data").rglob("*.parquet")]
    assert len(files) >= 50 and len({f.split("-")[1] for f in files}) <= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in sinks.read_weekly(spark, path).collect()) == list(range(100))
