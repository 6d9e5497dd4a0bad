"""Work that must not grow with rows that are alike: what meets in a join, and how often a table or a text is read."""

import math
import random

from pyspark.sql import functions as F

from halocline.operators import profiles as P
from halocline.operators import spatial as S
from halocline.plans import registry
from halocline.sources import scratch
from halocline.streaming import correlate


def thrice(spark, sf, folder, name, key, shift):
    """A table three times over with shifted keys."""
    t = spark.read.parquet(f"{sf}/{name}.parquet").crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    t.withColumn(key, F.col(key) + F.col("copy") * shift).drop("copy").write.parquet(f"{folder}/{name}.parquet")


def recorded(monkeypatch, name):
    """The DataFrames that a spatial operator is called with."""
    real, seen = getattr(S, name), []
    monkeypatch.setattr(S, name, lambda *args: (seen.append(args), real(*args))[1])
    return seen


def test_a_claim_is_made_once_for_a_place_and_hour(spark, sf, tmp_path, monkeypatch):
    thrice(spark, sf, tmp_path, "events", "event_id", 7_000_000)  # at the same places
    seen = recorded(monkeypatch, "within_distance")
    assert registry.QUERIES["one_claim_per_target"](spark, str(tmp_path)).count() == registry.QUERIES["one_claim_per_target"](spark, sf).count() > 0
    det, pos = seen[0][:2]
    assert det.groupBy("hour", "lon", "lat").count().where("count > 1").isEmpty() and pos.groupBy("r_hour", "lon", "lat").count().where("count > 1").isEmpty()


def test_detections_of_one_place_and_time_are_matched_once(spark, monkeypatch):
    det = spark.createDataFrame([(i, 10.0, 20.0, 1000) for i in range(9)] + [(10, 10.0, 40.0, 1000), (11, 10.0, 40.0, 1000), (12, None, 40.0, 1000)], "det_id long, lon double, lat double, t long")
    pos = spark.createDataFrame([(m, 10.001, 20.0, 900) for m in (5, 3, 4)] + [(6, 10.001, 20.0, 800), (7, 10.2, 40.0, 900), (8, 10.2, 40.0, 900)], "mmsi long, lon double, lat double, r_t long")
    seen = recorded(monkeypatch, "within_time_and_distance")
    got = {r.det_id: (r["class"], r.mmsi, r.gap_s, r.neighbours) for r in S.match_detections(det, pos).collect()}
    assert got == {i: ("matched", 3, 100, None) for i in range(9)} | {10: ("dark", None, None, 2), 11: ("dark", None, None, 2), 12: ("ambiguous", None, None, 0)}
    assert [seen[0][0].where("lon IS NOT NULL").count(), seen[0][1].count(), seen[1][0].where("lon IS NOT NULL").count()] == [2, 3, 1]


def test_equal_paths_are_asked_once(spark, monkeypatch):
    square = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    zones = spark.createDataFrame([(4, 0.0, 0.0, 1.0, 1.0, square)], "zone_id long, x0 double, y0 double, x1 double, y1 double, ring array<struct<x: double, y: double>>")
    path = lambda lon: [{"x": lon, "y": 0.5}, {"x": lon + 0.1, "y": 0.5}]
    paths = spark.createDataFrame([(i, lon, 0.5, path(lon)) for i in range(30) for lon in [(0.95, 1.1, 9.0)[i % 3]]], "id long, lon double, lat double, path array<struct<x: double, y: double>>")
    seen = recorded(monkeypatch, "near_zone")
    got = {r.id: (r.zone_id, r.fallback) for r in S.path_zone(paths, zones, 50.0).collect()}
    assert got == {i: (4, i % 3 == 1) for i in range(30) if i % 3 < 2} and seen[0][0].count() == 2


def test_an_export_reads_its_table_once(spark, sf):
    df = registry.QUERIES["area_export"](spark, sf)
    assert "Subquery" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_of_one_name_and_place_are_one_row(spark, sf):
    """Both sides are aggregated before they meet, and the pairs after that."""
    df = registry.QUERIES["file_links"](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3


def test_sections_are_in_many_files(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "folder", lambda spark, name: f"{tmp_path}/{name}")
    assert registry.QUERIES["sectioned_scan"](spark, sf).count() == 4
    assert len({f.rpartition("/")[0] for f in spark.read.text(f"{tmp_path}/sections").inputFiles()}) >= 13


def test_dates_are_read_once_for_each_form(spark, sf):
    """The records are joined with the forms that were read, and no record's text is taken apart."""
    df = registry.QUERIES["resolved_dates"](spark, sf)
    records = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in records


def test_a_later_nearer_pair_wins(spark):
    """A detection that an early pair matched is judged again when a nearer one comes; one without new pairs stays as it was."""
    det = spark.createDataFrame([(1,), (2,), (3,)], "det_id long")
    close = spark.createDataFrame([(0, 1, 7, 0.4, 100, 9.0), (2, 1, 8, 0.1, 120, 11.0), (2, 2, 9, 0.2, 50, 3.0)], "batch int, det_id long, mmsi long, km double, r_t long, gap double")
    heard = close.where("false")
    early = correlate.classify(det, close.where("batch < 2"), heard)
    got = {r.det_id: (r["class"], r.mmsi, r.gap_s) for r in correlate.judge_again(early, det, close, heard).collect()}
    assert got == {1: ("matched", 8, 11), 2: ("matched", 9, 3), 3: ("ambiguous", None, None)}


def test_short_tracks_share_a_call(spark):
    """Tracks that one chunk holds need no tables of chunks: they are walked together, each on its own, with the results of the walk in chunks."""
    rows = [(k if k < 500 else None, t * 60, (t * 7 + (k or 0)) % 5 * 0.3, 0.1 * (t % 3), float(t)) for k in range(501) for t in range(k % 11 + 1)]
    track = spark.createDataFrame(rows, "key long, t long, lon double, lat double, value double")
    cut = P.bounded_segments(track, "key", gap_s=600, limit=4)
    got = [(r.key, r.t // 60, r.segment) for r in cut.collect()]
    assert len(got) == len(rows) == len(set(got))
    # Segments end at four rows or over a degree; each track begins with its own first.
    for k in (5, 10, 499, None):
        mine, begin, number, want = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:4]), 0, 1, []
        for i, r in enumerate(mine):
            held = [x[2] for x in mine[begin : i + 1]]
            if i - begin >= 4 or max(held) - min(held) > 1.0:
                begin, number = i, number + 1
            want.append((i, number))
        assert sorted((p, s) for key, p, s in got if key == k) == want
    whole = track.where("key IS NOT NULL")
    for df in (P.bounded_segments(whole, "key", gap_s=600, limit=4), P.track_pieces(whole, "key", 0.002, most=8)):
        assert "CoGroup" not in df._jdf.queryExecution().executedPlan().toString()


def test_dense_positions_are_not_met_one_by_one(spark, monkeypatch):
    """Detections with positions in their own small cell meet those only, and of these the few that can be the nearest; the rows are those of all pairs."""
    rng = random.Random(4)
    lon, lat = [10 + 0.002 * i for i in range(3)] + [10.4], [20.0, 20.0011]
    pos = [(m % 40 if m % 9 else None, rng.randrange(6000), rng.choice(lon[:3]), rng.choice(lat)) for m in range(3000)] + [(77, 300, 10.4, 20.0)]
    det = [(i, rng.randrange(9000), rng.choice(lon), rng.choice(lat)) for i in range(300)] + [(5, 100, 10.0, 20.0), (5, 8000, 10.4, 20.0), (None, 100, 10.0, 20.0), (901, None, 10.0, 20.0), (902, 8000, 10.4, 20.0), (902, 8000, 10.0, 20.0)]
    km = lambda a, b: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2))
    want = []
    for key, *_ in det:
        own = [d for d in det if d[0] == key and key is not None and d[1] is not None]
        near = [(round(km(d, p), 9), p[0] is None, p[0] or 0, p[1], abs(d[1] - p[1]), p[0]) for d in own for p in pos if abs(d[1] - p[1]) <= 600 and km(d, p) <= 0.5]
        heard = len({p[0] for d in own for p in pos if p[0] is not None and abs(d[1] - p[1]) <= 3600 and km(d, p) <= 50})
        want.append((key, "matched", min(near)[5], min(near)[4], None) if near else (key, "dark" if heard else "ambiguous", None, None, heard))
    seen = recorded(monkeypatch, "within_time_and_distance")
    frames = spark.createDataFrame(det, "det_id long, t long, lon double, lat double"), spark.createDataFrame(pos, "mmsi long, r_t long, lon double, lat double")
    got = S.match_detections(*frames).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    asked = {(d[2], d[3], d[1]) for d in det if d[0] is not None and d[1] is not None}
    assert seen[0][0].count() < len(asked) / 2 and seen[0][1].count() < 800


def test_instalments_share_what_was_said(spark, sf, monkeypatch):
    """The positions are reduced to records once, not for every instalment, and no whole run is made beside them."""
    called = []
    for name in ("records", "match_detections"):
        monkeypatch.setattr(S, name, lambda *args, real=getattr(S, name), name=name, **more: (called.append(name), real(*args, **more))[1])
    registry.QUERIES["incremental_matches"](spark, sf)
    assert sorted(called) == ["match_detections", "match_detections", "records"]
