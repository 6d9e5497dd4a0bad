"""Operators that SQL cannot express, against plain Python, and the rules at their edges."""

import math

import pytest
from pyspark.sql import functions as F

from halocline.functions import occurrence, parse
from halocline.operators import grids, models, profiles, snapshots, spatial
from halocline.plans import science
from halocline.plans.standins import table
from halocline.sources import scans, sinks
from halocline.streaming import vessels


def test_track_pieces(spark):
    day = 86400
    points = [(1, 0, 0.5, 0.5, 1.0), (1, day // 2, 1.5, 0.5, 3.0), (1, day // 2 + 60, 1.6, 0.6, None), (1, 3 * day, 2.5, 0.5, 5.0), (1, 3 * day + 60, 9.5, 0.5, 1.0), (1, 3 * day + 120, 9.6, 1.5, 1.0), (1, 3 * day + 180, 9.6, 2.5, 1.0), (1, 3 * day + 240, 9.6, 3.5, 1.0), (1, 366 * day, 9.6, 3.6, 2.0), (2, 0, 179.9, 0.0, 1.0), (2, 60, -179.9, 0.0, 1.0)]
    df = spark.createDataFrame(points, "id long, t long, lon double, lat double, value double")
    got = sorted((r.id, r.year, r.piece, r.n, r["mean"], [tuple(v) for v in r.vertices]) for r in profiles.track_pieces(df, "id", 1.0, jump=3, most=3).collect())
    assert got == [
        (1, 1970, 0, 3, 2.0, [(0.5, 0.5), (1.5, 0.5)]), (1, 1970, 1, 1, 5.0, [(2.5, 0.5)]), (1, 1970, 2, 3, 1.0, [(9.5, 0.5), (9.6, 1.5), (9.6, 2.5)]), (1, 1970, 3, 1, 1.0, [(9.6, 2.5), (9.6, 3.5)]),
        (1, 1971, 0, 1, 2.0, [(9.6, 3.6)]), (2, 1970, 0, 1, 1.0, [(179.9, 0.0)]), (2, 1970, 1, 1, 1.0, [(-179.9, 0.0)]),
    ]


def test_drift_back_by_hand(spark):
    field = [(i, j, 0.1 + i / 100, j / 200 - 0.05) for i in range(12) for j in range(12) if (i, j) != (4, 4)]
    vel = {(i, j): (u, v) for i, j, u, v in field}
    start = [(1, 8.3, 6.2), (2, 5.6, 4.9), (3, 40.0, 3.0)]

    def at(lon, lat):
        return vel.get((math.floor(lon + 0.5), math.floor(lat + 0.5)))

    def degrees(uv, lat):
        return uv[0] * 86400 / (111320 * math.cos(math.radians(lat))), uv[1] * 86400 / 111320

    want = {}
    for k, lon, lat in start:
        age, speed = 0, 0.0
        for _ in range(5):
            stages, place = [], (lon, lat)
            for share in (0.5, 0.5, 1.0, None):
                uv = at(*place)
                if uv is None:
                    break
                stages.append((*degrees(uv, place[1]), math.hypot(*uv)))
                if share:
                    place = lon - stages[-1][0] * share, lat - stages[-1][1] * share
            if len(stages) < 4:
                break
            x, y, q = ((a + 2 * b + 2 * c + d) / 6 for a, b, c, d in zip(*stages, strict=True))
            lon, lat, age, speed = lon - x, lat - y, age + 1, speed + q
        want[k] = (lon, lat, age, speed / age if age else None)
    p = spark.createDataFrame(start, "id long, lon double, lat double")
    f = spark.createDataFrame(field, "i int, j int, u double, v double")
    for r in grids.drift_back(p, f, 5, (0.0, 0.0), 1.0).collect():
        assert (r.lon, r.lat, r.age) == pytest.approx(want[r.id][:3]) and (r.speed is None) == (want[r.id][3] is None)
    assert want[3][2] == 0 and want[1][2] == 5


def test_stream_side_against_one_run(spark, sf):
    whole = {tuple(r) for r in spatial.match_detections(table(spark, sf, "detections"), table(spark, sf, "positions")).select("det_id", "class").collect()}
    assert {tuple(r) for r in science.incremental_matches(spark, sf).collect()} == whole
    again = {r.det_id: r["class"] for r in science.reclassified_matches(spark, sf).collect()}
    assert again.keys() == {k for k, _ in whole} and all(again[k] == c for k, c in whole if again[k] == "ambiguous" or c == "ambiguous")


def test_importance_and_background(spark, sf):
    loss = {r.feature: r.loss for r in science.feature_importance(spark, sf).collect()}
    assert loss["price"] > 0.1 > abs(loss["noise"])
    rows = science.background_sample(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, science.background_sample(spark, sf).collect())) and sum(r.n for r in rows if r.label == 0) <= 500
    nothing = spark.createDataFrame([], "score double, label int")
    assert models.rank_auc(nothing).first().auc is None and models.boyce_index(nothing).first().boyce is None
    gate = spark.createDataFrame([(0.8, 0.5, 60), (0.8, 0.5, 49), (0.69, 0.5, 60), (0.8, 0.0, 60), (0.8, None, 60)], "a double, b double, n int")
    assert [r.g for r in gate.select(models.publish_gate(F.col("a"), F.col("b"), F.col("n")).alias("g")).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("text, proven, want", [
    ("2016-02-30", False, None), ("2016-02-29T24:00", False, (2016, 2, 29)), ("2016-02-29T24:01", False, None), ("2016-01-23 / 2016-02-16", False, (2016, None, None)), ("2016-01-23/2016-01-30", False, (2016, 1, None)), ("2015-12-31/2016-01-01", False, (None, None, None)),
    ("13/02/2001", False, (2001, 2, 13)), ("03/02/2001", False, (2001, None, None)), ("03/02/2001", True, (2001, 2, 3)), ("02/13/2001", True, (2001, None, None)), ("31.02.2001", False, None), ("0999", False, None), ("2001/7", False, (2001, 7, None)), ("2001-7-4T12:30:00Z", False, (2001, 7, 4)), ("soon", True, None), (None, True, None), ("", True, None),
])
def test_written_dates(spark, text, proven, want):
    r = spark.createDataFrame([(text,)], "t string").select(occurrence.written_date(F.col("t"), F.lit(proven)).alias("d")).first().d
    assert (r and tuple(r)) == want


def test_occurrence_rules_at_their_edges(spark):
    df = spark.createDataFrame([(None, None, None), (-5.0, 0.0, -10.0), (-5.0, 3.0, None), (None, 10.0, 20.0), (12000.0, None, None), (0.0, 0.0, 0.0)], "d double, a double, b double")
    assert [r.x for r in df.select(occurrence.resolved_depth(F.col("d"), F.col("a"), F.col("b")).alias("x")).collect()] == [None, 5.0, None, 15.0, None, 0.0]
    flags = spark.createDataFrame([(x,) for x in ("2.0", " 3", "", "\x00", "10", "2.5", "x", None, "-1")], "t string")
    assert [r.f for r in flags.select(occurrence.flag_number(F.col("t")).alias("f")).collect()] == [2, 3] + [None] * 7
    e = spark.createDataFrame([(0, "edna"), (2, None), (None, "x 16S y"), (None, None)], "n int, t string")
    assert [r.f for r in e.select(occurrence.is_edna(F.col("n"), F.col("t")).alias("f")).collect()] == [False, True, True, False]


def test_ranges_need_their_unit(spark):
    rows = [("sea_water_salinity", "psu"), ("sea_water_salinity", "m"), ("sea_surface_temperature", " deg_C "), ("eastward_sea_water_velocity", "cm/s"), ("other", "1"), ("sea_water_temperature", None)]
    lo, hi = parse.range_limits(F.col("n"), F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "n string, u string").select(lo.alias("a"), hi.alias("b")).collect()]
    assert got == [(2.0, 41.0), (None, None), (-2.5, 40.0), (-500.0, 500.0), (None, None), (None, None)]


@pytest.mark.parametrize("lon, lat, x, y", [(179.9, 10.0, -180.0, 10.0), (-179.95, 0.0, 179.0, 0.0), (30.0, 84.0, 35.0, 84.0), (0.0, -88.5, 30.0, -89.0)])
def test_near_zone_over_the_date_line_and_near_the_pole(spark, lon, lat, x, y):
    ring = [(x, y - 0.2), (x + 0.5, y - 0.2), (x + 0.5, y + 0.2), (x, y + 0.2), (x, y - 0.2)]
    zone = spark.createDataFrame([(1, [dict(zip("xy", p, strict=True)) for p in ring], x, y - 0.2, x + 0.5, y + 0.2)], "zone_id int, ring array<struct<x: double, y: double>>, x0 double, y0 double, x1 double, y1 double")
    point = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    assert spatial.near_zone(point, zone, 150.0).count() == 1 and spatial.near_zone(point, zone, 0.5).count() == 0


def test_weekly_partitions_of_a_batch_that_comes_again(spark, tmp_path):
    """What is stored stays, and what comes again (whole or in part) changes nothing."""
    df = spark.sql("SELECT id, timestamp_seconds(id * 86400) AS ts FROM range(30)")
    for number, part in ((0, df), (1, df.where("id >= 20")), (0, df)):
        sinks.write_weekly(part, str(tmp_path / "w"), number, ["id"], open_weeks=10)
    assert sorted(r.id for r in sinks.read_weekly(spark, str(tmp_path / "w")).collect()) == list(range(30))


def test_preamble_lines_are_not_data(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("title\nx\ty\na\tb\n1\tp\n")
    rows, rejects = scans.measured_text(spark, str(tmp_path), ["a", "b"], {"a": "int"})
    assert [(r.a, r.b) for r in rows.collect()] == [(1, "p")] and rejects.count() == 0


def test_untrusted_keys_are_never_gone(spark):
    index = spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 1), ('b', 2), ('c', 1) t(key, updated)")
    rejects = spark.sql("SELECT * FROM VALUES ('d'), (NULL) t(key)")
    stored = spark.sql("SELECT * FROM VALUES ('a', 1, 2), ('b', 1, 2), ('c', 1, 1), ('d', 1, 2), ('e', 1, 2) t(key, stamp, rules)")
    assert {r.key: r.action for r in snapshots.index_plan(index, rejects, stored, 2).collect()} == {"a": "keep", "b": "untrusted", "c": "need", "d": "untrusted", "e": "gone"}


def test_latest_breaks_ties(spark):
    a = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP '2020-01-01', 5), (2L, TIMESTAMP '2020-01-01', 1) t(mmsi, ts, v)")
    b = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP '2020-01-01', 7), (2L, TIMESTAMP '2019-01-01', 9) t(mmsi, ts, v)")
    assert {r.mmsi: r.v for r in vessels.merge_latest(a, b).collect()} == {1: 7, 2: 1} == {r.mmsi: r.v for r in vessels.merge_latest(b, a).collect()}
