"""Operators on small frames with hand-made answers: nulls, ties, edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from halocline.functions import classify, geo
from halocline.operators import grids, models, profiles, rollup, snapshots, spatial
from halocline.sources import scans, sinks
from halocline.streaming import vessels


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_depth_check_value(spark):
    assert abs(one(spark, d=geo.depth_from_pressure(F.lit(10000.0), F.lit(30.0))).d - 9712.653) < 0.01
    assert one(spark, d=geo.depth_from_pressure(F.lit(-3.0), F.lit(30.0))).d == 0.0


def test_morton_matches_bit_loop(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-180, 180), rng.uniform(-85, 85)) for _ in range(50)]
    rows = spark.createDataFrame(points, "lon double, lat double").select("*", geo.morton(F.col("lon"), F.col("lat")).alias("k")).collect()
    n = 1 << geo.GRID_BITS
    for r in rows:
        cx = int((r.lon + 180) / 360 * n)
        cy = int((1 - math.asinh(math.tan(math.radians(r.lat))) / math.pi) / 2 * n)
        want = sum(((cx >> i & 1) << 2 * i) | ((cy >> i & 1) << 2 * i + 1) for i in range(geo.GRID_BITS))
        assert r.k == want
        lo, hi = geo.tile_key_range(5, cx >> 15, cy >> 15)
        assert lo <= r.k < hi


def test_hex_cell_is_nearest_centre(spark):
    rng = random.Random(2)
    edge = 137_000.0
    points = [(rng.uniform(-179, 179), rng.uniform(-80, 80)) for _ in range(100)]
    q, r = geo.hex_cell(F.col("lon"), F.col("lat"), edge)
    rows = spark.createDataFrame(points, "lon double, lat double").select(q.alias("q"), r.alias("r"), geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y")).collect()
    far = lambda p, q, r: math.hypot(p.x - 1.5 * edge * q, p.y - math.sqrt(3) * edge * (r + q / 2))
    for p in rows:
        assert far(p, p.q, p.r) <= min(far(p, p.q + a, p.r + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) + 1e-6


@pytest.mark.parametrize("text, want", [("CC BY-NC 4.0", "cc-by-nc"), ("cc0", "cc0"), ("CC-BY-SA", "cc-by-sa"), ("cc by 4.0", "cc-by"), ("CC BY-ND", "unknown"), ("Restricted", "restricted"), (None, "unknown"), (" ", "unknown"), ("licence", "unknown")])
def test_licence(spark, text, want):
    assert one(spark, x=classify.licence(F.lit(text).cast("string"))).x == want


def test_nulls_of_classifiers(spark):
    null = F.lit(None).cast("int")
    r = one(spark, a=classify.decade(null, 2025), b=classify.depth_band(null), c=classify.good_value(F.lit(1.0), null), d=classify.good_position(null), e=classify.decade(F.lit(2026), 2025), f=classify.decade(F.lit(1949), 2025), g=classify.depth_band(F.lit(200)), h=classify.depth_band(F.lit(1000.5)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (-1, 3, None, True, -1, 1940, 0, 2)


@pytest.mark.parametrize("lon, lat, want", [(0, 70, "Arctic Ocean"), (10, 40, "Mediterranean Sea"), (50, 40, None), (110, 0, None), (-40, 0, "Atlantic Ocean"), (80, -20, "Indian Ocean"), (-150, 0, "Pacific Ocean"), (200, 0, None)])
def test_basin(spark, lon, lat, want):
    assert one(spark, x=classify.basin(F.lit(float(lon)), F.lit(float(lat)))).x == want


def test_ring_edge_counts_as_inside_and_hole_of_box(spark):
    ring = F.expr("array(struct(0D AS x, 0D AS y), struct(4D AS x, 0D AS y), struct(4D AS x, 4D AS y), struct(0D AS x, 0D AS y))")
    at = lambda x, y: one(spark, i=spatial.inside_ring(F.lit(float(x)), F.lit(float(y)), ring)).i
    assert at(3, 1) and at(2, 0) and at(2, 2) and at(4, 4) and not at(1, 3) and not at(5, 0)


def test_within_distance_over_the_date_line_and_far_north(spark):
    a = spark.createDataFrame([(1, 179.999, 0.0), (2, 10.0, 89.0), (3, None, 1.0)], "id int, lon double, lat double")
    b = spark.createDataFrame([(1, -179.999, 0.0), (2, 40.0, 89.0), (3, 1.0, 1.0)], "other int, lon double, lat double")
    got = {(r.id, r.other) for r in spatial.within_distance(a, b, 60.0).collect()}
    assert got == {(1, 1), (2, 2)}


@pytest.mark.parametrize("radius", [0.5, 60.0, 900.0, 8000.0])
def test_within_distance_finds_what_all_pairs_hold(spark, radius):
    rng = random.Random(int(radius))
    special = [(179.9999, 0.0), (-180.0, 0.001), (180.0, -0.001), (0.0, 90.0), (77.0, 89.999), (-103.0, 89.998), (12.0, -90.0), (-168.0, -89.9995), (0.0, 60.0), (0.004, 60.0), (359.999, 59.999)]
    places = special + [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(60)]
    near = [(x + rng.uniform(-1, 1) * radius / 111, max(-90.0, min(90.0, y + rng.uniform(-1, 1) * radius / 111))) for x, y in places]
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, lon double, lat double")
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(places + near)], "other int, lon double, lat double")
    got = [(r.id, r.other) for r in spatial.within_distance(a, b, radius).select("id", "other").collect()]
    km = spatial.haversine_km(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat"))
    want = a.crossJoin(b.withColumnsRenamed({"lon": "r_lon", "lat": "r_lat"})).where(km <= radius).select("id", "other").collect()
    assert len(got) == len(set(got)) and set(got) == {(r.id, r.other) for r in want} and len(got) >= len(places)


def test_counts_near(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 50.0, 50.0), (4, None, 1.0)], "id int, lon double, lat double")
    rows = spark.createDataFrame([(0.0, 0.1, "a"), (0.0, 0.1, "a"), (0.1, 0.0, "b"), (0.1, 0.0, "a"), (0.0, None, "c"), (0.1, 0.1, None), (0.0, 3.0, "z")], "lon double, lat double, v string")
    got = spatial.counts_near(left, {"n": (rows, 20.0, None), "kinds": (rows, 20.0, "v"), "far": (rows, 400.0, None), "none": (rows.limit(0), 9.0, None)}).orderBy("id").collect()
    assert [(r.id, r.n, r.kinds, r.far, r.none) for r in got] == [(1, 5, 2, 6, 0), (2, 5, 2, 6, 0), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0)]


def test_nearest_of_each_widens_until_all_are_answered(spark):
    rng = random.Random(8)
    places = [("dense", i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(300)] + [("one", 900, 179.9, 89.0), ("one", 901, 179.9, 89.0), ("two", 902, -60.0, -45.0), (None, 5, 0.0, 0.0), ("gone", 6, None, 1.0)]
    left = [(0, 0.0, 0.0), (1, -179.99, 10.0), (2, 120.0, 45.0), (3, 0.0, -90.0), (4, 10.0, 4.6), (5, None, 1.0)]
    got = {(r.id, r.src): (round(r.km, 6), r.place) for r in spatial.nearest_of_each(spark.createDataFrame(left, "id long, lon double, lat double"), spark.createDataFrame(places, "src string, place long, lon double, lat double"), "id", "src", "place").collect()}

    def km(a, b):
        (x, y), (u, v) = ([math.radians(c) for c in p] for p in (a, b))
        return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))

    want = {}
    for i, x, y in left[:5]:
        for src in ("dense", "one", "two"):
            d, place = min((km((x, y), p[2:]), p[1]) for p in places if p[0] == src)
            want[i, src] = (round(d, 6), place)
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-3) for k in want)
    assert max(v[0] for v in want.values()) > 15000


def test_match_classes(spark):
    det = spark.createDataFrame([(1, 0.0, 0.0, 1000), (2, 1.0, 0.0, 1000), (3, 9.0, 9.0, 1000)], "det_id long, lon double, lat double, t long")
    pos = spark.createDataFrame([(7, 0.001, 0.0, 1300), (8, 0.001, 0.0, 700), (9, 1.1, 0.0, 4000)], "mmsi long, lon double, lat double, r_t long")
    got = {r.det_id: tuple(r)[1:] for r in spatial.match_detections(det, pos).collect()}
    assert got == {1: ("matched", 7, 300, None), 2: ("dark", None, None, 1), 3: ("ambiguous", None, None, 0)}


def test_facets_keep_every_row(spark):
    rows = [("a", 180.0, 90.0, None, None, True), ("a", -180.0, -90.0, 1949, 200.0, False), ("b", 10.0000001, 5.0, 2030, 200.5, False), ("b", 10.0000002, 5.0, 1950, 1000.0, True)]
    o = spark.createDataFrame(rows, "grp string, lon double, lat double, year int, depth double, edna boolean")
    cube = rollup.facet_cube(o, 2025)
    grid = rollup.grid_facets(cube, 1.0)
    assert all(r.ok for r in rollup.conservation(o, {"cube": cube, "grid": grid}).collect())
    assert {(r.cx, r.cy) for r in grid.collect()} == {(179, 89), (-180, -90), (10, 5)}
    top = {(r.cx, r.cy): (r.total, r.top_group, r.groups) for r in rollup.cell_rollup(grid, ["a", "b"]).collect()}
    assert top[(10, 5)] == (2, "b", 2)


def test_lod_levels_add_up(spark):
    points = spark.createDataFrame([(i, i * 37 % 4096, 2000 + i % 2, float(i), 1.0, None if i % 3 else float(i)) for i in range(60)], "id long, key long, year int, x double, y double, v double")
    fine = rollup.lod_base(points, 6, 5, ["v"])
    coarse = rollup.lod_coarser(rollup.lod_coarser(fine, ["v"]), ["v"])
    a, b = (x.agg(F.sum("n").alias("n"), F.sum("sx").alias("x"), F.sum("s_v").alias("s"), F.sum("c_v").alias("c")).first() for x in (fine, coarse))
    assert tuple(a) == tuple(b) == (60, 1770.0, 570.0, 20)


def test_horizon(spark):
    rows = [(1, 0.0, 2.0), (1, 100.0, None), (1, 200.0, 0.0), (2, 50.0, 0.5), (3, 0.0, 2.0), (3, 10.0, 1.0)]
    got = {r.c: r.horizon for r in grids.crossing_depth(spark.createDataFrame(rows, "c int, depth double, value double"), ["c"]).collect()}
    assert got == {1: 100.0, 2: 50.0, 3: float("inf")}
    assert one(spark, x=grids.horizon_shift(F.lit(float("inf")), F.lit(3.0))).x is None
    assert one(spark, x=grids.horizon_shift(F.lit(2.0), F.lit(3.0))).x == 0.0


def test_block_of_gaps(spark):
    f = spark.createDataFrame([(0, 0, None), (7, 0, 2.0), (8, 1, 4.0)], "i int, j int, value double")
    assert {(r.bi, r.mean, r.valid) for r in grids.block_mean(f).collect()} == {(0, None, 0), (1, 3.0, 2)}


def test_track_back_stops_at_a_gap(spark):
    f = spark.createDataFrame([(i, 0, 1.0, 0.0) for i in (3, 4, 5)], "i int, j int, u double, v double")
    got = grids.track_back(spark.createDataFrame([(1, 5.0, 0.0)], "id int, lon double, lat double"), f, 6, (0.0, 0.0), 1.0).first()
    assert got.lon == 2.0 and got.age == 3  # the midpoint 2.5 still belongs to node 3


def test_segments_walk_matches_windows_and_limits(spark):
    rows = [(1, t, lon, 0.0) for t, lon in [(0, 0.0), (10, 0.1), (30000, 0.2), (30010, 1.5), (30020, 1.6), (30030, 1.7)]]
    track = spark.createDataFrame(rows, "k int, t long, lon double, lat double")
    assert [r.segment for r in profiles.segments(track, "k").orderBy("t").collect()] == [1, 1, 2, 2, 2, 2]
    assert [r.segment for r in profiles.bounded_segments(track, "k", limit=2).orderBy("t").collect()] == [1, 1, 2, 3, 3, 4]


def test_thinning_keeps_ends(spark):
    rows = spark.createDataFrame([(1, i) for i in range(23)], "k int, t int")
    got = [r.t for r in profiles.thin_evenly(rows, "k", ["t"], 5).orderBy("t").collect()]
    assert got[0] == 0 and got[-1] == 22 and len(got) <= 6


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, None, "b")], "id int, v int, s string")
    new = spark.createDataFrame([(1, None, "c"), (3, 7, None)], "id int, v int, s string")
    assert {tuple(r) for r in snapshots.coalescing_upsert(old, new, "id").collect()} == {(1, 5, "c"), (2, None, "b"), (3, 7, None)}
    assert {tuple(r) for r in snapshots.change_only_upsert(old, new, "id", ["v", "s"]).collect()} == {(1, "update"), (3, "insert")}
    assert {r.id for r in snapshots.append_new(old, new.union(new), ["id"]).collect()} == {3}


@pytest.mark.parametrize("seen, complete, verdict", [(range(100), True, "nothing"), (range(3, 100), True, "purge"), (range(40), True, "refuse"), (range(3, 100), False, "refuse")])
def test_purge_guard(spark, seen, complete, verdict):
    stored = spark.createDataFrame([(i, i % 3) for i in range(100)], "id int, dataset int")
    got = snapshots.purge_verdict(stored, spark.createDataFrame([(i,) for i in seen], "id int"), "id", "dataset", F.lit(complete)).first()
    assert got.verdict == verdict


def test_absent_dataset_and_null_dataset_meet_the_strict_ceiling(spark):
    stored = spark.createDataFrame([(i, None if i < 20 else 1) for i in range(100)], "id int, dataset int")
    got = snapshots.purge_verdict(stored, spark.createDataFrame([(i,) for i in range(15, 100)], "id int"), "id", "dataset", F.lit(True)).first()
    assert got.verdict == "refuse" and got.absent == 15


def test_publish_all_or_none(spark, tmp_path):
    df = spark.range(3)
    assert not sinks.publish({"a": df}, str(tmp_path), "v1", lambda t: t["a"].count() == 4)
    assert not (tmp_path / "versions").exists()
    assert sinks.publish({"a": df}, str(tmp_path), "v2", lambda t: t["a"].count() == 3)
    assert spark.read.json(str(tmp_path / "versions")).first().version == "v2"


def test_csv_and_geojson(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "=1+1", None)], "lon double, lat double, name string, url string")
    sinks.write_csv(df, str(tmp_path / "c"), {"url": "u", "licence": "cc0"})
    got = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert got.columns == ["lon", "lat", "name", "url", "source_url", "licence"] and got.first().name == "'=1+1"
    assert sinks.geojson_features(df).first().value == '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"name":"=1+1","url":null}}'


def test_nested_scan_reads_absent_fields_as_null(spark, tmp_path):
    spark.sql("SELECT 'x' AS _id, 'd' AS dataset_id, named_struct('scientificName', 's', 'minimumDepthInMeters', 10D, 'maximumDepthInMeters', 20D, 'decimalLatitude', 1D, 'decimalLongitude', 2D) AS interpreted").write.parquet(str(tmp_path / "o"))
    r = scans.occurrences(spark, str(tmp_path / "o")).first()
    assert (r.depth, r.year, r.dropped, r.flags) == (15.0, None, False, None)


def test_measured_text(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# note\na\tb\n1\tx\n2\t\n3\n")
    rows, rejects = scans.measured_text(spark, str(tmp_path / "t.tsv"), ["a", "b"], {"a": "int"})
    assert {(r.a, r.b) for r in rows.collect()} == {(1, "x"), (2, None)} and [r.value for r in rejects.collect()] == ["3"]
    with pytest.raises(ValueError):
        scans.measured_text(spark, str(tmp_path / "t.tsv"), ["b", "a"], {})


def test_profile_index(spark, tmp_path):
    line = "%s,20200101000000,1.5,,A,1,X,%s,%s,20200102000000\n"
    text = line % ("dac/12/profiles/SR12_001.nc", "TEMP DOXY", "RD") + line % ("dac/12/profiles/SR12_002D.nc", "TEMP", "R") + line % ("a.nc", "TEMP DOXY", "RD") + line % ("dac/12/profiles/SR12_003.nc", "TEMP DOXY", "R") + "broken\n"
    (tmp_path / "i.txt").write_text("# c\nfile,date,latitude,longitude,ocean,type,institution,parameters,modes,update\n" + text)
    rows, rejects = scans.profile_index(spark, str(tmp_path / "i.txt"), "DOXY")
    r = rows.collect()
    assert len(r) == 1 and (r[0].key, r[0].mode, r[0].lat, r[0].lon) == ("dac_12_001", "D", 1.5, None)
    assert sorted((x.reason, x.key) for x in rejects.collect() if x.key) == [("mode", "dac_12_003")] and sorted(x.reason for x in rejects.collect()) == ["fields", "mode", "path"]


def test_ragged_rejects_one_variable_only(spark):
    header = spark.createDataFrame([("t", 0, 2), ("t", 1, 1), ("s", 0, 2), ("s", 1, 1)], "var string, cast_no int, row_size int")
    values = spark.createDataFrame([("t", i, float(i)) for i in range(3)] + [("s", 0, 1.0)], "var string, at long, value double")
    assert {(r["var"], r.cast_no, tuple(r.vals)) for r in scans.ragged(header, values).collect()} == {("t", 0, (0.0, 1.0)), ("t", 1, (2.0,))}


def test_stream_and_batch_agree(spark, tmp_path):
    frame = '{"MessageType":"PositionReport","MetaData":{"MMSI":%d,"time_utc":"2024-01-01 %02d:00:00"},"Message":{"Latitude":%s,"Longitude":1,"Sog":5,"TrueHeading":511}}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join([frame % (1, 0, "2"), frame % (1, 0, "2"), frame % (2, 1, "91"), frame % (2, 2, "3")]))
    batch, _ = vessels.decode(spark.read.text(str(tmp_path / "in")))
    want = {(r.mmsi, str(r.ts)) for r in vessels.once(batch).collect()}
    stream, _ = vessels.decode(spark.readStream.text(str(tmp_path / "in")))
    q = vessels.once(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("once").collect()
    assert {(r.mmsi, str(r.ts)) for r in got} == want and len(got) == 2 and all(r.heading is None for r in got)


def test_open_flag_is_not_raised_again(spark):
    flags = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "key_id int, flag string")
    held = spark.createDataFrame([(1, "a", None)], "key_id int, flag string, acknowledged_at timestamp")
    assert [tuple(r) for r in vessels.open_flags(flags, held).collect()] == [(2, "a")]


def test_background_is_repeatable_and_boyce(spark):
    p = spark.range(100).select(F.col("id").cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    assert models.background(p, 7).collect() == models.background(p.repartition(3), 7).collect()
    s = spark.createDataFrame([(0.1, 0), (0.1, 1), (0.95, 1), (1.0, 1)], "score double, label int")
    assert {r.bin: r.ratio for r in models.boyce(s).collect()} == {1: pytest.approx(1 / 3), 9: None}
