"""Adaptive covers: holes, parts, edges, the date line and world-sized zones, against the even-odd rule on whole rings."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from halocline.operators import zones as Z
from halocline.plans import registry


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def star(rng, x, y, size, n):
    return ring(*[(x + r * math.cos(a), y + r * math.sin(a) / 2) for i in range(n) for a, r in ((2 * math.pi * i / n, size * (0.3 + 0.7 * rng.random())),)])


def odd(rings, x, y):
    n = 0
    for r in rings:
        for a, b in zip(r, r[1:], strict=False):
            if (a["y"] > y) != (b["y"] > y) and a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]) > x:
                n += 1
    return n % 2 == 1


def frame(spark, zones):
    return spark.createDataFrame(zones, "zone_id long, rings array<array<struct<x: double, y: double>>>")


def test_points_in_zones_of_every_shape(spark):
    rng = random.Random(6)
    zones = [
        (1, [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((3, 3), (6, 3), (6, 6), (3, 6))]),
        (2, [ring((170, -20), (200, -20), (200, 20), (170, 20))]),  # over the date line
        (3, [ring((-179, -89), (179, -89), (179, 89), (-179, 89)), star(rng, 20, 20, 40, 300)]),  # the world with a ragged hole
        (4, [star(rng, -100, 30, 25, 400), star(rng, 100, -30, 12, 60)]),
        (5, [star(rng, 178, 10, 8, 200)]),
        (6, [star(rng, -178, -10, 8, 200)]),  # on beyond -180 to the west
        (7, []), (8, None),
    ]
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(3000)] + [(3000 + i, (178 + rng.uniform(-9, 9) + 180) % 360 - 180, rng.uniform(-20, 20)) for i in range(1500)] + [(9000, None, 1.0), (9001, 5.0, None)]
    df = spark.createDataFrame(points, "id long, lon double, lat double")
    want = {(i, z) for z, rings in zones if rings for i, x, y in points if x is not None and y is not None and any(odd(rings, x + turn, y) for turn in (-360, 0, 360))}
    covered = Z.cover(frame(spark, zones)).cache()
    got = [(r.id, r.zone_id) for r in Z.points_in(df, covered).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # The world is covered by its border and a few inner cells, not by all degree cells; edges are dealt out, not copied.
    cells = covered.where("zone_id = 3").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("edges")).alias("most")).first()
    assert cells.n < 1500 and cells.most <= Z.EDGES
    plan = Z.points_in(df, covered)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("point, held", [((0.0, 5.0), True), ((10.0, 10.0), True), ((3.0, 4.0), True), ((4.5, 4.5), False), ((6.0, 6.0), True), ((10.0000001, 5.0), False), ((-1e-9, 5.0), False)])
def test_edges_and_corners_are_inside(spark, point, held):
    zones = frame(spark, [(1, [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((3, 3), (6, 3), (6, 6), (3, 6))])])
    df = spark.createDataFrame([point], "lon double, lat double")
    assert (Z.points_in(df, Z.cover(zones)).count() == 1) == held


@pytest.mark.parametrize("lon, held", [(175.0, True), (180.0, True), (-180.0, True), (-175.0, True), (-160.0, True), (-159.9, False), (169.9, False), (0.0, False)])
def test_a_zone_across_the_date_line(spark, lon, held):
    df = spark.createDataFrame([(lon, 1.0)], "lon double, lat double")
    for rings in ([ring((170, -20), (200, -20), (200, 20), (170, 20))], [ring((-190, -20), (-160, -20), (-160, 20), (-190, 20))]):
        assert (Z.points_in(df, Z.cover(frame(spark, [(1, rings)]))).count() == 1) == held


def test_no_zones_and_no_points(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "lon double, lat double")
    assert Z.points_in(df, Z.cover(frame(spark, []))).count() == 0
    assert Z.points_in(df.limit(0), Z.cover(frame(spark, [(1, [ring((0, 0), (2, 0), (2, 2))])]))).count() == 0


@pytest.mark.parametrize("a, b, area", [
    (ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((2, 2), (6, 2), (6, 6), (2, 6)), 4.0),
    (ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((2, 6), (6, 6), (6, 2), (2, 2)), 4.0),  # the other way round
    (ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2)), 1.0),
    (ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((5, 5), (6, 5), (6, 6)), 0.0),
    (ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4)), ring((0, 2), (4, 2), (4, 4), (0, 4)), 4.0 * 2 / 3),  # two tips of a notched shape
    (ring((0, 0), (2, 0), (0, 2)), ring((0, 0), (4, 0), (4, 4), (0, 4)), 2.0),
])
def test_clipped_areas(spark, a, b, area):
    df = spark.createDataFrame([(a, b)], "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    assert df.select(Z.clipped_area(F.col("a"), F.col("b")).alias("v")).first().v == pytest.approx(area)


def test_equal_area_of_a_cap(spark):
    df = spark.createDataFrame([(ring((10, 20), (40, 20), (40, 60), (10, 60)),)], "a array<struct<x: double, y: double>>")
    want = 6371.0**2 * math.radians(30) * (math.sin(math.radians(60)) - math.sin(math.radians(20)))
    a = Z.equal_area(F.col("a"))
    assert df.select(Z.clipped_area(a, a).alias("v")).first().v == pytest.approx(want, rel=1e-9)


def test_small_zones_meet_few_points(spark):
    """A zone far smaller than a root cell is cut to its own size, though it has few edges; what holds a place is counted and
    ranked as from the single pairs."""
    rng = random.Random(9)
    zones = [(i, [ring((x, y), (x + 3, y), (x + 3, y + 3), (x, y + 3)), ring((x + 1, y + 1), (x + 2, y + 1), (x + 2, y + 2), (x + 1, y + 2))]) for i in range(30) for x, y in [(rng.uniform(-10, 10), rng.uniform(-10, 10))]]
    zones.append((99, [ring((-179, -89), (179, -89), (179, 89), (-179, 89))]))
    covered = Z.cover(frame(spark, zones)).withColumn("rank", 1000 - F.col("zone_id")).cache()
    edged = covered.where("zone_id < 30").where(F.size("edges") > 0)
    assert edged.agg(F.max(F.lit(Z.ROOT) / F.pow(2.0, "level"))).first()[0] <= 3 / Z.FINE
    points = spark.createDataFrame([(rng.uniform(-12, 14), rng.uniform(-12, 14)) for _ in range(2000)], "lon double, lat double")
    pairs = Z.points_in(points, covered).groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("zones"), F.min(1000 - F.col("zone_id")).alias("least"))
    assert sorted(map(tuple, Z.least_of(points, covered, "rank").collect())) == sorted(map(tuple, pairs.collect()))


def test_zones_of_the_same_rings_are_covered_once(spark, sf, tmp_path, monkeypatch):
    """Suppliers 3600 apart have the same rings; each still counts, and the rows are those of the SQL."""
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    suppliers.withColumn("s_suppkey", F.col("s_suppkey") + F.col("copy") * 3600).drop("copy").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber < 3").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, real = [], Z.cover
    monkeypatch.setattr(Z, "cover", lambda zones: (seen.append(zones.count()), real(zones))[1])
    got = sorted(map(tuple, registry.QUERIES["points_in_holed_zones"](spark, str(tmp_path)).collect()))
    assert seen[0] <= spark.read.parquet(f"{sf}/supplier.parquet").count() + 1
    duck = duckdb.connect()
    for t in ("supplier", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(duck.execute(registry.ORACLE_SQL["points_in_holed_zones"]).fetchall()) and got
