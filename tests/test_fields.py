"""Closed axes, ensembles of fold models, buffers in km, sectioned text."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import grids, models
from halocline.sources import scans
from halocline.streaming import vessels


def test_a_block_over_the_seam(spark):
    """Longitudes of 10 degrees; a block of three columns holds 170, 180 (= -180) and -170."""
    field = spark.createDataFrame([(i, j, float(i) if (i, j) != (0, 1) else None) for i in range(36) for j in range(2)], "i int, j int, value double")
    got = {(r.bi, r.bj): (r["mean"], r.valid) for r in grids.block_mean(field, 3, 36, 35).collect()}
    assert got[0, 0] == (14.4, 5)  # columns 35, 0 and 1 of both rows, one a gap
    assert len(got) == 12 and got[1, 0] == (3.0, 6)
    uneven = {r.bi: r.valid for r in grids.block_mean(field.where("j = 0"), 5, 36, 0).collect()}
    assert uneven == {**dict.fromkeys(range(7), 5), 7: 1}
    points = spark.createDataFrame([(179.0, 0.0), (-179.0, 0.0), (174.0, 0.0)], "lon double, lat double")
    assert [r.value for r in grids.sample(points, field.where("j = 0"), (-180.0, 0.0), 10.0, 36).collect()] == [0.0, 0.0, 35.0]


def plain_fit(x, y, w):
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]), x.T @ (w * (y - p)))
    return beta


def test_ensemble_of_fold_models(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1] - 1)))).astype(float)
    fold = np.arange(400) % 3
    rows = spark.createDataFrame([(float(a), float(b), float(c), int(f)) for (a, b), c, f in zip(x, y, fold, strict=True)], "a double, b double, label double, fold int")
    cells = spark.createDataFrame([(i, float(i) / 3 - 2, 1 - float(i) / 4) for i in range(12)], "cell int, a double, b double")
    got = {r.cell: (r["mean"], r["std"]) for r in models.predict_ensemble(models.fold_models(rows, ["a", "b"], 3, reg=0.0), cells, ["a", "b"]).collect()}
    said = []
    for f in range(3):
        keep = fold != f
        w = np.where(y[keep] == 1, 1.0, y[keep].sum() / (1 - y[keep]).sum())
        beta = plain_fit(x[keep], y[keep], w)
        said.append([1 / (1 + math.exp(-(beta[0] + beta[1] * (i / 3 - 2) + beta[2] * (1 - i / 4)))) for i in range(12)])
    for i in range(12):
        assert got[i] == (pytest.approx(np.mean([s[i] for s in said]), abs=1e-4), pytest.approx(np.std([s[i] for s in said]), abs=1e-4))
    none = models.fold_models(rows.withColumn("label", F.lit(1.0)), ["a", "b"], 3)
    assert none == [] and models.predict_ensemble(none, cells, ["a", "b"]).first()["mean"] is None


@pytest.mark.parametrize("lon, lat, boxes", [
    (0.0, 0.0, [(0, -0.899, 0.899)]), (179.9, 0.0, [(0, 179.001, 180.0), (1, -180.0, -179.201)]), (-179.9, 0.0, [(0, 179.201, 180.0), (1, -180.0, -179.001)]), (10.0, 89.5, [(0, -180.0, 180.0)]), (0.0, 60.0, [(0, -1.799, 1.799)]),
])
def test_buffers_in_km(spark, lon, lat, boxes):
    got = vessels.buffered_boxes(spark.createDataFrame([(1, lon, lat), (2, None, lat)], "mmsi long, lon double, lat double"), 100.0).orderBy("part").collect()
    assert [(r.part, pytest.approx(r.x0, abs=2e-3), pytest.approx(r.x1, abs=2e-3)) for r in got] == boxes
    assert all(r.mmsi == 1 and -90 <= r.y0 < r.y1 <= 90 for r in got)


def test_sections_of_a_text(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("title\nZ\t1\nCode\tname\nA\tone\nB\ttwo\nB\ttwo again\nC\tthree\n\nD\tnote\ncode\tv\nA\t1\nB\t2\nB\t3\nD\t4\ncut\nA\tx\n")
    (tmp_path / "b.tsv").write_text("Code\tname\nD\tfour\ncode\tv\nD\t9\n\tempty\n")
    rows, rejects, datasets, problems = scans.sectioned_text(spark, str(tmp_path), ["Code", "name"], ["code", "v"], {"v": "int"}, "code")
    name = lambda r: r.file[-5]
    assert sorted((name(r), r.Code) for r in datasets.collect()) == [("a", "A"), ("a", "B"), ("a", "B"), ("a", "C"), ("b", "D")]
    assert sorted((name(r), r.code or "", r.reason, r.rows) for r in problems.collect()) == [("a", "B", "repeated", 2), ("a", "C", "missing", 0), ("a", "D", "unlisted", 1), ("b", "", "unlisted", 1)]
    assert rows.count() == 7 and [r.value for r in rejects.collect()] == ["cut"]


def test_nearest_without_a_radius_opens_few_cells(spark):
    """Against all distances; one source is dense and far from most of the places."""
    import random

    from halocline.operators import spatial

    rng = random.Random(9)
    left = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(60)] + [(100, 180.0, 0.0), (101, -180.0, 90.0), (102, None, 1.0)]
    right = [("dense", i, rng.gauss(100, 2), rng.gauss(-40, 2)) for i in range(1500)] + [("poles", 1, 0.0, 90.0), ("poles", 2, 10.0, -90.0), ("line", 3, -179.99, 1.0), (None, 4, 0.0, 0.0), ("gone", 5, None, 0.0)]
    got = {(r.id, r.src): (round(r.km, 6), r.place) for r in spatial.nearest_of_each(spark.createDataFrame(left, "id long, lon double, lat double"), spark.createDataFrame(right, "src string, place long, lon double, lat double"), "id", "src", "place").collect()}

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return round(2 * 6371.0 * math.asin(min(1.0, math.sqrt(h))), 6)

    want = {}
    for i, x, y in left:
        for src in ("dense", "poles", "line"):
            if x is not None:
                want[i, src] = min((km((x, y), r[2:]), r[1]) for r in right if r[0] == src)
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0], abs=1e-5) for k in want)
