"""Places in an order, exact quantiles and walks in chunks against plain Python, with one key that holds most rows."""

import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from halocline.functions import occurrence
from halocline.operators import models, ordered, profiles


def tracks(seed, n=900):
    rng = random.Random(seed)
    out = []
    for key, size in ((1, n), (2, 40), (3, 1)):
        t, lon, lat = 0, 179.5 if key == 1 else 10.0, 0.0
        for _ in range(size):
            t += rng.choice([60, 60, 60, 600, 30_000, 86_400 * 2]) if rng.random() < 0.2 else 60
            lon = (lon + rng.choice([0, 0.05, 0.1, -0.1, 0.4]) + 180) % 360 - 180
            lat += rng.choice([0, 0.02, -0.02])
            out.append((key, t, round(lon, 3), round(lat, 3), rng.choice([None, 1.0, 2.0, 4.0])))
    rng.shuffle(out)
    return out


def by_key(rows):
    held = collections.defaultdict(list)
    for r in rows:
        held[r[0]].append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2], r[3], r[4] is not None, r[4] or 0)) for k, v in held.items()}


def plain_segments(rows, gap, span, limit):
    out = []
    for key, walk in by_key(rows).items():
        number, held = 0, []
        for r in walk:
            box = [*held, r]
            width = max(max(x[i] for x in box) - min(x[i] for x in box) for i in (2, 3))
            if not held or len(held) >= limit or r[1] - held[-1][1] > gap or abs(r[2] - held[-1][2]) > 180 or width > span:
                number, held = number + 1, []
            held.append(r)
            out.append((key, r[1], r[2], r[3], number))
    return sorted(out)


@pytest.mark.parametrize("chunk, limit", [(16, 7), (64, 30), (1 << 16, 512)])
def test_segments_of_a_long_track(spark, monkeypatch, chunk, limit):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    rows = tracks(chunk)
    df = spark.createDataFrame(rows, "k long, t long, lon double, lat double, value double").select("k", "t", "lon", "lat").repartition(5)
    got = profiles.bounded_segments(df, "k", 20_000, 1.0, limit)
    assert sorted(map(tuple, got.collect())) == plain_segments(rows, 20_000, 1.0, limit)
    assert got.columns == ["k", "t", "lon", "lat", "segment"]


def plain_pieces(rows, cell, gap, jump, most):
    out = []
    for key, walk in by_key(rows).items():
        pieces, before = [], None
        for r in walk:
            at = (math.floor(r[2] / cell), math.floor(r[3] / cell))
            steps = 0 if before is None else max(abs(at[0] - before[1][0]), abs(at[1] - before[1][1]))
            broken = before is None or r[1] - before[0][1] > gap or abs(r[2] - before[0][2]) > 180 or steps > jump
            if broken:
                pieces.append([[], [(r[2], r[3])]])
            elif steps and len(pieces[-1][1]) >= most:
                pieces.append([[], [pieces[-1][1][-1], (r[2], r[3])]])
            elif steps:
                pieces[-1][1].append((r[2], r[3]))
            pieces[-1][0].append(r[4])
            before = r, at
        for i, (values, corners) in enumerate(pieces):
            known = [v for v in values if v is not None]
            out.append((key, i, len(values), round(statistics.fmean(known), 6) if known else None, corners))
    return sorted(out)


@pytest.mark.parametrize("chunk, most", [(16, 4), (50, 2), (1 << 16, 6)])
def test_pieces_of_a_long_track(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    rows = [r for r in tracks(chunk + most) if r[1] < 360 * 86_400]
    df = spark.createDataFrame(rows, "k long, t long, lon double, lat double, value double").repartition(5)
    got = profiles.track_pieces(df, "k", 0.09, 50_000, 3, most).collect()
    assert sorted((r.k, r.piece, r.n, None if r["mean"] is None else round(r["mean"], 6), [tuple(v) for v in r.vertices]) for r in got) == plain_pieces(rows, 0.09, 50_000, 3, most)


def test_a_hot_key_lies_in_many_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), ((F.col("id") * 7919) % 20_000).alias("t")).repartition(4)
    got = ordered.numbered(df, ["k"], ["t"])
    assert got.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("d"), F.max("pos").alias("m")).where("n <> d OR m <> n - 1").isEmpty()
    assert got.alias("a").where("k = 7 AND pos = 100").first().t == sorted(i * 7919 % 20_000 for i in range(20_000) if i % 3)[100]
    spread = df.repartitionByRange(4, "k", "t").select(F.spark_partition_id().alias("p"), "k").where("k = 7").distinct().count()
    assert spread > 1


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_exact(spark, by):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([rng.gauss(0, 1), 1.0, 1.0, None, float("nan")])) for _ in range(3000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    points = [0.0, 0.01, 0.5, 0.999, 1.0]
    got = {(r["g"] if by else 0, r.q): (r.value, r.n) for r in ordered.quantiles(df, "v", points, by).collect()}
    for g in {r[0] for r in rows} if by else [0]:
        v = sorted(x for k, x in rows if (k == g or not by) and x is not None and x == x)
        for p in points:
            if not v:
                assert (g, p) not in got
                continue
            at = p * (len(v) - 1)
            low, high = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            assert got[g, p] == (pytest.approx(low + (high - low) * (at - int(at)), abs=1e-12), len(v))
    assert ordered.quantiles(df.limit(0), "v", points, by).count() == 0


def test_auc_of_close_scores(spark):
    auc = lambda rows: models.rank_auc(spark.createDataFrame(rows, "score double, label int")).first().auc
    assert auc([(0.5 + 1e-6 * i, int(i >= 50)) for i in range(100)]) == 1.0
    assert auc([(0.5 - 1e-9 * i, int(i >= 50)) for i in range(100)]) == 0.0
    assert auc([(0.5, i % 2) for i in range(10)]) == 0.5
    rng = random.Random(3)
    rows = [(rng.choice([rng.random(), 0.3, 0.7]), rng.randint(0, 1)) for _ in range(400)]
    p, q = ([s for s, y in rows if y == label] for label in (1, 0))
    assert auc(rows) == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q)))
    assert auc([(0.1, 1)]) is None and auc([(None, 1), (0.2, None)]) is None


def test_dates_compile(spark):
    """Spark falls back to interpretation where the code of an expression is too large; the plan must not hold copies of it."""
    df = spark.createDataFrame([("2001-02-03", True)], "text string, day_first boolean")
    none = F.lit(None).cast("int")
    out = df.select(occurrence.resolved_date(F.col("text"), F.col("day_first"), F.lit(None).cast("date"), F.lit(None).cast("date"), none, none, none).alias("r"))
    assert tuple(out.first().r) == (2001, 2, 3, "text")
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_group_names_at_every_rank(spark):
    ranks = ["class", "subclass", "ord", "phylum", "division", "subphylum", "infraphylum"]
    rows = [("d", "Bacillariophyta", "division"), ("d", "Bacillariophyta", "phylum"), ("f", "Dinoflagellata", "subphylum"), ("f", "Dinoflagellata", "infraphylum"), ("f", "Dinoflagellata", "division"), (None, "Bacillariophyta", "subphylum"), (None, "x", "class")]
    df = spark.createDataFrame([(w, *[name if r == rank else None for r in ranks]) for w, name, rank in rows], "want string, " + ", ".join(f"{r} string" for r in ranks))
    got = df.select("want", occurrence.taxon_group(*[F.col(r) for r in ranks]).alias("g")).collect()
    assert [(r.g or "-")[:1] for r in got] == ["d", "d", "d", "d", "d", "-", "-"] and [r.g for r in got][:3] == ["diatoms", "diatoms", "dinoflagellates"]


def test_no_registered_query_is_empty(spark):
    from halocline.plans import registry

    for name in ("thinned_points", "date_spikes", "pending_lookups"):
        assert not registry.QUERIES[name](spark, "/root/testdata/sf0.01").isEmpty(), name
