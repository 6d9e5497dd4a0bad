"""Profiles, tracks and series: latest rows, picks, thinning, segments. Ties are broken by the columns named."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.functions.geo import fold_lon, haversine_km
from halocline.operators import ordered
from halocline.operators.ordered import bounded_cuts
from halocline.sources import scratch


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key by order, as one aggregate (partial maxima before the shuffle)."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def stride(rows: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    """Every s-th row of each key, s the least stride that leaves about limit rows."""
    w = W.partitionBy(key)
    out = rows.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(w))
    return out.where(F.pmod(F.col("rn"), F.greatest(F.lit(1), F.floor(F.col("total") / limit)).cast("int")) == 0).drop("rn", "total")


def thin_evenly(rows: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    """At most limit rows of each key, evenly spaced, with the first and the last."""
    w = W.partitionBy(key)
    out = rows.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.ceil((F.col("total") - 1) / F.lit(float(limit - 1)))).cast("int")
    return out.where((F.pmod(F.col("i"), step) == 0) | (F.col("i") == F.col("total") - 1)).drop("i", "total")


def standard_depths(levels: DataFrame, key: str, windows: list[tuple[float, float]]) -> DataFrame:
    """key, target, depth, value: the good level nearest to each target within its window; ties to the shallower."""
    table = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.lit(float(w)).alias("half")) for t, w in windows])
    near = levels.where("value IS NOT NULL").select(key, "depth", "value", F.inline(table)).where(F.abs(F.col("depth") - F.col("target")) <= F.col("half"))
    best = near.groupBy(key, "target").agg(F.min(F.struct(F.abs(F.col("depth") - F.col("target")).alias("off"), "depth", "value")).alias("b"))
    return best.select(key, "target", "b.depth", "b.value")


def surface_and_deep(levels: DataFrame, key: str, surface: float = 50.0) -> DataFrame:
    """Per cast: the shallowest value at most surface deep, and the deepest level, with depths."""
    ok = (F.col("depth") <= surface) & F.col("value").isNotNull()
    return levels.groupBy(key).agg(
        F.min(F.when(ok, F.col("depth"))).alias("surface_depth"), F.min_by(F.when(ok, F.col("value")), F.when(ok, F.col("depth"))).alias("surface_value"),
        F.max("depth").alias("deep_depth"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("depth"))).alias("deep_value"),
    )


def thin_bins(levels: DataFrame, key: str, width: float, cap: int) -> DataFrame:
    """The best (rank, then depth) level of each depth bin; of these the cap shallowest."""
    bins = levels.withColumn("bin", F.floor(F.col("depth") / width))
    best = bins.withColumn("rn", F.row_number().over(W.partitionBy(key, "bin").orderBy("rank", "depth", "value"))).where("rn = 1")
    return best.withColumn("at", F.row_number().over(W.partitionBy(key).orderBy("depth"))).where(F.col("at") <= cap).drop("rn", "at", "bin")


def best_instance(rows: DataFrame, keys: list[str], rank: dict[str, int], mode: str, newest: str, name: str) -> DataFrame:
    """One row per keys: best mode by rank, then the newest, then by name; losers is the number of rows given up."""
    order = F.coalesce(*[F.when(F.col(mode) == m, r) for m, r in rank.items()], F.lit(99))
    w = W.partitionBy(*keys)
    return rows.withColumn("rn", F.row_number().over(w.orderBy(order, F.desc(newest), name))).withColumn("losers", F.count(F.lit(1)).over(w) - 1).where("rn = 1").drop("rn")


def segments(track: DataFrame, key: str, gap_s: int = 6 * 3600) -> DataFrame:
    """track (key, t, lon, lat) with segment: a new one after a gap over gap_s or across the date line."""
    w = W.partitionBy(key).orderBy("t", "lon", "lat")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > gap_s) | (F.abs(F.col("lon") - F.lag("lon").over(w)) > 180), F.lit(True))
    return track.withColumn("new", new.cast("int")).withColumn("segment", F.sum("new").over(w)).drop("new")


def bounded_segments(track: DataFrame, key: str, gap_s: int = 6 * 3600, span: float = 1.0, limit: int = 512) -> DataFrame:
    """As segments, also ending a segment at limit rows or a span over span degrees; those depend on where it began. Tracks of
    any length are cut in chunks (see ordered.bounded_cuts)."""

    def next_cut(rows: pd.DataFrame) -> np.ndarray:
        t, lon, lat = (rows[c].to_numpy() for c in ("t", "lon", "lat"))
        n = len(rows)
        forced = np.append(np.flatnonzero((np.diff(t) > gap_s) | (np.abs(np.diff(lon)) > 180)) + 1, n)
        here = np.arange(n)
        out = np.minimum(forced[np.searchsorted(forced, here, "right")], here + limit)
        # Widen the boxes of all segments row by row; those that leave the span end there.
        box, alive = [lon.copy(), lon.copy(), lat.copy(), lat.copy()], here
        for step in range(1, limit):
            alive = alive[alive + step < out[alive]]
            if not len(alive):
                break
            x, y = lon[alive + step], lat[alive + step]
            for b, v, widen in zip(box, (x, x, y, y), (np.minimum, np.maximum, np.minimum, np.maximum), strict=True):
                b[alive] = widen(b[alive], v)
            far = (box[1][alive] - box[0][alive] > span) | (box[3][alive] - box[2][alive] > span)
            out[alive[far]] = alive[far] + step
        return out

    return bounded_cuts(track, [key], ["t", "lon", "lat"], next_cut, limit).drop("pos")


def trail(track: DataFrame, key: str) -> DataFrame:
    """Per key: points, great-circle length in order of time, first and last time."""
    w = W.partitionBy(key).orderBy("t", "lon", "lat")
    km = haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return track.withColumn("km", km).groupBy(key).agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("km"), F.lit(0.0)).alias("km"), F.min("t").alias("t0"), F.max("t").alias("t1"))


def cruise_extent(track: DataFrame, key: str) -> DataFrame:
    """Per key: west and east of the unwrapped track, folded back, and whether it crosses the date line."""
    w = W.partitionBy(key).orderBy("t", "lon", "lat")
    delta = F.pmod(F.col("lon") - F.lag("lon").over(w) + 180.0, F.lit(360.0)) - 180.0
    first = F.first("lon").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    wrapped = track.withColumn("delta", F.coalesce(delta, F.lit(0.0))).withColumn("first", first).withColumn("u", F.col("first") + F.sum("delta").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    fold = lambda c: F.pmod(c + 180.0, F.lit(360.0)) - 180.0
    return wrapped.groupBy(key).agg(fold(F.min("u")).alias("west"), fold(F.max("u")).alias("east"), (F.floor((F.min("u") + 180.0) / 360.0) != F.floor((F.max("u") + 180.0) / 360.0)).alias("crosses"))


def month_stamped(samples: DataFrame, key: str) -> DataFrame:
    """key, precision: month if a leg has several distinct stamps and all are midnight on a first; else time."""
    first = (F.dayofmonth("ts") == 1) & (F.date_trunc("day", "ts") == F.col("ts"))
    return samples.groupBy(key).agg(F.when(F.bool_and(first) & (F.count_distinct("ts") > 1), "month").otherwise("time").alias("precision"))


def casts(samples: DataFrame) -> DataFrame:
    """A cast per (set_name, station, day): hashed key, samples, depth range, presence of a positive value."""
    day = F.to_date("ts")
    return samples.groupBy("set_name", "station", day.alias("day")).agg(F.count(F.lit(1)).alias("samples"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.bool_or(F.coalesce(F.col("value") > 0, F.lit(False))).alias("has_value")).withColumn("cast_key", F.substring(F.sha1(F.concat_ws("|", "set_name", "station", F.date_format("day", "yyyy-MM-dd"))), 1, 16))


def level_arrays(levels: DataFrame, key: str) -> DataFrame:
    """Per cast the levels as arrays in order of depth, and how many depths came twice."""
    packed = F.array_sort(F.collect_list(F.struct("depth", "value")))
    out = levels.where("depth IS NOT NULL").groupBy(key).agg(packed.alias("p"), (F.count("depth") - F.count_distinct("depth")).alias("repeated"))
    return out.select(key, F.transform("p", lambda x: x["depth"]).alias("depths"), F.transform("p", lambda x: x["value"]).alias("vals"), "repeated")


def track_pieces(track: DataFrame, key: str, cell: float, gap_s: int = 86400, jump: int = 3, most: int = 64) -> DataFrame:
    """key, year, piece, n, mean, vertices array<struct<lon, lat>> of tracks (key, t seconds, lon, lat, value) drawn in cells of
    a size. A point in a new cell is a vertex. A piece ends at a new year, after a gap, at the date line and at a jump of more
    than jump cells; a full piece (most vertices, two at least) ends too, and the next one begins with its last vertex.

    Between two breaks only the number of vertices so far matters: the first piece takes most of them, each later one most - 1
    new ones. So chunks of a track tell how many they have before and after their breaks, those numbers are added up per year of
    a key, and the rows are then placed in all chunks at once."""
    if most < 2:
        raise ValueError("a piece has two vertices at least")
    order = ["t", "lon", "lat", "value"]
    rows = track.select(key, "t", "lon", "lat", F.col("value").cast("double").alias("value"), F.year(F.timestamp_seconds("t")).alias("year"))
    size = ordered.CHUNK
    placed = scratch.written(ordered.chunked(rows, [key, "year"], order, before=1), "chunks")
    full = lambda m: np.where(m < most, 0, 1 + (m - most) // (most - 1))  # noqa: E731  pieces filled after m moves

    def marks(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """The chunk's own rows in order, where a break is, and where a new cell is entered without one."""
        frame, own = ordered.walk_frame(frame, size)
        t, lon, lat = (frame[c].to_numpy() for c in ("t", "lon", "lat"))
        at = np.floor(np.stack([lon, lat]) / cell).astype(np.int64)
        steps = np.abs(np.diff(at, axis=1, prepend=at[:, :1])).max(0)
        broken = (np.diff(t, prepend=t[0]) > gap_s) | (np.abs(np.diff(lon, prepend=lon[0])) > 180) | (steps > jump)
        broken |= frame["pos"].to_numpy() == 0
        return frame[own], broken[own], ((steps > 0) & ~broken)[own]

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        frame, broken, moved = marks(frame)
        if not len(frame):  # a chunk behind the last one, with nothing but the row before it
            return pd.DataFrame({key: [], "year": [], "chunk": [], "before": [], "breaks": [], "after": [], "pieces": []})
        breaks = np.flatnonzero(broken)
        first, last = (breaks[0], breaks[-1]) if len(breaks) else (len(frame), 0)
        total = np.append(0, np.cumsum(moved))
        runs = np.diff(total[np.append(breaks, len(frame))]) if len(breaks) else np.empty(0, np.int64)
        pieces = len(breaks) + int(full(runs).sum())
        return pd.DataFrame({key: [frame[key].iloc[0]], "year": [frame["year"].iloc[0]], "chunk": [frame["pos"].iloc[0] // size], "before": [total[first]], "breaks": [len(breaks)], "after": [total[-1] - total[last]], "pieces": [pieces]})

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        moves, number, run, out = 0, 0, 0, []
        for before, breaks, after, pieces in zip(frame["before"], frame["breaks"], frame["after"], frame["pieces"], strict=True):
            out.append((moves, number, run))
            number, run = number + int(full(np.array(moves + before)) - full(np.array(moves))) + pieces, run + breaks
            moves = after if breaks else moves + before
        return frame[[key, "year", "chunk"]].assign(**dict(zip(("moves", "number", "run"), zip(*out, strict=True), strict=True)))

    def place(frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(entry):
            return pd.DataFrame({c: [] for c in (key, "year", "run", "piece", "pos", "lon", "lat", "value", "vertex", "carried")})
        frame, broken, moved = marks(frame)
        total = np.cumsum(moved)
        since = np.maximum.accumulate(np.where(broken, np.arange(len(frame)), -1))
        m = np.where(since < 0, total + int(entry["moves"].iloc[0]), total - total[np.maximum(since, 0)])
        filled = full(m)
        begins = broken | (moved & (filled > full(m - moved)))
        piece = int(entry["number"].iloc[0]) + np.cumsum(begins) - 1
        vertex = broken | moved
        # The last vertex of a full piece is the first of the next one too.
        ends = vertex & (full(m + 1) > filled)
        run = int(entry["run"].iloc[0]) + np.cumsum(broken)
        out = pd.DataFrame({key: frame[key].to_numpy(), "year": frame["year"].to_numpy(), "run": run, "piece": piece, "pos": frame["pos"].to_numpy(), "lon": frame["lon"].to_numpy(), "lat": frame["lat"].to_numpy(), "value": frame["value"].to_numpy(), "vertex": vertex, "carried": False})
        return pd.concat([out, out[ends].assign(piece=piece[ends] + 1, value=np.nan, carried=True)])

    keys = f"{key} long, year int, "
    out = keys + "run long, piece int, pos long, lon double, lat double, value double, vertex boolean, carried boolean"
    short, placed = ordered.short_and_long(placed, [key, "year"])
    done = ordered.walk_short(short, [key, "year"], lambda frame: place(frame, pd.DataFrame({"moves": [0], "number": [0], "run": [0]})), out)
    if placed is not None:
        tables = placed.groupBy(key, "year", "chunk").applyInPandas(summary, keys + "chunk long, before long, breaks long, after long, pieces long")
        entries = scratch.written(tables.groupBy(key, "year").applyInPandas(chain, keys + "chunk long, moves long, number long, run long"), "entries")
        done = done.unionByName(placed.groupBy(key, "year", "chunk").cogroup(entries.groupBy(key, "year", "chunk")).applyInPandas(place, out))
    placed = done
    # A vertex that is lent to a piece which never begins (the track ends or breaks) is alone there, as its run has no such piece.
    own = ~F.col("carried")
    vertices = F.array_sort(F.collect_list(F.when(F.col("vertex"), F.struct("pos", "lon", "lat"))))  # most at most
    pieces = placed.groupBy(key, "year", "run", "piece").agg(F.count_if(own).cast("int").alias("n"), F.avg(F.when(own, F.col("value"))).alias("mean"), vertices.alias("v")).where("n > 0")
    return pieces.select(key, "year", "piece", "n", "mean", F.transform("v", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("vertices"))


def thin_levels(levels: DataFrame, key: str, must: Column, most: int) -> DataFrame:
    """The levels (key, depth, level_no) of casts with more than most of them, thinned: those that must stay, the shallowest,
    the deepest, and the one nearest to each of evenly spaced depths (ties shallower, then first). Other casts stay whole; repeated levels count once."""
    level = F.struct("depth", "level_no")
    casts = levels.groupBy(key).agg(F.array_sort(F.collect_set(level)).alias("all"), F.collect_set(F.when(must, level)).alias("must"))
    held = F.array_union("must", F.array(F.element_at("all", 1), F.element_at("all", -1)))
    low, high, budget = F.element_at("all", 1)["depth"], F.element_at("all", -1)["depth"], F.lit(most) - F.size(held)
    near = lambda t: F.array_min(F.transform("all", lambda x: F.struct(F.abs(x["depth"] - t).alias("off"), x["depth"].alias("depth"), x["level_no"].alias("level_no"))))
    picks = F.transform(F.sequence(F.lit(1), budget), lambda i: F.struct(near(low + (high - low) * i / (budget + 1))["depth"].alias("depth"), near(low + (high - low) * i / (budget + 1))["level_no"].alias("level_no")))
    kept = F.when(F.size("all") <= most, F.col("all")).when(budget > 0, F.array_union(held, picks)).otherwise(held)
    return casts.select(key, F.inline(F.array_distinct(kept)))


def median_position(rows: DataFrame, key: list[str], radius_km: float = 50.0, share: float = 0.9) -> DataFrame:
    """key, lon, lat: the median of positions (lon unwrapped around the key's first), where enough of them lie near it."""
    known = rows.where("lon IS NOT NULL AND lat IS NOT NULL")
    first = known.groupBy(*key).agg(F.min(F.struct("lat", "lon"))["lon"].alias("ref"))
    middle = known.join(first, key).groupBy(*key, "ref").agg(F.percentile("lat", 0.5).alias("m_lat"), F.percentile(fold_lon(F.col("lon") - F.col("ref")), 0.5).alias("off"))
    middle = middle.select(*key, fold_lon(F.col("ref") + F.col("off")).alias("m_lon"), "m_lat")
    near = haversine_km(F.col("lon"), F.col("lat"), F.col("m_lon"), F.col("m_lat")) <= radius_km
    fits = known.join(middle, key).groupBy(*key, "m_lon", "m_lat").agg(F.count_if(near).alias("close"), F.count(F.lit(1)).alias("n")).where(F.col("close") >= share * F.col("n"))
    return fits.select(*key, F.round("m_lon", 5).alias("lon"), F.round("m_lat", 5).alias("lat"))


def bottle_casts(bottles: DataFrame, key: list[str]) -> DataFrame:
    """Casts of bottles (key, depth, lon, lat): depths in order, how often one repeats, bottles without depth (left out), and
    the distance of the farthest bottle from the mean place in km."""
    deep = F.col("depth").isNotNull()
    place = lambda c: F.avg(F.when(deep, F.col(c)))
    g = bottles.groupBy(*key).agg(F.count_if(~deep).alias("no_depth"), F.count("depth").alias("levels"), (F.count("depth") - F.count_distinct("depth")).alias("repeated"), F.array_sort(F.collect_list("depth")).alias("depths"), F.collect_set(F.when(deep, F.struct("lon", "lat"))).alias("places"), place("lon").alias("m_lon"), place("lat").alias("m_lat"))
    far = F.array_max(F.transform("places", lambda p: haversine_km(p["lon"], p["lat"], F.col("m_lon"), F.col("m_lat"))))
    return g.where("levels > 0").withColumn("spread_km", far).drop("places", "m_lon", "m_lat")


def merge_fragments(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """One row per key with, for each of values, the first that is given."""
    return rows.groupBy(key).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def top_labels(rows: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """key, taxa: the k commonest labels of a key as 'label (n)', ties in order of the label."""
    counts = rows.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), label))).where(F.col("place") <= k)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", label, "n"))), lambda x: F.concat(x[label], F.lit(" ("), x["n"], F.lit(")")))
    return best.groupBy(key).agg(F.array_join(texts, "; ").alias("taxa"))
