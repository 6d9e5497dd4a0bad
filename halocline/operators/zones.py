"""Points in zones of many parts, with holes and across the date line, by an adaptive cover of cells.

A zone is a list of closed rings under the even-odd rule, so holes and parts need no marks; its longitudes may run on beyond
180 where it crosses the date line (over 360 degrees at most). A quadtree covers it: a cell without edges lies wholly inside or outside, one with few
edges (or at the deepest level) keeps those that pass through it and whether its corner is inside, and others are split. A cell
is split, too, while it is large beside the ring that passes through it, so that small zones do not meet all points of a large
cell. So a world-sized zone is a few large inner cells and small ones along its border only.

Points meet cells by an equi join on (level, column, row). An inner cell answers by the join alone; in an edge cell the way
from the corner to the point is walked, up and then along, and every edge on it changes sides. The grid's origin is set off
by a little, so that no border of a cell runs along coordinates that zones are made of. Points on an edge are inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.sources import scratch

ROOT, COLUMNS = 45.0, 8
WEST, SOUTH = -180.000314159, -90.000271828
#: Edges of a cell that is not split, and the deepest level (45 / 2^12 degrees, about a km).
EDGES, DEEPEST = 16, 12
#: Edges that a point is tested against one by one in generated code; beyond that by a lambda over the array.
FEW = 2
#: A ring is this many cells wide or high at least.
FINE = 8
EDGE = "array<struct<x0: double, y0: double, x1: double, y1: double>>"


def edges_of_rings(rings: Column) -> Column:
    one = lambda ring: F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    return F.flatten(F.transform(rings, one))


def bound(value: Column, then) -> Column:
    """then(value) with the value evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _meets(e: Column, x: Column, y: Column, size: Column) -> Column:
    """Whether an edge passes through the cell with its corner at (x, y)."""
    side = lambda px, py: (e["x1"] - e["x0"]) * (py - e["y0"]) - (px - e["x0"]) * (e["y1"] - e["y0"])
    corners = [side(px, py) for px in (x, x + size) for py in (y, y + size)]
    apart = (F.greatest(*corners) < 0) | (F.least(*corners) > 0)
    return (F.least(e["x0"], e["x1"]) <= x + size) & (F.greatest(e["x0"], e["x1"]) >= x) & (F.least(e["y0"], e["y1"]) <= y + size) & (F.greatest(e["y0"], e["y1"]) >= y) & ~apart


def _odd(edges: Column, test) -> Column:
    return F.pmod(F.size(F.filter(edges, test)), F.lit(2)) == 1


def _each(edges: Column, test) -> list[Column]:
    """The test of each of FEW edges at most, false beyond their end."""
    return [F.coalesce(test(F.get(edges, F.lit(i))), F.lit(False)) for i in range(FEW)]


def _odd_few(edges: Column, test) -> Column:
    return reduce(lambda a, b: a != b, _each(edges, test))


def _any_few(edges: Column, test) -> Column:
    return reduce(lambda a, b: a | b, _each(edges, test))


def _up(edges: Column, x: Column, y: Column, to: Column, odd=_odd) -> Column:
    """Whether an odd number of edges crosses the way from (x, y) north to (x, to)."""
    at = lambda e: e["y0"] + (x - e["x0"]) * (e["y1"] - e["y0"]) / (e["x1"] - e["x0"])
    return odd(edges, lambda e: ((e["x0"] > x) != (e["x1"] > x)) & (F.when((e["x0"] > x) != (e["x1"] > x), at(e)) > y) & (at(e) <= to))


def _along(edges: Column, x: Column, y: Column, to: Column, odd=_odd) -> Column:
    """Whether an odd number of edges crosses the way from (x, y) east to (to, y)."""
    at = lambda e: e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])
    return odd(edges, lambda e: F.when((e["y0"] > y) != (e["y1"] > y), (at(e) > x) & (at(e) <= to)).otherwise(False))


def _on(edges: Column, x: Column, y: Column, some=F.exists) -> Column:
    return some(edges, lambda e: ((e["x1"] - e["x0"]) * (y - e["y0"]) == (x - e["x0"]) * (e["y1"] - e["y0"])) & x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"])))


def cover(zones: DataFrame, most: int = EDGES, deepest: int = DEEPEST) -> DataFrame:
    """zone_id, level, cx, cy, turn, inside, edges of the cells of zones (zone_id, rings array<array<struct<x, y>>>): turn is how
    often the cell lies once more round the world, inside whether its corner is in the zone. Cells outside are left out."""
    wide = lambda ring, c: F.array_max(F.transform(ring, lambda p: p[c])) - F.array_min(F.transform(ring, lambda p: p[c]))
    marked = lambda ring: F.transform(edges_of_rings(F.array(ring)), lambda e: e.withField("span", F.greatest(wide(ring, "x"), wide(ring, "y"))))
    z = zones.where("zone_id IS NOT NULL AND rings IS NOT NULL").select("zone_id", F.flatten(F.transform("rings", marked)).alias("all"))
    ends = lambda f, c: f(F.transform("all", lambda e: (F.greatest if f is F.array_max else F.least)(e[f"{c}0"], e[f"{c}1"])))
    span = lambda c, start: F.sequence(F.floor((ends(F.array_min, c) - start) / ROOT), F.floor((ends(F.array_max, c) - start) / ROOT))
    size = F.lit(ROOT)
    cells = z.where(F.size("all") > 0).withColumn("ix", F.explode(span("x", WEST))).withColumn("iy", F.explode(span("y", SOUTH)))
    x, y = F.col("ix") * ROOT + WEST, F.col("iy") * ROOT + SOUTH
    cells = cells.select("zone_id", "ix", "iy", _along(F.col("all"), F.lit(-1e9), y, x).alias("inside"), F.filter("all", lambda e: _meets(e, x, y, size)).alias("edges"))
    out = None
    for level in range(deepest + 1):
        cells = scratch.written(cells.repartition("zone_id", "ix", "iy"), "cells")
        narrow = F.exists("edges", lambda e: e["span"] < ROOT / 2**level * FINE)  # noqa: B023
        done = ((F.size("edges") <= most) & ~narrow) | F.lit(level == deepest)
        own = cells.where(done).where((F.size("edges") > 0) | F.col("inside")).withColumn("level", F.lit(level))
        out = own if out is None else out.unionByName(own)
        more = cells.where(~done)
        if more.isEmpty():
            break
        side = ROOT / 2 ** (level + 1)
        # The way from a cell's corner to that of a quarter stays in the cell, so its own edges tell which side that one is on.
        quarters = more.withColumn("q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
        quarters = quarters.withColumn("x", F.col("ix") * 2 * side + WEST).withColumn("y", F.col("iy") * 2 * side + SOUTH).withColumn("nx", F.col("x") + F.col("q.i") * side).withColumn("ny", F.col("y") + F.col("q.j") * side)
        x, y, nx, ny = (F.col(c) for c in ("x", "y", "nx", "ny"))
        inside = F.col("inside") != (_up(F.col("edges"), x, y, ny) != _along(F.col("edges"), x, ny, nx))
        own = F.filter("edges", lambda e: _meets(e, nx, ny, F.lit(side)))  # noqa: B023
        # New names: a column of the same select would be taken for the one that a lambda names.
        quarters = quarters.select("zone_id", (F.col("ix") * 2 + F.col("q.i")).alias("n_ix"), (F.col("iy") * 2 + F.col("q.j")).alias("n_iy"), inside.alias("n_inside"), own.alias("n_edges"))
        cells = quarters.withColumnsRenamed({f"n_{c}": c for c in ("ix", "iy", "inside", "edges")})
    around = F.lit(COLUMNS) * F.expr("shiftleft(1L, level)")
    return out.select("zone_id", "level", F.pmod("ix", around).alias("cx"), F.col("iy").alias("cy"), F.floor(F.col("ix") / around).alias("turn"), "inside", F.transform("edges", lambda e: e.dropFields("span")).alias("edges"))


def _in_cells(points: DataFrame, levels: list[int]) -> DataFrame:
    """A row of points for each level, with the cell (p_level, p_x, p_y) there."""
    side, around = F.lit(ROOT) / F.expr("shiftleft(1L, p_level)"), F.lit(COLUMNS) * F.expr("shiftleft(1L, p_level)")
    at = points.where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("p_level", F.explode(F.array(*[F.lit(n) for n in levels or [0]])))
    return at.withColumn("p_x", F.pmod(F.floor((F.col("lon") - WEST) / side), around)).withColumn("p_y", F.floor((F.col("lat") - SOUTH) / side))


def _levels(covered: DataFrame) -> list[int]:
    return [r.level for r in covered.select("level").distinct().orderBy("level").collect()]  # DEEPEST + 1 at most


def _meet() -> Column:
    return (F.col("p_level") == F.col("level")) & (F.col("p_x") == F.col("cx")) & (F.col("p_y") == F.col("cy"))


def least_of(places: DataFrame, covered: DataFrame, rank: str, alike: str | None = None) -> DataFrame:
    """lon, lat, zones, least of the places (lon, lat; each once) in any zone: how many hold it and their least rank, a whole
    number in covered beside each cell's zone; alike names a column of covered that counts a zone as so many. The zones that
    hold a cell whole are summed up per cell before any place meets them, so a place joins one row a level and, for the zones
    whose border is near, the cells of those."""
    covered = covered.withColumn("alike_", F.col(alike) if alike else F.lit(1).cast("long"))
    inner = covered.where(F.size("edges") == 0).where("inside").groupBy("level", "cx", "cy").agg(F.sum("alike_").alias("n"), F.min(rank).alias("least"))
    inner = scratch.written(inner, "inner")
    edged = covered.where(F.size("edges") > 0)
    whole = _in_cells(places.select("lon", "lat"), _levels(inner)).join(inner, _meet()).select("lon", "lat", "n", "least")
    near = points_in(places.select("lon", "lat"), edged, rank, "alike_").select("lon", "lat", F.col("alike_").alias("n"), F.col(rank).alias("least"))
    return whole.unionByName(near).groupBy("lon", "lat").agg(F.sum("n").alias("zones"), F.min("least").alias("least"))


def points_in(points: DataFrame, covered: DataFrame, *more: str) -> DataFrame:
    """points (lon, lat) with zone_id (and more columns of covered), a row for each zone that holds them. covered comes from cover;
    write it once if it serves several joins."""
    met = _in_cells(points, _levels(covered)).join(covered, _meet())
    side = F.lit(ROOT) / F.expr("shiftleft(1L, p_level)")
    around = F.lit(COLUMNS) * F.expr("shiftleft(1L, p_level)")
    # The point in the zone's own longitudes: as many turns on as the cell.
    x0 = (F.col("cx") + F.col("turn") * around) * side + WEST
    lon = F.col("lon") + 360.0 * (F.col("turn") - F.floor((F.col("lon") - WEST) / 360))
    y0 = F.col("cy") * side + SOUTH
    edges, lat = F.col("edges"), F.col("lat")
    held = lambda odd, some: (F.col("inside") != (_up(edges, x0, y0, lat, odd) != _along(edges, x0, lat, lon, odd))) | _on(edges, lon, lat, some)
    keep = F.when(F.size("edges") == 0, F.col("inside")).when(F.size("edges") <= FEW, held(_odd_few, _any_few)).otherwise(held(_odd, F.exists))
    return met.where(keep).select(*points.columns, "zone_id", *more)


def clipped_area(a: Column, b: Column) -> Column:
    """The area that a ring shares with a convex ring b (both closed arrays of x and y), in square units of the plane: a is cut by
    the half-plane of each edge of b in turn, then the shoelace."""
    bare = lambda ring: F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    round_ = lambda ring: F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring), F.lit(1))), F.slice(ring, F.lit(1), F.lit(1)))
    none = F.array().cast("array<struct<x: double, y: double>>")

    def cut(ring: Column, e: Column, sign: Column) -> Column:
        side = lambda p: sign * ((e["x1"] - e["x0"]) * (p["y"] - e["y0"]) - (p["x"] - e["x0"]) * (e["y1"] - e["y0"]))
        sided = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), side(p).alias("s")))

        def kept(pairs: Column) -> Column:
            share = lambda w: w["p"]["s"] / (w["p"]["s"] - w["q"]["s"])
            crossing = lambda w: point(w["p"]["x"] + share(w) * (w["q"]["x"] - w["p"]["x"]), w["p"]["y"] + share(w) * (w["q"]["y"] - w["p"]["y"]))
            inside = lambda w: F.when(w["p"]["s"] >= 0, F.array(point(w["p"]["x"], w["p"]["y"]))).otherwise(none)
            return F.flatten(F.transform(pairs, lambda w: F.concat(inside(w), F.when((w["p"]["s"] >= 0) != (w["q"]["s"] >= 0), F.array(crossing(w))).otherwise(none))))

        return bound(sided, lambda r: kept(F.zip_with(r, round_(r), lambda p, q: F.struct(p.alias("p"), q.alias("q")))))

    def clipped(given: Column) -> Column:
        turn = F.aggregate(given["edges"], F.lit(0.0), lambda s, e: s + e["x0"] * e["y1"] - e["x1"] * e["y0"])
        return bound(F.when(turn < 0, -1.0).otherwise(1.0), lambda sign: F.aggregate(given["edges"], given["start"], lambda ring, e: cut(ring, e, sign)))

    area = lambda ring: F.abs(F.aggregate(F.zip_with(ring, round_(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)) / 2
    start = F.transform(bare(a), lambda p: point(p["x"], p["y"]))
    met = bound(F.struct(edges_of_rings(F.array(b)).alias("edges"), start.alias("start")), clipped)
    return bound(met, lambda ring: F.when(F.size(ring) >= 3, area(ring)).otherwise(0.0))


def equal_area(ring: Column) -> Column:
    """A ring of degrees on the cylindrical equal-area plane of a sphere of 6371 km, in km."""
    return F.transform(ring, lambda p: F.struct((F.radians(p["x"]) * 6371.0).alias("x"), (F.sin(F.radians(p["y"])) * 6371.0).alias("y")))
