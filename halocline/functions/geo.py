"""Column functions over coordinates: distances, projections, cell and tile keys. All are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MERC_RADIUS, MERC_LAT = 6378137.0, 85.0511287798066
WORLD = math.pi * MERC_RADIUS
GRID_BITS = 20


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km; null if a coordinate is. The root is clamped to 1."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def fold_lon(lon: Column) -> Column:
    """Any longitude to [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def mercator_x(lon: Column) -> Column:
    return F.lit(MERC_RADIUS) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    low = F.greatest(F.least(lat, F.lit(MERC_LAT)), F.lit(-MERC_LAT))
    return F.lit(MERC_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(low) / 2))


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of Web-Mercator metres."""
    return F.degrees(x / MERC_RADIUS), F.degrees(2 * F.atan(F.exp(y / MERC_RADIUS)) - math.pi / 2)


def _grid(v: Column, bits: int) -> Column:
    n = 1 << bits
    return F.greatest(F.least(F.floor(v / (2 * WORLD) * float(n)), F.lit(n - 1)), F.lit(0)).cast("long")


def spread(v: Column) -> Column:
    """The bits of v on the even places: its binary digits read in base four."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def morton(lon: Column, lat: Column, bits: int = GRID_BITS) -> Column:
    """Key of the 2^bits x 2^bits Mercator grid: columns from the west in the even bits, rows from the north in the odd."""
    cx, cy = _grid(mercator_x(lon) + WORLD, bits), _grid(F.lit(WORLD) - mercator_y(lat), bits)
    return spread(cx).bitwiseOR(F.shiftleft(spread(cy), 1))


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy tile x and y at a zoom."""
    return _grid(mercator_x(lon) + WORLD, zoom), _grid(F.lit(WORLD) - mercator_y(lat), zoom)


def tile_key_range(zoom: int, tx: int, ty: int) -> tuple[int, int]:
    """The half-open range of Morton keys of a tile."""
    own = sum(((tx >> i & 1) << 2 * i) | ((ty >> i & 1) << 2 * i + 1) for i in range(zoom))
    return own << 2 * (GRID_BITS - zoom), (own + 1) << 2 * (GRID_BITS - zoom)


def hex_cell(lon: Column, lat: Column, edge_m: float) -> tuple[Column, Column]:
    """Axial (q, r) of the flat-topped hexagon of an edge length over Web Mercator: cube rounding, no hexagon table."""
    x, y = mercator_x(lon), mercator_y(lat)
    q, r = x * (2 / 3 / edge_m), (y / math.sqrt(3) - x / 3) / edge_m
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    q_off, r_off = (dq > dr) & (dq > ds), dr > ds
    return F.when(q_off, -rr - rs).otherwise(rq).cast("long"), F.when(~q_off & r_off, -rq - rs).otherwise(rr).cast("long")


def degree_cell(v: Column, step: float = 1.0) -> Column:
    return F.floor(v / step).cast("int")


def clamped_cell(v: Column, step: float, limit: int) -> Column:
    """floor(v / step), with the upper edge of the world in the last cell."""
    return F.least(F.floor(v / step), F.lit(int(limit / step) - 1)).cast("int")


def depth_from_pressure(p: Column, lat: Column) -> Column:
    """Depth in metres of a pressure in dbar at a latitude (the 1983 standard formula); not under 0."""
    x = F.pow(F.sin(F.radians(lat)), 2)
    g = F.lit(9.780318) * (1.0 + (F.lit(5.2788e-3) + F.lit(2.36e-5) * x) * x) + F.lit(1.092e-6) * p
    return F.when(p <= 0, F.lit(0.0)).otherwise(((((F.lit(-1.82e-15) * p + 2.279e-10) * p - 2.2512e-5) * p + 9.72659) * p) / g)


def deinterleave(key: Column, bits: int = GRID_BITS) -> tuple[Column, Column]:
    """Column and row of a Morton key."""
    take = lambda first: sum((F.shiftleft(F.shiftright(key, 2 * i + first).bitwiseAND(1), i) for i in range(1, bits)), F.shiftright(key, first).bitwiseAND(1))
    return take(0), take(1)


def area_key_ranges(west: float, south: float, east: float, north: float, most: int = 16) -> list[tuple[int, int]]:
    """At most that many half-open ranges of Morton keys that hold a box: its tiles at the deepest zoom at which they are few
    enough, neighbouring ranges joined."""

    def place(lon: float, lat: float, zoom: int) -> tuple[int, int]:
        y = math.log(math.tan(math.pi / 4 + math.radians(max(-MERC_LAT, min(MERC_LAT, lat))) / 2)) / math.pi
        at = lambda v: max(0, min((1 << zoom) - 1, math.floor(v * (1 << zoom))))
        return at((lon + 180) / 360), at((1 - y) / 2)

    tiles: list[tuple[int, int]] = [(0, 1 << 2 * GRID_BITS)]
    for zoom in range(1, GRID_BITS + 1):
        (x0, y0), (x1, y1) = place(west, north, zoom), place(east, south, zoom)
        if (x1 - x0 + 1) * (y1 - y0 + 1) > most:
            break
        tiles = sorted(tile_key_range(zoom, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))
    out = tiles[:1]
    for low, high in tiles[1:]:
        if low == out[-1][1]:
            out[-1] = out[-1][0], high
        else:
            out.append((low, high))
    return out
