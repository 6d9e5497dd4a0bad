"""Registries: sources of points under one schema, and layers for export by name. Entries are data; rules are SQL expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("vector", "field", "observations", "composite")


@dataclass(frozen=True)
class Source:
    """Where a source's points are: a table, expressions of longitude and latitude, and which of its rows count."""

    table: str
    lon: str = "lon"
    lat: str = "lat"
    where: str = "true"


def points(read: Callable[[str], DataFrame], sources: dict[str, Source]) -> DataFrame:
    """src, lon, lat of all sources. Sources of one table share one scan of it; a row that several of them count is a point of
    each. Points without coordinates or off the globe go."""
    if not sources:
        raise ValueError("no source is registered")
    out = None
    for name in dict.fromkeys(s.table for s in sources.values()):
        own = [F.when(F.expr(s.where), F.struct(F.lit(n).alias("src"), F.expr(s.lon).cast("double").alias("lon"), F.expr(s.lat).cast("double").alias("lat"))) for n, s in sources.items() if s.table == name]
        rows = read(name).select(F.inline(F.array_compact(F.array(*own))))
        out = rows if out is None else out.unionByName(rows)
    return out.where("lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90")


@dataclass(frozen=True)
class Layer:
    """A layer for export: its kind, and a table with expressions of id, place and value, or the names of its parts."""

    kind: str
    table: str = ""
    id: str = ""
    lon: str = "lon"
    lat: str = "lat"
    value: str = "NULL"
    where: str = "true"
    parts: tuple[str, ...] = ()


def leaves(layers: dict[str, Layer], name: str, above: tuple[str, ...] = ()) -> list[str]:
    """The layers with rows of their own that a layer is made of, each once, in order."""
    if name not in layers:
        raise KeyError(f"no layer {name} is registered")
    if name in above:
        raise ValueError(f"layer {name} is a part of itself")
    layer = layers[name]
    if layer.kind not in KINDS:
        raise ValueError(f"layer {name} is of no known kind: {layer.kind}")
    if layer.kind != "composite":
        return [name]
    return list(dict.fromkeys(x for p in layer.parts for x in leaves(layers, p, (*above, name))))


def export(read: Callable[[str], DataFrame], layers: dict[str, Layer], name: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """layer, part, kind (of the part), id, lon, lat, value of a registered layer; box is (west, south, east, north), and west is
    greater than east where it lies over the date line. A node of a field without a value is no row."""
    out = None
    for part in leaves(layers, name):
        p = layers[part]
        columns = [F.lit(name).alias("layer"), F.lit(part).alias("part"), F.lit(p.kind).alias("kind"), *[F.expr(e).cast(t).alias(n) for n, e, t in (("id", p.id, "string"), ("lon", p.lon, "double"), ("lat", p.lat, "double"), ("value", p.value, "double"))]]
        rows = read(p.table).where(p.where).select(*columns)
        if p.kind == "field":
            rows = rows.where("value IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"layer {name} has no part")
    if box is None:
        return out
    west, south, east, north = box
    inside = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    return out.where(inside & F.col("lat").between(south, north))
