"""Arithmetic on gridded fields kept as long tables (i, j or lon, lat, depth, value); a null value is a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def axis_index(v: Column, start: float, step: float) -> Column:
    """Index of the nearest node of a regular axis (halves go up)."""
    return F.floor((v - start) / step + 0.5).cast("int")


def sample(points: DataFrame, field: DataFrame, start: tuple[float, float], step: float, around: int | None = None) -> DataFrame:
    """points (lon, lat) with the value of the nearest node (i, j) of field, null off the grid or in a gap, and a status. With
    around, the columns are a closed circle of that many nodes, so a point before the seam may be nearest to the first one."""
    column = axis_index(F.col("lon"), start[0], step)
    at = points.withColumn("i", column if around is None else F.pmod(column, F.lit(around))).withColumn("j", axis_index(F.col("lat"), start[1], step))
    out = at.join(field.select(F.col("i").alias("f_i"), F.col("j").alias("f_j"), F.col("value"), F.lit(True).alias("covered")), (F.col("i") == F.col("f_i")) & (F.col("j") == F.col("f_j")), "left")
    return out.withColumn("status", F.when(F.col("covered").isNull(), "not_covered").when(F.col("value").isNull(), "no_data").otherwise("ok")).drop("f_i", "f_j", "covered")


def block_mean(field: DataFrame, size: int = 6, around: int | None = None, first: int = 0) -> DataFrame:
    """Mean and number of values per block of size x size nodes; a block of gaps has mean null and count 0. With around, the
    columns i are a closed circle of that many nodes: blocks are counted from column first and one may lie over the seam
    (columns that are left over make a narrower last block)."""
    column = F.col("i") if around is None else F.pmod(F.col("i") - first, F.lit(around))
    return field.groupBy(F.floor(column / size).cast("int").alias("bi"), F.floor(F.col("j") / size).cast("int").alias("bj")).agg(F.avg("value").alias("mean"), F.count("value").alias("valid"))


def with_fallback(points: DataFrame, monthly: DataFrame, annual: DataFrame, keys: list[str], deepest: float = 1500.0) -> DataFrame:
    """points with value: the month's climatology down to deepest, else the annual one."""
    m = monthly.withColumnRenamed("value", "m_value")
    a = annual.withColumnRenamed("value", "a_value")
    out = points.join(m, [*keys, "month"], "left").join(a, keys, "left")
    return out.withColumn("value", F.coalesce(F.when(F.col("depth") <= deepest, F.col("m_value")), F.col("a_value"))).drop("m_value", "a_value")


def anomaly(recent: DataFrame, climate: DataFrame, keys: list[str]) -> DataFrame:
    return recent.join(climate.withColumnRenamed("value", "climate"), keys).withColumn("anomaly", F.col("value") - F.col("climate"))


def crossing_depth(levels: DataFrame, keys: list[str], level: float = 1.0) -> DataFrame:
    """Per column of water the depth where value first falls below level, interpolated between the levels around it (gaps
    are skipped); the shallowest depth if already below; infinity if never."""
    w = W.partitionBy(*keys).orderBy("depth")
    rows = levels.where("value IS NOT NULL AND NOT isnan(value)").withColumn("d0", F.lag("depth").over(w)).withColumn("v0", F.lag("value").over(w))
    at = F.when(F.col("d0").isNull(), F.col("depth").cast("double")).otherwise(F.col("d0") + (F.lit(level) - F.col("v0")) / (F.col("value") - F.col("v0")) * (F.col("depth") - F.col("d0")))
    below = F.col("value") < level
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(below, at), F.when(below, F.col("depth"))), F.lit(float("inf"))).alias("horizon"))


def horizon_shift(before: Column, today: Column) -> Column:
    """before - today, not under 0; null unless both are finite."""
    inf = float("inf")
    return F.when((before < inf) & (today < inf), F.greatest(F.lit(0.0), before - today))


def ruggedness(field: DataFrame) -> DataFrame:
    """Per node the mean absolute difference to those of its eight neighbours that have a value: each node is sent to its
    neighbours, and one equi join on (i, j) brings them together."""
    around = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    sent = field.where("value IS NOT NULL").select("i", "j", F.col("value").alias("near"), F.inline(around)).select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "near")
    return field.where("value IS NOT NULL").join(sent, ["i", "j"]).groupBy("i", "j").agg(F.avg(F.abs(F.col("value") - F.col("near"))).alias("tri"), F.count(F.lit(1)).alias("neighbours"))


def track_back(particles: DataFrame, field: DataFrame, days: int, start: tuple[float, float], step: float, every: int = 5, hold=None) -> DataFrame:
    """particles (id, lon, lat) traced back by the velocity field (i, j, u, v in degrees a day), one midpoint step a day; a
    particle stops where the field has no value. hold(df) cuts the lineage every few steps."""
    vel = field.select(F.col("i").alias("f_i"), F.col("j").alias("f_j"), "u", "v")

    def sampled(df: DataFrame, lon: Column, lat: Column, u: str, v: str) -> DataFrame:
        at = df.withColumn("i", axis_index(lon, start[0], step)).withColumn("j", axis_index(lat, start[1], step))
        return at.join(vel, (F.col("i") == F.col("f_i")) & (F.col("j") == F.col("f_j")), "left").drop("i", "j", "f_i", "f_j").withColumnsRenamed({"u": u, "v": v})

    rows = particles.withColumn("age", F.lit(0))
    for day in range(days):
        rows = sampled(rows, F.col("lon"), F.col("lat"), "u1", "v1")
        rows = sampled(rows, F.col("lon") - F.coalesce("u1", F.lit(0.0)) / 2, F.col("lat") - F.coalesce("v1", F.lit(0.0)) / 2, "u2", "v2")
        moves = F.col("u1").isNotNull() & F.col("u2").isNotNull() & (F.col("age") == day)
        rows = rows.select(*[c for c in particles.columns if c not in ("lon", "lat")], F.when(moves, F.pmod(F.col("lon") - F.col("u2") + 180.0, F.lit(360.0)) - 180.0).otherwise(F.col("lon")).alias("lon"), F.when(moves, F.col("lat") - F.col("v2")).otherwise(F.col("lat")).alias("lat"), (F.col("age") + moves.cast("int")).alias("age"))
        if hold and day % every == every - 1:
            rows = hold(rows)
    return rows


def regrid(field: DataFrame, target: DataFrame, start: tuple[float, float], step: float, south: float, north: float) -> DataFrame:
    """target (lon, lat) with the value of the nearest node of field; outside the latitudes that field covers it is null."""
    out = sample(target, field, start, step).drop("i", "j", "status")
    return out.withColumn("value", F.when(F.col("lat").between(south, north), F.col("value")))


def slope(field: DataFrame, metres: float) -> DataFrame:
    """i, j, slope in degrees of the inner nodes of field, by central differences over nodes metres apart."""
    value = lambda di, dj, name: field.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("value").alias(name))
    near = field.select("i", "j").join(value(1, 0, "e"), ["i", "j"]).join(value(-1, 0, "w"), ["i", "j"]).join(value(0, 1, "n"), ["i", "j"]).join(value(0, -1, "s"), ["i", "j"])
    rise = F.sqrt(F.pow(F.col("e") - F.col("w"), 2) + F.pow(F.col("n") - F.col("s"), 2)) / (2 * metres)
    return near.select("i", "j", F.degrees(F.atan(rise)).alias("slope"))


def enrich_profiles(profiles: DataFrame, monthly: DataFrame, annual: DataFrame, variables: list[str]) -> DataFrame:
    """profiles (id, cell, month, surface, deepest) with, for each variable, its climatology at the surface and at the deepest
    level: columns {variable}_surface and {variable}_deep. The climatologies have variable, cell, depth (and month), value."""
    ends = profiles.select("id", "cell", "month", F.inline(F.array(F.struct(F.lit("surface").alias("level"), F.col("surface").alias("depth")), F.struct(F.lit("deep").alias("level"), F.col("deepest").alias("depth")))))
    asked = ends.withColumn("variable", F.explode(F.array(*[F.lit(v) for v in variables])))
    found = with_fallback(asked, monthly, annual, ["variable", "cell", "depth"])
    value = lambda v, level: F.max(F.when((F.col("variable") == v) & (F.col("level") == level), F.col("value"))).alias(f"{v}_{level}")
    return found.groupBy("id").agg(*[value(v, level) for v in variables for level in ("surface", "deep")])


def backfill(rows: DataFrame, columns: list[str], enriched: DataFrame) -> DataFrame:
    """rows (id and columns) where a null column takes the enriched value of its id; other values stay."""
    new = enriched.select(F.col("id").alias("n_id"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return rows.join(new, F.col("id") == F.col("n_id"), "left").select("id", *[F.coalesce(c, f"n_{c}").alias(c) for c in columns])


def drift_back(particles: DataFrame, field: DataFrame, days: int, start: tuple[float, float], step: float, every: int = 5, hold=None) -> DataFrame:
    """particles (id, lon, lat) traced back through velocities (i, j, u, v in metres a second) by fourth-order Runge-Kutta steps
    of a day, the nearest node's velocity at each stage; longitudes wrap. A particle stops where a stage finds no velocity.
    age: its steps; speed: the mean of its steps' speeds. hold(df) cuts the lineage every few steps."""
    metres, day_s = 111_320.0, 86_400.0
    vel = field.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("i").alias("f_i"), F.col("j").alias("f_j"), "u", "v")
    wrap = lambda x: F.pmod(x + 180.0, F.lit(360.0)) - 180.0

    def staged(df: DataFrame, name: str, share: float, last: str | None) -> DataFrame:
        """The degrees a day at the place that the last stage's velocity leads back to in a share of a day."""
        lon, lat = F.col("lon"), F.col("lat")
        if last:
            lon, lat = wrap(lon - F.col(f"x{last}") * share), lat - F.col(f"y{last}") * share
        here = df.withColumn("s_lat", lat).withColumn("i", axis_index(lon, start[0], step)).withColumn("j", axis_index(lat, start[1], step))
        out = here.join(vel, (F.col("i") == F.col("f_i")) & (F.col("j") == F.col("f_j")), "left")
        cos = F.greatest(F.cos(F.radians("s_lat")), F.lit(1e-6))
        return out.withColumn(f"x{name}", F.col("u") * day_s / (metres * cos)).withColumn(f"y{name}", F.col("v") * day_s / metres).withColumn(f"q{name}", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).drop("i", "j", "f_i", "f_j", "u", "v", "s_lat")

    rows = particles.withColumn("age", F.lit(0)).withColumn("speed_sum", F.lit(0.0))
    kept = [c for c in particles.columns if c not in ("lon", "lat")]
    for day in range(days):
        for name, share, last in (("1", 0.0, None), ("2", 0.5, "1"), ("3", 0.5, "2"), ("4", 1.0, "3")):
            rows = staged(rows, name, share, last)
        mean = lambda c: (F.col(f"{c}1") + 2 * F.col(f"{c}2") + 2 * F.col(f"{c}3") + F.col(f"{c}4")) / 6
        moves = mean("x").isNotNull() & mean("y").isNotNull() & (F.col("age") == day)
        rows = rows.select(*kept, F.when(moves, wrap(F.col("lon") - mean("x"))).otherwise(F.col("lon")).alias("lon"), F.when(moves, F.col("lat") - mean("y")).otherwise(F.col("lat")).alias("lat"), (F.col("age") + moves.cast("int")).alias("age"), (F.col("speed_sum") + F.when(moves, mean("q")).otherwise(0.0)).alias("speed_sum"))
        if hold and day % every == every - 1:
            rows = hold(rows)
    return rows.withColumn("speed", F.try_divide("speed_sum", "age")).drop("speed_sum")
