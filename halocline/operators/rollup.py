"""Roll-ups: facet cube, degree and Morton grids, level-of-detail pyramid, hotspots, statistics. Nulls as stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.functions import classify
from halocline.functions.geo import clamped_cell


def facet_cube(occurrences: DataFrame, cutoff: int) -> DataFrame:
    """rlon, rlat (decimals of 6 places), grp, decade, depth_band, edna -> n; a null year is decade -1, a null depth band 3."""
    keys = [
        F.col("lon").cast("decimal(9,6)").alias("rlon"), F.col("lat").cast("decimal(8,6)").alias("rlat"), "grp",
        classify.decade(F.col("year"), cutoff).alias("decade"), classify.depth_band(F.col("depth")).alias("depth_band"), "edna",
    ]
    return occurrences.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def site_ids(places: DataFrame) -> DataFrame:
    """Distinct (rlon, rlat) with dense ids in that order: ranks inside range partitions, plus the rows of those before;
    only a row per partition meets in one task."""
    part = places.select("rlon", "rlat").distinct().repartitionByRange("rlon", "rlat").withColumn("part", F.spark_partition_id())
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    ranked = part.withColumn("rn", F.row_number().over(W.partitionBy("part").orderBy("rlon", "rlat")))
    return ranked.join(before, "part").select((F.col("before") + F.col("rn")).alias("site_id"), "rlon", "rlat")


def grid_facets(cube: DataFrame, step: float) -> DataFrame:
    """The cube on a degree grid; longitude 180 and latitude 90 fall into the last cell."""
    x = clamped_cell(F.col("rlon").cast("double"), step, 180).alias("cx")
    y = clamped_cell(F.col("rlat").cast("double"), step, 90).alias("cy")
    return cube.groupBy(x, y, "grp", "decade", "depth_band", "edna").agg(F.sum("n").alias("n"))


def cell_rollup(facets: DataFrame, groups: list[str]) -> DataFrame:
    """Per cell: n, the group with most (ties in name order), the groups as bits, whether all is eDNA."""
    bit = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("grp")) - 1
    by_group = facets.groupBy("cx", "cy", "grp").agg(F.sum("n").alias("n"), F.bool_and("edna").alias("edna_only"))
    return by_group.groupBy("cx", "cy").agg(
        F.sum("n").alias("total"), F.min_by("grp", F.struct(-F.col("n"), "grp")).alias("top_group"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), bit.cast("int"))).alias("groups"), F.bool_and("edna_only").alias("edna_only"),
    )


def conservation(source: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """name, held, expected, ok: whether every row of source is counted once in each aggregate (column n)."""
    expected = source.agg(F.count(F.lit(1)).alias("expected")).scalar()
    out = None
    for name, table in tables.items():
        held = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("held")).select(F.lit(name).alias("name"), "held")
        out = held if out is None else out.unionByName(held)
    return out.withColumn("expected", expected).withColumn("ok", F.col("held") == F.col("expected"))


def lod_base(points: DataFrame, bits: int, level_bits: int, slots: list[str]) -> DataFrame:
    """cell, year -> n, rep (the greatest id), sx, sy and, per slot, s (sum) and c (count, null for 0)."""
    cell = F.shiftright("key", 2 * (bits - level_bits)).alias("cell")
    sums = [F.sum(x).alias(f"s_{x}") for x in slots] + [F.nullif(F.count(x), F.lit(0)).alias(f"c_{x}") for x in slots]
    return points.groupBy(cell, "year").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("rep"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), *sums)


def lod_coarser(level: DataFrame, slots: list[str]) -> DataFrame:
    """The next coarser level from a level: sums add."""
    sums = [F.sum(f"{p}_{x}").alias(f"{p}_{x}") for p in "sc" for x in slots]
    return level.groupBy(F.shiftright("cell", 4).alias("cell"), "year").agg(F.sum("n").alias("n"), F.max("rep").alias("rep"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), *sums)


def lod_read(level: DataFrame, slots: list[str], years: tuple[int, int]) -> DataFrame:
    """Per cell within a range of years: n, centroid, and per slot the mean (null without values)."""
    part = level.where(F.col("year").between(*years)).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), *[F.sum(f"{p}_{x}").alias(f"{p}_{x}") for p in "sc" for x in slots])
    return part.select("cell", "n", (F.col("sx") / F.col("n")).alias("cx"), (F.col("sy") / F.col("n")).alias("cy"), *[F.try_divide(f"s_{x}", f"c_{x}").alias(f"mean_{x}") for x in slots])


def heavy_tiles(points: DataFrame, finest: int, coarsest: int, threshold: int) -> DataFrame:
    """zoom, tx, ty, n of tiles with at least threshold points; coarser zooms add up the finest counts."""
    fine = points.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    up = fine.withColumn("zoom", F.explode(F.sequence(F.lit(coarsest), F.lit(finest))))
    shift = [F.call_function("shiftright", F.col(c), F.lit(finest) - F.col("zoom")).alias(c) for c in ("tx", "ty")]
    return up.select("zoom", *shift, "n").groupBy("zoom", "tx", "ty").agg(F.sum("n").alias("n")).where(F.col("n") >= threshold)


def hotspot_grid(records: DataFrame, step: float, top: int = 5) -> DataFrame:
    """Per cell (snapped to the nearest node): total, species, endangered, critical, and the top species by category, then
    records, then name. Columns lon, lat, species, category (null: NE)."""
    cell = [(F.rint(F.col(c) / step) * step).alias(f"cell_{c}") for c in ("lon", "lat")]
    one = records.groupBy(*cell, "species", F.coalesce("category", F.lit("NE")).alias("category")).agg(F.count(F.lit(1)).alias("records"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in ("CR", "EN", "VU", "NT", "LC")]), F.col("category")), F.lit(0))
    one = one.withColumn("rank", F.when(rank == 0, 6).otherwise(rank))
    kind = lambda *names: F.count_distinct(F.when(F.col("category").isin(*names), F.col("species")))
    stats = one.groupBy("cell_lon", "cell_lat").agg(F.sum("records").alias("total"), F.count_distinct("species").alias("species_count"), kind("CR", "EN", "VU").alias("endangered"), kind("CR", "EN").alias("critical"))
    best = one.withColumn("rn", F.row_number().over(W.partitionBy("cell_lon", "cell_lat").orderBy("rank", F.desc("records"), "species"))).where(F.col("rn") <= top)
    names = best.groupBy("cell_lon", "cell_lat").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "species"))), lambda s: s["species"]), "|").alias("top_species"))
    return stats.join(names, ["cell_lon", "cell_lat"], "left")


def hex_density(points: DataFrame) -> DataFrame:
    """Points and distinct sources per hexagon (columns q, r, src); only cells with points."""
    return points.groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"))


def histogram_map(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Per cell: n, min_year, max_year, undated, and decades as 'decade:count' in order (null if all are undated)."""
    dec = (F.floor(F.col("year") / 10) * 10).cast("int")
    parts = rows.groupBy(*cell, dec.alias("decade")).agg(F.count(F.lit(1)).alias("k"), F.min("year").alias("lo"), F.max("year").alias("hi"))
    pair = F.when(F.col("decade").isNotNull(), F.struct("decade", "k"))
    text = F.transform(F.array_sort(F.collect_list(pair)), lambda s: F.concat_ws(":", s["decade"], s["k"]))
    out = parts.groupBy(*cell).agg(F.sum("k").alias("n"), F.min("lo").alias("min_year"), F.max("hi").alias("max_year"), F.coalesce(F.sum(F.when(F.col("decade").isNull(), F.col("k"))), F.lit(0)).alias("undated"), text.alias("d"))
    return out.withColumn("decades", F.when(F.size("d") > 0, F.array_join("d", ","))).drop("d")


def median_flag(samples: DataFrame, group: str, value: str, threshold: float, use: Column) -> DataFrame:
    """samples with flagged: whether both the group's median over positive used values and the value reach the threshold."""
    med = samples.where(use).groupBy(group).agg(F.percentile(F.when(F.col(value) > 0, F.col(value)), 0.5).alias("med"))
    return samples.join(med, group, "left").withColumn("flagged", F.coalesce((F.col("med") >= threshold) & (F.col(value) >= threshold), F.lit(False)))


def usage(requests: DataFrame) -> DataFrame:
    """Hourly roll-up per key and label: requests, errors (status 400 and up), bytes."""
    return requests.groupBy("key_id", F.date_trunc("hour", "ts").alias("hour"), "label").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.sum("bytes").alias("bytes"))


def leak_flags(requests: DataFrame, now: Column, factor: float = 5.0, least: int = 100, spread: int = 3) -> DataFrame:
    """key_id, flag, severity: many distinct agents in the last 24 hours, or a spike over the mean day of the six before.
    A null key is left out; a null agent is not counted; exactly 24 hours ago is not in the window."""
    rows = requests.where("key_id IS NOT NULL").withColumn("age", (F.unix_micros(now) - F.unix_micros(F.col("ts"))) / 3.6e9)
    stats = rows.groupBy("key_id").agg(F.count_if(F.col("age") < 24).alias("recent"), F.count_distinct(F.when(F.col("age") < 24, F.col("agent"))).alias("agents"), (F.count_if((F.col("age") >= 24) & (F.col("age") < 168)) / 6.0).alias("baseline"))
    flags = F.array(
        F.when(F.col("agents") >= spread, F.struct(F.lit("multi_agent").alias("flag"), F.when(F.col("agents") >= 2 * spread, "warn").otherwise("info").alias("severity"))),
        F.when((F.col("baseline") > 0) & (F.col("recent") >= least) & (F.col("recent") > F.col("baseline") * factor), F.struct(F.lit("spike").alias("flag"), F.lit("warn").alias("severity"))),
    )
    return stats.where("recent > 0").select("key_id", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("f")).select("key_id", "f.flag", "f.severity")


def risk_index(cells: DataFrame) -> DataFrame:
    """cells (region, count, noise, weight) with norm = count over the region's 95th percentile (clamped to 1) and
    index = min(1, noise * norm * weight), or half the noise where the count is null; and its level."""
    p95 = cells.groupBy("region").agg(F.percentile("count", 0.95).alias("p95"))
    out = cells.join(p95, "region", "left").withColumn("norm", F.when(F.col("count").isNotNull(), F.least(F.lit(1.0), F.try_divide("count", "p95"))))
    index = F.least(F.lit(1.0), F.when(F.col("norm").isNotNull(), F.col("noise") * F.col("norm") * F.col("weight")).otherwise(F.col("noise") * 0.5))
    return out.withColumn("index", index).withColumn("level", classify.risk_level(F.col("index"), F.col("noise").isNull()))


def weighted_exposure(cells: DataFrame, cutoffs: list[float]) -> DataFrame:
    """cutoff, exposed_share: weight of corrosive cells over that of all classified ones whose suitability reaches the
    cutoff; cells without a class count on neither side; null (not 0) if none is left."""
    corrosive = F.col("class").isin("newly_corrosive", "corrosive_preindustrial")
    rows = cells.where("class <> 'no_data'").withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs]))).where("suitability >= cutoff")
    return rows.groupBy("cutoff").agg(F.try_divide(F.sum(F.when(corrosive, F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("exposed_share"))


def deployments(rows: DataFrame) -> DataFrame:
    """Per rounded place: device of the latest start, first start, and last end (null if any deployment is open)."""
    return rows.groupBy(F.round("lon", 2).alias("rlon"), F.round("lat", 2).alias("rlat")).agg(
        F.max_by("device", F.struct("started", "device")).alias("device"), F.min("started").alias("started"),
        F.when(~F.bool_or(F.col("ended").isNull()), F.max("ended")).alias("ended"),
    )


def facet_filter(cube: DataFrame, **allowed: list) -> DataFrame:
    """Rows of a facet cube whose every named facet has one of the values allowed; a facet not named is not asked."""
    for name, values in allowed.items():
        cube = cube.where(F.col(name).isin(*values))
    return cube


def leak_statistics(requests: DataFrame, now: Column, window_h: float = 24, days: int = 6) -> DataFrame:
    """key_id, recent, countries, asns, agents, names (countries in order), baseline: the last window of a key (unknown countries,
    networks and agents are not counted) and the mean of the windows of days before. A null key is left out."""
    rows = requests.where("key_id IS NOT NULL").withColumn("age", (F.unix_micros(now) - F.unix_micros(F.col("ts"))) / 3.6e9)
    recent = F.col("age") < window_h
    own = lambda c: F.when(recent, F.col(c))
    earlier = F.count_if((F.col("age") >= window_h) & (F.col("age") < window_h * (days + 1)))
    g = rows.groupBy("key_id").agg(F.count_if(recent).alias("recent"), *[F.count_distinct(own(c)).alias(n) for c, n in (("country", "countries"), ("asn", "asns"), ("agent", "agents"))], F.array_sort(F.collect_set(own("country"))).alias("names"), F.nullif(earlier / float(days), F.lit(0.0)).alias("baseline"))
    return g.where("recent > 0").withColumn("names", F.when(F.size("names") > 0, F.array_join("names", ",")))


def leak_rules(stats: DataFrame, countries: int = 3, asns: int = 5, agents: int = 5, factor: float = 5.0, least: int = 1000) -> DataFrame:
    """stats with a row for each flag that it raises: flag and severity."""
    said = lambda when, flag, severity: F.when(when, F.struct(F.lit(flag).alias("flag"), severity.alias("severity")))
    rules = F.array(
        said(F.col("countries") >= countries, "multi_country", F.when(F.col("countries") >= 2 * countries, "critical").otherwise("warn")), said(F.col("asns") >= asns, "multi_asn", F.lit("warn")),
        said(F.col("agents") >= agents, "multi_agent", F.when(F.col("agents") >= 2 * agents, "warn").otherwise("info")), said((F.col("baseline") > 0) & (F.col("recent") >= least) & (F.col("recent") > F.col("baseline") * factor), "spike", F.lit("warn")),
    )
    return stats.select("*", F.inline(F.array_compact(rules)))
