"""Places in an order, without a task that holds a whole group: numbers, quantiles, and walks cut into chunks.

Rows are range-partitioned by group and order, so a group of any size lies in many partitions, sorted; the counts per group and
partition (a small table) turn the place in a partition into the place in the group. Equal rows may stand in any order among
themselves; a caller that cares adds columns to the order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegralType

from halocline.sources import scratch

BROADCAST_ROWS = 1_000_000
#: Rows of a chunk of a walk.
CHUNK = 1 << 16


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has BROADCAST_ROWS rows at most; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _beside(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the row of table (columns r_<key> for the keys) that has the same keys, nulls alike."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return rows.join(table, on).drop(*[f"r_{k}" for k in keys])


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with pos, their place in the order within their group, from 0."""
    sort = [*by, *order]
    staged = scratch.written(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at_", F.monotonically_increasing_id()), "ordered")
    staged = staged.withColumn("part_", F.shiftright("at_", 33))
    spans = staged.groupBy(*by, "part_").agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = scratch.written(spans.select(*[F.col(k).alias(f"r_{k}") for k in (*by, "part_")], (before - F.col("first_")).alias("shift_")), "spans")
    return _beside(staged, _small(spans), [*by, "part_"]).withColumn("pos", F.col("at_") + F.col("shift_")).drop("at_", "part_", "shift_")


def quantiles(rows: DataFrame, value: str, points: list[float], by: list[str] | None = None) -> DataFrame:
    """by, q, value, n: exact quantiles of the values that are given, between two of them by proportion. The counts of the
    partitions locate the ranks, a second pass over the ordered rows picks the two values of each."""
    by = by or []
    placed = numbered(rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("value_")), by, ["value_"])
    totals = scratch.written(placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "totals")
    at = F.col("q") * (F.col("n") - 1)
    wanted = totals.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in points]))).withColumn("low_", F.floor(at)).withColumn("part", at - F.floor(at))
    asked = wanted.select(*[F.col(k).alias(f"r_{k}") for k in by], "q", "n", "part", "low_", F.explode(F.array_distinct(F.array("low_", F.least(F.col("low_") + 1, F.col("n") - 1)))).alias("r_pos"))
    met = _beside(placed, _small(scratch.written(asked, "ranks")), [*by, "pos"])
    got = met.groupBy(*by, "q", "n", "part").agg(F.min("value_").alias("low"), F.max("value_").alias("high"))
    return got.select(*by, "q", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"), "n")


def rank_auc(scored: DataFrame) -> DataFrame:
    """auc of score over label (0 or 1), ties counting half, from the exact places of all rows; null without both labels."""
    placed = numbered(scored.where("score IS NOT NULL AND label IN (0, 1)").select("score", "label"), [], ["score"])
    ties = placed.groupBy("score").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("p"))
    # Twice the mean rank (from 1) of the rows of a score is a whole number.
    twice = (2 * F.col("first") + F.col("n") + 1).cast("decimal(38,0)")
    g = ties.agg(F.sum(twice * F.col("p")).alias("ranks"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    p, q = F.col("p").cast("decimal(19,0)"), F.col("q").cast("decimal(19,0)")
    return g.select(F.try_divide((F.col("ranks") - p * (p + 1)).cast("double"), 2.0 * F.col("p") * F.col("q")).alias("auc"))


def chunked(rows: DataFrame, by: list[str], order: list[str], before: int = 0, after: int = 0) -> DataFrame:
    """rows with pos and chunk (CHUNK rows of a group each, in order); the last rows before a chunk, and the first after it, are
    in it too, as many as asked (under CHUNK)."""
    own = F.floor(F.col("pos") / CHUNK)
    inside = F.pmod(F.col("pos"), F.lit(CHUNK))
    chunks = F.array_compact(F.array(own, F.when(inside >= CHUNK - before, own + 1) if before else F.lit(None), F.when((inside < after) & (own > 0), own - 1) if after else F.lit(None)))
    return numbered(rows, by, order).withColumn("chunk", F.explode(chunks))


def walk_frame(rows: pd.DataFrame, size: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows of a chunk of a size in order, and which are its own."""
    rows = rows.sort_values("pos", kind="stable")
    return rows, (rows["pos"].to_numpy() // size) == rows["chunk"].iloc[0]


def short_and_long(placed: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """placed (from chunked) as the groups that lie in one chunk, and all others (None if there are none). Groups with a null in a
    column of whole numbers are among the others: in one frame with them, pandas would turn the numbers of all to floats."""
    apart = F.col("chunk") > 0
    for f in placed.schema.fields:
        apart = apart | F.col(f.name).isNull() if isinstance(f.dataType, IntegralType) else apart
    others = scratch.written(placed.where(apart).select(*[F.col(k).alias(f"o_{k}") for k in by]).distinct(), "others")
    if others.isEmpty():
        return placed, None
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    return placed.join(others, on, "left_anti"), placed.join(others, on, "left_semi")


def walk_short(short: DataFrame, by: list[str], one: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """one over every group of short ones; about a chunk of rows of many groups is a call, as a call for each group costs more
    than its rows."""
    calls = max(1, -(-short.count() // CHUNK))

    def many(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="call_")
        codes = rows.groupby(by, sort=False).ngroup().to_numpy()
        order = np.lexsort((rows["pos"].to_numpy(), codes))
        rows, ends = rows.iloc[order], np.append(np.flatnonzero(np.diff(codes[order])) + 1, len(rows))
        return pd.concat([one(rows.iloc[a:b]) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)])

    return short.withColumn("call_", F.pmod(F.xxhash64(*by), F.lit(calls))).groupBy("call_").applyInPandas(many, schema)


def bounded_cuts(track: DataFrame, by: list[str], order: list[str], next_cut: Callable[[pd.DataFrame], np.ndarray], limit: int) -> DataFrame:
    """track with pos and segment (from 1), where a segment that begins at row p ends before row next_cut(frame)[p], at most limit
    rows on (the frame's length where that is not in it).

    A segment's end depends on where it began, so each chunk first tells, for every row of its first ``limit`` where a segment
    may begin, which row of the next chunk the walk then reaches and after how many segments. Those short tables are chained per
    group; then every chunk walks from the row that it is entered at. No task holds more than a chunk or the tables of a group.
    Groups that lie in one chunk need no tables and are walked many in a call."""
    size = CHUNK
    if limit >= size:
        raise ValueError("a segment must be shorter than a chunk")
    placed = scratch.written(chunked(track, by, order, after=limit), "chunks")

    def leaps(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        rows, own = walk_frame(rows, size)
        return rows, own, next_cut(rows)

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        ordered, own, leap = leaps(rows)
        n = int(own.sum())
        last, count = np.arange(len(ordered)), np.zeros(len(ordered), np.int64)
        for p in range(n - 1, -1, -1):
            q = int(leap[p])
            last[p], count[p] = (last[q], count[q] + 1) if q < n else (q, 1)
        first = ordered["pos"].to_numpy()[0]
        return pd.DataFrame({**{k: [ordered[k].iloc[0]] for k in by}, "chunk": [rows["chunk"].iloc[0]], "first": [first], "last": [last[: min(n, limit)]], "count": [count[: min(n, limit)]]})

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        entry, number, out = 0, 0, []
        for first, last, count in zip(rows["first"], rows["last"], rows["count"], strict=True):
            at = entry - first  # the row of this chunk at which a segment begins first
            inside = at < len(last)
            out.append((at if inside else -1, number))
            if inside:
                entry, number = first + int(last[at]), number + int(count[at])
        return pd.DataFrame({**{k: rows[k].to_numpy() for k in by}, "chunk": rows["chunk"].to_numpy(), "entry": [x for x, _ in out], "number": [x for _, x in out]})

    schema = {f.name: f.dataType.simpleString() for f in track.schema.fields}
    keys = ", ".join(f"{k} {schema[k]}" for k in by)
    short, placed = short_and_long(placed, by)

    def walked(rows: pd.DataFrame, at: int, number: int) -> pd.DataFrame:
        ordered, own, leap = leaps(rows)
        n = int(own.sum())
        begins = np.zeros(n, np.int64)
        while 0 <= at < n:
            begins[at] = 1
            at = int(leap[at])
        return ordered.iloc[:n].drop(columns="chunk").assign(segment=number + np.cumsum(begins))

    out = ", ".join(f"{f.name} {schema[f.name]}" for f in track.schema.fields) + ", pos long, segment long"
    done = walk_short(short, by, lambda rows: walked(rows, 0, 0), out)
    if placed is None:
        return done
    tables = placed.groupBy(*by, "chunk").applyInPandas(summary, f"{keys}, chunk long, first long, last array<long>, count array<long>")
    entries = scratch.written(tables.groupBy(*by).applyInPandas(chain, f"{keys}, chunk long, entry long, number long"), "entries")
    cut = lambda rows, entry: walked(rows, int(entry["entry"].iloc[0]), int(entry["number"].iloc[0]))
    return done.unionByName(placed.groupBy(*by, "chunk").cogroup(entries.groupBy(*by, "chunk")).applyInPandas(cut, out))
