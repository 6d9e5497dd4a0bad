"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A block is a document. Each source draws an exact number of blocks: whole passes over all its blocks and then, in permuted
order (by a seeded hash), as many as its target still asks for, the last one cut to the word. A binary tree splits the
quotas of all sources over the output shards: a node gives its left half a multivariate-hypergeometric share of every
source and the right half the rest, so that leaves hold disjoint runs of the permuted blocks that add up exactly. Within a
shard, blocks are shuffled by hash. The draws in the tree are exact at every size. Permuted order is found by hash bins of about BIN documents, so a source that holds a
third of all rows is spread over many tasks.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in order; rows
alike in doc_id, source and text are told apart by a number; an empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.llm import common as C

WEIGHTS, LIMIT, SHARDS, BIN, SEED = (5, 2, 1), 3, 16, 512, 17


def targets(sources: DataFrame) -> DataFrame:
    """source, size, count -> with rank, weight and target: all sizes shared by weight, none above LIMIT times its size.
    One row per source; the level is found in order of size per weight."""
    one = W.orderBy(F.lit(1))
    by_name = W.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    out = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
    fill = W.orderBy(F.col("size") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    whole = one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("size").over(whole) - F.coalesce(F.sum(F.lit(LIMIT) * F.col("size")).over(fill), F.lit(0))
    out = out.withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0))))
    out = out.withColumn("full", LIMIT * F.col("size") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return out.withColumn("target", F.when(F.col("full"), (LIMIT * F.col("size")).cast("double")).otherwise(level * F.col("weight"))).drop("level", "full")


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw, by rejection from the hat that lies over every log-concave distribution: flat for about one
    over the height of the mode on each side of it, exponential beyond."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low

    def log_weight(x: int) -> float:
        return -sum(map(math.lgamma, (x + 1, good - x + 1, n - x + 1, bad - n + x + 1)))

    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    top = log_weight(mode)
    whole = math.lgamma(good + 1) + math.lgamma(bad + 1) + math.lgamma(n + 1) + math.lgamma(good + bad - n + 1) - math.lgamma(good + bad + 1)
    height = min(1.0, math.exp(whole + top))
    wide = 1 + height / 2
    while True:
        u, v, sign, accept = rng.random(), 1 - rng.random(), 1 if rng.random() < 0.5 else -1, 1 - rng.random()
        y = (v * wide if u <= wide / (1 + wide) else wide - math.log(v)) / height
        if y > high - low + 1:
            continue
        x = mode + sign * round(y)
        if low <= x <= high and math.log(accept) + min(0.0, wide - height * y) <= log_weight(x) - top:
            return x


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (row) in each shard (column); rows add up to the quotas, columns differ by one at most."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(lo: int, hi: int, own: list[int]) -> None:
        if hi - lo == 1:
            out[:, lo] = own
            return
        rng, mid = np.random.default_rng([seed, lo, hi]), (lo + hi) // 2
        rest, want, left = sum(own), sum(own) * (mid - lo) // (hi - lo), []
        for q in own:
            rest -= q
            left.append(_draw(rng, q, rest, want))
            want -= left[-1]
        node(lo, mid, left)
        node(mid, hi, [q - x for q, x in zip(own, left, strict=True)])

    node(0, shards, list(quotas))
    return out


def sized(docs: DataFrame) -> DataFrame:
    """docs with h, th, m (which row it is, by hashes of id and source, of the text, and a number) and size."""
    rows = docs.withColumn("th", F.xxhash64(C.whole_text())).withColumn("h", F.xxhash64("doc_id", "source", F.col("source").isNull()))
    rows = rows.withColumn("size", F.regexp_count(C.whole_text(), F.lit(C.WORD)).cast("long"))
    return rows.withColumn("m", F.row_number().over(W.partitionBy("h", "th").orderBy("h")))


def _unit(*columns: str | Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11) / F.lit(float(1 << 53))


def plan(docs: DataFrame, shards: int = SHARDS, once: bool = False) -> DataFrame:
    """doc_id, h, th, m, size, source_size, target, taken, draws array<struct<shard, place, words>> for every row. once: a
    mix that is made already is dealt over the shards; every block is drawn once."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    rows = C.materialise(sized(rows).drop("text"), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("count"))
    sources = targets(sources)
    if once:
        sources = sources.withColumn("target", F.col("size").cast("double"))
    sources = sources.withColumn("passes", F.floor(F.try_divide("target", "size"))).withColumn("passes", F.coalesce(F.least("passes", F.lit(LIMIT)), F.lit(0)))
    sources = sources.withColumn("rest", F.least(F.round(F.col("target") - F.col("passes") * F.col("size")).cast("long"), "size"))
    sources = C.materialise(sources.withColumn("bins", F.ceil(F.col("count") / BIN).cast("int")).withColumnsRenamed({"source": "s_name", "size": "source_size"}), "sources")
    if sources.count() <= 10_000:  # a short row per source; beyond that the join shuffles
        sources = F.broadcast(sources)
    units = rows.join(sources, F.col("source").eqNullSafe(F.col("s_name"))).withColumn("u", _unit("h", "th", "m"))
    units = units.withColumn("bin", F.when(F.col("size") > 0, F.floor(F.col("u") * F.col("bins")).cast("int")).otherwise(F.floor(F.col("u") * -1024).cast("int") - 1))
    counts = units.where("size > 0").groupBy("rank", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("blocks"))
    earlier = W.partitionBy("rank").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("rank").alias("c_rank"), F.col("bin").alias("c_bin"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"), F.coalesce(F.sum("blocks").over(earlier), F.lit(0)).alias("blocks_before"))
    inside = W.partitionBy("rank", "bin").orderBy("u", "h", "th", "m")
    units = units.join(counts, (F.col("rank") == F.col("c_rank")) & (F.col("bin") == F.col("c_bin")), "left")
    units = units.withColumn("before", F.col("words_before") + F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    units = units.withColumn("block", F.col("blocks_before") + F.row_number().over(inside) - 1)
    units = units.withColumn("last", F.coalesce(F.greatest(F.least(F.col("rest") - F.col("before"), "size"), F.lit(0)), F.lit(0)))
    units = C.materialise(units.select("doc_id", "h", "th", "m", "size", "source_size", "target", "rank", "count", "passes", "block", "last"), "units")

    quotas = units.groupBy("rank").agg((F.max(F.col("passes") * F.col("count")) + F.count(F.when(F.col("last") > 0, 1))).alias("quota"))

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        ends = np.cumsum(split_quotas(rows["quota"].tolist(), shards), axis=1)
        return pd.DataFrame({"rank": rows["rank"], "ends": list(ends)})

    # The tree needs the vector of quotas: one number per source, whatever the number of documents.
    ends = quotas.groupBy(F.lit("all")).applyInPandas(tree, "rank int, ends array<long>").withColumnRenamed("rank", "e_rank")
    out = units.join(F.broadcast(ends) if sources.count() <= 10_000 else ends, F.col("rank") == F.col("e_rank"), "left")
    draws = "transform(if(size > 0, filter(sequence(0, cast(passes AS int)), p -> p < passes OR last > 0), array()), p -> named_struct('shard', size(filter(ends, e -> e <= p * count + block)), 'place', xxhash64(h, th, m, p), 'words', if(p < passes, size, last)))"
    return out.select("doc_id", "h", "th", "m", "size", "source_size", F.col("target"), (F.col("passes") * F.col("size") + F.col("last")).alias("taken"), F.expr(draws).alias("draws"))


def mix(docs: DataFrame, shards: int = SHARDS, once: bool = False) -> DataFrame:
    """The mix itself: the columns of docs, a row for each draw (a repeated document comes as often as it is drawn; the
    last block of a source is cut after its words), with shard and place (order by them to read a shard shuffled). once: the
    rows of docs as they are, also those without a word, dealt over the shards."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    keyed = sized(packed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").cast("string").alias("source"), F.col("row.text").alias("text"), "row"))
    wanted = plan(docs, shards, once).where("taken > 0 OR " + str(once)).groupBy(F.col("h").alias("p_h"), F.col("th").alias("p_th")).agg(F.collect_list(F.struct("m", "draws")).alias("drawn"))
    # The keys are those that numbered the rows, so the texts are not shuffled again.
    both = keyed.join(wanted, F.expr("h = p_h AND th = p_th")).withColumn("draws", F.get(F.filter("drawn", lambda x: x["m"] == F.col("m")), F.lit(0))["draws"])
    both = both.drop("drawn").where("draws IS NOT NULL").withColumn("draw", (F.explode_outer if once else F.explode)("draws"))
    cut = F.when(F.col("draw.words") < F.col("size"), F.array_join(F.slice(C.words(C.whole_text()), F.lit(1), F.greatest(F.col("draw.words"), F.lit(1)).cast("int")), " ")).otherwise(F.col("text"))
    out = both.withColumn("cut", cut)
    return out.select(*[F.col("cut").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.coalesce("draw.shard", F.lit(0)).alias(C.fresh(docs, "shard")[0]), F.coalesce("draw.place", F.col("h")).alias(C.fresh(docs, "place")[0]))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(C.parquet(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))
