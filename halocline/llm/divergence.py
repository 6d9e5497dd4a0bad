"""Source divergence audit: how far the word use of each source of a language is from the other sources and from the
language as a whole.

A text is tokenised as bytes: one translate call lowers A-Z and blanks every separator, split cuts the terms, and a Counter of
the document gives its frequencies; tasks add them up for each (lang, source) in bounded tables before anything is shuffled.
A language keeps the terms in at least ``min_docs`` of its documents. Shares are whole numbers (parts of 10^9), so all
arithmetic is exact.

Distances between sources are summed over parts of PART terms and pairs of blocks of SOURCES sources: a task holds the shares
of one part for two blocks, and a term that none of the sources there has adds the same constant for each pair, which is put
in at the end. So neither a frequent term, nor a large source, nor many sources make a large group.

Edge cases: null text, lang and source count as ''; a group without terms is a group with counts of 0; a language without kept
terms has pairs of value 0 and no terms; every row is a document (repeated rows count as often as they come, with or without
ids); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.llm import common as C

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 10**9, 50
#: Terms in a part and sources in a block of the distances; entries that a task holds before it passes them on.
PART, SOURCES, HELD, BROADCAST_ROWS = 256, 128, 300_000, 1_000_000
#: A-Z to a-z; every other ASCII character but a-z to a space; bytes of other characters as they are.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); for each group one row without term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in held.items():
                words = [None, *n]
                yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(seen.__getitem__, n)], pa.int64())], schema=schema)
            held.clear()

        size = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                own = Counter(terms(text))
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                for w, k in own.items():
                    n[w] += k
                seen.update(own.keys())
                size += len(n) - before + 1
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]).withColumn("text", F.col("text").cast("binary"))
    return read.mapInArrow(count, "lang string, source string, term binary, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(SCALE * (count + smoothing) / (total + smoothing * kept)), in exact decimals."""
    over = (count + smoothing).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", over, (total + smoothing * kept).cast("decimal(20,0)")) + 1


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has BROADCAST_ROWS rows at most; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, i, j (numbers of sources, i < j), extra: the sum over terms of |p - q| less what it would be if neither source
    had any of them. counts: lang, term, at, p; groups: lang, at, p0, blocks, parts."""

    def placed(df: DataFrame) -> DataFrame:
        """A row for each pair of blocks that the source's block is in."""
        own = F.expr(f"cast(at div {SOURCES} AS int)")
        return df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("own", "other")

    left = placed(counts.withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))).select("lang", "part", "lo", "hi", "term", "at", "p")
    right = placed(groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))).select(*[F.col(c).alias(c) for c in ("lang", "part", "lo", "hi", "at", "p0")])  # names of its own: both sides read groups

    def sums(counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        if not len(counts):
            return pd.DataFrame({"lang": [], "i": [], "j": [], "extra": []})
        groups = groups.sort_values("at")
        at, p0 = groups["at"].to_numpy(), groups["p0"].to_numpy()
        rows, row = pd.factorize(counts["term"])[0], np.searchsorted(at, counts["at"].to_numpy())
        shares = np.repeat(p0[:, None], rows.max() + 1, axis=1)  # a line of the part's terms for each source
        shares[row, rows] = counts["p"].to_numpy()
        block = at // SOURCES
        lo, hi = block[0], block[-1]
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        out = []
        for i in left:
            js = right[right > i]
            out.append((np.full(len(js), at[i]), at[js], (np.abs(shares[js] - shares[i]) - np.abs(p0[js] - p0[i])[:, None]).sum(1)))
        i, j, extra = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"lang": groups["lang"].iloc[0], "i": i, "j": j, "extra": extra})

    keys = ["lang", "part", "lo", "hi"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(sums, "lang string, i long, j long, extra long")
    return found.groupBy("lang", "i", "j").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its distance to every other (part pair) and the
    terms that it uses most above the language's share (part term, the first ``top``)."""
    found = C.materialise(_counted(docs), "terms")
    lang_terms = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    lang_terms = C.materialise(lang_terms, "kept_terms")
    counts = found.where("term IS NOT NULL").select("lang", "source", "term", "n").join(_small(lang_terms), ["lang", "term"])
    counts = C.materialise(counts, "kept_counts")
    langs = lang_terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total"))
    groups = found.where("term IS NULL").select("lang", "source").join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "all_total"])
    # A row per source; numbers follow the order of the sources in their language.
    groups = groups.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1).withColumn("blocks", F.ceil(F.count(F.lit(1)).over(W.partitionBy("lang")) / SOURCES).cast("int"))
    groups = groups.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("v") / PART)).cast("int")).withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0))
    groups = C.materialise(groups, "groups")
    shares = counts.join(_small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    extra = _distances(shares.select("lang", "term", "at", "p", "blocks", "parts"), groups.where("v > 0").select("lang", "at", "p0", "blocks", "parts"))
    extra = C.materialise(extra, "distances")
    extra = extra.unionByName(extra.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "extra"))
    # The pairs are the result: every source of a language beside every other one.
    one = groups.select("lang", "source", F.col("at").alias("i"), F.col("p0").alias("p"), "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("j"), F.col("p0").alias("q"))
    pairs = one.join(other, "lang").where("i <> j").join(extra, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") * F.abs(F.col("p") - F.col("q")) + F.coalesce("extra", F.lit(0))).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    above = shares.withColumn("value", F.col("p") - share(F.col("all_n"), F.col("all_total"), F.col("v"))).where("value > 0")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(above)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.parquet(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN own ON own.lang = g.lang AND own.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT tot.lang, tot.source, k.term, coalesce(o.c, 0) AS c,
  1 + ({SCALE}::HUGEINT * (coalesce(o.c, 0) + {SMOOTHING})) // (tot.n + {SMOOTHING} * l.v) AS p, 1 + ({SCALE}::HUGEINT * (k.c + {SMOOTHING})) // (l.n + {SMOOTHING} * l.v) AS q
  FROM tot JOIN kept k ON k.lang = tot.lang JOIN langs l ON l.lang = tot.lang LEFT JOIN own o ON o.lang = tot.lang AND o.source = tot.source AND o.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
