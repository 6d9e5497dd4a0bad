"""Benchmark decontamination with the q-gram lemma.

Texts and benchmark items are normalised (lower case, runs of other than letters and digits as one space). An occurrence of
an item of m characters with at most e edits shares at least m - q + 1 - q * e of its q-grams with the text, all within
e + 1 neighbouring diagonals. q is Q, or m // (e + 1) where that is less, so the bound is never under 1. Shared q-grams are counted in overlapping diagonal bands of twice that width; bands that meet
the bound are aligned (banded, with free ends in the text), and those within the budget of EDITS percent are matches.

The benchmark is the query set: it is read in blocks of at most BLOCK_CHARS characters, each broadcast in turn.

Edge cases: null and empty texts and items match nothing; an item under Q normalised characters is matched exactly and
as whole words (next to a script that writes no spaces, anywhere); repeated items and repeated rows are treated alike; null
ids are kept. Of matches of an item that overlap (ends closer than its least length) the one with the fewest edits, then
the first, is reported, and so on until none is left. The whole item must match: a quotation of a part of it is not found.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import common as C

Q, EDITS, BLOCK_CHARS, TABLE_BITS, SHORT_BITS, CHUNK = 10, 6, 2_000_000, 22, 16, 2_000_000
OTHER = re.compile(r"[\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Code points of scripts without spaces between words (Thai to Myanmar, Khmer, Chinese, Japanese).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
KIND = "array<struct<item_id: long, start: long, end: long, edits: int>>"


def normal(text: str | None) -> np.ndarray:
    """Code points of the normalised text."""
    return np.frombuffer(OTHER.sub(" ", (text or "").lower()).strip().encode("utf-32-le"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling."""
    h, length, power = codes.astype(np.uint64) + np.uint64(1), 1, int(BASE)
    parts, done = None, 0
    while True:
        if q & length:
            if parts is None:
                parts, done = h, length
            else:
                n = min(len(parts), len(h) - done)
                parts, done = parts[: max(n, 0)] * np.uint64(power) + h[done : done + max(n, 0)], done + length
        if 2 * length > q:
            break
        h, power, length = h[: max(len(h) - length, 0)] * np.uint64(power) + h[length:], power * power % 2**64, 2 * length
    parts = parts[: max(len(codes) - q + 1, 0)] * BASE
    return parts ^ (parts >> np.uint64(29))


class Grams:
    """The q-grams of items for one q, sorted by hash, and a bit table that tells most others apart."""

    def __init__(self, q: int, codes: list[tuple[int, np.ndarray]]):
        self.q, self.bits = q, np.uint64(64 - (TABLE_BITS if q == Q else SHORT_BITS))
        hashes = [gram_hashes(c, q) for _, c in codes]
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.repeat([i for i, _ in codes], [len(x) for x in hashes])[order]
        self.at = np.concatenate([np.arange(len(x)) for x in hashes])[order]
        self.table = np.zeros(1 << (64 - int(self.bits)), bool)
        self.table[(self.hash >> self.bits).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[(h >> self.bits).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        n = hi - lo
        rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[rows], self.at[rows]


class Items:
    """The items of a block and their q-grams."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        items = [(i, c) for i, c in items if len(c)]
        self.ids, self.codes = [i for i, _ in items], [c for _, c in items]
        sizes = np.array([len(c) for c in self.codes], np.int64)
        self.budget = sizes * EDITS // 100
        q = np.minimum(sizes // (self.budget + 1), Q)
        self.need = sizes - q + 1 - q * self.budget
        self.grams = [Grams(int(x), [(i, self.codes[i]) for i in np.flatnonzero(q == x)]) for x in np.unique(q)]

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in codes, item, place in the item) of every shared q-gram."""
        found = [g.hits(codes) for g in self.grams] or [(np.empty(0, np.int64),) * 3]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def unspaced(code: int) -> bool:
    return any(low <= code <= high for low, high in UNSPACED)


def whole_words(text: np.ndarray, start: int, end: int) -> bool:
    """Whether a word may begin at start and end at end."""
    edges = [(i - 1, i) for i in (start, end) if 0 < i < len(text)]
    return all(text[a] == 32 or text[b] == 32 or unspaced(int(text[a])) or unspaced(int(text[b])) for a, b in edges)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, end in the text, start in the text) of the best alignment of the whole item whose diagonals lie in [low, high]."""
    width = high - low + 1
    shift = np.arange(width)
    far = np.int64(1 << 30)
    start = low + shift
    d = np.where((start >= 0) & (start <= len(text)), 0, far)
    begin = start.copy()  # where the path to a cell begins in the text
    for i, c in enumerate(item):
        col = start + i  # text place that a match at this row would use
        inside = (col >= 0) & (col < len(text))
        sub = d + np.where(inside, text[np.clip(col, 0, max(len(text) - 1, 0))] != c, far)
        gap = np.append(d[1:], far) + 1
        begin = np.where(sub <= gap, begin, np.append(begin[1:], 0))
        own = np.minimum(sub, gap) - shift
        low_own = np.minimum.accumulate(own)  # text characters that the item lacks
        from_ = np.maximum.accumulate(np.where(np.append(True, own[1:] < low_own[:-1]), shift, 0))
        d, begin = low_own + shift, begin[from_]
        if d.min() > budget:
            return None
    best = int(np.argmin(d))
    return int(d[best]), min(int(start[best]) + len(item), len(text)), max(0, int(begin[best]))


def find(items: Items, texts: list[np.ndarray]) -> list[list[tuple]]:
    """For each text its matches (item_id, start, end, edits) in normalised characters."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    codes = np.concatenate([np.append(t, np.uint32(0)) for t in texts]) if texts else np.empty(0, np.uint32)
    found: list[dict] = [{} for _ in texts]
    place, item, at = items.hits(codes)
    if len(place):
        doc = np.searchsorted(starts, place, "right") - 1
        diagonal = place - starts[doc] - at
        step = items.budget[item] + 1
        band = (diagonal + (1 << 40)) // step
        # A window of e + 1 diagonals lies wholly in one of the overlapping bands of 2 (e + 1); without edits it is one diagonal.
        wide = np.flatnonzero(step > 1)
        band, doc, item, diagonal = np.append(band, band[wide] - 1), np.append(doc, doc[wide]), np.append(item, item[wide]), np.append(diagonal, diagonal[wide])
        order = np.lexsort((band, item, doc))
        band, doc, item, diagonal = band[order], doc[order], item[order], diagonal[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])))
        count = np.diff(np.append(new, len(band)))
        low, high = np.minimum.reduceat(diagonal, new), np.maximum.reduceat(diagonal, new)
        last = None
        for g in np.flatnonzero(count >= items.need[item[new]]):
            d, k = int(doc[new[g]]), int(item[new[g]])
            e, code, text, start = int(items.budget[k]), items.codes[k], texts[d], int(low[g])
            regions = found[d].setdefault(k, [])
            if e:
                # The overlapping band with the same diagonals would give the same again.
                if last == (d, k, start, int(high[g])):
                    continue
                last = d, k, start, int(high[g])
                region = align(code, text, start - e, int(high[g]) + e, e)
            else:
                same = start >= 0 and np.array_equal(text[start : start + len(code)], code)
                region = (0, start + len(code), start) if same and (len(code) >= Q or whole_words(text, start, start + len(code))) else None
            if region:
                regions.append(region)
    return [[(items.ids[k], start, end, edits) for k, r in sorted(f.items()) for edits, end, start in apart(r, len(items.codes[k]) - int(items.budget[k]))] for f in found]


def apart(regions: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Of (edits, end, start) the best, then the best whose end is at least least away from all taken, and so on; by end."""
    taken: list[int] = []
    out = []
    for edits, end, start in sorted(set(regions)):
        i = bisect.bisect_left(taken, end)
        if (i == 0 or end - taken[i - 1] >= least) and (i == len(taken) or taken[i] - end >= least):
            taken.insert(i, end)
            out.append((edits, end, start))
    return sorted(out, key=lambda r: r[1])


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items, in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), C.whole_text().alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_CHARS)) if total > BLOCK_CHARS else 1
    for b in range(blocks):
        yield Items([(r.item_id, normal(r.text)) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id").collect()])


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """The columns of keep with a column of matches (its name is returned), an empty array for a clean text."""
    name, text = C.fresh(docs.select(*keep), "matches", "text_in")
    rows = docs.select(*keep, C.whole_text().alias(text), F.array().cast(KIND).alias(name))
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        both = C.fresh(rows, "both")[0]

        def scan(pairs: list[dict], shared=shared) -> list[list]:
            found, part, size = [], [], 0
            for i, pair in enumerate(pairs):
                part.append(normal(pair["text"]))
                size += len(part[-1])
                if size >= CHUNK or i == len(pairs) - 1:
                    found += find(shared.value, part)
                    part, size = [], 0
            return [[p["text"] for p in pairs], [p["old"] + [dict(zip(("item_id", "start", "end", "edits"), m, strict=True)) for m in new] for p, new in zip(pairs, found, strict=True)]]

        rows = C.added(rows.select(*keep, F.struct(F.col(text).alias("text"), F.col(name).alias("old")).alias(both)), both, f"{text} string, {name} {KIND}", scan)
    return rows.drop(text), name


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each match: doc_id, item_id, start, end, edits."""
    rows, name = mark(C.parquet(spark, sf_dir, "documents").select("doc_id", "text"), C.parquet(spark, sf_dir, "benchmark"), ["doc_id"])
    return rows.select("doc_id", F.explode(name).alias("m")).select("doc_id", F.col("m.item_id").alias("item_id"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.edits").alias("edits"))
