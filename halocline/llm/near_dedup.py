"""MinHash near-duplicate groups with sequential Bayesian verification.

A document's set of word shingles has a signature of HASHES minima; BANDS bands of ROWS minima give its block keys. Sets with
similarity s share a block with probability 1 - (1 - s^ROWS)^BANDS: at 0.8 one pair in 20 million is missed.

Candidates of a block are compared on their signatures, BATCH minima at a time. With a uniform prior, m equal minima of n make
the similarity Beta(m + 1, n - m + 1); a candidate is dropped as soon as the probability that it reaches the threshold is
under MISS. What survives all batches is verified on the full sets.

Groups come from links between representatives: equal sets are one class first; a member of a block meets the earlier members
near it in order of size, which joins nearly all; blocks that still hold several components are then searched for pairs of
different components: survivors whose sets have SMALL shingles at most are settled there and then on the sets that ride
along, links found so far leaving no more pairs within a component, and of the others each member's likeliest is verified
first and all that still join different components in the end. Large blocks are dealt over pieces (twice by independent hashes
in the first search; later members outside the block's largest component meet every piece), frequent keys are counted in
place, and no pairs within a component are made.

Edge cases: a null or empty text, or one without a word, has an empty set, is linked with nothing and is its own component; a
text with fewer words than a shingle has its whole sequence as its one shingle. Rows that share a doc_id are one document:
where their texts differ, it is in one component with all that any of them is linked with. A row without doc_id is linked with
nothing, has no component and is kept. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import common as C
from halocline.llm import jaccard_join as J
from halocline.llm.components import components

HASHES, BANDS, ROWS, BATCH, MISS, SEED = 128, 32, 4, 32, 1e-6, 7
#: Earlier members that the first search tries; pairs compared, and hashes taken, at once.
LAGS, CHUNK, SLICE = 4, 1 << 17, 4096
#: Shingles of a set that rides along with its signature (2 KB).
SMALL = 256
FOUND = J.PAIRS + ", sure boolean"
#: Odd factors; the upper half of a product is a hash of a mixed 64-bit number.
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """The least hash of a set under each function."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), SLICE):
        np.minimum(out, ((s[i : i + SLICE] * FACTORS[:, None]) >> np.uint64(32)).min(1).astype(np.uint32), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key of each band of a signature; its number is mixed in."""
    bands = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = J.mix(key * J.M1 + bands[:, i])
    return key >> np.uint64(64 - J.KEY_BITS)


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """After each batch, the equal minima that a candidate needs. Beta(m + 1, n - m + 1) exceeds t as likely as a binomial of
    n + 1 trials with chance t stays at m or under."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        m, below = 0, (1 - t) ** (n + 1)
        while m < n and below < miss:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(sig: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows (i, j) stay, and their equal minima: sizes in ratio, and no batch that rules the similarity out."""
    keep = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    equal = np.zeros(len(keep), np.int64)
    for batch, least in enumerate(need):
        part = sig[:, batch * BATCH : (batch + 1) * BATCH]
        equal = equal + np.concatenate([np.empty(0, np.int64), *[(part[i[x]] == part[j[x]]).sum(1) for x in (keep[a : a + CHUNK] for a in range(0, len(keep), CHUNK))]])
        keep, equal = keep[equal >= least], equal[equal >= least]
    return keep, equal


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, d1, d2 (digests of the set), sig, keys, small (the set, if it is) of every row; the last three are null for an
    empty set or without id."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for no_id, h in zip(batch["no_id"], batch["h"], strict=True):
                s = J.shingles(h, k)
                sig = signature(s) if len(s) and not no_id else None
                digests = (int(J.mix(s ^ m).sum(dtype=np.uint64).view(np.int64)) for m in (J.M1, J.M2))
                out.append((len(s), *digests, None if sig is None else sig.tobytes(), None if sig is None else band_keys(sig).view(np.int64), s.tobytes() if sig is not None and len(s) <= SMALL else None))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").mask(batch["no_id"])} | {c: [x[i] for x in out] for i, c in enumerate(("n", "d1", "d2", "sig", "keys", "small"))})

    doc_id = F.col("doc_id").cast("long")
    hashed = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), C.word_hashes(C.whole_text()).alias("h"))
    return C.materialise(hashed.mapInPandas(rows, "doc_id long, n long, d1 long, d2 long, sig binary, keys array<long>, small binary"), "signatures")


def _opened(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(len(rows), HASHES)


class Settled:
    """Components of the rows of a group, joined as links are found; sets of the small rows, opened once."""

    def __init__(self, component: np.ndarray, small: pd.Series):
        self.component, self.small, self.sets = component.copy(), small.to_numpy(), {}
        self.is_small = small.notna().to_numpy()

    def set_of(self, i: int) -> set[int]:
        if i not in self.sets:
            self.sets[i] = set(np.frombuffer(self.small[i], np.uint64).tolist())
        return self.sets[i]

    def links(self, i: np.ndarray, j: np.ndarray, equal: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Of small pairs, likeliest first, those that are linked and join two components; they are one from then on."""
        out = []
        for at in np.argsort(-equal, kind="stable").tolist():
            a, b = int(i[at]), int(j[at])
            if self.component[a] == self.component[b]:
                continue
            x, y = self.set_of(a), self.set_of(b)
            if (100 + percent) * len(x & y) >= percent * (len(x) + len(y)):
                low, high = sorted((self.component[a], self.component[b]))
                self.component[self.component == high] = low
                out.append((a, b))
        return out


def _found(node: np.ndarray, sure: list[tuple[int, int]], i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    known = np.array(sure, np.int64).reshape(-1, 2)
    return pd.concat([J._pairs(node, known[:, 0], known[:, 1]).assign(sure=True), J._pairs(node, i, j).assign(sure=False)])


def _first_search(members: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """u, v, sure (verified already) in each block: each member with the nearest of the LAGS before it that survives."""
    need = least_matches(percent)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cut in J.whole_groups(batches, ["key", "piece"]):
            sig, n = _opened(rows), rows["n"].to_numpy()
            start = np.repeat(cut[:-1], np.diff(cut))
            left, i, j, sure = np.arange(len(n)), [], [], []
            settled = Settled(np.arange(len(n)), rows["small"])
            for lag in range(1, LAGS + 1):
                left = left[left - lag >= start[left]]
                found, equal = survivors(sig, n, left - lag, left, percent, need)
                a, b = left[found] - lag, left[found]
                both = settled.is_small[a] & settled.is_small[b]
                linked = settled.links(a[both], b[both], equal[both], percent)
                sure += linked
                i.append(a[~both])
                j.append(b[~both])
                left = np.setdiff1d(left, np.append(b[~both], [y for _, y in linked]).astype(np.int64))
            yield _found(rows["node"].to_numpy(), sure, np.concatenate(i), np.concatenate(j))

    dealt = J.dealt_twice(members).join(sigs.drop("keys"), "node").repartition("key", "piece").sortWithinPartitions("key", "piece", "n", "node")
    return dealt.mapInPandas(search, FOUND)


def across(sig: np.ndarray, n: np.ndarray, settled: Settled, own: np.ndarray, mine: Callable[[np.ndarray, np.ndarray], np.ndarray], percent: int, need: list[int], last: bool) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Pairs of rows of different components (and of the two pieces, if there are two): the small ones that are linked, and
    candidates (i, j) of the others, for each j the likeliest. The last search leaves out small pairs, all of which the first
    one has settled, and returns every candidate. mine tells which pairs are this block's to settle."""
    two = own.min() != own.max()
    sure, out = [], [(np.empty(0, np.int64),) * 2]
    rows = np.arange(len(n))
    step = max(1, CHUNK // max(1, len(n)))
    for first in range(0, len(n), step):
        j = np.repeat(np.arange(first, min(first + step, len(n))), len(n))
        i = np.tile(rows, len(j) // len(n))
        some = (i < j) & (settled.component[i] != settled.component[j])
        if two:
            some &= own[i] != own[j]
        if last:
            some &= ~(settled.is_small[i] & settled.is_small[j])
        i, j = i[some], j[some]
        found, equal = survivors(sig, n, i, j, percent, need)
        own_ones = mine(i[found], j[found])
        found, equal = found[own_ones], equal[own_ones]
        i, j = i[found], j[found]
        both = settled.is_small[i] & settled.is_small[j]
        sure += settled.links(i[both], j[both], equal[both], percent)
        i, j, equal = i[~both], j[~both], equal[~both]
        if not last and len(j):
            order = np.lexsort((i, -equal, j))
            i, j = i[order], j[order]
            top = np.append(True, j[1:] != j[:-1])
            i, j = i[top], j[top]
        out.append((i, j))
    return sure, *(np.concatenate(x) for x in zip(*out, strict=True))


def _second_search(known: DataFrame, top: DataFrame, sigs: DataFrame, percent: int, last: bool) -> DataFrame:
    """u, v, sure of pairs of different components in the open blocks. A pair that shares several open blocks is settled in the one
    with the least key only: keys holds, band by band, a member's keys of open blocks, and 0 elsewhere."""
    need = least_matches(percent)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cut in J.whole_groups(batches, ["key", "lo", "hi"]):
            node, comp, n, own, sig = *(rows[c].to_numpy() for c in ("node", "component", "n", "own")), _opened(rows)
            keys = np.stack(rows["keys"].to_numpy())
            for start, end in zip(cut[:-1], cut[1:], strict=True):
                at, key = slice(start, end), rows["key"].iloc[start]

                def mine(i: np.ndarray, j: np.ndarray, k: np.ndarray = keys[at], key: int = key) -> np.ndarray:
                    out = [np.where((k[i[a : a + SLICE]] == k[j[a : a + SLICE]]) & (k[i[a : a + SLICE]] > 0), k[i[a : a + SLICE]], np.int64(1) << 62).min(1) == key for a in range(0, len(i), SLICE)]
                    return np.concatenate([np.empty(0, bool), *out])

                settled = Settled(comp[at], rows["small"].iloc[at])
                yield _found(node[at], *across(sig[at], n[at], settled, own[at], mine, percent, need, last))

    pieces = J.open_rows(known, top)
    held = pieces.groupBy("node").agg(F.collect_set("key").alias("open_keys"))  # BANDS for each text at most
    keyed = sigs.join(held, "node").withColumn("keys", F.transform("keys", lambda k: F.when(F.array_contains("open_keys", k), k).otherwise(0))).drop("open_keys")
    dealt = J.open_pieces(known, top).join(keyed, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "node")
    return dealt.mapInPandas(search, FOUND)


def _links(found: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among pairs u, v, sure: those that are sure, and those of the others that the full sets confirm."""
    found = C.materialise(found.distinct(), "found")
    return found.where("sure").select("u", "v").unionByName(J.verified(found.where("NOT sure").select("u", "v"), docs, k, percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs. Two documents are linked when 100 * shared shingles >=
    percent * all shingles of the two."""
    index = signatures(docs, k)
    known = index.where("keys IS NOT NULL")
    classes = C.materialise(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "classes")
    firsts = known.join(J._small(classes.select("node").distinct()), F.col("doc_id") == F.col("node"), "left_semi")
    members = J._members(firsts.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key")))
    sigs = firsts.select(F.col("doc_id").alias("node"), "n", "sig", "small", "keys").distinct()
    links = _links(_first_search(members, sigs, percent), docs, k, percent).unionByName(J.same_ids(known, classes))
    labels = components(links)
    for last in (False, True):
        now = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        top = J.open_blocks(now)
        if top is None:
            break
        more = _links(_second_search(now, top, sigs, percent, last), docs, k, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    roots = classes.join(labels, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    found = index.where("n > 0 AND doc_id IS NOT NULL").join(roots, ["d1", "d2"]).select("doc_id", "n", "component")
    alone = index.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).alias("component"))
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.col("doc_id").isNull())
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.parquet(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)
