"""N-gram Jaccard self-join with a count-vector R-tree.

A document's set of word shingles is hashed into GROUPS groups; the group counts are its point. For two sets, the summed
minima of their coordinates bound the overlap from above, and an R-tree over points bounds a whole subtree by its upper
corner; pairs that survive are verified on the sets themselves.

How the tree is spread: equal sets become one class first. In the order of their hashes, the x shingles that only one of
two linked sets has and the y that only the other has cut the common ones into x + y + 1 runs at most; so the first
r * (1 - p) * n + r shingles of each set hold a common run of r. A block holds the classes with the same run. Of blocks with
the same members one stays. The tree of a block (a block of up to LEAF members is one leaf) gives each member its nearest
earlier one that may be linked, which joins nearly all; blocks that still hold more than one component are then searched
for pairs of different components, the nearest few first and in the end all of them. There a pair belongs to the block with
the least key among the first OPEN_KEYS open blocks of either member, if they share one of those, so that a pair with hundreds
of blocks in common is a candidate once and not in each of them. Large blocks are dealt over pieces of
PIECE members: twice by independent hashes in the first search; later, members outside the block's largest component meet
every piece.

Links are counted after that, if asked for: two linked classes are in one component, so the members of a component (in
pairs of pieces of COUNT_PIECE, each pair of members in one of them) are searched by an R-tree, every candidate is verified
on the sets, and a link between classes counts once for each document of the other class. A caller that needs components
only leaves the count out.

Edge cases: a null or empty text, or one without a word, has an empty set, is linked with nothing and is its own component;
a text with fewer words than a shingle has its whole sequence as its one shingle. Rows that share a doc_id are one
document: where their texts differ, it is in one component with all that any of them is linked with. A row without doc_id
is linked with nothing and has no component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import common as C
from halocline.llm.components import components

GROUPS, LONGEST_RUN, PIECE, COUNT_PIECE, LEAF, KEY_BITS, BROADCAST_ROWS = 256, 3, 2048, 8192, 32, 48, 1_000_000
NEAREST, CHUNK = (1, 4, None), 1 << 16
#: Keys looked up as frequent at most, and counters of the sketch that finds them.
FREQUENT, COUNTERS = 1024, 1 << 16
#: Least keys of open blocks that ride along with a member, what fills the list up (above every key), and pairs whose lists are compared at once.
OPEN_KEYS, NO_KEY, LISTS = 16, 1 << 62, 4096
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of hashed k-word shingles of a sequence of word hashes."""
    h = np.asarray(hashes, np.int64).view(np.uint64)
    n = len(h) - k + 1
    if not len(h):
        return h
    if n < 1:
        n, k = 1, len(h)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * M1 + h[i : i + n])
    return np.unique(out)


def run_of(percent: int) -> int:
    """Shingles in a run: so few that sets with less than a whole prefix of runs can only be linked if equal."""
    return max(1, min(LONGEST_RUN, 100 * percent // (10_000 - percent * percent))) if percent < 100 else LONGEST_RUN


def run_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the runs in the prefix of a sorted set, in order; two linked sets share one at least, if they differ. A key that
    two runs share by chance costs a candidate, never a link."""
    r = run_of(percent)
    n = min(len(s), r * (100 - percent) * len(s) // 100 + r) - r + 1
    if n < 1:
        return s[:0]
    key = np.full(n, r, np.uint64)
    for i in range(r):
        key = mix(key * M1 + s[i : i + n])
    return np.unique(key >> np.uint64(64 - KEY_BITS))


def point(s: np.ndarray) -> np.ndarray:
    return np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def packed(p: np.ndarray) -> bytes:
    """A point as bytes, with one, two or four for each coordinate."""
    top = p.max()
    return p.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int32).tobytes()


def unpacked(points: pd.Series) -> np.ndarray:
    kinds = {GROUPS: np.uint8, 2 * GROUPS: np.uint16, 4 * GROUPS: np.int32}
    widest = kinds[max(map(len, points))]
    return np.stack([np.frombuffer(b, kinds[len(b)]).astype(widest, copy=False) for b in points])


def may(q: np.ndarray, n: np.ndarray, corner: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Row by row, whether a box with that upper corner and those sizes can hold a set linked with point q of n shingles:
    sizes in ratio, and the summed minima not under the least overlap."""
    fits = (100 * n >= percent * low) & (100 * high >= percent * n)
    at = np.flatnonzero(fits)
    need = percent * (n[at] + np.maximum(low[at], -(-percent * n[at] // 100)))
    fits[at] = (100 + percent) * np.minimum(corner[at], q[at]).sum(1, dtype=np.int64) >= need
    return fits


class RTree:
    """Points packed into leaves of LEAF by size and then by their widest coordinate, and leaves into nodes; each has its
    upper corner and its least and greatest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = np.argsort(sizes, kind="stable")
        wide = int(np.argmax(points.max(0) - points.min(0)))
        step = LEAF * LEAF
        self.order = np.concatenate([slab[i : i + step][np.argsort(points[slab[i : i + step], wide], kind="stable")] for i in range(0, len(slab), step)])
        own = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [own]  # points, leaves, nodes: (corner, least size, greatest size)
        for _ in range(2):
            corner, low, high = self.levels[-1]
            cut = np.arange(0, len(low), LEAF)
            self.levels.append((np.maximum.reduceat(corner, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def pairs(self, q: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, place of a point) of all pairs that may be linked; q has n shingles row by row."""
        found: list[tuple] = [(np.empty(0, np.int64),) * 2]
        tops = len(self.levels[2][1])
        for first in range(0, len(q), max(1, CHUNK // tops)):
            rows = np.arange(first, min(len(q), first + max(1, CHUNK // tops)))
            who, box = np.repeat(rows, tops), np.tile(np.arange(tops), len(rows))
            for depth in (2, 1, 0):
                corner, low, high = self.levels[depth]
                keep = [np.arange(i, min(i + CHUNK, len(who)))[may(q[w := who[i : i + CHUNK]], n[w], corner[x := box[i : i + CHUNK]], low[x], high[x], percent)] for i in range(0, len(who), CHUNK)]
                keep = np.concatenate([np.empty(0, np.int64), *keep])
                who, box = who[keep], box[keep]
                if depth:
                    who, box = np.repeat(who, LEAF), (box[:, None] * LEAF + np.arange(LEAF)).ravel()
                    inside = box < len(self.levels[depth - 1][1])
                    who, box = who[inside], box[inside]
            found.append((who, self.order[box]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def search(self, q: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Places of the points that may be linked with point q of n shingles."""
        return self.pairs(q[None, :], np.array([n]), percent)[1]


def _index(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, d1, d2 (digests of the set), point, keys of every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for no_id, h in zip(batch["no_id"], batch["h"], strict=True):
                s = shingles(h, k)
                known = len(s) > 0 and not no_id
                digests = (int(mix(s ^ m).sum(dtype=np.uint64).view(np.int64)) for m in (M1, M2))
                out.append((len(s), *digests, packed(point(s)) if known else None, run_keys(s, percent).view(np.int64) if known else None))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").mask(batch["no_id"])} | {c: [x[i] for x in out] for i, c in enumerate(("n", "d1", "d2", "point", "keys"))})

    doc_id = F.col("doc_id").cast("long")
    hashed = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), C.word_hashes(C.whole_text()).alias("h"))
    return C.materialise(hashed.mapInPandas(rows, "doc_id long, n long, d1 long, d2 long, point binary, keys array<long>"), "shingles", **{"parquet.writer.version": "PARQUET_2_0"})  # sorted keys are stored as differences


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has BROADCAST_ROWS rows of a few numbers at most; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of rows that are sorted by the columns of by, cut between groups, and where their groups begin (and the end)."""

    def cut(rows: pd.DataFrame) -> np.ndarray:
        new = np.append(True, np.zeros(len(rows) - 1, bool))
        for c in by:
            x = rows[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), len(rows))

    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        at = cut(batch)
        if held and (held[-1][by].iloc[-1] != batch[by].iloc[0]).any():
            rows = pd.concat(held)
            yield rows, cut(rows)
            held = []
        if len(at) > 2:
            rows = pd.concat([*held, batch.iloc[: at[-2]]])
            yield rows, cut(rows)
            held = [batch.iloc[at[-2] :]]
        else:
            held.append(batch)
    if held:
        rows = pd.concat(held)
        yield rows, cut(rows)


def candidates(points: np.ndarray, n: np.ndarray, cut: np.ndarray, percent: int, asks: np.ndarray, comp: np.ndarray | None, own: np.ndarray | None, nearest: int | None, mine: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): for each row j that asks, the rows i before it in its group that may be linked with it (of another component
    if comp is given; of the other piece, before or after, if the group has two; if mine is given, of the pairs that it keeps),
    or only the nearest. Groups begin at cut."""
    size = np.diff(cut)
    out: list[tuple] = [(np.empty(0, np.int64),) * 2]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        if mine is not None:
            keep = mine(i, j)
            i, j = i[keep], j[keep]
        order = np.lexsort((np.abs(j - i), j))
        i, j = i[order], j[order]
        if nearest is not None:
            first = np.maximum.accumulate(np.where(np.append(True, j[1:] != j[:-1]), np.arange(len(j)), 0)) if len(j) else j
            i, j = i[np.arange(len(j)) - first < nearest], j[np.arange(len(j)) - first < nearest]
        out.append((i, j))

    def differ(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        keep = np.ones(len(i), bool) if comp is None else comp[i] != comp[j]
        return keep if own is None else keep & ((own[i] != own[j]) | ~two[j])

    if own is not None:  # groups that hold two pieces are searched for pairs between them
        two = np.repeat((np.maximum.reduceat(own, cut[:-1]) != np.minimum.reduceat(own, cut[:-1])), size) if len(size) else own > own
    for m in np.unique(size[(size > 1) & (size <= LEAF)]):  # groups of one leaf, side by side
        i, j = np.tril_indices(m, -1)[::-1]
        starts = cut[:-1][size == m]
        for at in range(0, len(starts), max(1, CHUNK // len(i))):
            start = starts[at : at + max(1, CHUNK // len(i))]
            a, b = (start[:, None] + i).ravel(), (start[:, None] + j).ravel()
            keep = asks[b] & differ(a, b)
            a, b = a[keep], b[keep]
            keep = may(points[a], n[a], points[b], n[b], n[b], percent)
            add(a[keep], b[keep])
    for start, end in zip(cut[:-1][size > LEAF], cut[1:][size > LEAF], strict=True):
        rows, q = np.arange(start, end), start + np.flatnonzero(asks[start:end])
        if own is not None and two[start]:  # the smaller piece asks the other one
            low = own[start:end] == own[start:end].min()
            q, rows = (rows[low], rows[~low]) if 2 * low.sum() <= len(low) else (rows[~low], rows[low])
        if not len(q):
            continue
        tree = RTree(points[rows], n[rows])
        for at in range(0, len(q), 256):
            who, found = tree.pairs(points[q[at : at + 256]], n[q[at : at + 256]], percent)
            a, b = rows[found], q[at + who]
            keep = a < b if len(rows) == end - start else a != b
            a, b = a[keep], b[keep]
            keep = differ(a, b)
            add(a[keep], b[keep])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_earlier(points: np.ndarray, n: np.ndarray, cut: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): for each row j the last row i before it in its group that may be linked with it. Groups begin at cut."""
    first = np.zeros(len(n), bool)
    first[cut[:-1]] = True
    j = np.flatnonzero(~first)  # the row just before is tried at once for all
    fits = np.concatenate([np.empty(0, bool), *[may(points[x - 1], n[x - 1], points[x], n[x], n[x], percent) for x in (j[i : i + CHUNK] for i in range(0, len(j), CHUNK))]])
    asks = ~first
    asks[j[fits]] = False
    a, b = candidates(points, n, cut, percent, asks, None, None, 1)
    return np.append(j[fits] - 1, a), np.append(j[fits], b)


PAIRS = "u long, v long"
#: Pairs that a set is copied for at once, bytes of the copies in a frame, and bytes of sets in a piece of a component.
PARTNERS, FRAME_BYTES, COUNT_BYTES = 256, 1 << 25, 1 << 25


def _pairs(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    return pd.DataFrame({"u": u, "v": v})[u != v].drop_duplicates()


def _members(keys: DataFrame) -> DataFrame:
    """key, node, size of the blocks that hold more than one node; of blocks with the same members one stays. One shuffle by
    key serves the blocks and their members, but for the most frequent keys (FREQUENT at most, found by a sketch): those are
    counted in place and their blocks broadcast, so no task holds all rows of a key."""
    found = keys.agg(F.expr(f"approx_top_k(key, {FREQUENT}, {COUNTERS})").alias("top"), F.count(F.lit(1)).alias("all")).first()
    # Rarer keys are no larger than the share of a task among that many.
    frequent = [x["item"] for x in found["top"] or [] if x["count"] * COUNTERS >= found["all"] and x["count"] > PIECE // 2]
    often = F.col("key").isin(frequent)

    def kinds(rows: DataFrame) -> DataFrame:
        out = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.sum(F.shiftright(F.xxhash64("node"), 32)).alias("z"))  # repeated rows cancel in x and y
        return out.where("low < high").groupBy("size", "x", "y", "z").agg(F.min("key").alias("key")).select("key", "size")

    rare = (keys.where(~often) if frequent else keys).repartition("key")
    out = rare.join(kinds(rare), "key")
    if frequent:
        out = out.unionByName(keys.where(often).join(F.broadcast(kinds(keys.where(often))), "key"))
    return C.materialise(out, "members")


def dealt_twice(members: DataFrame) -> DataFrame:
    """key, node, piece: large blocks dealt over pieces of PIECE members, twice by independent hashes."""
    parts = F.ceil(F.col("size") / PIECE).cast("int")
    deals = F.when(parts > 1, F.array(*[F.pmod(F.xxhash64("node", F.lit(i)), parts).cast("int") + i * parts for i in range(2)])).otherwise(F.array(F.lit(0)))
    return members.select("key", "node", F.explode(deals).alias("piece"))


def _first_search(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (u, v) in each block (members: key, node, size): one for each member at most, and so a number in
    proportion to the members."""
    dealt = dealt_twice(members).join(points, "node").repartition("key", "piece").sortWithinPartitions("key", "piece", "n", "node")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cut in whole_groups(batches, ["key", "piece"]):
            yield _pairs(rows["node"].to_numpy(), *nearest_earlier(unpacked(rows["point"]), rows["n"].to_numpy(), cut, percent))

    return dealt.mapInPandas(search, PAIRS)


def open_blocks(known: DataFrame) -> DataFrame | None:
    """The blocks (known: key, node, size, component) that hold more than one component, with the largest one in them and the
    numbers of pieces inside and outside it; None if there are none."""
    each = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    top = each.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    top = top.select(F.col("key").alias("t_key"), F.col("top.component").alias("largest"), F.ceil(F.col("top.m") / PIECE).cast("int").alias("p_in"), F.ceil((F.col("all") - F.col("top.m")) / PIECE).cast("int").alias("p_out"))
    top = C.materialise(top, "open")
    n = top.count()
    return (F.broadcast(top) if n <= BROADCAST_ROWS else top) if n else None


def open_pieces(known: DataFrame, top: DataFrame) -> DataFrame:
    """key, lo, hi, own, node, component: pairs of pieces of the open blocks. Members of the largest component of a block meet
    the others only."""
    rows = known.join(top, F.col("key") == F.col("t_key")).withColumn("out", F.col("component") != F.col("largest"))
    # Pieces 0 to p_out - 1 hold the members outside the largest component, the next p_in those inside.
    rows = rows.withColumn("own", F.when(F.col("out"), F.pmod(F.xxhash64("node"), F.col("p_out"))).otherwise(F.col("p_out") + F.pmod(F.xxhash64("node"), F.col("p_in"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("p_out") + F.col("p_in")).otherwise(F.col("p_out")) - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return rows.select("key", "lo", "hi", "own", "node", "component")


def open_rows(known: DataFrame, top: DataFrame) -> DataFrame:
    """key, node of the members of the open blocks."""
    return known.join(top, F.col("key") == F.col("t_key")).select("key", "node")


def belongs(i: np.ndarray, j: np.ndarray, key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which pairs of rows (i, j) of the blocks key belong there: those whose lists first share no lesser key. Every key of a
    list is an open block of its row, so a pair that is left out here meets again in a block with a lesser key."""
    out = [np.empty(0, bool)]
    for at in range(0, len(i), LISTS):
        a, b = i[at : at + LISTS], j[at : at + LISTS]
        x = first[a]
        x = np.where(x < key[a][:, None], x, -1)
        out.append(~(x[:, :, None] == first[b][:, None, :]).any((1, 2)))
    return np.concatenate(out)


def _second_search(known: DataFrame, top: DataFrame, points: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Candidate pairs (u, v) of different components, all or for each member and piece the nearest, in the open blocks; a pair
    only in the block to which it belongs."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cut in whole_groups(batches, ["key", "lo", "hi"]):
            node, comp, n, own, key = (rows[c].to_numpy() for c in ("node", "component", "n", "own", "key"))
            first = np.stack(rows["first"].to_numpy())

            def mine(i: np.ndarray, j: np.ndarray, key: np.ndarray = key, first: np.ndarray = first) -> np.ndarray:
                return belongs(i, j, key, first)

            yield _pairs(node, *candidates(unpacked(rows["point"]), n, cut, percent, np.ones(len(n), bool), comp, own, nearest, mine))

    keys = F.concat(F.sort_array(F.collect_set("key")), F.array_repeat(F.lit(NO_KEY), OPEN_KEYS))  # as many as a text's prefix has
    firsts = open_rows(known, top).groupBy("node").agg(F.slice(keys, 1, OPEN_KEYS).alias("first"))
    dealt = open_pieces(known, top).join(points.join(firsts, "node"), "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "node")
    return dealt.mapInPandas(search, PAIRS)


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The distinct pairs (u, v) whose sets are linked. A text is read once for every PARTNERS pairs that name it or so; its
    set goes to each of them."""
    pairs = C.materialise(pairs.distinct(), "pairs")
    n_pairs = pairs.count()
    ends = pairs.select(F.col("u").alias("node"), "u", "v").unionByName(pairs.select(F.col("v").alias("node"), "u", "v"))
    if n_pairs > PARTNERS:  # a node in more pairs than that has them in several lists
        lists = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PARTNERS).select("node", F.ceil(F.col("n") / PARTNERS).cast("int").alias("lists"))
        ends = ends.join(F.broadcast(lists) if n_pairs <= PARTNERS * BROADCAST_ROWS else lists, "node", "left").withColumn("slot", F.when(F.col("lists") > 1, F.pmod(F.xxhash64("u", "v"), F.col("lists")).cast("int")).otherwise(0))
    else:
        ends = ends.withColumn("slot", F.lit(0))
    ends = ends.groupBy("node", "slot").agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"))
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), C.whole_text().alias("text")).join(F.broadcast(ends) if n_pairs <= BROADCAST_ROWS else ends, "node")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def frame() -> pd.DataFrame:
            rows = pd.DataFrame(held, columns=["u", "v", "node", "s"])
            held.clear()
            return rows

        for batch in batches:
            for node, us, vs, h in zip(batch["node"], batch["us"], batch["vs"], batch["h"], strict=True):
                own = shingles(h, k).tobytes()
                for u, v in zip(us, vs, strict=True):
                    held.append((u, v, node, own))
                    size += len(own) + 64
                    if size > FRAME_BYTES:
                        yield frame()
                        size = 0
        if held:
            yield frame()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cut in whole_groups(batches, ["u", "v"]):
            u, node, s = rows["u"].to_numpy(), rows["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["s"]]
            linked = []
            for start, end in zip(cut[:-1], cut[1:], strict=True):
                a, b = ([s[i] for i in range(start, end) if (node[i] == u[start]) == first] for first in (True, False))
                if any((100 + percent) * len(np.intersect1d(x, y, True)) >= percent * (len(x) + len(y)) for x in a for y in b):
                    linked.append(start)
            yield pd.DataFrame({"u": u[linked], "v": rows["v"].to_numpy()[linked]})

    sent = rows.select("node", "us", "vs", C.word_hashes(F.col("text")).alias("h")).mapInPandas(sets, "u long, v long, node long, s binary")
    return C.materialise(sent.repartition("u", "v").sortWithinPartitions("u", "v").mapInPandas(verify, PAIRS), "links")


def _linked(docs: DataFrame, labels: DataFrame, classes: DataFrame, points: DataFrame, k: int, percent: int) -> DataFrame:
    """node, linked (documents of the other classes that node's class is linked with; left out where none). labels: node,
    component. A component is cut into pieces by the bytes of its sets, so that it is sent as often as it has pieces of COUNT_BYTES."""
    sizes = labels.join(points.select("node", "n"), "node").groupBy("component").agg(F.ceil(F.sum("n") * 8 / COUNT_BYTES + F.count(F.lit(1)) / COUNT_PIECE).cast("int").alias("parts"))
    ids = _small(C.materialise(labels.join(sizes, "component").join(classes.groupBy("node").agg(F.sum("docs").alias("docs")), "node"), "labelled"))
    found = docs.select(F.col("doc_id").cast("long").alias("node"), C.whole_text().alias("text")).join(ids, "node")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = [shingles(h, k) for h in batch.pop("h")]
            yield batch.assign(n=[len(x) for x in s], point=[packed(point(x)) for x in s], s=[x.tobytes() for x in s])

    pieces = found.select("component", "parts", "docs", "node", C.word_hashes(F.col("text")).alias("h")).mapInPandas(sets, "component long, parts int, docs long, node long, n long, point binary, s binary")
    pieces = pieces.where("n > 0").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pieces = pieces.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cut in whole_groups(batches, ["component", "lo", "hi"]):
            for start, end in zip(cut[:-1], cut[1:], strict=True):
                yield counted(rows.iloc[start:end])

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
        rows = rows[~rows.duplicated(["node", "s"]).to_numpy()]  # repeated rows of a document are one member
        node, n, docs, own = (rows[c].to_numpy() for c in ("node", "n", "docs", "own"))
        points = unpacked(rows["point"])
        ids = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["s"]]), return_inverse=True)[1]
        starts = np.cumsum(n) - n
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        linked = np.zeros(len(rows), np.int64)
        if len(left) and len(right):
            mark = np.zeros(int(ids.max()) + 1, np.int64)
            who, found = RTree(points[right], n[right]).pairs(points[left], n[left], percent)
            order = np.argsort(who, kind="stable")
            who, found = left[who[order]], right[found[order]]
            found, who = found[node[found] != node[who]], who[node[found] != node[who]]
            cut = np.append(np.flatnonzero(np.append(True, who[1:] != who[:-1])), len(who)) if len(who) else [0]
            for first_at, end in zip(cut[:-1], cut[1:], strict=True):
                i, at = who[first_at], found[first_at:end]
                mine = ids[starts[i] : starts[i] + n[i]]
                mark[mine] = 1
                first = np.cumsum(n[at]) - n[at]
                both = np.add.reduceat(mark[ids[np.repeat(starts[at] - first, n[at]) + np.arange(n[at].sum())]], first)
                mark[mine] = 0
                at = at[(100 + percent) * both >= percent * (n[i] + n[at])]
                linked[i] += docs[at].sum()
                if lo != hi:
                    np.add.at(linked, at, docs[i])
        return pd.DataFrame({"node": node, "linked": linked})

    dealt = pieces.select("component", "lo", "hi", "own", "node", "docs", "n", "point", "s").repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return C.materialise(dealt.mapInPandas(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked")), "linked")


def same_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes (d1, d2, node) of one doc_id's texts, where they differ."""
    many = known.select("doc_id", "d1", "d2").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("doc_id")
    same = known.join(many, "doc_id", "left_semi").join(classes, ["d1", "d2"]).select("doc_id", "node")
    return same.join(same.groupBy("doc_id").agg(F.min("node").alias("u")), "doc_id").select("u", F.col("node").alias("v")).where("u < v")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs, and n_links with count_links: the number of other documents it
    is linked with. Two documents are linked when 100 * shared shingles >= percent * all shingles of the two."""
    index = _index(docs, k, percent)
    known = index.where("keys IS NOT NULL")
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count_distinct("doc_id").alias("docs"))
    firsts = known.join(_small(classes.select("node").distinct()), F.col("doc_id") == F.col("node"), "left_semi")
    keys = firsts.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key")).where("key IS NOT NULL")
    members = _members(keys)
    points = firsts.select(F.col("doc_id").alias("node"), "n", "point").distinct()
    links = verified(_first_search(members, points, percent), docs, k, percent)  # NEAREST[0]
    links = links.unionByName(same_ids(known, classes))
    labels = components(links)
    for nearest in NEAREST[1:]:
        now = members.join(labels, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
        top = open_blocks(now)
        if top is None:
            break
        more = verified(_second_search(now, top, points, percent, nearest), docs, k, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    roots = classes.join(labels, "node", "left")
    if count_links:
        roots = roots.join(_linked(docs, labels, classes, points, k, percent), "node", "left")
    else:
        roots = roots.withColumn("linked", F.lit(None).cast("long"))
    roots = roots.select("d1", "d2", F.coalesce("component", "node").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("docs") - 1).alias("links"))
    out = index.where("n > 0 AND doc_id IS NOT NULL").join(roots, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))
    alone = index.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = out.unionByName(alone)
    return out if count_links else out.drop("n_links")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.parquet(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)
