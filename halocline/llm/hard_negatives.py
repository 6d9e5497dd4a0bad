"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors become whole numbers, are ordered by label and by their place on a Hilbert curve through the dimensions that vary
most, and are written as a Parquet table of blocks: a row per BLOCK vectors, with the least and greatest value of every
dimension (its zone map) in columns of their own. Interval arithmetic on a zone map bounds the score of an anchor with
every vector of a block from both sides; only blocks whose bounds meet a score window of an anchor are read for it.

Two searches use it. The first finds each anchor's positives: its window begins at the score that its own block already
offers. The second finds the negatives in the windows that the positives' scores give. Both run over tiles (ranges of the
order) by chunks of anchors, so a task holds a tile and a chunk whatever the number of rows, hot labels and repeated vectors
included; inside, the scores found so far raise the bound that a block has to meet. The answers are exact.

Edge cases: rows without vec_id, label or vector, or with a null or non-finite component, take no part; rows alike in
vec_id, label and vector count once; rows that share a vec_id otherwise are rows of their own, but never partners of each
other; a shorter vector counts as filled up with zeros; scores outside a long are cut to its range; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.llm import common as C

BLOCK, CHUNK, ANCHORS_AT_ONCE = 512, 16_384, 1024
#: Rows of a tile, between these bounds: small tables have small tiles, so that all tasks have work.
TILES, TILE_ROWS = 64, (2048, 65_536)
#: Dimensions and bits of the curve: a key of 64 bits.
CURVE_DIMS, CURVE_BITS, SPREAD = 16, 4, 2.5
SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
EXACT = float(1 << 53)
LONG = 2**63 - 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (one whole number of so many bits per dimension), as a signed long."""
    x = cells.astype(np.int64)
    n = x.shape[1]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[:, n - 1] & q, q - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[:, i] >> b) & 1).astype(np.uint64)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def packed(m: np.ndarray) -> bytes:
    """Whole numbers as 4 or 8 bytes each."""
    return (m.astype("<i4") if np.abs(m).max(initial=0) < 1 << 31 else m.astype("<f8")).tobytes()


def unpacked(b: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(b, "<i4" if len(b) == 4 * rows * dims else "<f8").reshape(rows, dims).astype(np.float64)


def dots(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: as doubles where every sum fits, else as Python's whole numbers, cut to a long."""
    if fits(a, m):
        return a @ m.T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(m).T, -LONG - 1, LONG)


def fits(a: np.ndarray, m: np.ndarray) -> bool:
    return np.abs(a).max(initial=0) * np.abs(m).max(initial=0) * a.shape[1] < EXACT


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) possible inner product of each row of a with a vector between low and high (a row per block)."""
    if not (fits(a, low) and fits(a, high)):
        return np.full((len(a), len(low)), -np.inf), np.full((len(a), len(low)), np.inf)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def participants(rows: DataFrame) -> DataFrame:
    """vec_id, label (moved for every seventh id), v (whole numbers) of the rows that take part."""
    fine = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.col("label").cast("long")
    scaled = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(4e18)), F.lit(-4e18))).cast("double")
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.transform("embedding", scaled).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of dims numbers; what a list lacks is 0."""
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(sizes), dims))
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def write_blocks(rows: DataFrame) -> tuple[DataFrame, int, int] | None:
    """The block table of rows (vec_id, label, v), the number of dimensions and of tiles; None without rows. Columns: tile,
    block, n, ids, labels, m, label_low, label_high, low, high, part (of the anchors of the tile, CHUNK at most)."""
    total, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return None
    dims = max(1, dims)
    spread = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    widest = spread.orderBy(F.desc("std"), "d").limit(CURVE_DIMS).collect()  # CURVE_DIMS rows
    axes, mean, std = (np.array([r[c] for r in widest]) for c in ("d", "mean", "std"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("v"), dims)
            keys = np.zeros(len(m), np.int64)
            if len(axes):
                place = (m[:, axes] - mean) / np.maximum(std, 1e-9) / (2 * SPREAD) + 0.5
                keys = hilbert(np.clip(np.floor(place * (1 << CURVE_BITS)), 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(keys), pa.array([packed(r) for r in m], pa.binary())], names=["vec_id", "label", "key", "v"])

    tile_rows = min(max(-(-total // TILES), TILE_ROWS[0]), TILE_ROWS[1])
    tiles = -(-total // tile_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        tile, last, anchors, number = TaskContext.get().partitionId(), None, 0, 0
        held: list[tuple] = []

        def block() -> pd.DataFrame:
            nonlocal anchors, number
            ids, labels = (np.array([r[i] for r in held], np.int64) for i in (0, 1))
            m = np.concatenate([unpacked(r[2], 1, dims) for r in held])
            row = {"tile": tile, "block": number, "n": len(m), "ids": ids.tobytes(), "labels": labels.tobytes(), "m": packed(m), "label_low": labels.min(), "label_high": labels.max(), "low": m.min(0).tobytes(), "high": m.max(0).tobytes(), "part": anchors // CHUNK}
            number, anchors = number + 1, anchors + int((ids % EVERY == 0).sum())
            held.clear()
            return pd.DataFrame([row])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "v")), strict=True):
                if row != last:
                    held.append(row)
                    last = row
                if len(held) == BLOCK:
                    yield from arrow(block())
        if held:
            yield from arrow(block())

    def arrow(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pandas(rows, schema=pa.schema([("tile", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "m")], ("label_low", pa.int64()), ("label_high", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("part", pa.int32())]))

    order = ["label", "key", "vec_id", "v"]
    keyed = rows.mapInArrow(key, "vec_id long, label long, key long, v binary").repartitionByRange(tiles, *order).sortWithinPartitions(*order)
    schema = "tile int, block int, n int, ids binary, labels binary, m binary, label_low long, label_high long, low binary, high binary, part int"
    return C.materialise(keyed.select("vec_id", "label", "v").mapInArrow(cut, schema), "blocks"), dims, tiles


ANCHORS = "chunk long, uid long, id long, label long, v binary, lows array<double>, highs array<double>"


def anchors_of(blocks: DataFrame, dims: int, tile_rows_per_chunk: int) -> DataFrame:
    """A row per anchor, with one window: from the score of the last of POSITIVES partners in its own block upwards."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                ids, labels, m = np.frombuffer(b.ids, np.int64), np.frombuffer(b.labels, np.int64), unpacked(b.m, b.n, dims)
                at = np.flatnonzero(ids % EVERY == 0)
                if not len(at):
                    continue
                low = np.full(len(at), -np.inf)
                if b.n >= POSITIVES and fits(m, m):
                    s = np.where((labels[at, None] == labels) & (ids[at, None] != ids), dots(m[at], m), -np.inf)
                    low = np.partition(s, -POSITIVES, axis=1)[:, -POSITIVES]
                yield pd.DataFrame({"chunk": (b.tile // tile_rows_per_chunk) * (1 << 32) + b.part, "uid": (b.tile << 40) + (b.block << 12) + at, "id": ids[at], "label": labels[at], "v": [packed(r) for r in m[at]], "lows": [[x] for x in low], "highs": [[np.inf]] * len(at)})

    return C.materialise(blocks.select("tile", "block", "n", "ids", "labels", "m", "part").mapInPandas(find, ANCHORS), "anchors")


def search(blocks: DataFrame, anchors: DataFrame, dims: int, tiles: int, same: bool, k: int) -> DataFrame:
    """uid, w (number of the window), score, id, rank: for each window of each anchor its first k vectors of the same or of
    another label, by score and id."""
    # A row per CHUNK anchors and one per tile of rows.
    chunks = [r.chunk for r in anchors.select("chunk").distinct().collect()]
    if not chunks:
        chunks = [0]
    everywhere = anchors.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    zones = blocks.select("tile", "block", "label_low", "label_high", "low", "high", F.explode(F.array(*[F.lit(c).cast("long") for c in chunks])).alias("chunk"))

    def wanted(a: np.ndarray, rows: pd.DataFrame, low: np.ndarray, high: np.ndarray, zone: pd.DataFrame) -> np.ndarray:
        """Anchor by block: whether a vector of the block may lie in a window [low, high] of the anchor."""
        least, most = bounds(a, *(np.stack([np.frombuffer(x, np.float64) for x in zone[c]]) for c in ("low", "high")))
        of, lo, hi = rows["label"].to_numpy()[:, None], zone["label_low"].to_numpy(), zone["label_high"].to_numpy()
        fit = (lo <= of) & (of <= hi) if same else (lo != of) | (hi != of)
        for w in range(low.shape[1]):
            found = (most >= low[:, w, None]) & (least <= high[:, w, None])
            met = found if w == 0 else met | found
        return fit & met

    def opened(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors' vectors, and the ends of their windows, padded with empty ones."""
        a = np.concatenate([unpacked(x, 1, dims) for x in rows["v"]])
        n = rows["lows"].map(len).to_numpy()
        low, high = np.full((len(rows), n.max()), np.inf), np.full((len(rows), n.max()), -np.inf)
        inside = np.arange(n.max()) < n[:, None]
        low[inside], high[inside] = np.concatenate(rows["lows"].to_numpy()), np.concatenate(rows["highs"].to_numpy())
        return a, low, high

    def choose(rows: pd.DataFrame, zone: pd.DataFrame) -> pd.DataFrame:
        """The blocks of a tile that a chunk must read."""
        need = np.zeros(len(zone), bool)
        for i in range(0, len(rows) if len(zone) else 0, ANCHORS_AT_ONCE):
            part = rows.iloc[i : i + ANCHORS_AT_ONCE]
            a, low, high = opened(part)
            need |= wanted(a, part, low, high, zone).any(0)
        return zone.loc[need, ["tile", "block", "chunk"]]

    def read(rows: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = [read_part(rows.iloc[i : i + ANCHORS_AT_ONCE], data) for i in range(0, len(rows) if len(data) else 0, ANCHORS_AT_ONCE)]
        return pd.concat(found) if found else pd.DataFrame({"uid": [], "w": [], "score": [], "id": []})

    def read_part(rows: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        a, low, high = opened(rows)
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        least, most = bounds(a, *(np.stack([np.frombuffer(x, np.float64) for x in data[c]]) for c in ("low", "high")))
        score = np.empty(0, object)
        group, other = np.empty(0, np.int64), np.empty(0, np.int64)
        windows = low.shape[1]
        for j, b in enumerate(data.itertuples()):
            may = ((most[:, j, None] >= low) & (least[:, j, None] <= high)).any(1)
            at = np.flatnonzero(may)
            if not len(at):
                continue
            b_ids, b_labels = np.frombuffer(b.ids, np.int64), np.frombuffer(b.labels, np.int64)
            s = dots(a[at], unpacked(b.m, b.n, dims))
            mask = ((labels[at, None] == b_labels) == same) & (ids[at, None] != b_ids)
            new = []
            for w in range(windows):
                ok = mask & (s >= low[at, w, None]) & (s <= high[at, w, None])
                some = np.flatnonzero(ok.any(1))
                if len(some) and b.n > k:  # no more than the first k of the block, and their ties
                    own = np.where(ok[some], s[some], -np.inf)
                    ok[some] &= own >= np.partition(own, -k, axis=1)[:, -k, None]
                r, c = np.nonzero(ok)
                new.append((at[r] * windows + w, s[r, c], b_ids[c]))
            if not sum(len(x[0]) for x in new):
                continue
            group, score, other = (np.concatenate([old, *x]) for old, x in zip((group, score.astype(s.dtype) if not len(score) else score, other), zip(*new, strict=True), strict=True))
            order = np.lexsort((other, -score, group))
            group, score, other = group[order], score[order], other[order]
            place = np.arange(len(group)) - np.searchsorted(group, group, "left")
            group, score, other = group[place < k], score[place < k], other[place < k]
            full = np.flatnonzero(place[place < k] == k - 1)
            low[group[full] // windows, group[full] % windows] = score[full]  # later ones must reach the last of k
        return pd.DataFrame({"uid": rows["uid"].to_numpy()[group // windows], "w": group % windows, "score": [int(x) for x in score], "id": other})

    keys = ["tile", "chunk"]
    needed = everywhere.groupBy(*keys).cogroup(zones.groupBy(*keys)).applyInPandas(choose, "tile int, block int, chunk long")
    data = needed.join(blocks.select(*[F.col(c).alias(c) for c in ("tile", "block", "n", "ids", "labels", "m", "low", "high")]), ["tile", "block"])
    again = everywhere.select(*[F.col(c).alias(c) for c in everywhere.columns])
    best = again.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(read, "uid long, w int, score long, id long")
    order = W.partitionBy("uid", "w").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for columns vec_id, embedding, label."""
    made = write_blocks(C.materialise(participants(rows), "vectors"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if made is None:
        return rows.sparkSession.createDataFrame([], schema)
    blocks, dims, tiles = made
    tile_rows = TILE_ROWS[1] if tiles > TILES else TILE_ROWS[0]
    anchors = anchors_of(blocks, dims, max(1, CHUNK * EVERY // tile_rows))
    positives = C.materialise(search(blocks, anchors, dims, tiles, True, POSITIVES), "positives")
    # 50 p <= 100 s <= 95 p in whole numbers; without a positive score (or 0) no s meets both.
    windows = positives.where("score >= 0").selectExpr("uid", "rank - 1 AS p_rank", "id AS positive_id", "score AS positive_score", "score div 2 + score % 2 AS low", "score - (score div 20 + if(score % 20 > 0, 1, 0)) AS high").where("low <= high")
    windows = C.materialise(windows, "windows")
    each = windows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("p_rank", "low", "high"))).alias("ws"))  # POSITIVES at most
    asked = anchors.drop("lows", "highs").join(each, "uid").select("chunk", "uid", "id", "label", "v", F.expr("transform(ws, x -> cast(x.low AS double))").alias("lows"), F.expr("transform(ws, x -> cast(x.high AS double))").alias("highs"), F.expr("transform(ws, x -> x.p_rank)").alias("ranks"))
    asked = C.materialise(asked, "asked")
    negatives = search(blocks, asked.drop("ranks"), dims, tiles, False, NEGATIVES)
    out = negatives.join(asked.select("uid", F.col("id").alias("anchor_id"), "ranks"), "uid").withColumn("p_rank", F.expr("ranks[w]")).join(windows.select("uid", "p_rank", "positive_id", "positive_score"), ["uid", "p_rank"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(C.parquet(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


SQL = f"""
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= {NEGATIVES}
"""
