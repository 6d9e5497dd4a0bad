"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of bigrams, add-one estimates of words and the uniform distribution (over the words and one for
all unknown) are mixed with weights that depend on how often the context was seen (buckets of powers of two). The weights
are learned by expectation-maximisation on the counts of a held-out seventh of the training documents, which is left out
("deleted") of the estimates while they are learned. Every word and every bigram of training is counted; nothing is cut.

Texts become blocks of about BLOCK tokens: a sorted dictionary of word keys and the tokens as places in it. A block sends
its distinct words and bigrams, with their training counts in it, to parts of the key space (about PART tokens' worth each);
a part adds up what the blocks sent and answers each of them in the order asked. So a word in every text is one key per
block, counting and looking up are one shuffle, and the answers are a byte or two per key. A block then has the counts of
all its tokens, words and contexts at hand. Words and bigrams are named by 64-bit hashes.

Edge cases: a null or empty text has the end token only; without training tokens N and V are 0, no word is known and the
model is uniform over the one class that remains; null ids count as the empty text in the fold; rows may repeat and
each comes back. Other columns are not read. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import common as C

BLOCK, PART, BUCKETS, ROUNDS, STEP = 1 << 20, 1 << 21, 24, 60, 0.05
END = -0x5E3D  # stands for the end token; a word with this hash would share its count
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
REMEMBERED = 200_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
CODED = "block long, deleted boolean, doc_id array<long>, no_id array<boolean>, held_out array<boolean>, sizes array<int>, words binary, tokens binary"


def folds() -> tuple[Column, Column]:
    """Whether a row is held out of training (its crc32 modulo 7 is 2), and whether it is the deleted seventh (3)."""
    return C.fold("doc_id", 7) == 2, C.fold("doc_id", 7) == 3


class Keys(dict):
    """The 64-bit key of a word (bytes, as a signed number); the words met are remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 42)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def small(x: np.ndarray) -> bytes:
    """Counts as bytes, one, two, four or eight for each."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)).tobytes()


def wide(b: bytes, n: int) -> np.ndarray:
    """What small made of n counts."""
    return np.frombuffer(b, f"u{len(b) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def coded(docs: DataFrame, train: bool) -> DataFrame:
    """The blocks of docs. Those of the deleted seventh are apart; without train no row counts for training."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, held = Keys(), {False: [[], [], [], [], []], True: [[], [], [], [], []]}

        def block(deleted: bool) -> pd.DataFrame:
            ids, none, out, sizes, hashes = held[deleted]
            held[deleted] = [[], [], [], [], []]
            words, tokens = np.unique(np.array(hashes, np.int64).view(np.uint64) * M1, return_inverse=True)  # an odd factor keeps keys apart
            return pd.DataFrame({"block": [uuid.uuid4().int >> 65], "deleted": [deleted], "doc_id": [ids], "no_id": [none], "held_out": [out], "sizes": [sizes], "words": [words.tobytes()], "tokens": [small(tokens)]})

        for batch in batches:
            for doc, no_id, out, deleted, text in zip(batch["doc_id"], batch["no_id"], batch["held_out"], batch["deleted"], batch["text"], strict=True):
                words = text.encode().translate(LOWER).split()  # bytes are cut at ASCII white space alone
                own = held[deleted]
                if own[4] and len(own[4]) + len(words) > BLOCK:
                    yield block(deleted)
                    own = held[deleted]
                own[0].append(int(doc))
                own[1].append(bool(no_id))
                own[2].append(bool(out))
                own[3].append(len(words) + 1)
                own[4] += map(keys.__getitem__, words)
                own[4].append(END)
        for deleted in (False, True):
            if held[deleted][0]:
                yield block(deleted)

    out, deleted = folds()
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), out.alias("held_out"), (deleted if train else F.lit(False)).alias("deleted"), C.whole_text().alias("text"))
    return C.materialise(rows.mapInPandas(code, CODED), "blocks", compression="zstd")


@dataclass
class Block:
    """A block's tokens: document, place of the context's and of the token's word, place of the bigram; keys of both."""

    doc: np.ndarray
    u: np.ndarray
    v: np.ndarray
    pair: np.ndarray
    words: np.ndarray
    pairs: np.ndarray


def opened(row) -> Block:
    words = np.frombuffer(row.words, np.uint64)
    v = wide(row.tokens, int(sum(row.sizes)))
    end = int(np.searchsorted(words, np.array([END], np.int64).view(np.uint64) * M1)[0])
    u = np.append(end, v[:-1])  # every text follows an end token
    key = (words[u] ^ (words[u] >> np.uint64(29))) * M2 + words[v]
    key = (key ^ (key >> np.uint64(32))) * M2
    pairs, pair = np.unique(key ^ (key >> np.uint64(29)), return_inverse=True)
    return Block(np.repeat(np.arange(len(row.sizes)), row.sizes), u, v, pair, words, pairs)


def requests(blocks: DataFrame, n_tokens: int, train: bool) -> DataFrame:
    """kind (1 words, 2 bigrams), part, block, deleted, keys, c (training count in the block), held (of it, the deleted)."""
    parts = {1: max(1, n_tokens // (4 * PART)), 2: max(1, n_tokens // PART)}

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                b = opened(row)
                trains = ~np.array(row.held_out, bool)[b.doc] if train else np.zeros(len(b.doc), bool)
                for kind, keys, at in ((1, b.words, b.v), (2, b.pairs, b.pair)):
                    c = np.bincount(at[trains], minlength=len(keys))
                    edges = np.searchsorted(keys, [np.uint64((i << 64) // parts[kind]) for i in range(1, parts[kind])])
                    cut = [0, *edges.tolist(), len(keys)]
                    rows = [(kind, p, keys[lo:hi].tobytes(), small(c[lo:hi])) for p, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo]
                    yield pd.DataFrame(rows, columns=["kind", "part", "keys", "c"]).assign(block=row.block, deleted=row.deleted)

    return blocks.mapInPandas(ask, "kind int, part int, keys binary, c binary, block long, deleted boolean")


def answers(asked: DataFrame, tell: Column) -> DataFrame:
    """For the requests that tell holds for: kind, part, block, deleted, n (keys), c and held (training counts of all blocks
    together); and a row for each part with block -1: types (keys with c > 0), tokens and fit (their sums, all and not deleted)."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["keys"].map(len).to_numpy() // 8
        ends = np.cumsum(sizes)
        keys, at = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in rows["keys"]]), return_inverse=True)
        own = np.concatenate([wide(c, n) for c, n in zip(rows["c"], sizes, strict=True)])
        whole = lambda x: np.rint(np.bincount(at, x, len(keys))).astype(np.int64)
        c, held = whole(own), whole(np.where(np.repeat(rows["deleted"].to_numpy(), sizes), own, 0))
        out = [(b, d, int(n), small(c[x]), small(held[x]), 0, 0, 0) for b, d, n, end, t in zip(rows["block"], rows["deleted"], sizes, ends, rows["tell"], strict=True) if t for x in (at[end - n : end],)]
        out.append((-1, False, 0, b"", b"", int((c > 0).sum()), int(c.sum()), int((c - held).sum())))
        return pd.DataFrame(out, columns=["block", "deleted", "n", "c", "held", "types", "tokens", "fit"]).assign(kind=rows["kind"].iloc[0], part=rows["part"].iloc[0])

    schema = "block long, deleted boolean, n long, c binary, held binary, types long, tokens long, fit long, kind int, part int"
    return C.materialise(asked.withColumn("tell", tell).groupBy("kind", "part").applyInPandas(count, schema), "answers", compression="zstd")


def counts_of(answer: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(c, held) of a block's keys of a kind, in their order."""
    rows = answer[answer["kind"] == kind].sort_values("part")
    return tuple(np.concatenate([wide(b, n) for b, n in zip(rows[x], rows["n"], strict=True)]) for x in ("c", "held"))


@dataclass
class Model:
    """p(v | u) = l2[b] c(u, v) / c(u) + l1[b] (c(v) + 1) / (N + V + 1) + l0[b] / (V + 1), with b the bucket of c(u)."""

    docs: DataFrame
    blocks: DataFrame
    asked: DataFrame
    answered: DataFrame
    n_tokens: int
    tokens: int
    types: int
    weights: np.ndarray


def bucket(count: np.ndarray) -> np.ndarray:
    """The power of two of count + 1, capped."""
    return np.minimum(np.frexp(count + 1.0)[1] - 1, BUCKETS - 1)


def learn_weights(events: pd.DataFrame) -> np.ndarray:
    """Mixture weights (uniform, unigram, bigram) of each bucket, by expectation-maximisation on the histogram of held-out
    events: bucket, the two likelihood ratios over the unigram part (logarithms in steps; null for 0), and their number."""
    weights = np.tile([0.02, 0.5, 0.48], (BUCKETS, 1))
    for b, rows in events.groupby("bucket"):
        ratio = np.stack([np.exp(rows["r0"] * STEP), np.ones(len(rows)), np.exp(rows["r2"] * STEP).fillna(0.0)], 1)
        n = rows["n"].to_numpy(float)
        for _ in range(ROUNDS):
            share = weights[b] * ratio
            share *= (n / share.sum(1))[:, None]
            weights[b] = share.sum(0) / n.sum()
    weights = np.maximum(weights, 1e-6)
    return weights / weights.sum(1, keepdims=True)


def fit(docs: DataFrame) -> Model:
    """N, V, the weights and the tables of counts that scoring reads."""
    blocks = coded(docs, True)
    n_tokens = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    asked = requests(blocks, n_tokens, True)
    answered = answers(asked, F.lit(True))
    total = answered.where("block < 0 AND kind = 1").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), F.sum("fit").alias("fit")).first()
    n, v, n_fit = total.n or 0, total.v or 0, total.fit or 0

    def histogram(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        b = opened(next(block.itertuples()))
        (c, held), (c2, held2) = counts_of(answer, 1), counts_of(answer, 2)
        # The deleted seventh is left out of the estimates for the weights.
        fu, fv, two = (c - held)[b.u], (c - held)[b.v], (c2 - held2)[b.pair]
        one = (fv + 1) / (n_fit + v + 1.0)
        step = lambda x: np.rint(np.log(x) / STEP)
        seen = two > 0
        r2 = np.full(len(two), np.nan)
        r2[seen] = step(two[seen] / np.maximum(fu[seen], 1) / one[seen])
        rows = pd.DataFrame({"bucket": bucket(fu), "r0": step(1 / (v + 1.0) / one), "r2": r2})
        return rows.groupby(["bucket", "r0", "r2"], dropna=False).size().reset_index(name="n").astype({"bucket": "int64", "r0": "int64", "r2": "Int64", "n": "int64"})

    apart = blocks.where("deleted").groupBy("block").cogroup(answered.where("deleted").groupBy("block"))
    # Ratios lie in steps of 5 % between a few bounds, so this histogram has a bounded number of rows.
    found = apart.applyInPandas(histogram, "bucket long, r0 long, r2 long, n long").groupBy("bucket", "r0", "r2").agg(F.sum("n").alias("n"))
    return Model(docs, blocks, asked, answered, n_tokens, n, v, learn_weights(found.orderBy("bucket", "r0", "r2").toPandas()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    blocks, answered, n, v, weights = model.blocks, model.answered, model.tokens, model.types, model.weights
    if docs is not model.docs:  # other texts than the model's own ask with counts of 0
        blocks = coded(docs, False)
        asked = requests(blocks, model.n_tokens, False).withColumn("new", F.lit(True)).unionByName(model.asked.withColumn("new", F.lit(False)))
        answered = answers(asked, F.col("new"))

    def rows(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples())
        b, size = opened(row), len(row.sizes)
        c, c2 = counts_of(answer, 1)[0], counts_of(answer, 2)[0]
        cu, cv, w = c[b.u], c[b.v], weights[bucket(c)][b.u]
        p = w[:, 2] * c2[b.pair] / np.maximum(cu, 1) + w[:, 1] * (cv + 1) / (n + v + 1.0) + w[:, 0] / (v + 1.0)
        total = lambda x: np.bincount(b.doc, x, size)
        n_tokens = np.asarray(row.sizes, np.int64)
        out = {"doc_id": pd.Series(np.asarray(row.doc_id, np.int64)).astype("Int64").mask(np.array(row.no_id, bool)), "held_out": row.held_out, "n_tokens": n_tokens, "n_known": np.rint(total((cv > 0).astype(float))).astype(np.int64), "train_tokens": n}
        return pd.DataFrame(out | {"base_score": total(np.log10(cv + 1.0)) - n_tokens * np.log10(n + v + 1.0), "score": total(np.log10(p))})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answered.where("block >= 0").groupBy("block")).applyInPandas(rows, schema)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.parquet(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs))
