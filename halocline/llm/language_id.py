"""Language identification with hyperdimensional profiles.

Every lower-case letter has a fixed random vector of +1 and -1, made from a hash of its code point; all that is no letter has
one more. A letter 3-gram is the product of its letters' vectors, each permuted (rolled) by its place; a document is the
bundle (sum) of its 3-grams and a language prototype the bundle of all 3-grams of its training documents. Prediction is by
the cosine of document and prototype, both without the mean prototype. Bundles are integers and additive: tasks bundle what
they read, Spark adds the coordinates.

Edge cases: a text that is null or has no letter is `und` with score 0; with nothing learned every text is `und`; ties go
to the first language in code-point order; null ids count as the empty text in the fold; rows may repeat. Other columns
are not read. The model is a row per language value seen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import common as C

DIM, SEED, GRAMS, LANGUAGES, LEAST = 512, 11, 1024, 32, 64


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A row of DIM numbers +1 and -1 for each code point, from a hash of it."""
    return np.concatenate([np.empty((0, DIM), np.int8), *map(_vector, letters.tolist())]).reshape(len(letters), DIM)


@lru_cache(maxsize=4096)
def _vector(letter: int) -> np.ndarray:
    letters = np.array([letter])
    x = letters.astype(np.uint64)[:, None] * np.uint64(DIM // 64) + np.arange(DIM // 64, dtype=np.uint64) + np.uint64(SEED << 40)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    bits = np.unpackbits((x ^ (x >> np.uint64(32))).astype("<u8").view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of a text (0 for all else), its distinct 3-grams with a letter in the middle as rows of three places in
    them, and how often each stands in the text."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), np.uint32)
    marks, at = np.unique(codes, return_inverse=True)
    letters = np.append(0, marks[[chr(c).isalpha() for c in marks]])
    at = np.where(np.isin(marks, letters), np.searchsorted(letters, marks), 0)[at]
    grams = ((at[:-2] * len(letters) + at[1:-1]) * len(letters) + at[2:])[at[1:-1] > 0]
    grams, n = np.unique(grams, return_counts=True)
    return letters, np.stack([grams // len(letters) ** 2, grams // len(letters) % len(letters), grams % len(letters)], 1), n


def bundle(letters: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of the 3-grams' vectors, each as often as it stands in the text."""
    own = letter_vectors(letters)
    a, b, c = np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own
    out = np.zeros(DIM, np.int64)
    for i in range(0, len(grams), GRAMS):
        g = grams[i : i + GRAMS]
        # Sums of up to GRAMS products of +1 and -1 with counts are whole numbers that a double holds exactly.
        out += np.rint(n[i : i + GRAMS].astype(np.float64) @ (a[g[:, 0]] * b[g[:, 1]] * c[g[:, 2]]).astype(np.float32)).astype(np.int64)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-12)


def learn(labelled: DataFrame) -> list[tuple[str, np.ndarray]]:
    """Prototypes (language, vector) from columns text and lang, both not null."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: np.zeros(DIM, np.int64))
        rows = lambda: pa.record_batch([pa.array([x for x in held for _ in range(DIM)], pa.string()), pa.array(np.tile(np.arange(DIM, dtype=np.int32), len(held))), pa.array(np.concatenate(list(held.values())))], names=["lang", "i", "v"])
        for batch in (part for whole in batches for part in C.slices(whole)):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if lang not in held and len(held) >= LANGUAGES:  # memory stays bounded however many languages there are
                    yield rows()
                    held.clear()
                held[lang] += bundle(*gram_counts(text))
        if held:
            yield rows()

    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(sums, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = rows.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
    return sorted((r.lang, np.array(r.v, np.float32)) for r in rows.collect())


def predict(docs: DataFrame, model: list[tuple[str, np.ndarray]], keep: list[str]) -> DataFrame:
    """The columns of keep, untouched, with lang_pred, score and likeness for every row; text is the input. likeness is the
    cosine of document and nearest prototype, nothing taken off; null for a text with under LEAST different 3-grams, too
    short to tell a language from noise."""
    names = [x for x, _ in model]
    table = np.array([unit(v) for _, v in model], np.float32).reshape(len(model), DIM)
    mean = table.mean(axis=0) if len(model) > 1 else np.zeros(DIM, np.float32)
    centred = np.array([unit(v - mean) for v in table], np.float32).reshape(len(model), DIM)
    shared = docs.sparkSession.sparkContext.broadcast((names, mean, centred, table))  # two rows of 2 KB per language
    label, score, likeness, text = C.fresh(docs.select(*keep), "lang_pred", "score", "likeness", "text_in")

    def marks(texts: list[str | None]) -> list[list]:
        names, mean, centred, table = shared.value
        said = []
        for t in texts:
            letters, grams, n = gram_counts(t or "")
            if not len(grams) or not names:
                said.append(("und", 0.0, None))
                continue
            own = unit(bundle(letters, grams, n).astype(np.float32))
            cos = centred @ unit(own - mean)
            best = int(np.argmax(cos))
            said.append((names[best], float(min(1.0, max(0.0, (1 + cos[best]) / 2))), float((table @ own).max()) if len(grams) >= LEAST else None))
        return [list(x) for x in zip(*said, strict=True)] or [[], [], []]

    schema = f"{label} string, {score} double, {likeness} double"
    if ("text", "string") in docs.select(*keep).dtypes:  # it goes to the workers once
        return C.added(docs.select(*keep), "text", schema, marks, stays=True)
    return C.added(docs.select(*keep, F.col("text").cast("string").alias(text)), text, schema, marks)


def training(docs: DataFrame) -> DataFrame:
    """Text and lang of the rows to learn from: lang and text given, not of the held-out fold."""
    return docs.where((C.fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs.withColumn("held_out", C.fold("doc_id", 3) == 1), learn(training(docs)), ["doc_id", "held_out"]).drop("likeness")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.parquet(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
