"""Toxicity by multiple-instance learning: a document is a bag of sentences and its probability the noisy-or of theirs.

Every labelled training document counts in the word statistics that choose the features (a word, or its first five
letters): those of the greatest gain in likelihood, FEATURES at most, which bounds the classifier (a documented bound, with
SAMPLE: the model that is collected and broadcast has the same size whatever the corpus); the weights are then learned by gradient ascent on the noisy-or likelihood of the document labels, over at most
SAMPLE documents drawn by a hash of the id (the documented bound), each reduced to the chosen features of its sentences. A
chosen feature that no drawn document holds takes its weight from the statistics.
Sentence scores then tell which sentences offend.

Edge cases: a null or empty text has no sentence and scores 0; without both labels in training all scores are 0; several
labels of one id count as toxic if one does; null labels and labels of unknown ids are ignored. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import common as C

SAMPLE, FEATURES, MIN_DOCS, PREFIX, STEPS, THRESHOLD = 20_000, 20_000, 4, 5, 400, 0.7
BROADCAST_ROWS = 1_000_000
#: Documents whose doubt a feature must settle to keep its weight: words that only repeat what others tell lose theirs.
SPARSE = 0.3
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def features(word: str) -> tuple[str, ...]:
    return (word, "^" + word[:PREFIX]) if len(word) >= PREFIX else (word,)


def sentences(text: str) -> list[list[str]]:
    return [w for s in SENTENCE.split(text.lower()) if (w := WORD.findall(s))]


def noisy_or_fit(bags: list[list[list[int]]], empty: np.ndarray, labels: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights and bias of sentence scores sigmoid(bias + sum of weights) that make the labels of the bags likely.
    bags: of each document the feature ids of its sentences that have some; empty: its number of other sentences."""
    doc_of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    sent_of = np.repeat(np.arange(len(doc_of)), [len(s) for b in bags for s in b])
    feat = np.array([f for b in bags for s in b for f in s], np.int64)
    w, bias = np.full(n, 0.5), -5.0
    m1, m2 = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sent_of, w[feat], len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-bias))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags)) + empty * np.log1p(-p0)
        # d log-likelihood / d z of a sentence: p * (1 - P) / P in a toxic document, -p in another.
        odds = np.where(labels == 1, np.exp(none) / np.maximum(-np.expm1(none), 1e-9), -1.0)
        dz = p * odds[doc_of]
        grad = np.append(np.bincount(feat, dz[sent_of], n) if len(feat) else np.zeros(n), dz.sum() + (empty * p0 * odds).sum()) / len(bags)
        grad[:n] -= 1e-5 * w + SPARSE / len(bags)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, bias = np.maximum(w + move[:n], 0), min(bias + move[n], -3.0)
    return w, float(bias)


def learn(labelled: DataFrame, sample: int = SAMPLE, features_at_most: int = FEATURES) -> tuple[dict[str, float], float]:
    """Feature weights and bias from columns doc_id, text (not null), toxic (0 or 1)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    both = F.array_distinct(F.concat(found, F.transform(F.filter(found, lambda w: F.length(w) >= PREFIX), lambda w: F.concat(F.lit("^"), F.substring(w, 1, PREFIX)))))
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos")).first()
    if not total.pos or total.pos == total.n:
        return {}, -30.0
    base = total.pos / total.n
    counts = labelled.select("toxic", F.explode(both).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos"))
    # The gain in log-likelihood that the feature's own rate brings over the base rate, of features that speak for toxic.
    rate = F.col("pos") / F.col("n")
    gain = F.col("pos") * F.log(rate / base) + F.when(F.col("pos") < F.col("n"), (F.col("n") - F.col("pos")) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    rows = counts.where((F.col("n") >= MIN_DOCS) & (rate > min(0.9, 2 * base))).withColumn("gain", gain).orderBy(F.desc("gain"), "f").limit(features_at_most).select("f", "n", "pos").toPandas()
    chosen = rows["f"].tolist()
    ids = {f: i for i, f in enumerate(chosen)}
    shared = labelled.sparkSession.sparkContext.broadcast(ids)

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            bags, empty = [], []
            for text in batch["text"]:
                found = [[known[f] for w in s for f in features(w) if f in known] for s in sentences(text)]
                bags.append([s for s in found if s])
                empty.append(len(found) - len(bags[-1]))
            yield pd.DataFrame({"toxic": batch["toxic"], "bags": bags, "empty": empty})

    share = min(1.0, sample / total.n)
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**15)) < int(10**15 * share)).mapInPandas(reduce_rows, "toxic int, bags array<array<int>>, empty long").toPandas()
    if not len(drawn) or drawn["toxic"].nunique() < 2:
        return {}, -30.0
    w, bias = noisy_or_fit([[list(s) for s in b] for b in drawn["bags"]], drawn["empty"].to_numpy(float), drawn["toxic"].to_numpy(), len(chosen))
    seen = np.zeros(len(chosen), bool)
    seen[[f for b in drawn["bags"] for s in b for f in s]] = True
    # Others: the probability that the noisy-or needs beside the base rate; a word and its first letters share it.
    rate = (rows["pos"].to_numpy(float) + MIN_DOCS * base) / (rows["n"].to_numpy(float) + MIN_DOCS)
    lift = np.clip(1 - (1 - rate) / (1 - base), 1e-9, 1 - 1e-9)
    own = np.maximum(np.log(lift / (1 - lift)) - bias, 0) * np.where(rows["f"].str.len() >= PREFIX, 0.5, 1.0)
    w = np.where(seen, w, own)
    return {f: float(x) for f, x in zip(chosen, w, strict=True) if x > 1e-3}, bias


def score(docs: DataFrame, model: tuple[dict[str, float], float], keep: list[str]) -> DataFrame:
    """The columns of keep with score and offending, an array of (sentence, score) of sentences scoring over a half."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights, a few bytes a feature
    value, where, text = C.fresh(docs.select(*keep), "score", "offending", "text_in")

    def marks(texts: list[str]) -> list[list]:
        weights, bias = shared.value
        calm = np.log1p(-1 / (1 + np.exp(-bias)))
        scores, bad = [], []
        for t in texts:
            none, hits = 0.0, []
            for i, s in enumerate(sentences(t)):
                z = sum([weights.get(w, 0.0) + weights.get("^" + w[:PREFIX], 0.0) if len(w) >= PREFIX else weights.get(w, 0.0) for w in s])
                if z:
                    p = 1 / (1 + np.exp(-min(30.0, bias + z)))
                    none += np.log1p(-min(p, 1 - 1e-9))
                    if p > 0.5:
                        hits.append({"sentence": i, "score": float(p)})
                else:
                    none += calm
            scores.append(float(-np.expm1(none)))
            bad.append(hits)
        return [scores, bad]

    return C.added(docs.select(*keep, C.whole_text().alias(text)), text, f"{value} double, {where} array<struct<sentence: int, score: double>>", marks)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled rows to learn from."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(C.fold("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if marks.count() <= BROADCAST_ROWS:  # 16 bytes a row; beyond that the texts of the fold are shuffled
        marks = F.broadcast(marks)
    return docs.where("text IS NOT NULL").where(C.fold("doc_id", 3) != 1).select("doc_id", "text").join(marks, "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.parquet(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(C.materialise(labelled(docs, C.parquet(spark, sf_dir, "labels")), "labelled"))
    out = score(docs.withColumn("held_out", C.fold("doc_id", 3) == 1), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "offending")
