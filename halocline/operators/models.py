"""Presence-background models: spatial thinning and folds, logistic regression per fold, rank AUC, publish gate."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halocline.operators.ordered import rank_auc


def thin(points: DataFrame, species: str, places: int = 2) -> DataFrame:
    """One point per place (rounded) and species, the one first in order."""
    key = [F.round(c, places).alias(f"r_{c}") for c in ("lon", "lat")]
    return points.groupBy(*key, species).agg(F.min(F.struct("lon", "lat")).alias("p")).select("p.lon", "p.lat", species)


def background(points: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """A repeatable sample of n points by a seeded hash (a sampling operator: the limit is its purpose)."""
    return points.orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(points.columns)])).limit(n)


def block_fold(lon: Column, lat: Column, k: int, size: float = 5.0) -> Column:
    """Fold of the block of size degrees that holds a point."""
    return F.pmod(F.floor(lat / size) + F.floor(lon / size), F.lit(k)).cast("int")


def evaluate_folds(rows: DataFrame, features: list[str], k: int, least_auc: float = 0.7, least_n: int = 50) -> DataFrame:
    """fold, n, auc, publish: a model of the other folds tested on each. A fold without both labels has a null auc and is not
    published."""
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    counts = {(r.fold, r.label): r.n for r in rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 k rows
    out = []
    for fold in range(k):
        train = [sum(n for (f, y), n in counts.items() if f != fold and y == label) for label in (0.0, 1.0)]
        test = [counts.get((fold, label), 0) for label in (0.0, 1.0)]
        part = ready.where(F.col("fold") == fold)
        auc = None
        if min(train) and min(test):
            model = LogisticRegression(maxIter=20, regParam=0.01).fit(ready.where(F.col("fold") != fold))
            auc = float(BinaryClassificationEvaluator().evaluate(model.transform(part)))
        out.append(part.agg(F.lit(fold).alias("fold"), F.count(F.lit(1)).alias("n"), F.round(F.lit(auc).cast("double"), 4).alias("auc")))
    table = reduce(DataFrame.unionByName, out)
    return table.withColumn("publish", F.coalesce((F.col("auc") >= least_auc) & (F.col("n") >= least_n), F.lit(False)))


def fold_models(rows: DataFrame, features: list[str], k: int, reg: float = 0.01, standardise: bool = True) -> list:
    """The model of each fold that has both labels to learn from: logistic regression of presences (label 1) against background
    (0) on the rows of the other folds, where all background together weighs as much as all presences."""
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    counts = {(r.fold, r.label): r.n for r in rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 k rows
    out = []
    for fold in range(k):
        absent, present = (sum(n for (f, y), n in counts.items() if f != fold and y == label) for label in (0.0, 1.0))
        if absent and present:
            train = ready.where(F.col("fold") != fold).withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(present / absent))
            out.append(LogisticRegression(maxIter=100, tol=1e-10, regParam=reg, standardization=standardise, weightCol="weight").fit(train))
    return out


def predict_ensemble(models: list, cells: DataFrame, features: list[str]) -> DataFrame:
    """cells with mean and std (of the population) of the chance of presence that the models give; null without models."""
    chance = []
    for m in models:  # k models of a few numbers: the predictions are column expressions of one pass
        z = F.lit(float(m.intercept))
        for c, w in zip(features, m.coefficients.toArray(), strict=True):
            z = z + F.col(c) * float(w)
        chance.append(1 / (1 + F.exp(-z)))
    if not chance:
        none = F.lit(None).cast("double")
        return cells.withColumns({"mean": none, "std": none})
    mean = sum(chance[1:], chance[0]) / len(chance)
    spread = [F.pow(c - F.col("mean"), 2) for c in chance]
    return cells.withColumn("mean", mean).withColumn("std", F.sqrt(sum(spread[1:], spread[0]) / len(chance)))


def boyce(scored: DataFrame, bins: int = 10) -> DataFrame:
    """bin, presence, background, ratio of a score in [0, 1]: the share of presences over that of background per bin."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    counts = scored.groupBy(b.alias("bin")).agg(F.count_if(F.col("label") == 1).alias("presence"), F.count_if(F.col("label") == 0).alias("background"))
    p, q = (counts.agg(F.sum(c)).scalar() for c in ("presence", "background"))
    return counts.select("bin", "presence", "background", F.try_divide(F.col("presence") / p, F.col("background") / q).alias("ratio"))


def boyce_index(scored: DataFrame, bins: int = 10) -> DataFrame:
    """boyce: the rank correlation between a score's bins and the ratio of presences to background in them (bins without
    background are left out); null with fewer than three bins. The bins are few, so their ranks are one small window."""
    rows = boyce(scored, bins).where("ratio IS NOT NULL")
    w = Window.orderBy("ratio")
    ties = Window.partitionBy("ratio")
    ranks = rows.withColumn("first", F.rank().over(w)).withColumn("r", F.col("first") + (F.count(F.lit(1)).over(ties) - 1) / 2).withColumn("b", F.row_number().over(Window.orderBy("bin")))
    return ranks.agg(F.when(F.count(F.lit(1)) >= 3, F.corr("b", "r")).alias("boyce"))


def envelope(training: DataFrame, rows: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """rows with outside: whether a numeric column leaves the range that it has in training, or a category is not in it."""
    seen = training.agg(*[f(c).alias(f"{p}_{c}") for c in numeric for f, p in ((F.min, "lo"), (F.max, "hi"))], *[F.collect_set(c).alias(f"in_{c}") for c in categories])
    value = lambda name: seen.select(name).scalar()
    out = F.lit(False)
    for c in numeric:
        out = out | ~F.coalesce(F.col(c).between(value(f"lo_{c}"), value(f"hi_{c}")), F.lit(False))
    for c in categories:
        out = out | ~F.coalesce(F.array_contains(value(f"in_{c}"), F.col(c)), F.lit(False))
    return rows.withColumn("outside", out)


def publish_gate(auc: Column, boyce: Column, n: Column) -> Column:
    """Whether a model may be published; a measure that is missing closes the gate."""
    return F.coalesce((auc >= 0.7) & (boyce > 0) & (n >= 50), F.lit(False))


def importance(scored: DataFrame, score_of, features: list[str], seed: int = 1) -> DataFrame:
    """feature, loss: how much auc falls when a feature's values are dealt anew over the rows (by a seeded hash of row_id, which
    is unique). score_of(df) gives column score from the features."""
    base = rank_auc(score_of(scored))
    out = []
    for f in features:
        # Values move to the row that has the same place in another order; places are ranks within hash buckets.
        bucket = lambda s: F.pmod(F.xxhash64(F.lit(s), "row_id"), F.lit(64))
        give = scored.select(bucket(seed).alias("g_b"), F.row_number().over(Window.partitionBy(bucket(seed)).orderBy("row_id")).alias("g_n"), F.col(f).alias("g_value"))
        take = scored.withColumn("t_b", bucket(seed)).withColumn("t_n", F.row_number().over(Window.partitionBy(bucket(seed)).orderBy(F.xxhash64(F.lit(seed + 1), F.lit(f), "row_id"))))
        mixed = take.join(give, (F.col("t_b") == F.col("g_b")) & (F.col("t_n") == F.col("g_n"))).withColumn(f, F.col("g_value"))
        out.append(rank_auc(score_of(mixed)).select(F.lit(f).alias("feature"), (base.scalar() - F.col("auc")).alias("loss")))
    return reduce(DataFrame.unionByName, out)
