"""Snapshot reconciliation: upserts, purge sets, guard verdicts, plans. Deletions are decided in one row before a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not stored, one per key."""
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def _both(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    o = old.select(*[F.col(c).alias(f"old_{c}") for c in old.columns])
    n = new.select(*[F.col(c).alias(f"new_{c}") for c in new.columns])
    return o.join(n, F.col(f"old_{key}") == F.col(f"new_{key}"), "full")


def coalescing_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A new value that is not null wins, else the old one stays."""
    return _both(old, new, key).select(*[F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in old.columns])


def additive_upsert(old: DataFrame, new: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    return old.select(*keys, *counters).unionByName(new.select(*keys, *counters)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def widening_upsert(old: DataFrame, new: DataFrame, keys: list[str], weight: str, label: str) -> DataFrame:
    """The greatest weight of old and new, with its label (ties: the first in order that is not null)."""
    rows = old.select(*keys, weight, label).unionByName(new.select(*keys, weight, label))
    return rows.groupBy(*keys).agg(F.max(weight).alias(weight), F.max_by(label, F.when(F.col(label).isNotNull(), F.col(weight))).alias(label))


def change_only_upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, op (insert, update, noop) of every row of the new snapshot."""
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    rows = _both(old, new, key).where(F.col(f"new_{key}").isNotNull())
    return rows.select(F.col(f"new_{key}").alias(key), F.when(F.col(f"old_{key}").isNull(), "insert").when(same, "noop").otherwise("update").alias("op"))


def change_report(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """change, n: how each row of new differs from the stored value."""
    a, b = F.col(f"old_{value}"), F.col(f"new_{value}")
    kind = (
        F.when(F.col(f"old_{key}").isNull(), "not_in_table").when(a.eqNullSafe(b), "unchanged").when(a.isNull(), "null_to_value").when(b.isNull(), "value_to_null")
        .when(a == 0, "zero_to_value").when(a * b < 0, "sign_flip").otherwise("other")
    )
    return _both(old, new, key).where(F.col(f"new_{key}").isNotNull()).groupBy(kind.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def purge_set(stored: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return stored.join(seen.select(key), key, "left_anti")


def orphan_split(stored: DataFrame, seen: DataFrame, key: str, dataset: str) -> DataFrame:
    """dataset, orphans, live of every dataset with orphans."""
    marked = stored.select(key, dataset).join(seen.select(F.col(key).alias("seen_key")).distinct(), F.col(key) == F.col("seen_key"), "left")
    return marked.groupBy(dataset).agg(F.count_if(F.col("seen_key").isNull()).alias("orphans"), F.count_if(F.col("seen_key").isNotNull()).alias("live")).where("orphans > 0")


def purge_verdict(stored: DataFrame, seen: DataFrame, key: str, dataset: str, complete: Column, max_rows: int = 4_200_000, max_fraction: float = 0.12, max_total: float = 0.35, least_seen: float = 0.5) -> DataFrame:
    """One row: total, seen, orphans, absent, verdict (purge, nothing or refuse) and reasons. A republished dataset (one
    with live rows) is exempt from the strict ceilings; a null dataset is not."""
    split = orphan_split(stored, seen, key, dataset)
    sums = split.agg(F.coalesce(F.sum("orphans"), F.lit(0)).alias("orphans"), F.coalesce(F.sum(F.when((F.col("live") == 0) | F.col(dataset).isNull(), F.col("orphans"))), F.lit(0)).alias("absent"))
    row = sums.withColumn("total", stored.agg(F.count(F.lit(1)).alias("total")).scalar()).withColumn("seen", seen.agg(F.count_distinct(key).alias("seen")).scalar())
    reasons = F.array_compact(F.array(
        F.when(~complete, "incomplete"), F.when((F.col("total") > 0) & (F.col("seen") < F.col("total") * least_seen), "too few seen"),
        F.when((F.col("absent") > max_rows) | (F.col("absent") > F.col("total") * max_fraction), "absent datasets over the ceiling"),
        F.when(F.col("orphans") > F.col("total") * max_total, "all orphans over the ceiling"),
    ))
    return row.select("total", "seen", "orphans", "absent", F.when(F.size(reasons) > 0, "refuse").when(F.col("orphans") == 0, "nothing").otherwise("purge").alias("verdict"), F.array_join(reasons, "; ").alias("reasons"))


def revision_plan(remote: DataFrame, stored: DataFrame, skipped: DataFrame) -> DataFrame:
    """id, action of every id: new, corrected, broken, stamp_only, skip, keep or vanished (reported, never deleted).
    remote (id, revision), stored (id, stamp, has_values), skipped (id, judged). A null stamp is not stale."""
    rows = remote.select(F.col("id").alias("r_id"), "revision").join(stored.select(F.col("id").alias("s_id"), "stamp", "has_values"), F.col("r_id") == F.col("s_id"), "full").join(skipped.select(F.col("id").alias("k_id"), "judged"), F.col("r_id") == F.col("k_id"), "left")
    stale = F.col("stamp").isNotNull() & (F.col("revision") > F.col("stamp"))
    action = (
        F.when(F.col("r_id").isNull(), "vanished").when(F.col("s_id").isNull() & (F.col("judged") >= F.col("revision")), "skip").when(F.col("s_id").isNull(), "new")
        .when(~F.col("has_values"), "broken").when(stale, "corrected").when(F.col("stamp").isNull(), "stamp_only").otherwise("keep")
    )
    return rows.select(F.coalesce("r_id", "s_id").alias("id"), action.alias("action"))


def held_deletions(gone: DataFrame, stored: DataFrame, provider: str, floor: int, fraction: float, share: float) -> DataFrame:
    """One row: gone, stored, hold: whether so many rows, or so much of one provider, would go that a person must look."""
    a = gone.groupBy(provider).agg(F.count(F.lit(1)).alias("g"))
    b = stored.groupBy(provider).agg(F.count(F.lit(1)).alias("s"))
    rows = b.join(a, provider, "left").withColumn("g", F.coalesce("g", F.lit(0)))
    sums = rows.agg(F.sum("g").alias("gone"), F.sum("s").alias("stored"), F.bool_or(F.col("g") > F.col("s") * share).alias("provider_goes"))
    return sums.select("gone", "stored", ((F.col("gone") > F.greatest(F.lit(float(floor)), F.col("stored") * fraction)) | F.col("provider_goes")).alias("hold"))


def pending(names: DataFrame, answers: DataFrame, name: str, now: Column, days: int) -> DataFrame:
    """Distinct names without an answer, or whose check failed more than days ago."""
    fresh = answers.where(F.col("found") | (F.col("checked_at") > now - F.make_interval(days=F.lit(days))))
    return names.where(F.col(name).isNotNull()).select(name).distinct().join(fresh.select(name), name, "left_anti")


def index_plan(index: DataFrame, rejects: DataFrame, stored: DataFrame, rules: int) -> DataFrame:
    """key, action: need (stamp differs, rows of older rules, or new), keep, gone, or untrusted. index (key, updated) may hold a
    key twice: such keys, and those of rejected lines, say nothing, so that their stored rows are never gone. stored: key,
    stamp, rules."""
    counts = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("updated").alias("updated"))
    doubt = counts.where("n > 1").select("key").unionByName(rejects.where("key IS NOT NULL").select("key")).distinct().withColumn("doubtful", F.lit(True))
    all_ = counts.where("n = 1").drop("n").join(stored, "key", "full").join(doubt, "key", "full")
    need = F.col("stamp").isNull() | (F.col("stamp") != F.col("updated")) | (F.col("rules") < rules)
    return all_.select("key", F.when(F.col("doubtful"), "untrusted").when(F.col("updated").isNull(), "gone").when(need, "need").otherwise("keep").alias("action"))


def minimum_share(seen: DataFrame, stored: DataFrame, key: str, share: float) -> DataFrame:
    """The keys to remove: stored but not seen; none at all if the walk saw less than a share of what is stored."""
    n = lambda df: df.select(key).distinct().agg(F.count(F.lit(1))).scalar()
    gone = stored.join(seen.select(key), key, "left_anti")
    return gone.withColumn("enough_", n(seen) >= share * n(stored)).where("enough_").drop("enough_")


def fill_category(stored: DataFrame, new: DataFrame, key: str, weak: tuple[str, ...] = ("NE", "DD")) -> DataFrame:
    """stored (key, category) where new may fill it: only a null or weak category is replaced, and only by another one."""
    fresh = new.groupBy(F.col(key).alias("n_key")).agg(F.max("category").alias("n_category"))
    both = stored.join(fresh, F.col(key) == F.col("n_key"), "left")
    open_ = F.col("category").isNull() | F.col("category").isin(*weak)
    fills = open_ & F.col("n_category").isNotNull() & ~F.col("n_category").eqNullSafe(F.col("category"))
    return both.withColumn("filled", fills).withColumn("category", F.when(fills, F.col("n_category")).otherwise(F.col("category"))).drop("n_key", "n_category")


def resume(work: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """The work whose key has no ledger row; a ledger row stands for a load that is whole."""
    return work.join(ledger.select(key).distinct(), key, "left_anti")


def unpivot_abundance(samples: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """(rows, tally) of JSON objects taxon -> abundance: key, taxon (trimmed), abundance of what can be counted (zero can), and per
    key how many values are null, not a number or negative, and how many names collide once trimmed."""
    entry = samples.select(key, F.explode(F.from_json(json, "map<string, string>")).alias("name", "text")).withColumn("taxon", F.trim("name")).withColumn("abundance", F.col("text").try_cast("double"))
    bad = F.col("abundance").isNull() | F.isnan("abundance") | (F.col("abundance") < 0)
    tally = entry.groupBy(key, "taxon").agg((F.count(F.lit(1)) - 1).alias("again"), F.count_if(bad).alias("bad")).groupBy(key).agg(F.sum("bad").alias("not_counted"), F.sum("again").alias("collisions"))
    return entry.where(~bad).select(key, "taxon", "abundance"), tally
