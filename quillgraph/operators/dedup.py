"""Uniqueness, best rows and top-n per key (W-01 to W-09, SL-03, SL-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strictly_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose value of each key stands on no other row, the keys applied one after the other.

    The order matters: rows that fall out by the first key don't count for the second. A row whose key
    is null falls out. Rows of a frequent key are combined before the shuffle, so none is sent on.
    """
    for k in keys:
        # One aggregate, combined before the shuffle: of a key that has one row, the least value is the value.
        rest = [c for c in df.schema if c.name != k]
        least = [F.first(f.name).alias(f.name) if "map<" in f.dataType.simpleString() else F.min(f.name).alias(f.name) for f in rest]
        df = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("_n"), *least).where("_n = 1").select(*df.columns)
    return df


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of every key in `order`, which should end in an id so that ties are defined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def greedy_pairs(links: DataFrame, left: str, right: str, score: str, id: str) -> DataFrame:
    """One-to-one links by score: the best link of each `left`, then of those the best of each `right`."""
    order = [F.col(score).desc(), F.col(id)]
    return best_per_key(best_per_key(links, [left], order), [right], order)


def mode_by_recency(df: DataFrame, key: str, value: str, date: str, as_: str | None = None) -> DataFrame:
    """(key, mode) of `value` per key; ties go to the value seen last, then to the smaller value."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.max(date).alias("_last"))
    best = best_per_key(counts, [key], [F.col("_n").desc(), F.col("_last").desc_nulls_last(), F.col(value)])
    return best.select(key, F.col(value).alias(as_ or value))


def position_labels(df: DataFrame, key: str, order: list[Column], as_: str = "position", only: str = "only") -> DataFrame:
    """Rows with `first`, `middle` or `last` by their place within the key; a single row is `only`."""
    w = Window.partitionBy(key)
    place = F.row_number().over(w.orderBy(*order))
    n = F.count(F.lit(1)).over(w)
    label = F.when(n == 1, only).when(place == 1, "first").when(place == n, "last").otherwise("middle")
    return df.withColumn(as_, label)


def z_scores(df: DataFrame, keys: list[str], value: str, as_: str = "z") -> DataFrame:
    """Value minus mean over sample deviation within the keys; null where there is no spread."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    z = F.when(F.col("_std") > 0, (F.col(value) - F.col("_mean")) / F.col("_std"))
    return df.join(stats, keys).withColumn(as_, z).drop("_mean", "_std")


def latest(df: DataFrame, date: str) -> DataFrame:
    """The newest date of a listing of snapshots, as one row."""
    return df.agg(F.max(date).alias(date))
