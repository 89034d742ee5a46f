"""Joins and groupings that hold when one key has a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows, or more than TASK_ROWS of them.
HOT_SHARE = 1 / 200
#: And more rows than this: fewer are no burden for a task, whatever their share.
HOT_ROWS = 10_000
#: Rows of one key that a task should not have to hold. Of very large tables, the rows per hot key rise, so that there are at most MOST_HOT such keys.
TASK_ROWS, MOST_HOT = 2_000_000, 100_000


def hot_from(total: int, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> float:
    """Number of rows above which a key of a table of `total` rows is hot; fewer than max(1 / share, MOST_HOT) keys are."""
    return max(float(rows), min(total * share, max(TASK_ROWS, total / MOST_HOT)))


def hot_keys(df: DataFrame, keys: list[str], total: int, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> DataFrame:
    """Keys of `df` that hold more rows than `hot_from` says of a table of `total` rows, counted exactly.

    Counts are combined before the shuffle. At most max(1/share, MOST_HOT) rows come out whatever the
    data, which is the bound that allows to broadcast them. Null keys are never hot.
    """
    counts = df.na.drop(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > F.lit(hot_from(total, share, rows))).drop("_rows")


_UNKNOWN = object()


def known_hot(df: DataFrame, keys: list[str], total: int | None = None, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys of `df` as a table in the driver, or None if there is none.

    No more exist than `hot_keys` says, so no more are fetched; joins with them then need no second count.
    """
    total = df.count() if total is None else total
    if total <= rows:
        return None
    found = hot_keys(df, keys, total, share, rows)
    held = found.collect()
    return df.sparkSession.createDataFrame(held, found.schema) if held else None


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", *, total: int | None = None, share: float = HOT_SHARE, rows: int = HOT_ROWS, hot=_UNKNOWN) -> DataFrame:
    """Join of `left` to `right`, where `right` has one row a key and `how` is inner, left, left_semi or left_anti.

    Rows of hot keys meet their right rows in a broadcast, one row a key and no more keys than
    `hot_keys` says, so no task gets a hot key; all other keys are joined by one shuffle. Rows of `left` whose key is null stay as an
    ordinary join has them (kept by left and left_anti), without being sent to one partition. `hot`
    may hold the hot keys of `left`, as `known_hot` gives them; else they are counted first.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    if hot is _UNKNOWN:
        hot = known_hot(left, keys, total, share, rows)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    some = left.where(known)
    if hot is None:
        parts = [some.join(right, keys, how)]
    else:
        hot_right = right.join(F.broadcast(hot), keys, "left_semi")
        parts = [
            some.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(hot_right), keys, how),
            some.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how),
        ]
    if how in ("left", "left_anti") and any(left.schema[k].nullable for k in keys):
        extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in keys] if how == "left" else []
        parts.append(left.where(~known).select(*(F.col(c) for c in [*keys, *(c for c in left.columns if c not in keys)]), *extra))
    return reduce(DataFrame.unionByName, parts)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether `df` has at most `max_rows` rows; reads no more than it needs."""
    return df.limit(max_rows + 1).count() <= max_rows
