"""Aggregates of reports: describe, quantile cuts, shares, counts by several groupings (AG-*, PF-07, PF-08)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import Stage


def describe(df: DataFrame, value: str, by: list[str] | None = None, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, sample std, min, exact percentiles (linear interpolation) and max of a value."""
    aggs = [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("min"),
        *(F.percentile(value, q).alias(f"p{q * 100:g}".replace(".", "_")) for q in quantiles), F.max(value).cast("double").alias("max"),
    ]
    return df.groupBy(*(by or [])).agg(*aggs)


def below_quantile(df: DataFrame, value: str, q: float, strict: bool = False) -> DataFrame:
    """Rows at most (or below) the exact quantile of all rows. The cut is one row, broadcast."""
    cut = df.agg(F.percentile(value, q).alias("_cut"))
    ok = F.col(value) < F.col("_cut") if strict else F.col(value) <= F.col("_cut")
    return df.join(F.broadcast(cut), ok, "left_semi")


def between_quantiles(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows between two exact quantiles, both included; nulls fall out."""
    cut = df.agg(F.percentile(value, low).alias("_low"), F.percentile(value, high).alias("_high"))
    return df.join(F.broadcast(cut), F.col(value).between(F.col("_low"), F.col("_high")), "left_semi")


def shares(df: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """Count per key and its percentage of the rows of `within` (of all rows if none)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if within:
        return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*within)))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("percent", F.col("n") * 100.0 / F.col("_total")).drop("_total")


def count_report(df: DataFrame, groupings: dict[str, str], counts: dict[str, str]) -> DataFrame:
    """Rows and distinct values per group, for several groupings and in total: (grouping, group_value, n_rows, …).

    One pass: every row is repeated once a grouping and aggregated together; null groups are left out,
    as an inner join with the dimension would leave them out.
    """
    pairs = [F.struct(F.lit(g).alias("grouping"), F.col(c).cast("string").alias("group_value")) for g, c in groupings.items()]
    pairs.append(F.struct(F.lit("total").alias("grouping"), F.lit("total").alias("group_value")))
    long = df.select(*counts.values(), F.inline(F.array(*pairs))).where("group_value is not null")
    return long.groupBy("grouping", "group_value").agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_distinct(c).alias(n) for n, c in counts.items()))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of two labels: a row per `row`, a column per value, 0 where there is none."""
    return df.groupBy(row).agg(*(F.count(F.when(F.col(column) == v, 1)).alias(f"n_{v}") for v in values))


def mean_interval(df: DataFrame, by: list[str], value: str, z: float = 1.959963984540054) -> DataFrame:
    """Mean with its normal 95 % interval per group."""
    half = F.lit(z) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"), F.count(value).alias("n"))


def running_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n, run): rows per distinct value, and rows of at most that value, nulls left out.

    Values are counted, range partitioned and written; what to add to a partition comes from the sums of
    those before it, one row each. So no task holds all values, however many different ones there are.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = Stage(df.sparkSession).save(counts.repartitionByRange(parts, value).sortWithinPartitions(value).withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_part").agg(F.sum("n").alias("_size")).select("_part", before.alias("_before"))  # one row a partition
    within = F.sum("n").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_within", within).join(F.broadcast(starts), "_part").select(value, "n", (F.col("_before") + F.col("_within")).alias("run"))


def exact_quantiles(df: DataFrame, value: str, *qs: float) -> DataFrame:
    """Exact quantiles (linear interpolation) of all rows as one row of columns q0, q1, …; for values of which there
    are too many different ones for the buffer of `percentile`. All null where there are no values."""
    rows = Stage(df.sparkSession).save(running_counts(df, value))
    total = rows.agg(F.max("run").alias("_total"))
    at = [F.lit(float(q)) * (F.col("_total") - 1) for q in qs]
    rows = rows.join(F.broadcast(total))  # one row
    ends = rows.agg(F.max("_total").alias("_total"), *(F.min(F.when(F.col("run") > f(r), F.col(value).cast("double"))).alias(f"_{n}{i}") for i, r in enumerate(at) for n, f in (("low", F.floor), ("high", F.ceil))))
    return ends.select(*(((1 - (r - F.floor(r))) * F.col(f"_low{i}") + (r - F.floor(r)) * F.col(f"_high{i}")).alias(f"q{i}") for i, r in enumerate(at)))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, share) of rows at most that value."""
    rows = running_counts(df, value)
    total = df.agg(F.count(value).alias("_total"))
    return rows.join(F.broadcast(total)).select(value, (F.col("run") / F.col("_total")).alias("share"))  # one row


def box_plot(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles and the most distant values within one and a half interquartile ranges of them."""
    box = df.groupBy(*by).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.75).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.select(*by, value).join(box, by).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*by, "q1", "median", "q3").agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))


def missing_rate(df: DataFrame, *columns: str) -> DataFrame:
    """Share of null values per column, as one row."""
    return df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which no column is null, NaN or infinite."""
    inf = F.lit(float("inf"))
    ok = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < inf) for c in columns))
    return df.where(ok)


def keys_with_rows(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key has at least `least` rows."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key), key, "left_semi")


def share_of(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0 or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def trend(df: DataFrame, x: str, y: str, z: float = 1.959963984540054) -> DataFrame:
    """Linear trend of y by x as one row: (n, slope, intercept, se of the slope, low, high)."""
    slope = F.regr_slope(y, x)
    left = F.regr_syy(y, x) - slope * F.regr_sxy(y, x)
    out = df.agg(F.regr_count(y, x).alias("n"), slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt(left / (F.regr_count(y, x) - 2) / F.regr_sxx(y, x)).alias("se"))
    return out.select("*", (F.col("slope") - z * F.col("se")).alias("low"), (F.col("slope") + z * F.col("se")).alias("high"))
