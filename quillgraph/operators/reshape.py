"""Reshaping: long and wide form, one-hot columns, interactions (RS-*, SO-01, SL-05 to SL-09)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import title_text
from quillgraph.runtime import Stage


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long; the values become double."""
    return df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(ids, values, name, value)


def one_hot(df: DataFrame, column: str, levels: list[str], prefix: str | None = None) -> DataFrame:
    """A 0/1 column for every level but the first in alphabetical order, which is the baseline."""
    prefix = prefix or column
    return df.select("*", *((F.col(column) == v).cast("double").alias(f"{prefix}_{v}") for v in sorted(levels)[1:]))


def levels_of(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The distinct values of a category, sorted; refuses a column that has more than `most`."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


def interactions(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Products of every left with every right column, named `left × right`."""
    return df.select("*", *((F.col(a) * F.col(b)).alias(f"{a} × {b}") for a in left for b in right))


def stack_sources(*parts: tuple[str, DataFrame], name: str = "source") -> DataFrame:
    """Union by column name with a column that names the part; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn(name, F.lit(n)) for n, d in parts])


def hash_sample(df: DataFrame, id: str, fraction: float, seed: int = 0) -> DataFrame:
    """A repeatable share of the rows: those whose hashed id falls below it."""
    return df.where(F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def sample_per_group(df: DataFrame, group: str, id: str, n: int, seed: int = 12) -> DataFrame:
    """`n` rows of every group, the same at every run."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(id, F.lit(seed)), id)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def ordinal(df: DataFrame, order: list[str], as_: str = "ordinal", stage: Stage | None = None) -> DataFrame:
    """Number of each row from 0 in the order of columns, without sorting all rows in one task.

    Rows are range partitioned, sorted and numbered within their partition by one shuffle, and written
    with the number of the partition; the sizes of the partitions, counted from what was written, give
    what to add. Nothing is partitioned twice, so numbers can't repeat however the ranges were cut.
    Columns of the order should make rows distinct: which of two equal rows comes first is not defined.
    """
    stage = stage or Stage(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()  # the partition above bit 33, the place within it below
    rows = stage.save(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_row", row))
    rows = rows.withColumns({"_part": F.shiftright("_row", 33), "_local": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_row")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # one row a partition
    return rows.join(F.broadcast(starts), "_part").withColumn(as_, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def batches(df: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """Rows with the number of their batch of `size`, in the order of columns that make them distinct."""
    return ordinal(df, order, "_o").withColumn("batch", F.floor(F.col("_o") / size)).drop("_o")


def round_robin(df: DataFrame, order: list[str], n: int, as_: str = "slot") -> DataFrame:
    """Rows dealt out to `n` slots in turn."""
    return ordinal(df, order, "_o").withColumn(as_, F.pmod("_o", F.lit(n))).drop("_o")


def ranked_order(column: str, order: list[str]) -> Column:
    """Sort key of an ordered category."""
    return F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column))


def flatten(df: DataFrame, struct: str) -> DataFrame:
    """The fields of a struct column as columns."""
    return df.select(*(c for c in df.columns if c != struct), f"{struct}.*")


def transpose(df: DataFrame, id: str, values: list[str], names: list[str]) -> DataFrame:
    """A small table turned: a row per value column, a column per name in `id`."""
    long = melt(df, [id], values)
    return long.groupBy("metric").agg(*(F.max(F.when(F.col(id) == n, F.col("value"))).alias(n) for n in names))


AUDIT = ["created_datetime", "updated_datetime"]


def without_audit(df: DataFrame) -> DataFrame:
    """The table without its two audit columns."""
    return df.drop(*AUDIT)


def replaced(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """Values of a column replaced by a map; others stay."""
    names = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return df.withColumn(column, F.coalesce(names[F.col(column)], F.col(column)))


def renamed(df: DataFrame, keep: list[str] = ("const", "y")) -> DataFrame:
    """Column names as titles, but for those that are kept."""
    return df.toDF(*(c if c in keep else title_text(c) for c in df.columns))


def first_by(df: DataFrame, key: str, value: str, order: list[str], as_: str | None = None) -> DataFrame:
    """(key, value) of the first row per key in order of columns, combined before the shuffle; null values are skipped."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(as_ or value))


def mode_smallest(df: DataFrame, key: str, value: str, as_: str | None = None) -> DataFrame:
    """(key, mode) of `value` per key, the smallest of equally frequent ones."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(as_ or value))
