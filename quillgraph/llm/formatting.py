"""Duplicates hidden by formatting differences (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.codehost import let
from quillgraph.functions.keys import tidy_reference
from quillgraph.operators.skew import HOT_ROWS, HOT_SHARE, known_hot
from quillgraph.runtime import Stage


def canonical(pairs: DataFrame, id: str = "raw_id", fields: tuple[str, str] = ("repo_url", "paper_doi")) -> DataFrame:
    """(id, key): both fields in tidy spelling, in one order; the key is null where a field is missing or blank."""
    two = F.array(*(tidy_reference(F.col(c)) for c in fields))
    key = let(two, lambda x: F.when(x[0].isNotNull() & x[1].isNotNull(), F.array_join(F.array_sort(x), " ")))
    return pairs.select(F.col(id).alias("id"), key.alias("key"))


def _split(pairs: DataFrame, id: str, fields: tuple[str, str], share: float, rows_: int):
    """(rows of hot keys or None, all other rows) as (id, key)."""
    stage = Stage(pairs.sparkSession)
    tidied, total = stage.save_counted(canonical(pairs, id, fields))  # rows without a key stay: a filter would tidy twice
    rows = tidied.where("id is not null and key is not null")
    hot = known_hot(rows, ["key"], total, share, rows_)
    if hot is None:
        return None, rows
    hot = F.broadcast(hot)  # no more keys than `hot_keys` says
    return rows.join(hot, "key", "left_semi"), rows.join(hot, "key", "left_anti")


def _hot_groups(rows: DataFrame, salts: int) -> DataFrame:
    """Two levels: by key and salt, then by key."""
    part = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts))).groupBy("key", "_salt").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    return part.groupBy("key").agg(F.sum("n").alias("n_copies"), F.min("least").alias("group_id"))


def collapse(pairs: DataFrame, id: str = "raw_id", fields: tuple[str, str] = ("repo_url", "paper_doi"), *, share: float = HOT_SHARE, rows: int = HOT_ROWS, salts: int = 64) -> DataFrame:
    """One row a distinct pair: (group_id, n_copies, key); `group_id` is its least id.

    Hot keys, counted exactly, are salted and aggregated on two levels; all others on one.
    """
    hot, rest = _split(pairs, id, fields, share, rows)
    cold = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("group_id"))
    return (cold if hot is None else _hot_groups(hot, salts).unionByName(cold)).select("group_id", "n_copies", "key")


def copies(pairs: DataFrame, id: str = "raw_id", fields: tuple[str, str] = ("repo_url", "paper_doi"), *, share: float = HOT_SHARE, rows: int = HOT_ROWS, salts: int = 64) -> DataFrame:
    """(group_id, raw_id) of every row that has at least one copy, the first included.

    Rows are copies if both fields name the same things apart from letter case, white space and
    invisible characters, scheme, `www.`, repeated or trailing slashes, a final `.git`, resolver
    address, `doi` prefix, enclosing or trailing punctuation, and the order of the fields.

    Defined cases: a missing, empty or blank field puts a row in no group; rows without id are left
    out; an id that repeats counts as often as it stands there; rows without a partner don't come
    out; empty tables give no rows; further columns are ignored.

    Scale: the tidy keys are written once. Keys with more rows than a task should hold are found from
    partial counts and aggregated with a salt on two levels; their groups, no more than `hot_keys`
    says, are broadcast back to their rows. All other keys take one shuffle, which brings the rows of
    a key together for a window.
    """
    hot, rest = _split(pairs, id, fields, share, rows)
    w = Window.partitionBy("key")
    cold = rest.select("id", F.min("id").over(w).alias("group_id"), F.count(F.lit(1)).over(w).alias("n")).where("n > 1").select("group_id", F.col("id").alias(id))
    if hot is None:
        return cold
    groups = _hot_groups(hot, salts).where("n_copies > 1").select("key", "group_id")
    return hot.join(F.broadcast(groups), "key").select("group_id", F.col("id").alias(id)).unionByName(cold)
