"""Links between the authors and the developers of a pair: a pluggable scorer (ST-11, D-41, J-10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL, VERSION = "token-similarity", "1"


def similarity(author: Column, username: Column, name: Column) -> Column:
    """Between 0 and 1: the better of the edit similarity of the names and of the author's joined name to the user name."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L} ]", "")
    tight = lambda c: F.replace(plain(c), F.lit(" "), F.lit(""))
    near = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    initial = F.concat(F.substring(tight(author), 1, 1), F.split_part(plain(author), F.lit(" "), F.lit(-1)))
    return F.greatest(F.when(plain(name) != "", near(plain(author), plain(name))).otherwise(0.0), near(tight(author), tight(username)), near(initial, tight(username)))


def match_pairs(pairs: DataFrame, authors: DataFrame, developers: DataFrame, score: Callable[..., Column] = similarity, least: float = 0.9) -> DataFrame:
    """Link rows of every author and developer of one pair that the scorer finds alike.

    `authors` has document_id, researcher_id, name; `developers` has repository_id,
    developer_account_id, username, account_name. Candidates are the two sides of one pair, found by
    its keys; people are told apart by id, so homonyms stay apart.
    """
    rows = pairs.select("document_id", "repository_id").distinct().join(authors, "document_id").join(developers, "repository_id")
    scored = rows.select("researcher_id", "developer_account_id", score(F.col("name"), F.col("username"), F.col("account_name")).alias("predictive_model_confidence"))
    best = scored.where(F.col("predictive_model_confidence") >= least).groupBy("researcher_id", "developer_account_id").agg(F.max("predictive_model_confidence").alias("predictive_model_confidence"))
    return best.select("researcher_id", "developer_account_id", F.lit(MODEL).alias("predictive_model_name"), F.lit(VERSION).alias("predictive_model_version"), "predictive_model_confidence")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last by `order`, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
