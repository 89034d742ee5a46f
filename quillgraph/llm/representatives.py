"""Best representative of each duplicate group (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.keys import tidy_doi
from quillgraph.llm.components import components
from quillgraph.operators.skew import skew_join
from quillgraph.runtime import Stage

#: Fields of the surviving record; those in COUNTS only grow, so their greatest value is the newest.
FIELDS = ["open_alex_id", "title", "publication_date", "fwci", "document_type", "is_open_access", "open_access_status", "cited_by_percentile_year_min", "cited_by_percentile_year_max"]
COUNTS = ["cited_by_count"]


def _filled(c: Column, kind: str) -> Column:
    """Whether a value says something: not null, not NaN, not blank."""
    if kind == "string":
        return c.isNotNull() & (F.trim(c) != "")
    return c.isNotNull() & ~F.isnan(c) if kind in ("double", "float") else c.isNotNull()


def _whole(c: Column, kind: str) -> Column:
    """2 for a filled value, 1 for one that is cut off by an ellipsis, 0 for none."""
    if kind != "string":
        return _filled(c, kind).cast("int")
    return F.when(~_filled(c, kind), 0).when(F.rtrim(c).rlike("(…|\\.\\.\\.)$"), 1).otherwise(2)


def article_groups(documents: DataFrame, alternates: DataFrame, stage: Stage | None = None) -> DataFrame:
    """(id, group_id, current) of the documents that share an article with another document.

    Two documents are one article if an alternate DOI of one is the DOI of the other or both have the
    same alternate DOI, in tidy spelling, directly or through others; `group_id` is the least id.
    `current` is false for a document whose own DOI is an alternate DOI of another document.
    """
    stage = stage or Stage(documents.sparkSession)
    alt = alternates.select(F.col("document_id").alias("id"), tidy_doi(F.col("doi")).alias("key"), F.lit(False).alias("own"))
    alt = alt.join(documents.select("id").distinct(), "id", "left_semi")
    named = stage.save(documents.select("id", tidy_doi(F.col("doi")).alias("key"), F.lit(True).alias("own")).union(alt)).where("id is not null and key is not null")
    # Only keys of several documents tie anything; most keys stop here.
    other = F.when(~F.col("own"), F.col("id"))
    hubs = named.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("most"), F.min(other).alias("least_other"), F.max(other).alias("most_other"))
    hubs = hubs.where("hub <> most").drop("most")
    old = F.col("own") & ((F.col("least_other") != F.col("id")) | (F.col("most_other") != F.col("id")))
    tied = stage.save(skew_join(named, hubs, ["key"]).select("id", "hub", F.coalesce(old, F.lit(False)).alias("old")))
    groups = components(tied.select(F.col("id").alias("u"), F.col("hub").alias("v")), stage)
    current = tied.groupBy("id").agg((~F.max("old")).alias("current"))
    return groups.select(F.col("node").alias("id"), F.col("root").alias("group_id")).join(current, "id")


def _ranking(kinds: dict[str, str]) -> tuple[Column, Column, list[Column]]:
    """(completeness, recency, order of the ranking)."""
    filled = sum((_whole(F.col(c), kinds[c]) * (1 if kinds[c] == "string" else 2) for c in FIELDS if c in kinds), F.lit(0))
    seen = F.greatest(F.col("updated_datetime"), F.col("created_datetime"))
    order = [F.col("current").desc(), F.col("_filled").desc(), F.col("_seen").desc_nulls_last(), F.col("id").asc()]
    return filled.alias("_filled"), seen.alias("_seen"), order


def best_records(documents: DataFrame, alternates: DataFrame) -> DataFrame:
    """One row a group of two or more documents: (first_id, survivor_id, n_members, fields).

    Members are ranked by trust (their DOI is the current one), completeness (number of filled
    fields, cut-off ones counting half), recency (latest update or creation) and least id; the top
    one survives. Every field then takes its best value among all members: whole before cut off
    before missing, then by the same ranking; counts take their greatest value.

    Defined cases: null ids and null or blank DOIs tie nothing; alternate DOIs of documents that are
    not stored tie nothing; a document that names its own DOI as an alternate one is not superseded
    by itself; if all members (in a circle) or several are current, the ranking decides; documents
    without a partner don't come out; repeated alternate rows change nothing; repeated document rows
    of one id count as one member with its best row; other columns are ignored.

    Scale: the ranking keeps one row per group before the shuffle (window group limit), and the
    fields are combined by partial aggregation, so a group may hold any share of the rows.
    """
    stage = Stage(documents.sparkSession)
    groups = article_groups(documents, alternates, stage)
    kinds = dict(documents.dtypes)
    fields = [c for c in FIELDS if c in kinds]
    filled, seen, order = _ranking(kinds)
    members = stage.save(documents.select("id", "doi", *fields, *COUNTS, filled, seen).join(groups, "id"))
    top = members.withColumn("_rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).where("_rank = 1")
    top = top.select("group_id", F.col("id").alias("survivor_id"), F.col("doi").alias("doi"))

    def best(c: str) -> Column:
        return F.max_by(F.col(c), F.struct(_whole(F.col(c), kinds[c]), "current", F.col("_filled"), F.coalesce(F.unix_micros(F.col("_seen").cast("timestamp")), F.lit(-(1 << 62))), -F.col("id"))).alias(c)

    values = members.groupBy("group_id").agg(
        F.count_distinct("id").alias("n_members"), *(best(c) for c in fields), *(F.max(c).alias(c) for c in COUNTS)
    )
    return top.join(values, "group_id").withColumnRenamed("group_id", "first_id")


def survivors(documents: DataFrame, alternates: DataFrame) -> DataFrame:
    """(first_id, survivor_id) of `best_records`, by the same ranking; no field is shuffled or built."""
    groups = article_groups(documents, alternates)
    filled, seen, order = _ranking(dict(documents.dtypes))
    members = documents.select("id", filled, seen).join(groups, "id")
    top = members.withColumn("_rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).where("_rank = 1")
    return top.select(F.col("group_id").alias("first_id"), F.col("id").alias("survivor_id"))
