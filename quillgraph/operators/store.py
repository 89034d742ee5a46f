"""Surrogate keys without repeated rows: get or create in bulk (SNK-01, SNK-02, SO-05, J-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import strip
from quillgraph.operators.reshape import ordinal
from quillgraph.runtime import Stage


def stripped(df: DataFrame) -> DataFrame:
    """All string columns trimmed, as every stored row is."""
    return df.select(*(strip(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of `incoming` whose key is not stored, one per key: the first in `order`, or the least row.

    The first writer wins: stored rows are neither changed nor repeated. A null in a key counts as a value.
    """
    rows = stripped(incoming)
    w = Window.partitionBy(*keys).orderBy(*(order or [F.col(c) for c in rows.columns]))
    first = rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    e = existing.select(*(F.col(k).alias(f"_e_{k}") for k in keys)).distinct()
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_e_{k}"))
        same = c if same is None else same & c
    return first.join(e, same, "left_anti")


def with_ids(existing: DataFrame, fresh: DataFrame, keys: list[str], id: str = "id", stage: Stage | None = None) -> DataFrame:
    """`fresh` with ids that follow the greatest stored one, in order of the key, without one task sorting all."""
    top = existing.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))
    numbered = ordinal(fresh, keys, "_o", stage).join(F.broadcast(top))  # one row
    return numbered.withColumn(id, F.col("_top") + F.col("_o") + 1).drop("_o", "_top")


def get_or_create(existing: DataFrame, incoming: DataFrame, keys: list[str], id: str = "id", now: Column | None = None, stage: Stage | None = None) -> DataFrame:
    """The rows to append: new ones with their ids, creation time and a null update time."""
    fresh = with_ids(existing, new_rows(existing, incoming, keys), keys, id, stage)
    out = fresh.withColumn("created_datetime", (now if now is not None else F.current_timestamp()).cast("timestamp_ntz")).withColumn("updated_datetime", F.lit(None).cast("timestamp_ntz"))
    return out.select(id, *(c for c in out.columns if c != id))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on several rows; a table that holds its unique key has none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def with_references(rows: DataFrame, references: dict[str, tuple[str, dict[str, str]]], table) -> DataFrame:
    """`rows` with the ids of what their natural keys name; rows that name nothing stored are left out.

    `table` gives a stored table by name. Keys are compared as they are stored, trimmed. A reference
    may use an id that was found before it.
    """
    rows = stripped(rows)
    for id, (target, key) in references.items():
        stored = table(target).select(F.col("id").alias("_id"), *(F.col(k).alias(f"_k_{k}") for k in key))
        on = None
        for k, c in key.items():
            same = F.col(c) == F.col(f"_k_{k}")
            on = same if on is None else on & same
        rows = rows.join(stored, on).drop(*(f"_k_{k}" for k in key)).withColumnRenamed("_id", id)
    return rows


def not_yet_stored(pairs: DataFrame, documents: DataFrame, alternates: DataFrame, repositories: DataFrame, links: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Pairs (paper_doi, owner, name) without a stored link between the document and the repository.

    A document is known by its DOI or by an alternate one; case of owner and name makes no difference.
    With `hosts` (id, name), pairs have a `host` too, and only repositories of that host count.
    """
    dois = documents.select(F.lower("doi").alias("_doi"), F.col("id").alias("_document")).union(alternates.select(F.lower("doi"), "document_id")).where("_doi is not null").distinct()
    keys = {"paper_doi": "_doi", "owner": "_owner", "name": "_name"}
    repos = repositories.select(F.lower("owner").alias("_owner"), F.lower("name").alias("_name"), F.col("id").alias("_repository"), *(["code_host_id"] if hosts is not None else []))
    if hosts is not None:
        keys["host"] = "_host"
        repos = repos.join(hosts.select(F.col("id").alias("code_host_id"), F.lower("name").alias("_host")), "code_host_id").drop("code_host_id")
    stored = (
        links.select(F.col("document_id").alias("_document"), F.col("repository_id").alias("_repository")).distinct()
        .join(dois, "_document").join(repos, "_repository").select(*keys.values()).distinct()
    )
    on = None
    for c, k in keys.items():
        same = F.lower(pairs[c]) == stored[k]
        on = same if on is None else on & same
    return pairs.join(stored, on, "left_anti")
