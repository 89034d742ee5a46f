"""Pairs from a landing folder, stored batch by batch (section 2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.functions.codehost import split_pairs
from quillgraph.operators.scorer import match_pairs
from quillgraph.operators.store import not_yet_stored, with_references
from quillgraph.runtime import Stage
from quillgraph.schema import REFERENCES
from quillgraph.sources.landed import AUTHOR, repo_tables, updated_doi, work_tables
from quillgraph.sources.tables import Catalog, write_errors

LANDED = "source string, repo_url string, paper_doi string"


def store_batch(
    catalog: Catalog, pairs: DataFrame, batch: int, errors: str | None = None, *,
    works: DataFrame | None = None, authors: DataFrame | None = None, repos: DataFrame | None = None, latest: DataFrame | None = None, least: float = 0.9,
) -> dict[str, int]:
    """Stores what the pairs name and their links; rows added per table. Running it again for the same pairs adds nothing.

    Pairs that are stored already (same host, document by any of its DOIs) are left out first. With
    `works`, `authors` and `repos` (landed metadata) the whole graph of the remaining pairs is stored,
    21 tables with their foreign ids, and links of authors and accounts that the scorer finds alike by
    `least`; a pair whose work or repository is not landed is an error. Without, documents and
    repositories are stored bare. `latest` (doi, latest_doi) replaces DOIs and keeps the former ones as
    alternates. Errors are always written, one folder a batch.
    """
    stage = Stage(catalog.spark)
    try:
        ok, bad = split_pairs(pairs)
        ok = updated_doi(ok, latest) if latest is not None else ok.withColumns({"document_doi": F.col("paper_doi"), "alternate_doi": F.lit(None).cast("string")})
        new = not_yet_stored(ok.drop("paper_doi").withColumnRenamed("document_doi", "paper_doi"), *(catalog.read(t) for t in ("document", "document_alternate_doi", "repository", "document_repository_link")), catalog.read("code_host"))
        new = stage.save(new.withColumn("doi", F.lower("paper_doi")))  # written, as its tables change below
        rows: dict[str, DataFrame] = {}
        whole = works is not None and repos is not None
        if whole:
            known = work_tables(works.join(new.select(F.col("doi").alias("_d")).distinct(), F.lower("doi") == F.col("_d"), "left_semi"), authors if authors is not None else catalog.spark.createDataFrame([], AUTHOR))
            same = (F.lower("owner") == F.lower("_o")) & (F.lower("repo") == F.lower("_n"))
            rows |= {t: df.withColumnRenamed("repo", "name").withColumn("host", F.lit("github")) for t, df in repo_tables(repos.join(new.select(F.col("owner").alias("_o"), F.col("name").alias("_n")).distinct(), same, "left_semi")).items()}
            bad = bad.unionByName(known.pop("errors"))
            rows |= known
            # The names as the metadata spells them; what isn't there is an error.
            spelled = rows["repository"].select(F.lower("owner").alias("_o"), F.lower("name").alias("_n"), F.col("owner").alias("_owner"), F.col("name").alias("_name"))
            found = new.join(spelled, (F.lower("owner") == F.col("_o")) & (F.lower("name") == F.col("_n")), "left").join(rows["document"].select("doi", F.lit(True).alias("_work")).distinct(), "doi", "left")
            found = stage.save(found)
            missing = F.when(F.col("_work").isNull(), "no work").when(F.col("_name").isNull(), "no repository")
            gone = found.where(missing.isNotNull())
            bad = bad.unionByName(gone.select("source", F.lit("metadata-lookup").alias("step"), F.col("doi").alias("identifier"), missing.alias("error"), F.lit("").alias("traceback")))
            new = found.where(missing.isNull()).withColumns({"owner": F.col("_owner"), "name": F.col("_name")})
        else:
            rows |= {"document": new.select("doi").distinct(), "repository": new.select("host", "owner", "name").distinct()}
        if errors:
            write_errors(bad, errors, batch)
        rows |= {
            "dataset_source": new.select(F.col("source").alias("name")).distinct(), "code_host": new.select(F.col("host").alias("name")).distinct(),
            "document_alternate_doi": new.where("alternate_doi is not null").select(F.col("doi").alias("document_doi"), F.col("alternate_doi").alias("doi")).distinct(),
            "document_repository_link": new.select("source", "host", "owner", "name", "doi").distinct(),
        }
        n = {t: catalog.store_natural(t, rows[t]) for t in REFERENCES if t in rows}
        if whole:
            n["researcher_developer_account_link"] = catalog.store("researcher_developer_account_link", _people(catalog, new, least))
        return n
    finally:
        stage.close()


def _people(catalog: Catalog, new: DataFrame, least: float) -> DataFrame:
    """Scored links of all authors and all developers of the stored pairs (D-41)."""
    links = with_references(new.select("host", "owner", "name", "doi"), {k: v for k, v in REFERENCES["document_repository_link"].items() if k != "dataset_source_id"}, catalog.read).select("document_id", "repository_id").distinct()
    authors = catalog.read("document_contributor").select("document_id", "researcher_id").join(catalog.read("researcher").select(F.col("id").alias("researcher_id"), "name"), "researcher_id")
    devs = catalog.read("repository_contributor").select("repository_id", "developer_account_id").join(catalog.read("developer_account").select(F.col("id").alias("developer_account_id"), "username", F.col("name").alias("account_name")), "developer_account_id")
    return match_pairs(links, authors, devs, least=least)


def ingest_stream(spark: SparkSession, landing: str, catalog: Catalog, checkpoint: str, errors: str | None = None) -> StreamingQuery:
    """A query that stores all files that are there and ends; started again, it goes on with new ones."""
    landed = spark.readStream.schema(LANDED).json(landing)
    return landed.writeStream.foreachBatch(lambda df, batch: store_batch(catalog, df, batch, errors) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
