"""Teams, code contributions by position, and careers (D-07 to D-20, D-22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import days_between, years
from quillgraph.operators.dedup import best_per_key
from quillgraph.operators.summary import below_quantile
from quillgraph.plans.bridge import SURE, Graph
from quillgraph.runtime import Stage

#: A person or account with more sure links than this is ambiguous.
MOST_LINKS = 3
REFERENCE_DATE = "2024-11-01"


def author_contributors(pairs: DataFrame, authors: DataFrame, contributors: DataFrame, people: DataFrame) -> DataFrame:
    """(document_id, researcher_id) of authors who contributed code: the best link of each account
    within the document is taken first, then the sure ones, then those to an account of the repository."""
    rows = pairs.select("document_id", "repository_id").join(authors.select("document_id", "researcher_id"), "document_id").join(people, "researcher_id")
    best = best_per_key(rows, ["document_id", "account_id"], [F.col("confidence").desc(), F.col("link_id")]).where(F.col("confidence") >= SURE)
    return best.join(contributors, ["repository_id", "account_id"], "left_semi").select("document_id", "researcher_id").distinct()


def non_author_developers(pairs: DataFrame, authors: DataFrame, contributors: DataFrame, people: DataFrame) -> DataFrame:
    """(document_id, repository_id, account_id, n_researchers) of accounts of the repository that are
    none of the authors: the best link of each researcher within the repository first, then the sure
    ones; accounts of more than MOST_LINKS researchers are left out, those of none stay."""
    rows = pairs.select("document_id", "repository_id").join(contributors, "repository_id")
    best = best_per_key(rows.join(people, "account_id"), ["repository_id", "researcher_id"], [F.col("confidence").desc(), F.col("link_id")]).where(F.col("confidence") >= SURE)
    known = best.join(authors.select("document_id", "researcher_id", F.lit(1).alias("_author")), ["document_id", "researcher_id"], "left")
    per = known.groupBy("document_id", "repository_id", "account_id").agg(F.count_distinct("researcher_id").alias("n_researchers"), F.count("_author").alias("n_authors"))
    all_ = rows.join(per, ["document_id", "repository_id", "account_id"], "left").na.fill(0, ["n_researchers", "n_authors"])
    return all_.where((F.col("n_researchers") <= MOST_LINKS) & (F.col("n_authors") == 0)).drop("n_authors")


def _of_pairs(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pairs, authors, contributors, people) of the one-to-one pairs, written once for all branches of a plan."""
    stage = Stage(g.pairs.sparkSession)
    pairs = stage.save(g.pairs)
    authors = stage.save(g.authors.join(pairs.select("document_id"), "document_id", "left_semi"))
    contributors = stage.save(g.contributors.join(pairs.select("repository_id"), "repository_id", "left_semi"))
    return pairs, authors, contributors, stage.save(g.people)


def team_composition(g: Graph) -> DataFrame:
    """One row per pair with its numbers of authors and developers by role (D-07)."""
    pairs, authors, contributors, people = _of_pairs(g)
    n = lambda df, key, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    coders = n(author_contributors(pairs, authors, contributors, people), "document_id", "n_author_devs")
    others = n(non_author_developers(pairs, authors, contributors, people), "repository_id", "n_non_author_devs")
    team = (
        pairs.join(n(authors, "document_id", "n_authors"), "document_id", "left").join(n(contributors, "repository_id", "n_devs"), "repository_id", "left")
        .join(coders, "document_id", "left").join(others, "repository_id", "left").na.fill(0, ["n_authors", "n_devs", "n_author_devs", "n_non_author_devs"])
    )
    return team.select("document_id", "repository_id", "source", "n_authors", "n_devs", "n_author_devs", (F.col("n_authors") - F.col("n_author_devs")).alias("n_author_non_devs"), "n_non_author_devs")


def team_frame(g: Graph, team: DataFrame | None = None) -> DataFrame:
    """Teams of three and more with their documents, before the cut of large ones (D-06, D-08)."""
    rows = (team if team is not None else team_composition(g)).join(g.documents, "document_id").join(g.repositories.drop("name"), "repository_id").join(g.domains.select("document_id", "domain"), "document_id")
    pushed = days_between(F.col("publication_date"), F.col("last_pushed_datetime"))
    rows = rows.where("n_authors >= 3 and n_devs >= 1").withColumn("push_days", pushed).where("push_days <= 90")
    return rows.select(
        *(c for c in rows.columns if c not in ("creation_datetime", "last_pushed_datetime")), F.year("publication_date").alias("publication_year"),
        days_between(F.col("creation_datetime"), F.col("last_pushed_datetime")).alias("duration_days"),
        years(F.datediff(F.lit(REFERENCE_DATE).cast("date"), F.col("publication_date"))).alias("years_since"),
    )


def team_filtered(g: Graph) -> DataFrame:
    """The frame without teams above the 0.97 quantile of authors (D-08)."""
    return below_quantile(team_frame(g), "n_authors", 0.97)


def code_flags(g: Graph) -> DataFrame:
    """(document_id, repository_id, researcher_id, position, is_corresponding, is_code_contributor) of
    the authors; researchers with more than MOST_LINKS sure links are left out (D-13)."""
    sure = g.people.where(F.col("confidence") >= SURE)
    many = sure.groupBy("researcher_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_LINKS)
    hits = g.pairs.select("document_id", "repository_id").join(g.contributors, "repository_id").join(sure, "account_id").select("document_id", "researcher_id").distinct().withColumn("_hit", F.lit(True))
    rows = g.pairs.select("document_id", "repository_id").join(g.authors, "document_id").join(many, "researcher_id", "left_anti").join(hits, ["document_id", "researcher_id"], "left")
    return rows.select("document_id", "repository_id", "researcher_id", "position", "is_corresponding", F.col("_hit").isNotNull().alias("is_code_contributor"))


def coding_status(coded, documents):
    """none, any (up to a half), majority, always."""
    return F.when(coded == 0, "none").when(coded * 2 <= documents, "any").when(coded < documents, "majority").otherwise("always")


def careers(g: Graph) -> DataFrame:
    """One row per researcher of three and more documents: modal position, type and domain, and how
    often they coded (D-16)."""
    flags = code_flags(g).join(g.documents.select("document_id", "publication_date", "document_type"), "document_id")
    rows = Stage(flags.sparkSession).save(flags.join(g.domains.select("document_id", "domain"), "document_id", "left").select("researcher_id", "is_code_contributor", "publication_date", "position", "document_type", "domain"))
    counts = rows.groupBy("researcher_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(F.col("is_code_contributor"), 1)).alias("n_coded")).where("n_documents >= 3")
    # The three modes in one pass; of equally frequent values the one seen last, then the smallest.
    names = {"position": "modal_position", "document_type": "modal_type", "domain": "modal_domain"}
    long = rows.select("researcher_id", "publication_date", F.inline(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(c).alias("value")) for c, n in names.items())))).where("value is not null")
    seen = long.groupBy("researcher_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_date("publication_date")).alias("last"))
    order = F.struct(-F.col("n"), F.coalesce(-F.col("last"), F.lit(2147483647)), F.col("value"))
    modes = seen.groupBy("researcher_id").agg(*(F.min_by(F.when(F.col("kind") == n, F.col("value")), F.when(F.col("kind") == n, order)).alias(n) for n in names.values()))
    counts = counts.join(modes.na.drop(subset=list(names.values())), "researcher_id").join(g.researchers.drop("name"), "researcher_id")
    return counts.select("*", (F.col("n_coded") / F.col("n_documents")).alias("coding_share"), coding_status(F.col("n_coded"), F.col("n_documents")).alias("coding_status"))
