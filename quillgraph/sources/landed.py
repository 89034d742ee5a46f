"""Landed files of the four pair sources and of the two metadata providers (SRC-01 to SRC-16, D-38, D-39).

Every pair source gives (pairs, errors) in common columns; nothing raises on a bad record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import ARXIV_DOI, decoded, doi_url, id_or_new, text_of_index

# The names of steps, the texts of errors and the fields of payloads in this file.
PAIR = ["source", "repo_url", "paper_doi"]
ERROR = ["source", "step", "identifier", "error", "traceback"]


def _pairs(df: DataFrame, source: str, url: Column, doi: Column) -> DataFrame:
    return df.select(F.lit(source).alias("source"), url.alias("repo_url"), doi.alias("paper_doi"))


def _errors(df: DataFrame, source: str, step: str, identifier: Column, error: Column) -> DataFrame:
    return df.select(F.lit(source).alias("source"), F.lit(step).alias("step"), identifier.alias("identifier"), error.alias("error"), F.lit("").alias("traceback"))


def joss(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages of papers as JSON arrays; the accepted ones are pairs, none is an error."""
    rows = spark.read.schema("state string, software_repository string, doi string").option("multiLine", True).json(path)
    ok = _pairs(rows.where("state = 'accepted'"), "joss", F.col("software_repository"), F.col("doi"))
    return ok, _errors(rows.where("false"), "joss", "joss-page", F.col("doi"), F.lit(""))


def pwc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A (compressed) JSON array of links; official ones with an archive id are pairs."""
    rows = spark.read.schema("paper_url string, paper_arxiv_id string, repo_url string, is_official boolean").option("multiLine", True).json(path)
    official, id = F.coalesce("is_official", F.lit(False)), F.coalesce("paper_arxiv_id", F.lit(""))
    step = "pwc-json-processing"
    ok = _pairs(rows.where(official & (id != "")), "pwc", F.col("repo_url"), F.concat(F.lit(ARXIV_DOI), id))
    bad = rows.where(~official | (id == ""))
    return ok, _errors(bad, "pwc", step, F.when(~official, F.col("paper_arxiv_id")).otherwise(F.col("paper_url")), F.when(~official, "Not an official paper").otherwise("No arxiv id"))


def softwarex(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Repositories with their search hits; a fork stands for its parent, exactly one hit makes a pair."""
    rows = spark.read.schema("name string, parent struct<html_url:string>, hits array<struct<doi:string>>").option("multiLine", True).json(path)
    rows = rows.withColumn("url", F.coalesce("parent.html_url", F.concat(F.lit("https://github.com/ElsevierSoftwareX/"), F.col("name")))).withColumn("n", F.coalesce(F.size("hits"), F.lit(0)))
    text = F.when(F.col("n") > 1, F.concat(F.lit("Multiple papers found for "), F.col("name"))).otherwise(F.concat(F.lit("No papers found for "), F.col("name")))
    ok = _pairs(rows.where("n = 1"), "softwarex", F.col("url"), F.col("hits")[0]["doi"])
    return ok, _errors(rows.where("n <> 1"), "softwarex", "elsevier-repo-processing", F.col("url"), text)


def plos(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A folder of JATS articles: first link of the data availability statement and the DOI.

    The text of the link counts, up to its first child, not its target. A DOCTYPE is cut off, so no
    definition is fetched. Every article is read by itself; one that isn't well-formed is an error.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value"), F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file"))
    files = files.withColumn("xml", F.regexp_replace("value", "(?s)<!DOCTYPE[^>\\[]*(?:\\[.*?\\])?\\s*>", ""))
    out = "struct<url:string,doi:string,error:string>"

    @F.pandas_udf(out)
    def parse(xml):
        import xml.etree.ElementTree as ET

        import pandas as pd

        rows = []
        for x in xml:
            try:
                root = ET.fromstring(x)
            except ET.ParseError as e:
                rows.append((None, None, str(e)))
                continue
            block = root.find(".//custom-meta[@id='data-availability']")
            link = block.find(".//ext-link[@ext-link-type='uri']") if block is not None else None
            url = link.text if link is not None else None
            id = root.find(".//article-id[@pub-id-type='doi']")
            doi = id.text if id is not None else None
            rows.append((url, doi, "No Repository URL" if url is None else "No Paper DOI" if doi is None else None))
        return pd.DataFrame(rows, columns=["url", "doi", "error"])

    rows = files.select("file", parse("xml").alias("r"))
    ok = _pairs(rows.where("r.error is null"), "plos", F.col("r.url"), F.col("r.doi"))
    return ok, _errors(rows.where("r.error is not null"), "plos", "plos-xml-processing", F.col("file"), F.col("r.error"))


#: Name of a source and its reader (SRC-05).
READERS = {"joss": joss, "plos": plos, "pwc": pwc, "softwarex": softwarex}

WORK = """id string, doi string, title string, publication_date string, cited_by_count int, cited_by_percentile_year struct<min:int,max:int>, fwci double, type string,
    open_access struct<is_oa:boolean,oa_status:string>, abstract_inverted_index map<string,array<int>>,
    topics array<struct<id:string,display_name:string,score:double,field:struct<id:string,display_name:string>,subfield:struct<id:string,display_name:string>,domain:struct<id:string,display_name:string>>>,
    authorships array<struct<author:struct<id:string>,author_position:string,is_corresponding:boolean,institutions:array<struct<id:string,display_name:string,ror:string>>>>,
    grants array<struct<funder:string,funder_display_name:string,award_id:string>>"""
AUTHOR = "id string, display_name string, works_count int, cited_by_count int, summary_stats struct<h_index:int,i10_index:int,`2yr_mean_citedness`:double>"
REPO = """owner string, repo string, description string, fork boolean, forks_count int, stargazers_count int, watchers_count int, open_issues_count int, size int, created_at string, pushed_at string,
    languages map<string,bigint>, readme struct<content:string>, contributors array<struct<login:string,name:string,email:string>>"""


def work_tables(works: DataFrame, authors: DataFrame) -> dict[str, DataFrame]:
    """Rows of the article tables, with natural keys in place of ids (D-38).

    A work without its yearly percentile is an error row; a grant without an award is left out with
    its funder; topics and contributors that repeat within a work come out once.
    """
    bad = works.where("cited_by_percentile_year is null or id is null")
    w = works.where("cited_by_percentile_year is not null and id is not null").withColumn("doi", F.lower("doi"))
    topic = w.select("doi", F.explode("topics").alias("t"))
    person = w.select("doi", F.posexplode("authorships").alias("place", "a"))
    grant = w.select("doi", F.explode("grants").alias("g")).where("g.award_id is not null")
    place = person.select("doi", F.col("a.author.id").alias("researcher"), F.explode("a.institutions").alias("i"))
    who = person.select(F.col("a.author.id").alias("id")).distinct()
    return {
        "document": w.select("doi", F.col("id").alias("open_alex_id"), "title", F.to_date("publication_date").alias("publication_date"), "cited_by_count", F.col("cited_by_percentile_year.min").alias("cited_by_percentile_year_min"), F.col("cited_by_percentile_year.max").alias("cited_by_percentile_year_max"), "fwci", F.col("type").alias("document_type"), F.col("open_access.is_oa").alias("is_open_access"), F.col("open_access.oa_status").alias("open_access_status")),
        "document_abstract": w.select("doi", text_of_index(F.col("abstract_inverted_index")).alias("content")),
        "topic": topic.select(F.col("t.id").alias("open_alex_id"), F.col("t.display_name").alias("name"), F.col("t.field.display_name").alias("field_name"), F.col("t.field.id").alias("field_open_alex_id"), F.col("t.subfield.display_name").alias("subfield_name"), F.col("t.subfield.id").alias("subfield_open_alex_id"), F.col("t.domain.display_name").alias("domain_name"), F.col("t.domain.id").alias("domain_open_alex_id")).dropDuplicates(["open_alex_id"]),
        "document_topic": topic.groupBy("doi", F.col("t.id").alias("topic")).agg(F.max("t.score").alias("score")),
        "researcher": authors.join(who, "id", "left_semi").select(F.col("id").alias("open_alex_id"), F.col("display_name").alias("name"), "works_count", "cited_by_count", F.col("summary_stats.h_index").alias("h_index"), F.col("summary_stats.i10_index").alias("i10_index"), F.col("summary_stats")["2yr_mean_citedness"].alias("two_year_mean_citedness")),
        "document_contributor": person.groupBy("doi", F.col("a.author.id").alias("researcher")).agg(F.min_by("a.author_position", "place").alias("position"), F.min_by("a.is_corresponding", "place").alias("is_corresponding")),
        "institution": place.select(F.col("i.id").alias("open_alex_id"), F.col("i.display_name").alias("name"), F.col("i.ror").alias("ror")).dropDuplicates(["open_alex_id"]),
        "document_contributor_institution": place.select("doi", "researcher", F.col("i.id").alias("institution")).distinct(),
        "funder": grant.select(F.col("g.funder").alias("open_alex_id"), F.col("g.funder_display_name").alias("name")).dropDuplicates(["open_alex_id"]),
        "funding_instance": grant.select(F.col("g.funder").alias("funder"), F.col("g.award_id").alias("award_id")).distinct(),
        "document_funding_instance": grant.select("doi", F.col("g.funder").alias("funder"), F.col("g.award_id").alias("award_id")).distinct(),
        "errors": _errors(bad, "works", "work-processing", F.col("doi"), F.lit("incomplete work")),
    }


def updated_doi(pairs: DataFrame, latest: DataFrame) -> DataFrame:
    """Pairs with `document_doi`, the latest DOI where `latest` (doi, latest_doi) has one, and
    `alternate_doi`, the original one where they differ, case included (SRC-10)."""
    known = latest.groupBy("doi").agg(F.max("latest_doi").alias("latest_doi")).withColumnRenamed("doi", "paper_doi")
    new = F.coalesce("latest_doi", "paper_doi")
    return pairs.join(known, "paper_doi", "left").withColumn("document_doi", new).withColumn("alternate_doi", F.when(new != F.col("paper_doi"), F.col("paper_doi"))).drop("latest_doi")


def repo_tables(repos: DataFrame, top_n: int = 30) -> dict[str, DataFrame]:
    """Rows of the repository tables, with natural keys in place of ids (D-39); the first `top_n` contributors count."""
    key = ["owner", "repo"]
    people = repos.select(*key, F.explode(F.slice(F.coalesce("contributors", F.array()), 1, top_n)).alias("c"))
    stamp = lambda c: F.to_timestamp_ntz(F.regexp_replace(c, "Z$|[+]00:?00$", ""))
    return {
        "repository": repos.select("owner", F.col("repo").alias("name"), "description", F.col("fork").alias("is_fork"), "forks_count", "stargazers_count", "watchers_count", "open_issues_count", F.col("size").alias("size_kb"), stamp("created_at").alias("creation_datetime"), stamp("pushed_at").alias("last_pushed_datetime")),
        "repository_readme": repos.select(*key, decoded(F.col("readme.content")).alias("content")),
        "repository_language": repos.select(*key, F.explode("languages").alias("language", "bytes_of_code")),
        "developer_account": people.groupBy(F.col("c.login").alias("username")).agg(F.max("c.name").alias("name"), F.max("c.email").alias("email")),
        "repository_contributor": people.select(*key, F.col("c.login").alias("username")).distinct(),
    }


def contributor_totals(stats: DataFrame, login: str = "login") -> DataFrame:
    """Commits, additions and deletions of each contributor and of the whole repository from weekly
    counts: `stats` has owner, repo, login, weeks array<struct<c,a,d>> (SRC-14)."""
    weeks = stats.select("owner", "repo", login, F.explode_outer("weeks").alias("w"))
    sums = {"n_commits": "w.c", "n_additions": "w.a", "n_deletions": "w.d"}
    per = weeks.groupBy("owner", "repo", login).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))
    total = per.groupBy("owner", "repo").agg(*(F.sum(n).alias(n.replace("n_", "total_repo_")) for n in sums))
    return per.join(total, ["owner", "repo"])


def commit_churn(commits: DataFrame) -> DataFrame:
    """Per commit lines added, removed and changed, files, and `file: +a -b; …`: `commits` has hash and
    files map<file, struct<insertions, deletions>> (AG-22)."""
    files = F.map_entries("files")
    add = F.aggregate(files, F.lit(0).cast("long"), lambda s, e: s + e["value"]["insertions"])
    cut = F.aggregate(files, F.lit(0).cast("long"), lambda s, e: s + e["value"]["deletions"])
    text = F.array_join(F.transform(files, lambda e: F.format_string("%s: +%d -%d", e["key"], e["value"]["insertions"], e["value"]["deletions"])), "; ")
    return commits.withColumns({"positive_lines_changed": add, "negative_lines_changed": cut, "abs_lines_changed": add + cut, "n_files_changed": F.size("files"), "per_file_lines_changed": text})


def works_of(pairs: DataFrame, works: DataFrame, doi: str = "paper_doi") -> DataFrame:
    """Pairs with their landed work, found by the DOI as an address; a pair without one has a null work (SRC-11)."""
    held = works.select(doi_url(F.col("doi")).alias("_url"), F.struct(*works.columns).alias("work")).groupBy("_url").agg(F.min_by("work", F.col("work.id")).alias("work"))
    return pairs.withColumn("_url", doi_url(F.col(doi))).join(held, "_url", "left").drop("_url")


PAPER = "paperId string, externalIds struct<DOI:string>, title string, authors array<struct<authorId:string,name:string>>, embedding struct<vector:array<float>>"


def extended_papers(papers: DataFrame, dois: DataFrame | None = None) -> DataFrame:
    """(doi, paper_id, title, author_id, name, position) of landed extended papers, one row an author: `only`, or
    `first`, `middle` and `last` in their order; an author without id gets a new one (SRC-16, W-08, F-21).
    `dois` (doi) keeps those asked for; papers without authors or DOI don't come out."""
    rows = papers.select(F.lower("externalIds.DOI").alias("doi"), F.col("paperId").alias("paper_id"), "title", F.size("authors").alias("_n"), F.posexplode("authors").alias("_at", "_a")).where("doi is not null")
    if dois is not None:
        rows = rows.join(dois.select(F.lower("doi").alias("doi")).distinct(), "doi", "left_semi")
    place = F.when(F.col("_n") == 1, "only").when(F.col("_at") == 0, "first").when(F.col("_at") == F.col("_n") - 1, "last").otherwise("middle")
    return rows.select("doi", "paper_id", "title", id_or_new(F.col("_a.authorId")).alias("author_id"), F.col("_a.name").alias("name"), place.alias("position"))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits (hash, author, datetime, message, files map<file, struct<insertions, deletions>>) of landed logs as
    `git log --numstat --format=%x1e%H%x1f%an%x1f%aI%x1f%s` writes them; binary files count no lines (SRC-15)."""
    text = spark.read.option("lineSep", "\u001e").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\n")
    head = F.split(F.element_at(lines, 1), "\u001f")
    stats = F.filter(F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.split(x, "\t", 3)), lambda x: F.size(x) == 3)
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
    files = F.map_from_entries(F.transform(stats, lambda x: F.struct(x[2], F.struct(number(x[0]).alias("insertions"), number(x[1]).alias("deletions")))))
    return text.select(head[0].alias("hash"), head[1].alias("author"), F.to_timestamp(head[2]).alias("datetime"), head[3].alias("message"), files.alias("files"))
