import gzip
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillgraph.schema import KEYS, SCHEMAS, foreign_keys
from quillgraph.sources import landed, tables
from quillgraph.streaming.ingest import ingest_stream, store_batch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_schema_has_all_tables():
    assert len(SCHEMAS) == 21 and all(set(k) <= set(SCHEMAS[t].names) for t, k in KEYS.items())
    assert len(foreign_keys()) >= 20


def test_joss_pages(spark, tmp_path):
    for n, page in enumerate((20, 19)):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"state": "accepted" if i else "rejected", "software_repository": f"github.com/o/r{n}{i}", "doi": f"10.1/{n}{i}"} for i in range(page)]))
    ok, bad = landed.joss(spark, str(tmp_path))
    assert ok.count() == 37 and bad.count() == 0 and ok.columns == landed.PAIR


def test_pwc(spark, tmp_path):
    items = [{"paper_url": "p1", "paper_arxiv_id": "1.2", "repo_url": "github.com/o/r", "is_official": True}, {"paper_url": "p2", "paper_arxiv_id": "", "repo_url": "r", "is_official": True}, {"paper_url": "p3", "paper_arxiv_id": "3", "repo_url": "r", "is_official": False}, {"paper_url": "p4", "repo_url": "r", "is_official": True}]
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        json.dump(items, f)
    ok, bad = landed.pwc(spark, str(tmp_path / "x.json.gz"))
    assert rows(ok) == [("pwc", "github.com/o/r", "10.48550/arxiv.1.2")]
    assert rows(bad.select("identifier", "error")) == [("3", "Not an official paper"), ("p2", "No arxiv id"), ("p4", "No arxiv id")]


def test_softwarex(spark, tmp_path):
    items = [{"name": "a", "parent": {"html_url": "github.com/p/a"}, "hits": [{"doi": "10.1/a"}]}, {"name": "b", "hits": []}, {"name": "c", "hits": [{"doi": "1"}, {"doi": "2"}]}, {"name": "d", "hits": [{"doi": "10.1/d"}]}]
    (tmp_path / "s.json").write_text(json.dumps(items))
    ok, bad = landed.softwarex(spark, str(tmp_path / "s.json"))
    assert rows(ok.select("repo_url")) == [("github.com/p/a",), ("https://github.com/ElsevierSoftwareX/d",)]
    assert rows(bad.select("error")) == [("Multiple papers found for c",), ("No papers found for b",)]


ARTICLE = """<?xml version="1.0"?><!DOCTYPE article PUBLIC "-//X//DTD//EN" "http://nowhere.invalid/x.dtd"><article><front><article-id pub-id-type="doi">10.1/{n}</article-id>
<custom-meta id="data-availability"><meta-value>See <ext-link ext-link-type="uri">{url}</ext-link> and <ext-link ext-link-type="uri">second</ext-link></meta-value></custom-meta></front></article>"""


def test_plos(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLE.format(n=1, url="github.com/o/<b>r</b>"))
    (tmp_path / "b.xml").write_text("<article><broken></article>")
    (tmp_path / "c.xml").write_text(ARTICLE.format(n=3, url="x").replace("data-availability", "other"))
    (tmp_path / "d.xml").write_text(ARTICLE.format(n=4, url="x").replace('pub-id-type="doi"', 'pub-id-type="pmc"'))
    ok, bad = landed.plos(spark, str(tmp_path))
    assert rows(ok) == [("plos", "github.com/o/", "10.1/1")]
    got = {r["identifier"]: r["error"] for r in bad.collect()}
    assert got["c.xml"] == "No Repository URL" and got["d.xml"] == "No Paper DOI" and "mismatched tag" in got["b.xml"]


def test_works_and_authors(spark, tmp_path):
    work = {"id": "W1", "doi": "10.1/A", "title": "T", "publication_date": "2020-01-02", "cited_by_count": 3, "cited_by_percentile_year": {"min": 1, "max": 2}, "fwci": None, "type": "article", "open_access": {"is_oa": True, "oa_status": "gold"}, "abstract_inverted_index": {"b": [2], "a": [0, 5]},
            "topics": [{"id": "T1", "display_name": "t", "score": 0.5, "field": {"id": "F", "display_name": "f"}, "subfield": {"id": "S", "display_name": "s"}, "domain": {"id": "D", "display_name": "d"}}] * 2,
            "authorships": [{"author": {"id": "A1"}, "author_position": "first", "is_corresponding": True, "institutions": [{"id": "I1", "display_name": "i", "ror": "r"}]}],
            "grants": [{"funder": "F1", "funder_display_name": "f", "award_id": None}, {"funder": "F2", "funder_display_name": "g", "award_id": "X"}]}
    (tmp_path / "w.json").write_text("\n".join(json.dumps(w) for w in (work, work | {"id": "W2", "doi": "10.1/B", "cited_by_percentile_year": None})))
    (tmp_path / "a.json").write_text(json.dumps({"id": "A1", "display_name": "Ann", "works_count": 1, "cited_by_count": 2, "summary_stats": {"h_index": 3, "i10_index": 4, "2yr_mean_citedness": 0.5}}))
    t = landed.work_tables(spark.read.schema(landed.WORK).json(str(tmp_path / "w.json")), spark.read.schema(landed.AUTHOR).json(str(tmp_path / "a.json")))
    assert rows(t["document_abstract"]) == [("10.1/a", "a b a")]
    assert t["document_topic"].count() == t["topic"].count() == 1 and rows(t["funder"].select("open_alex_id")) == [("F2",)]
    assert rows(t["researcher"].select("h_index", "two_year_mean_citedness")) == [(3, 0.5)] and rows(t["errors"].select("identifier")) == [("10.1/B",)]
    assert rows(t["document_contributor"]) == [("10.1/a", "A1", "first", True)]


def test_doi_updates(spark):
    pairs = spark.createDataFrame([("10.1/a",), ("10.1/b",), ("10.1/c",)], "paper_doi string")
    latest = spark.createDataFrame([("10.1/a", "10.2/a"), ("10.1/b", "10.1/B")], "doi string, latest_doi string")
    assert rows(landed.updated_doi(pairs, latest)) == [("10.1/a", "10.2/a", "10.1/a"), ("10.1/b", "10.1/B", "10.1/b"), ("10.1/c", "10.1/c", None)]


def test_repos(spark, tmp_path):
    repo = {"owner": "o", "repo": "r", "fork": False, "created_at": "2020-01-01T10:00:00Z", "pushed_at": "2020-02-01T10:00:00Z", "languages": {"R": 5, "C": 7}, "readme": {"content": "aGk="}, "contributors": [{"login": f"u{i}", "name": None, "email": None} for i in range(40)]}
    (tmp_path / "r.json").write_text("\n".join(json.dumps(x) for x in (repo, repo | {"repo": "s", "readme": None, "contributors": None})))
    t = landed.repo_tables(spark.read.schema(landed.REPO).json(str(tmp_path / "r.json")))
    assert t["repository_contributor"].count() == 30 and rows(t["repository_readme"].select("content")) == [("hi",), (None,)]
    assert t["repository_language"].count() == 4 and t["repository"].first()["creation_datetime"].hour == 10


def test_weekly_stats_and_churn(spark):
    s = spark.createDataFrame([("o", "r", "a", [(1, 2, 3), (1, 0, 0)]), ("o", "r", "b", [])], "owner string, repo string, login string, weeks array<struct<c:int,a:int,d:int>>")
    assert rows(landed.contributor_totals(s).select("login", "n_commits", "total_repo_additions")) == [("a", 2, 2), ("b", 0, 2)]
    c = spark.createDataFrame([("h", {"f": (10, 5)}), ("e", {})], "hash string, files map<string, struct<insertions:int,deletions:int>>")
    assert rows(landed.commit_churn(c).select("hash", "abs_lines_changed", "n_files_changed", "per_file_lines_changed")) == [("e", 0, 0, ""), ("h", 15, 1, "f: +10 -5")]


def test_csv_languages_snapshots(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,,b\n1,2,3\n")
    assert tables.read_csv(spark, str(tmp_path / "x.csv")).columns == ["a", "b"]
    (tmp_path / "l.yml").write_text("---\nABAP:\n  type: programming\n  color: x\n'C#':\n  type: programming\nCSV:\n  type: data\n")
    assert rows(tables.programming_languages(spark, str(tmp_path / "l.yml"))) == [("ABAP",), ("C#",)]
    assert tables.latest_snapshot(["2024-01-02", "latest", "2024-11-01/"]) == "2024-11-01/"


def test_sqlite(spark, tmp_path):
    path = tmp_path / "g.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (id INTEGER, name VARCHAR, ok BOOLEAN, x FLOAT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, f"n{i}", i % 2, i / 2) for i in range(10)])
    con.commit()
    con.close()
    df = tables.read_sqlite(spark, str(path), "t", 3)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("ok", "boolean"), ("x", "double")]
    assert df.count() == 10 and df.where("ok").count() == 5


@pytest.fixture
def landing(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def _land(path, name, pairs):
    (path / "in" / name).write_text("\n".join(json.dumps({"source": s, "repo_url": u, "paper_doi": d}) for s, u, d in pairs))


def test_store_twice_and_stream(spark, landing):
    catalog = tables.Catalog(spark, str(landing / "db"))
    _land(landing, "1.json", [("joss", "github.com/o/r", "10.1/A"), ("joss", "gitlab.com/o/r", "10.1/b"), ("pwc", "github.com/o/r", "10.1/a")])
    batch = spark.read.schema("source string, repo_url string, paper_doi string").json(str(landing / "in"))
    assert store_batch(catalog, batch, 0)["document_repository_link"] == 1
    assert set(store_batch(catalog, batch, 1).values()) == {0}
    _land(landing, "2.json", [("plos", "github.com/o/new", "10.1/n"), ("plos", "", "10.1/x")])
    for _ in range(2):
        ingest_stream(spark, str(landing / "in"), catalog, str(landing / "ck"), str(landing / "err")).awaitTermination()
    assert catalog.read("repository").count() == 2 and catalog.read("document_repository_link").count() == 2
    assert catalog.check("repository").isEmpty() and tables.read_errors(spark, str(landing / "err")).count() == 2
    assert catalog.read("document").where(F.col("updated_datetime").isNotNull()).isEmpty()


def _graph(spark, path):
    """Landed metadata of three works and three repositories that share authors, topics, funders and developers."""
    works = [{"id": f"W{k}", "doi": f"10.1/W{k}", "title": f"T {k}", "publication_date": "2020-01-02", "cited_by_count": k, "cited_by_percentile_year": {"min": 1, "max": 2}, "fwci": 0.5, "type": "article", "open_access": {"is_oa": True, "oa_status": "gold"}, "abstract_inverted_index": {"a": [0], f"w{k}": [1]},
              "topics": [{"id": f"T{j}", "display_name": "t", "score": 0.5, "field": {"id": "F", "display_name": "f"}, "subfield": {"id": "S", "display_name": "s"}, "domain": {"id": "D", "display_name": "d"}} for j in (1, k)],
              "authorships": [{"author": {"id": f"A{j}"}, "author_position": "first" if j == 1 else "last", "is_corresponding": j == 1, "institutions": [{"id": f"I{j}", "display_name": "i", "ror": "r"}]} for j in (1, k + 1)],
              "grants": [{"funder": "F1", "funder_display_name": "f", "award_id": f"X{k % 2}"}]} for k in (1, 2, 3)]
    authors = [{"id": f"A{j}", "display_name": ["", "Ann Bell", "Bo Li", "Cy Dee", "Di Fox"][j], "works_count": 1, "cited_by_count": 2, "summary_stats": {"h_index": 3, "i10_index": 4, "2yr_mean_citedness": 0.5}} for j in (1, 2, 3, 4)]
    repos = [{"owner": "Own", "repo": f"rep{k}", "fork": False, "forks_count": 1, "stargazers_count": 1, "watchers_count": 1, "open_issues_count": 0, "size": 5, "created_at": "2020-01-01T10:00:00Z", "pushed_at": "2020-02-01T10:00:00Z", "languages": {"R": 5, "C": 7}, "readme": {"content": "aGk="}, "contributors": [{"login": "annbell", "name": "Ann Bell", "email": None}, {"login": f"u{k}", "name": None, "email": None}]} for k in (1, 2, 3)]
    frames = []
    for name, items, schema in (("w", works, landed.WORK), ("a", authors, landed.AUTHOR), ("r", repos, landed.REPO)):
        (path / f"{name}.json").write_text("\n".join(map(json.dumps, items)))
        frames.append(spark.read.schema(schema).json(str(path / f"{name}.json")))
    return dict(zip(("works", "authors", "repos"), frames))


def test_the_whole_graph_is_stored_once(spark, tmp_path):
    from quillgraph.operators.orphans import orphan_cascade

    meta = _graph(spark, tmp_path)
    pairs = spark.createDataFrame([("joss", "https://github.com/own/REP1", "10.1/old"), ("joss", "github.com/Own/rep2", "10.1/w2"), ("pwc", "github.com/Own/rep2", "10.1/W3"), ("pwc", "github.com/Own/none", "10.1/w1"), ("plos", "github.com/Own/rep3", "10.1/unknown"), ("plos", "gitlab.com/Own/rep3", "10.1/w1")], "source string, repo_url string, paper_doi string")
    latest = spark.createDataFrame([("10.1/old", "10.1/W1")], "doi string, latest_doi string")
    catalog = tables.Catalog(spark, str(tmp_path / "db"))
    n = store_batch(catalog, pairs.where("source <> 'pwc'"), 0, str(tmp_path / "err"), **meta, latest=latest)
    assert set(n) == set(SCHEMAS) and n["document"] == 2 and n["document_repository_link"] == 2 and n["document_alternate_doi"] == 1 and n["researcher_developer_account_link"] == 1
    more = store_batch(catalog, pairs, 1, str(tmp_path / "err"), **meta, latest=latest)
    assert more["document"] == 1 and more["document_repository_link"] == 1 and more["document_contributor"] == 2 and more["dataset_source"] == 1 and more["code_host"] == 0
    again = store_batch(catalog, pairs, 2, str(tmp_path / "err"), **meta, latest=latest)
    assert set(again.values()) == {0}
    for t in SCHEMAS:
        ids = catalog.read(t)
        assert catalog.check(t).isEmpty() and ids.select("id").distinct().count() == ids.count() > 0, t
    assert orphan_cascade({t: catalog.read(t) for t in SCHEMAS}, foreign_keys(), times=dict.fromkeys(SCHEMAS)).isEmpty()
    assert rows(tables.read_errors(spark, str(tmp_path / "err")).where("batch = 1").select("identifier", "error")) == [("10.1/unknown", "no work"), ("10.1/w1", "Not a GitHub repository"), ("10.1/w1", "no repository")]
    link = catalog.read("researcher_developer_account_link").join(catalog.read("researcher").selectExpr("id as researcher_id", "name"), "researcher_id").first()
    assert link["name"] == "Ann Bell"
    assert tables.write_snapshot(catalog, str(tmp_path / "snap"), "2024-05-01", skip=("topic",)) == [t for t in SCHEMAS if t != "topic"]
    assert tables.read_snapshot(spark, str(tmp_path / "snap"), "document").count() == 3
    assert tables.read_snapshot(spark, str(tmp_path / "snap"), "document", "2024-05-01") is None and tables.read_snapshot(spark, str(tmp_path / "none"), "document") is None
    assert tables.read_snapshot(spark, str(tmp_path / "snap"), "document", "2024-05-01", force=True).count() == 3


def test_a_repository_of_another_host_hides_no_pair(spark):
    from quillgraph.operators.store import not_yet_stored

    docs, alt = spark.createDataFrame([(1, "10.1/a")], "id long, doi string"), spark.createDataFrame([], "document_id long, doi string")
    repos, hosts = spark.createDataFrame([(5, 2, "own", "rep")], "id long, code_host_id long, owner string, name string"), spark.createDataFrame([(1, "github"), (2, "gitlab")], "id long, name string")
    links = spark.createDataFrame([(1, 5)], "document_id long, repository_id long")
    pairs = spark.createDataFrame([("10.1/a", "own", "rep", "github"), ("10.1/a", "own", "rep", "gitlab")], "paper_doi string, owner string, name string, host string")
    assert rows(not_yet_stored(pairs, docs, alt, repos, links, hosts).select("host")) == [("github",)]


def test_lookups_papers_logs_and_credentials(spark, tmp_path):
    pairs = spark.createDataFrame([("10.1/A",), ("10.1/z",)], "paper_doi string")
    works = spark.createDataFrame([("W1", "https://doi.org/10.1/a"), ("W0", "10.1/A")], "id string, doi string")
    assert rows(landed.works_of(pairs, works).select("paper_doi", "work.id")) == [("10.1/A", "W0"), ("10.1/z", None)]
    papers = [{"paperId": "P", "externalIds": {"DOI": "10.1/A"}, "title": "T", "authors": [{"authorId": "1", "name": "a"}, {"authorId": None, "name": "b"}, {"authorId": "3", "name": "c"}]}, {"paperId": "Q", "externalIds": {"DOI": "10.1/b"}, "title": "U", "authors": [{"authorId": "9", "name": "d"}]}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, papers)))
    found = landed.extended_papers(spark.read.schema(landed.PAPER).json(str(tmp_path / "p.json")))
    assert rows(found.select("name", "position")) == [("a", "first"), ("b", "middle"), ("c", "last"), ("d", "only")] and found.where("author_id is null").isEmpty()
    (tmp_path / "log.txt").write_text("\x1eabc\x1fAnn\x1f2024-01-02T03:04:05+00:00\x1ffix: x\n\n3\t1\ta.py\n-\t-\tb.png\n\x1edef\x1fBo\x1f2024-01-03T03:04:05+00:00\x1fempty\n")
    log = landed.commit_churn(landed.commit_log(spark, str(tmp_path / "log.txt")))
    assert rows(log.select("hash", "author", "message", "abs_lines_changed", "n_files_changed")) == [("abc", "Ann", "fix: x", 4, 2), ("def", "Bo", "empty", 0, 0)]
    (tmp_path / "c.yml").write_text("emails:\n  - a@x.example\n  - 'b@x.example'\nkeys:\n  - k1\n")
    assert tables.credentials(str(tmp_path / "c.yml"), "emails") == ["a@x.example", "b@x.example"] and tables.credentials(str(tmp_path / "c.yml"), "none") == []


def test_rendered_reports(spark):
    df = spark.createDataFrame([("a_b", 1), ("<c>", None)], "name string, n long")
    assert tables.rendered(df) == "| name | n |\n| --- | --- |\n| a_b | 1 |\n| <c> |  |"
    assert "<td>&lt;c&gt;</td>" in tables.rendered(df, "html") and "a\\_b & 1 \\\\" in tables.rendered(df, "latex")
    with pytest.raises(ValueError):
        tables.rendered(spark.range(5), most=3)
