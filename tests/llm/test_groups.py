"""Components, representatives and formatting duplicates."""

import random
from datetime import date, datetime

import pytest

from quillgraph.llm.components import components, match_groups
from quillgraph.llm.formatting import collapse, copies
from quillgraph.llm.representatives import best_records, survivors


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return sorted((n, find(n)) for n in parent)


def _edges(kind):
    r = random.Random(5)
    if kind == "path":
        order = list(range(60))
        r.shuffle(order)
        return list(zip(order, order[1:]))
    if kind == "star":
        return [(7, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 210)]
    if kind == "random":
        return [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    return [(1, 1), (2, 3), (3, 2), (2, 3), (5, 5)]


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops"])
def test_components_equal_union_find(spark, kind):
    edges = _edges(kind)
    df = spark.createDataFrame([(u, v, "x") for u, v in edges] + [(None, 4, "x")], "u long, v long, root string")
    assert [tuple(r) for r in sorted(components(df).collect())] == _union_find(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_match_groups(spark):
    links = [(7, 1, 0.99), (3, 1, 0.97), (7, 1, 0.2), (9, 7, None), (8, 3, 0.969), (5, 7, 0.98), (5, None, 0.99), (6, 7, float("nan"))]
    df = spark.createDataFrame(links, "researcher_id long, developer_account_id long, predictive_model_confidence double")
    assert rows(match_groups(df)) == [(3, "account", 1), (3, "researcher", 3), (3, "researcher", 7), (5, "account", 7), (5, "researcher", 5)]
    with pytest.raises(Exception, match="out of range"):
        match_groups(spark.createDataFrame([(1 << 62, 1, 1.0)], df.schema)).collect()


DOC = "id long, doi string, open_alex_id string, title string, publication_date date, fwci double, document_type string, is_open_access boolean, open_access_status string, cited_by_percentile_year_min int, cited_by_percentile_year_max int, cited_by_count int, created_datetime timestamp_ntz, updated_datetime timestamp_ntz, survivor_id string"


def _doc(id, doi, title="T", fwci=None, cited=0, day=1, access="gold"):
    return (id, doi, f"W{id}", title, date(2020, 1, day), fwci, "article", True, access, 1, 2, cited, datetime(2024, 1, day), None, "clash")


def test_best_records(spark):
    docs = spark.createDataFrame([
        _doc(1, "10.1/old", "A long tit…", 1.5, 9, 1, "green"), _doc(2, "10.1/new", "", None, 3, 5, ""), _doc(3, "10.1/mid", "A long title", None, 4, 3),
        _doc(4, "10.2/a"), _doc(5, "10.2/b"), _doc(6, "10.3/self"), _doc(7, "10.4/x"), _doc(8, None), _doc(9, " "),
    ], DOC)
    alt = spark.createDataFrame([
        (2, "HTTPS://DOI.EXAMPLE/10.1//OLD,"), (2, "(10.1/mid)"), (2, "10.1/mid"), (2, "10.1/new"), (4, "10.9/shared"), (5, "doi: 10.9/Shared."), (6, "10.3/self"), (7, "10.8/unknown"), (99, "10.4/x"), (8, None), (None, "10.4/x"), (9, ""),
    ], "document_id long, doi string")
    out = {r["first_id"]: r for r in best_records(docs, alt).collect()}
    assert set(out) == {1, 4}
    r = out[1]
    assert (r["survivor_id"], r["doi"], r["n_members"], r["title"], r["fwci"], r["cited_by_count"], r["open_access_status"]) == (2, "10.1/new", 3, "A long title", 1.5, 9, "green")  # of the two that have a status, the more complete record
    assert out[4]["survivor_id"] == 4  # both current and equal: the smaller id
    assert rows(survivors(docs, alt)) == [(1, 2), (4, 4)]
    assert survivors(docs, alt.where("false")).count() == 0 and survivors(docs.where("false"), alt).count() == 0


def test_a_circle_and_a_repeated_document(spark):
    docs = spark.createDataFrame([_doc(1, "10.1/a"), _doc(2, "10.1/b", cited=5, day=9), _doc(2, "10.1/b", cited=5, day=9)], DOC)
    alt = spark.createDataFrame([(1, "10.1/b"), (2, "10.1/a")], "document_id long, doi string")
    r = best_records(docs, alt).collect()
    assert [(x["first_id"], x["survivor_id"], x["n_members"], x["cited_by_count"]) for x in r] == [(1, 2, 2, 5)]


PAIRS = [
    (1, "https://forge.example/Own/Rep", "10.1/a"), (2, "http://www.FORGE.example//own/rep.git/", "doi: 10.1/A."), (3, "(10.1/a)", " forge.example/own /rep "), (4, "forge.example/own/rep", "10.1/b"),
    (5, "forge.example/own/rep-x", "10.1/a"), (6, None, "10.1/a"), (7, " ", "10.1/a"), (8, "forge.example/own/rep", ""), (9, "forge.example/own/rep.py", "10.1/a"), (10, "forge.example/own/re.p", "10.1/a"),
]


@pytest.mark.parametrize("hot", [(1.0, 10_000), (0.2, 1)])
def test_copies(spark, hot):
    df = spark.createDataFrame([(*p, "a", "b") for p in PAIRS], "raw_id long, repo_url string, paper_doi string, key string, id string")
    assert rows(copies(df, share=hot[0], rows=hot[1])) == [(1, 1), (1, 2), (1, 3)]
    assert rows(collapse(df, share=hot[0], rows=hot[1]).select("group_id", "n_copies")) == [(1, 3), (10, 1), (4, 1), (5, 1), (9, 1)]
    assert copies(df.where("false")).count() == 0


def test_a_hot_key_takes_the_salted_path(spark, monkeypatch):
    """A key of half of all rows, with the thresholds as they are."""
    from pyspark.sql import functions as F

    from quillgraph.llm import formatting

    salted = []
    two_levels = formatting._hot_groups
    monkeypatch.setattr(formatting, "_hot_groups", lambda rows, salts: salted.append(salts) or two_levels(rows, salts))
    n = 24_000
    hot = F.concat(F.when(F.col("id") % 4 == 0, "https://").otherwise("HTTP://www."), F.lit("forge.example/Own/Rep"), F.when(F.col("id") % 3 == 0, ".git/").otherwise("/"))
    rows = spark.range(n).select(F.col("id").alias("raw_id"), F.when(F.col("id") % 2 == 0, hot).otherwise(F.concat(F.lit("forge.example/o/r"), (F.col("id") % 5999).cast("string"))).alias("repo_url"), F.lit("10.1/A").alias("paper_doi"))
    got = copies(rows)
    assert salted and got.where("group_id = 0").count() == n // 2
    want = rows.where("raw_id % 2 = 1").groupBy("repo_url").agg(F.min("raw_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    rest = got.where("group_id <> 0").groupBy("group_id").agg(F.count("*").alias("n"))
    assert rest.count() == want.count() > 5000 and rest.join(want, ["group_id", "n"], "left_anti").count() == 0
    assert collapse(rows).agg(F.max("n_copies"), F.sum("n_copies")).first() == (n // 2, n)
