"""Regression numbers of the graph bridge, and rules on micro tables."""

import importlib
import os

import pytest
from pyspark.sql import functions as F

from quillgraph.plans import team
from quillgraph.plans.bridge import Graph

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_bridge_numbers(spark):
    g = Graph(spark, DATA)
    t = team.team_composition(g).agg(F.count(F.lit(1)), F.sum("n_author_devs"), F.sum("n_non_author_devs"), F.min(F.col("n_author_devs") + F.col("n_author_non_devs") - F.col("n_authors")), F.max(F.col("n_author_devs") + F.col("n_author_non_devs") - F.col("n_authors"))).first()
    assert tuple(t) == (455, 342, 1501, 0, 0)
    f = team.code_flags(g).agg(F.count(F.lit(1)), F.count(F.when(F.col("is_code_contributor"), 1))).first()
    assert tuple(f) == (1733, 304)
    assert team.team_filtered(g).count() == 266


def _graph(spark, links, contributors, authors, people):
    class Micro:
        pairs = spark.createDataFrame(links, "document_id long, repository_id long, source string")
        authors_ = spark.createDataFrame(authors, "document_id long, researcher_id long, position string, is_corresponding boolean")
        contributors_ = spark.createDataFrame(contributors, "repository_id long, account_id long")
        people_ = spark.createDataFrame(people, "link_id long, researcher_id long, account_id long, confidence long")

    m = Micro()
    m.authors, m.contributors, m.people = m.authors_, m.contributors_, m.people_
    return m


def test_links_are_reduced_before_the_threshold_and_ambiguous_accounts_skipped(spark):
    g = _graph(
        spark, [(1, 1, "A")], [(1, 100), (1, 101), (1, 102)],
        [(1, 10, "first", True), (1, 11, "last", False)],
        # account 100: researcher 10 beats 11, both sure; account 101 has four sure researchers, none an author
        [(1, 10, 100, 99), (2, 11, 100, 98), (3, 20, 101, 99), (4, 21, 101, 99), (5, 22, 101, 99), (6, 23, 101, 99)],
    )
    t = team.team_composition(g).first()
    assert (t["n_author_devs"], t["n_author_non_devs"], t["n_non_author_devs"]) == (1, 1, 1)  # 102 has no link at all


def test_researchers_with_many_links_are_left_out_of_flags(spark):
    g = _graph(spark, [(1, 1, "A")], [(1, 100)], [(1, 10, "first", True), (1, 11, "last", False)], [(i, 10, 100 + i, 99) for i in range(4)] + [(9, 11, 100, 97)])
    assert [tuple(r) for r in team.code_flags(g).select("researcher_id", "is_code_contributor").collect()] == [(11, True)]


@needs_data
def test_every_oracle_has_a_query_and_entry_runs(spark):
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
    assert e.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["one_to_one", "position_rates", "greedy_links", "url_normalise", "label_agreement", "p4_found"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    e = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = e.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall(), key=repr)
    assert got == want


def test_owner_filter_ignores_case(spark):
    from quillgraph.plans.report_queries import owner_filter

    df = spark.createDataFrame([(1, "https://h/Own/r", "https://h/own"), (2, "https://h/own/r", "https://h/other"), (3, None, "https://h/own")], "id long, repository_url string, developer_account_url string")
    assert [[r["id"] for r in owner_filter(df, m).orderBy("id").collect()] for m in ("all", "none", "only")] == [[1, 2, 3], [2, 3], [1]]
