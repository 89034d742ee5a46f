from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import codehost, keys, text

URLS = [
    ("https://github.com/Own/Rep", ("github", "own", "rep", None)),
    ("http://www.github.com/own/rep.git", ("github", "own", "rep", None)),
    ("  github.com/own/rep/tree/main/x  ", ("github", "own", "rep", None)),
    ("github.com/own", ("github", "own", None, None)),
    ("own.github.io/rep", ("github", "own", "rep", None)),
    ("own.github.com/rep", ("github", "own", "rep", None)),
    ("own.github.io", ("github", "own", None, None)),
    ("gist.github.com/u/id", ("github", "gist", "u", None)),
    ("gitlab.com/own/rep", ("gitlab", "own", "rep", None)),
    ("own.gitlab.io/rep", ("gitlab", "own", "rep", None)),
    ("own.gitlab.com/rep", ("gitlab", "own", "rep", None)),
    ("bitbucket.org/own/rep", ("bitbucket", "own", "rep", None)),
    ("sourceforge.net/projects/rep", ("sourceforge", None, "rep", None)),
    ("github.com/own/x.github.io", ("github", "own", "x.github.io", None)),
    ("https://elsewhere.example/a/b", (None, None, None, codehost.UNPARSED)),
    ("", (None, None, None, codehost.UNPARSED)),
    ("https://", (None, None, None, codehost.UNPARSED)),
    (None, (None, None, None, codehost.UNPARSED)),
]


def test_code_hosts(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "i int, u string")
    got = {r["i"]: tuple(r["p"]) for r in df.select("i", codehost.parse_code_host(F.col("u")).alias("p")).collect()}
    assert {URLS[i][0]: got[i] for i in got} == {u: w for u, w in URLS}


def test_compat_removes_every_git(spark):
    df = spark.createDataFrame([("github.com/own/foo.github.io",)], "u string")
    assert df.select(codehost.parse_code_host(F.col("u"), compat=True).alias("p")).first()[0]["name"] == "foohub.io"


def test_pairs_are_split(spark):
    df = spark.createDataFrame([("joss", "github.com/o/r", "10.1/a"), ("joss", "gitlab.com/o/r", "10.1/b"), ("pwc", "", "10.1/c")], "source string, repo_url string, paper_doi string")
    ok, bad = codehost.split_pairs(df)
    assert [r["paper_doi"] for r in ok.collect()] == ["10.1/a"]
    assert {(r["identifier"], r["error"]) for r in bad.collect()} == {("10.1/b", codehost.OTHER_HOST), ("10.1/c", codehost.UNPARSED)}


@pytest.mark.parametrize(("value", "tidy"), [
    (" DOI: 10.5555/A.B ", "10.5555/a.b"), ("https://doi.example/(10.5555//x.1)", "10.5555/x.1"), ("<10.1/x;>", "10.1/x"), ("10.00203/ tmsw.3", "10.00203/tmsw.3"),
    (" 10.1/x​\n", "10.1/x"), ("doi10.1/x./", "10.1/x"), ("nothing", None), ("", None), (None, None),
])
def test_tidy_doi(spark, value, tidy):
    assert spark.createDataFrame([(value,)], "v string").select(keys.tidy_doi(F.col("v"))).first()[0] == tidy


@pytest.mark.parametrize(("value", "tidy"), [
    ("HTTPS://www.Forge.example//Own/Rep.git/,", "forge.example/own/rep"), ("(forge.example/own/rep//)", "forge.example/own/rep"), ("forge.example/o/r-x", "forge.example/o/r-x"), (" ", None), (None, None),
])
def test_tidy_repository(spark, value, tidy):
    assert spark.createDataFrame([(value,)], "v string").select(keys.tidy_repository(F.col("v"))).first()[0] == tidy


def test_inverted_index(spark):
    df = spark.createDataFrame([({"world": [1, 4], "hello": [0]},), ({},), (None,)], "m map<string, array<int>>")
    assert [r[0] for r in df.select(text.text_of_index(F.col("m"))).collect()] == ["hello world world", "", None]
    t = spark.createDataFrame([("a b a  c",), ("",)], "t string")
    assert [r[0] for r in t.select(text.text_of_index(text.index_of_text(F.col("t")))).collect()] == ["a b a  c", ""]


def test_days_round_down(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 12), datetime(2024, 1, 1)), (datetime(2024, 1, 1), datetime(2024, 1, 3, 23))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(text.days_between(F.col("a"), F.col("b"))).collect()] == [-2, 2]


def test_small_texts(spark):
    df = spark.createDataFrame([("aGVsbG8=", "name: Ann;\nemail: None;\n")], "b string, f string")
    r = df.select(text.decoded(F.col("b")), text.parsed_fields(F.col("f")), text.decoded(F.lit("*bad*")), text.stars(F.lit(0.004)), text.percent(F.lit(0.286)), text.mean_std(F.lit(4.84), F.lit(1.8))).first()
    assert list(r) == ["hello", {"name": "Ann", "email": None}, None, "**", "28.6%", "4.8 ± 1.8"]
    d = spark.createDataFrame([("10.48550/arXiv.1805.1",), ("https://doi.org/10.1/x",)], "d string")
    assert [tuple(r) for r in d.select(text.doi_url(F.col("d")), text.lookup_id(F.col("d"))).collect()] == [("https://doi.org/10.48550/arxiv.1805.1", "arxiv:1805.1"), ("https://doi.org/10.1/x", "https://doi.org/10.1/x")]
