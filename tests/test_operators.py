from datetime import date

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import dedup, reshape, summary
from quillgraph.operators.skew import hot_from
from quillgraph.operators.store import get_or_create, new_rows, not_yet_stored, repeated_keys


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_strict_uniqueness_is_sequential(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3), (4, 3)], "a long, b long")
    assert rows(dedup.strictly_unique(df, "a", "b")) == [(2, 2)]
    assert rows(dedup.strictly_unique(df, "b", "a")) == [(1, 1)]


def test_best_row_and_greedy_pairs_break_ties_by_id(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9), (2, 1, 2, 0.9), (3, 2, 1, 0.8), (4, 2, 2, 0.7)], "id long, a long, b long, s double")
    assert rows(dedup.best_per_key(df, ["a"], [F.col("s").desc(), F.col("id")]).select("id")) == [(1,), (3,)]
    assert rows(dedup.greedy_pairs(df, "a", "b", "s", "id").select("id")) == [(1,)]


def test_mode_prefers_the_latest_on_a_tie(spark):
    df = spark.createDataFrame([(1, "x", date(2020, 1, 1)), (1, "y", date(2021, 1, 1)), (2, "z", None), (2, "z", None), (2, "a", date(2022, 1, 1))], "k long, v string, d date")
    assert rows(dedup.mode_by_recency(df, "k", "v", "d")) == [(1, "y"), (2, "z")]


def test_positions(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (2, 3)], "k long, o long")
    assert rows(dedup.position_labels(df, "k", [F.col("o")])) == [(1, 1, "only"), (2, 1, "first"), (2, 2, "middle"), (2, 3, "last")]


def test_quantile_cuts(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "v double")
    assert summary.below_quantile(df, "v", 0.5).count() == 50
    assert summary.between_quantiles(df, "v", 0.03, 0.97).count() == 94
    assert rows(summary.describe(df, "v", quantiles=(0.5,)).select("n", "p50")) == [(100, 50.5)]


def test_quantiles_of_many_values_are_exact(spark):
    import random

    r = random.Random(1)
    values = [r.choice([r.random(), round(r.random(), 1), None]) for _ in range(5001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    qs = (0.0, 0.03, 0.25, 0.5, 0.977, 1.0)
    want = df.agg(*(F.percentile("v", q) for q in qs)).first()
    assert list(summary.exact_quantiles(df, "v", *qs).first()) == pytest.approx(list(want))
    kept = sorted(v for v in values if v is not None)
    got = {x["v"]: x["share"] for x in summary.ecdf(df, "v").collect()}
    assert len(got) == len(set(kept)) and all(got[v] == pytest.approx(sum(k <= v for k in kept) / len(kept)) for v in kept[::200])
    assert list(summary.exact_quantiles(df.where("false"), "v", 0.5).first()) == [None] and summary.ecdf(df.where("v is null"), "v").count() == 0


def test_strictly_unique_of_wide_rows(spark):
    df = spark.createDataFrame([(1, None, {"a": 1}, "x"), (2, 5, {"b": 2}, None), (2, 6, {}, "y"), (None, 7, {}, "z")], "k long, n long, m map<string,long>, s string")
    assert [tuple(r) for r in dedup.strictly_unique(df, "k").collect()] == [(1, None, {"a": 1}, "x")]


def test_count_report_leaves_null_groups_out(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, g string")
    assert rows(summary.count_report(df, {"g": "g"}, {"n_ids": "id"})) == [("g", "x", 1, 1), ("total", "total", 2, 2)]


def test_reshape_round_trip_and_numbering(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "id long, a double, b double")
    long = reshape.melt(df, ["id"], ["a", "b"])
    assert rows(long.groupBy("id").pivot("metric", ["a", "b"]).agg(F.first("value"))) == rows(df)
    assert rows(reshape.transpose(df.withColumn("id", F.col("id").cast("string")), "id", ["a", "b"], ["1", "2"])) == [("a", 2.0, 4.0), ("b", 3.0, 5.0)]
    n = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert [r[1] for r in sorted(tuple(r) for r in reshape.ordinal(n, ["x"]).collect())] == list(range(1000))
    assert reshape.batches(n, ["x"], 50).select("batch").distinct().count() == 20
    assert {r[1] for r in reshape.round_robin(n, ["x"], 3).groupBy("slot").count().collect()} == {333, 334}


def test_numbers_of_wide_rows_do_not_repeat(spark):
    df = spark.range(30_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), *(F.repeat(F.lit("x"), 20).alias(f"c{i}") for i in range(6)))
    out = reshape.ordinal(df, ["key"]).select("ordinal", "key")
    assert [r[1] for r in out.orderBy("ordinal").collect()] == sorted(r[0] for r in df.select("key").collect())
    assert tuple(out.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first()) == (30_000, 0, 29_999)
    ids = get_or_create(spark.createDataFrame([(7, "a")], "id long, key string"), df.union(df), ["key"])
    assert tuple(ids.agg(F.count(F.lit(1)), F.count_distinct("id"), F.min("id"), F.max("id")).first()) == (30_000, 30_000, 8, 30_007)


def test_few_keys_are_hot_at_every_size():
    assert hot_from(20_000) == 10_000 and hot_from(10_000_000) == 50_000 and hot_from(10**10) == 2_000_000
    assert all(total / hot_from(total) <= 100_000 for total in (10**k for k in range(4, 16)))


def test_samples_are_repeatable(spark):
    df = spark.range(10_000).withColumn("g", F.col("id") % 3)
    a, b = (reshape.hash_sample(df, "id", 0.1, 5) for _ in range(2))
    assert rows(a) == rows(b) and 800 < a.count() < 1200
    assert rows(reshape.sample_per_group(df, "g", "id", 7).groupBy("g").count()) == [(0, 7), (1, 7), (2, 7)]


def test_one_hot_drops_the_first_level(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "t string")
    out = reshape.one_hot(df, "t", reshape.levels_of(df, "t"))
    assert out.columns == ["t", "t_b", "t_c"]
    with pytest.raises(ValueError):
        reshape.levels_of(df, "t", 2)


def test_store_is_idempotent_and_first_writer_wins(spark):
    schema = "k string, v string"
    empty = spark.createDataFrame([], "id long, " + schema)
    first = get_or_create(empty, spark.createDataFrame([(" a ", "1"), ("b", "2"), ("a", "3")], schema), ["k"])
    stored = first.select("id", "k", "v")
    assert rows(stored) == [(1, "a", "1"), (2, "b", "2")] and {r[0] for r in first.select("updated_datetime").collect()} == {None}
    again = get_or_create(stored, spark.createDataFrame([("a", "9"), ("c", "4")], schema), ["k"])
    assert rows(again.select("id", "k", "v")) == [(3, "c", "4")]
    assert new_rows(stored, spark.createDataFrame([("a", "9")], schema), ["k"]).isEmpty() and repeated_keys(stored, ["k"]).isEmpty()


def test_not_yet_stored_knows_alternate_dois(spark):
    docs = spark.createDataFrame([(1, "10.1/A")], "id long, doi string")
    alt = spark.createDataFrame([(1, "10.1/old")], "document_id long, doi string")
    repos = spark.createDataFrame([(5, "Own", "Rep")], "id long, owner string, name string")
    links = spark.createDataFrame([(1, 5)], "document_id long, repository_id long")
    pairs = spark.createDataFrame([("10.1/a", "own", "rep"), ("10.1/OLD", "own", "rep"), ("10.1/a", "own", "other")], "paper_doi string, owner string, name string")
    assert rows(not_yet_stored(pairs, docs, alt, repos, links)) == [("10.1/a", "own", "other")]
