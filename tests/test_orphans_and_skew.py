from datetime import datetime

from quillgraph.operators.orphans import ForeignKey, orphan_cascade, orphan_report
from quillgraph.operators.skew import fits, hot_keys, skew_join

T = "id long, parent_id long, created_datetime timestamp_ntz"
D1, D2, D3 = datetime(2024, 1, 5), datetime(2024, 2, 5), datetime(2024, 3, 5)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_missing_late_and_null_keys(spark):
    parent = spark.createDataFrame([(1, None, D1), (2, None, D3), (3, None, None), (4, None, D3), (4, None, D1)], T)
    child = spark.createDataFrame([(10, 1, D2), (11, 2, D2), (12, 9, D2), (13, None, D2), (14, 3, D2), (15, 2, None), (12, 9, D2), (16, 4, D2)], T)
    out = orphan_cascade({"child": child, "parent": parent}, [ForeignKey("child", "parent_id", "parent")])
    assert rows(out.select("row_id", "kind", "reason")) == [(11, "direct", "late"), (12, "direct", "missing"), (12, "direct", "missing")]


def test_cascade_over_a_chain_and_a_circle(spark):
    a = spark.createDataFrame([(1, 99, D1), (2, None, D1)], T)
    b = spark.createDataFrame([(5, 1, D2), (6, 2, D2)], T)
    c = spark.createDataFrame([(7, 5, D3), (8, 6, D3)], T)
    keys = [ForeignKey("a", "parent_id", "x"), ForeignKey("b", "parent_id", "a"), ForeignKey("c", "parent_id", "b")]
    x = spark.createDataFrame([], T)
    out = orphan_cascade({"a": a, "b": b, "c": c, "x": x}, keys)
    assert rows(out.select("ref_table", "row_id", "kind", "depth")) == [("a", 1, "direct", 0), ("b", 5, "inherited", 1), ("c", 7, "inherited", 2)]
    # A table that refers to itself: 1 -> 2 -> 3 -> 1 is whole, 4 hangs on 5 which is missing.
    ring = spark.createDataFrame([(1, 2, D1), (2, 3, D1), (3, 1, D1), (4, 5, D1), (6, 4, D1)], T)
    out = orphan_cascade({"ring": ring}, [ForeignKey("ring", "parent_id", "ring")])
    assert rows(out.select("row_id", "kind")) == [(4, "direct"), (6, "inherited")]


def test_report_and_extra_columns(spark):
    parent = spark.createDataFrame([(1, None, D1)], T)
    child = spark.createDataFrame([(10, 9, D1, "x", "y"), (11, 9, D2, "x", "y")], T + ", key string, reason string")
    out = orphan_report(orphan_cascade({"child": child, "parent": parent}, [ForeignKey("child", "parent_id", "parent")]))
    assert rows(out.select("month", "n_rows")) == [("2024-01", 1), ("2024-02", 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], T)
    some = spark.createDataFrame([(1, 2, D1)], T)
    keys = [ForeignKey("child", "parent_id", "parent")]
    assert rows(orphan_cascade({"child": none, "parent": some}, keys)) == []
    assert orphan_cascade({"child": some, "parent": none}, keys).count() == 1


def test_skew_join_equals_a_plain_join(spark):
    left = spark.createDataFrame([(1 if i % 3 == 0 else i, i) for i in range(60)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 60, 2)] + [(1, "r1")], "k long, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = rows(left.join(right, "k", how))
        for few in (0, 10_000):
            assert rows(skew_join(left, right, ["k"], how, share=0.1, rows=few).select(*left.join(right, "k", how).columns)) == plain
    assert rows(hot_keys(left, ["k"], 61, 0.1, 0)) == [(1,)]
    assert fits(left, 61) and not fits(left, 60)
