"""Nulls, ties, empty tables and repeated rows in the batch operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators.aggregate import Measure, aggregate, aggregate_inputs, deltas, running
from millrace.operators.dedup import bucket_seconds, contains, first_in_bucket, seen_before
from millrace.operators.lookup import lookup_join, unique_rows
from millrace.operators.merge import merge_latest, union_inputs

EVENTS = "k string, at int, v double, s string"


@pytest.fixture
def events(spark):
    return spark.createDataFrame([("a", 1, 1.5, "x"), ("a", 2, None, None), ("a", 3, 0.5, "z"), (None, 1, 2.0, "q"), ("b", 1, None, None)], EVENTS)


def by_key(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_null_policies(events):
    measures = [Measure("n", "COUNT"), Measure("s", "SUM", "v", "NUMBER(2)"), Measure("m", "AVG", "v", "NUMBER(2)"), Measure("lo", "MIN", "v", "NUMBER(2)"), Measure("f", "FIRST", "s", "VARCHAR"), Measure("l", "LAST", "s", "VARCHAR"), Measure("t", "SUM", "s", "VARCHAR")]
    zero = by_key(aggregate(events, ["k"], measures, ["at"]))
    assert zero["a"] == (3, 2.0, 2.0 / 3, 0.0, "x", "z", "x,,z")
    assert zero["b"] == (1, 0.0, 0.0, 0.0, "", "", "")
    assert zero[None][:2] == (1, 2.0)
    sql = by_key(aggregate(events, ["k"], measures[:4], null_policy="sql"))
    assert sql["a"] == (3, 2.0, 1.0, 0.5) and sql["b"] == (1, None, None, None)


def test_measures_are_checked(events):
    with pytest.raises(ValueError):
        Measure("x", "MEDIAN", "v")
    with pytest.raises(ValueError):
        Measure("x", "SUM")
    with pytest.raises(ValueError):
        aggregate(events, ["k"], [Measure("x", "FIRST", "v")])


def test_empty_table(events):
    empty = events.limit(0)
    assert aggregate(empty, ["k"], [Measure("n", "COUNT")]).count() == 0
    assert running(empty, ["k"], [Measure("n", "COUNT")], ["at"], F.col("at")).count() == 0
    assert unique_rows(empty, ["k"]).count() == 0


@pytest.mark.parametrize("slices", ["at", "0", "at div 2"])
def test_running_does_not_depend_on_slices(events, slices):
    measures = [Measure("n", "COUNT"), Measure("s", "SUM", "v", "NUMBER(2)"), Measure("lo", "MIN", "v", "NUMBER(2)"), Measure("hi", "MAX", "v", "NUMBER(2)"), Measure("f", "FIRST", "s", "VARCHAR"), Measure("l", "LAST", "s", "VARCHAR")]
    got = sorted((tuple(r) for r in running(events.filter("k = 'a'"), ["k"], measures, ["at"], F.expr(slices)).collect()), key=lambda r: r[1])
    assert got == [("a", 1, 1, 1.5, 1.5, 1.5, "x", "x"), ("a", 2, 2, 1.5, 0.0, 1.5, "x", ""), ("a", 3, 3, 2.0, 0.0, 1.5, "x", "z")]


def test_running_keeps_null_keys(events):
    got = running(events, ["k"], [Measure("n", "COUNT")], ["at"], F.col("at")).filter("k IS NULL").collect()
    assert [r.n for r in got] == [1]


def test_deltas(events):
    assert {tuple(r) for r in deltas(events, ["k"], [Measure("n", "COUNT"), Measure("s", "SUM", "v", "NUMBER(2)")]).collect()} == {("a", 1, 1.5), ("a", 1, 0.0), ("a", 1, 0.5), (None, 1, 2.0), ("b", 1, 0.0)}


def test_inputs_do_not_multiply(spark):
    left = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "a int, x double")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "b int, y string")
    got = by_key(aggregate_inputs([(left, [F.col("a")], [Measure("sx", "SUM", "x", "NUMBER(1)")]), (right, [F.col("b")], [Measure("ny", "COUNT"), Measure("my", "MAX", "y", "VARCHAR")])], ["k"]))
    assert got == {1: (3.0, 2, "q"), 2: (5.0, 0, ""), 3: (0.0, 1, "r")}


def test_lookup_last_row_wins_and_misses_get_defaults(spark):
    facts = spark.createDataFrame([(1, "keep"), (2, "keep"), (None, "keep")], "id int, _take0 string")
    lookup = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "never", 3)], "key int, name string, at int")
    got = lookup_join(facts, lookup, {"id": "key"}, {"name": "name", "at": "at"}, {"name": "VARCHAR"}, ["at"])
    assert got.columns == ["id", "_take0", "name", "at"]
    assert sorted(map(tuple, got.select("id", "name", "at").collect()), key=str) == [(1, "new", 2), (2, "", None), (None, "", None)]


def test_lookup_check(spark):
    lookup = spark.createDataFrame([(1, "a", True), (1, "b", False)], "key int, name string, good boolean")
    facts = spark.createDataFrame([(1,)], "id int")
    assert lookup_join(facts, lookup, {"id": "key"}, {"name": "name"}, order=["name"], check="good").first().name == "a"


def test_merge_waits_for_all_inputs(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 5, 1), (None, 9, 9)], "k int, x int, at int")
    b = spark.createDataFrame([(1, 7, 1), (3, 8, 1)], "k int, y int, at int")
    got = by_key(merge_latest([(a, {"k": F.col("k")}, {"x": F.col("x")}, ["at"]), (b, {"k": F.col("k")}, {"y": F.col("y")}, ["at"])], {"both": F.col("x") + F.col("y")}))
    assert got == {1: (20, 7, 27), 2: (5, None, None), 3: (None, 8, None)}
    with pytest.raises(ValueError):
        merge_latest([(a, {"k": F.col("k")}, {}, ["at"]), (b, {"j": F.col("k")}, {}, ["at"])])


def test_union_fills_missing_columns(spark):
    got = union_inputs([spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(2,)], "k int")])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, None)]


def test_bucket_rules():
    assert [bucket_seconds(r) for r in ("1", "1:5", "2", "2:1", "3:2")] == [1800, 300, 3600, 3600, 172800]
    for bad in ("4:1", "2:0"):
        with pytest.raises(ValueError):
            bucket_seconds(bad)


def test_buckets(spark):
    t = lambda h, m: datetime(2024, 1, 1, h, m)
    df = spark.createDataFrame([(1, t(1, 5), "a"), (2, t(1, 50), "a"), (3, t(2, 1), "a"), (4, t(1, 7), None), (5, t(1, 8), None), (6, None, "a")], "id int, ts timestamp, k string")
    assert sorted(r.id for r in first_in_bucket(df, ["k"], "ts", ["ts", "id"]).collect()) == [1, 3, 4, 6]
    assert {r.id: r.seen for r in seen_before(df, ["k"], "ts", ["ts", "id"]).collect()} == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False}
    assert sorted(r.id for r in contains(df, df.filter("id = 2"), ["k"], "ts").collect()) == [1, 2]


def test_lookups_known_to_be_unique_need_no_aggregate(spark):
    df, dim = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, name string")
    options = {"on": {"k": "id"}, "take": {"name": "name"}, "types": {"name": "VARCHAR"}, "check": "name <> 'b'"}
    plain, known = lookup_join(df, dim, **options), lookup_join(df, dim, **options, unique=True)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, known.collect()), key=str) == [(1, "a"), (2, ""), (None, "")]
    plan = lambda q: q._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan(plain) and "Aggregate" not in plan(known)
