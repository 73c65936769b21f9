"""Streams in several batches give what one batch run gives."""

import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators.aggregate import Measure, aggregate, running
from millrace.plans.build import Context, build_graph
from millrace.plans.specs import FieldSpec, InputSpec, JoinSpec, LookupSpec, NodeSpec, PushSpec, SpecError, StoreSpec
from millrace.sources.readers import table_stream
from millrace.streaming.graph import RunningGraph, parts_of
from millrace.streaming.run import drained, first_in_bucket_stream, progress, run_summary, running_stream, source_lag, start

MEASURES = [Measure("n", "COUNT"), Measure("total", "SUM", "value", "NUMBER(2)"), Measure("last", "LAST", "event_type", "VARCHAR")]


def several_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / uuid.uuid4().hex)
    for k in range(3):  # files are read in the order of their times
        events.filter(F.col("event_id") * 3 >= 1000 * k).filter(F.col("event_id") * 3 < 1000 * (k + 1)).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder, events


def test_aggregate_over_batches(spark, tmp_path):
    folder, events = several_files(spark, tmp_path)
    stream = aggregate(table_stream(spark, folder, "events", 1), ["user_id"], MEASURES, ["ts", "event_id"])
    batch = aggregate(events, ["user_id"], MEASURES, ["ts", "event_id"])
    assert set(map(tuple, drained(stream, ["user_id"]).collect())) == set(map(tuple, batch.collect()))


def test_dedup_over_batches(spark, tmp_path):
    folder, events = several_files(spark, tmp_path)
    got = drained(first_in_bucket_stream(table_stream(spark, folder, "events", 1), ["user_id"], "ts", "3:1", "60 days"), mode="append")
    want = events.select("user_id", F.date_trunc("day", "ts")).distinct().count()
    assert got.count() == got.distinct().count() == want


def test_running_over_batches(spark, tmp_path):
    folder, events = several_files(spark, tmp_path)
    measures = [Measure("n", "COUNT"), Measure("total", "SUM", "value", "NUMBER(2)"), Measure("mean", "AVG", "value", "NUMBER(2)"), Measure("least", "MIN", "value", "NUMBER(2)"), Measure("greatest", "MAX", "event_id"), Measure("first", "FIRST", "event_type", "VARCHAR"), Measure("last", "LAST", "event_type", "VARCHAR"), Measure("whole", "SUM", "event_id")]
    got = drained(running_stream(table_stream(spark, folder, "events", 1), ["user_id"], ["ts", "event_id"], measures), mode="append")
    want = running(events, ["user_id"], measures, ["ts", "event_id"], F.date_trunc("day", "ts"))
    names = ["event_id", "user_id", *(m.name for m in measures)]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def meeting(**more):
    fields = (FieldSpec("person", "NUMBER", "1:a;2:b", key=True), FieldSpec("x", "NUMBER", "x"), FieldSpec("y", "NUMBER", "y"), FieldSpec("text", "VARCHAR", "concat(x, ' y at ', y)"))
    return NodeSpec(1, "meeting", (InputSpec(1, 10), InputSpec(2, 11)), fields, arrival_order=("at",), **more)


def streams_of(spark, folder, **tables):
    out = {}
    for name, rows in tables.items():
        for k, batch in enumerate(rows):
            batch.coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")
        out[name] = table_stream(spark, folder, name, 1)
    return out


def test_inputs_meet_in_a_stream(spark, tmp_path):
    a = [spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "a int, x int, at int"), spark.createDataFrame([(1, 11, 2)], "a int, x int, at int")]
    b = [spark.createDataFrame([(1, 5, 1)], "b int, y int, at int"), spark.createDataFrame([(3, 7, 1)], "b int, y int, at int")]
    found = streams_of(spark, str(tmp_path), one=a, two=b)
    merged = drained(build_graph([meeting()], Context({10: found["one"], 11: found["two"]}))[1].full, ["person"])
    assert sorted(map(tuple, merged.collect())) == [(1, 11, 5, "11 y at 5"), (2, 20, 0, None), (3, 0, 7, None)]
    grouped = NodeSpec(1, "g", (InputSpec(1, 10), InputSpec(2, 11)), (FieldSpec("person", "NUMBER", "1:a;2:b", key=True), FieldSpec("n", "NUMBER", method="COUNT"), FieldSpec("xs", "NUMBER", "x", "SUM"), FieldSpec("y", "NUMBER", "y", "LAST")), arrival_order=("at",))
    counted = drained(build_graph([grouped], Context({10: found["one"], 11: found["two"]}))[1].full, ["person"])
    assert sorted(map(tuple, counted.collect())) == [(1, 3, 21, 5), (2, 1, 20, 0), (3, 1, 0, 7)]


def test_a_graph_runs_stops_and_is_edited(spark, tmp_path):
    folder, events = several_files(spark, tmp_path)
    users = {"v": 1}
    dim = lambda: spark.range(101).select(F.col("id").alias("u"), F.concat(F.lit(f"v{users['v']}-"), (F.col("id") % 2).cast("string")).alias("name"))
    spec = LookupSpec(5, "dim", (("u",),), {"name": "VARCHAR"})
    fields = (FieldSpec("name", "VARCHAR", "name", key=True), FieldSpec("n", "NUMBER", method="COUNT"))
    join = (JoinSpec(5, {"user_id": "u"}, {"name": "name"}),)
    node = NodeSpec(1, "names", (InputSpec(1, 10),), fields, join, stores=(StoreSpec("table", key=("name",)),), pushes=(PushSpec("kafka", "t", delta=True, key_kind="text", key=("name",)),))
    plain = NodeSpec(2, "ids", (InputSpec(1, 10),), (FieldSpec("id", "NUMBER", "event_id"),), stores=(StoreSpec("ids"),))
    got = {"table": {}, "kafka": [], "ids": []}
    writers = {"table": lambda rows, n: got["table"].update({r.name: r.n for r in rows.collect()}), "kafka": lambda rows, n: got["kafka"].append(rows.count()), "ids": lambda rows, n: got["ids"].extend(r.id for r in rows.collect())}
    with pytest.raises(SpecError):
        RunningGraph([node], {}, {}, str(tmp_path))
    graph = RunningGraph([node, plain], {10: table_stream(spark, folder, "events", 1)}, writers, f"{tmp_path}/checkpoints", {5: (spec, dim)})
    assert {p.name for n in graph.nodes for p in parts_of(n)} == {"node-1-full-0", "node-1-delta-0", "node-2-full-0"}
    graph.start().drain()
    n = events.count()
    assert sum(got["table"].values()) == n == sum(got["kafka"]) == len(got["ids"]) and set(got["table"]) == {"v1-0", "v1-1"}
    users["v"] = 2
    assert graph.reload([5]) == {1}
    events.limit(7).write.mode("append").parquet(f"{folder}/events.parquet")
    graph.drain()
    assert sum(got["table"][k] for k in ("v2-0", "v2-1") if k in got["table"]) == 7 and len(got["ids"]) == n + 7
    only = NodeSpec(2, "ids", (InputSpec(1, 10, filter="event_id < 3"),), plain.fields, stores=plain.stores)
    assert graph.edit([node, only]) == {2}
    events.filter("event_id < 9").write.mode("append").parquet(f"{folder}/events.parquet")
    graph.drain()
    assert len(got["ids"]) == n + 7 + events.filter("event_id < 3").count()
    graph.stop()
    assert not graph.queries


def test_lag_of_partitions(spark):
    got = source_lag(spark, [("k", '{"t": {"0": 5, "1": 7}}', '{"t": {"0": 9, "1": 7}}'), ("files", '{"logOffset": 3}', None), ("new", None, None), ("k2", '{"t": {"0": 5}}', None)])
    assert sorted(map(tuple, got.collect()), key=str) == [("k", "t", 0, 5, 9, 4), ("k", "t", 1, 7, 7, 0), ("k2", "t", 0, 5, None, None)]


def test_restart_goes_on_and_progress_is_reported(spark, tmp_path):
    folder, events = several_files(spark, tmp_path)
    counts = []
    for k in range(2):
        query = start(table_stream(spark, folder, "events", 1).select("event_id"), lambda rows, batch: counts.append(rows.count()), str(tmp_path / "checkpoint"), "append")
        query.awaitTermination()
        if k == 0:
            seen = progress(spark, query).collect()
            assert sorted({r.batch for r in seen}) == [0, 1, 2] and sum(r.rows for r in seen) == events.count()
    assert sum(counts) == events.count()


def test_run_summary(spark):
    log = spark.createDataFrame([("a", 5), ("a", 1), ("b", 2)], "node string, ms long")
    assert sorted(map(tuple, run_summary(log, ["node"], "ms").collect())) == [("a", 2, 6, 1, 5), ("b", 1, 2, 2, 2)]
