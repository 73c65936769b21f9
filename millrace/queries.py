"""Queries over the driver's tables, one for each operator; oracle.py has the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.macros import macro_value
from .functions.scalar import FunctionRegistry, capture, date_to_string, reverse_pair, to_long
from .functions.types import digit_prefix_double, digit_prefix_long, truthy, typed
from .operators.aggregate import Measure, aggregate, aggregate_inputs, deltas, running
from .operators.dedup import bucket_start, contains, first_in_bucket, seen_before
from .operators.lookup import lookup_chain, lookup_join
from .operators.merge import merge_latest, union_inputs
from .plans.build import Context, build_graph
from .plans.specs import FieldSpec, InputSpec, JoinSpec, LookupSpec, NodeSpec, PushSpec, StoreSpec
from .sources.readers import shared_folder, sharded_query, table, table_stream
from .sources.records import decode_records, decode_texts, encode_records
from .sources.sinks import filtered, folder_writer, key_text, newest_rows, partition_of, pushed, stored
from .streaming.graph import RunningGraph
from .streaming.run import drained, first_in_bucket_stream, run_summary, running_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Order of arrival of the event stream.
ARRIVAL = ["ts", "event_id"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def only(nodes: list[NodeSpec], context: Context, node: int, delta: bool = False) -> DataFrame:
    found = build_graph(nodes, context)[node]
    return found.delta if delta else found.full


PRICING = NodeSpec(
    1,
    "pricing",
    (InputSpec(1, 10),),
    (
        FieldSpec("l_returnflag", "VARCHAR", "l_returnflag", key=True),
        FieldSpec("l_linestatus", "VARCHAR", "l_linestatus", key=True),
        FieldSpec("sum_qty", "NUMBER(2)", "l_quantity", "SUM"),
        FieldSpec("revenue", "NUMBER(4)", "l_extendedprice * (1 - l_discount)", "SUM"),
        FieldSpec("least_price", "NUMBER(2)", "l_extendedprice", "MIN"),
        FieldSpec("greatest_line", "NUMBER", "l_linenumber", "MAX"),
        FieldSpec("mean_discount", "NUMBER(2)", "l_discount", "AVG"),
        FieldSpec("lines", "NUMBER", method="COUNT"),
    ),
)


@query
def agg_all_methods(spark: SparkSession, d: str) -> DataFrame:
    return only([PRICING], Context({10: table(spark, d, "lineitem")}), 1)


@query
def agg_first_last(spark: SparkSession, d: str) -> DataFrame:
    measures = [Measure("first_value", "FIRST", "value", "NUMBER(2)"), Measure("last_value", "LAST", "value", "NUMBER(2)"), Measure("last_type", "LAST", "event_type", "VARCHAR")]
    return aggregate(table(spark, d, "events"), ["user_id"], measures, ARRIVAL)


@query
def agg_sum_string(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "events"), ["user_id"], [Measure("types", "SUM", "event_type", "VARCHAR")], ARRIVAL)


@query
def agg_sum_date(spark: SparkSession, d: str) -> DataFrame:
    return aggregate(table(spark, d, "events"), ["user_id"], [Measure("times", "SUM", "ts", "DATE")], ARRIVAL)


@query
def agg_avg_date(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate(table(spark, d, "events"), ["user_id"], [Measure("mean_ts", "AVG", "ts", "DATE")])
    return out.select("user_id", F.unix_seconds("mean_ts").alias("mean_seconds"))


@query
def agg_minmax_string_date(spark: SparkSession, d: str) -> DataFrame:
    measures = [Measure("least_type", "MIN", "event_type", "VARCHAR"), Measure("greatest_type", "MAX", "event_type", "VARCHAR"), Measure("first_ts", "MIN", "ts", "DATE"), Measure("last_ts", "MAX", "ts", "DATE")]
    out = aggregate(table(spark, d, "events"), ["user_id"], measures)
    return out.select("user_id", "least_type", "greatest_type", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"))


@query
def agg_running(spark: SparkSession, d: str) -> DataFrame:
    measures = [Measure("n", "COUNT"), Measure("total", "SUM", "value", "NUMBER(2)"), Measure("mean", "AVG", "value", "NUMBER(2)"), Measure("least", "MIN", "value", "NUMBER(2)"), Measure("greatest", "MAX", "value", "NUMBER(2)"), Measure("first_type", "FIRST", "event_type", "VARCHAR")]
    out = running(table(spark, d, "events"), ["user_id"], measures, ARRIVAL, F.date_trunc("day", "ts"))
    return out.select("event_id", "user_id", "n", "total", "mean", "least", "greatest", "first_type")


@query
def agg_delta(spark: SparkSession, d: str) -> DataFrame:
    return deltas(table(spark, d, "events"), ["user_id"], [Measure("n", "COUNT"), Measure("total", "SUM", "value", "NUMBER(2)")], ["event_id"])


@query
def agg_null_zero(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "customer").filter("c_acctbal > 0")
    joined = table(spark, d, "orders").join(some, F.col("o_custkey") == F.col("c_custkey"), "left")
    measures = [Measure("n", "COUNT"), Measure("least_balance", "MIN", "c_acctbal", "NUMBER(2)"), Measure("mean_balance", "AVG", "c_acctbal", "NUMBER(2)"), Measure("greatest_segment", "MAX", "c_mktsegment", "VARCHAR"), Measure("least_segment", "MIN", "c_mktsegment", "VARCHAR")]
    return aggregate(joined, ["o_orderpriority"], measures)


@query
def agg_null_sql(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "customer").filter("c_acctbal > 0")
    joined = table(spark, d, "orders").join(some, F.col("o_custkey") == F.col("c_custkey"), "left")
    measures = [Measure("n", "COUNT", "c_acctbal"), Measure("least_balance", "MIN", "c_acctbal", "NUMBER(2)"), Measure("mean_balance", "AVG", "c_acctbal", "NUMBER(2)")]
    return aggregate(joined, ["o_orderpriority"], measures, null_policy="sql")


def _projected(spark: SparkSession, d: str, source: str, *fields: FieldSpec) -> DataFrame:
    node = NodeSpec(1, "projection", (InputSpec(1, 10),), fields)
    return only([node], Context({10: table(spark, d, source)}), 1)


@query
def project_constant(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, "nation", FieldSpec("n_nationkey", "NUMBER", "n_nationkey"), FieldSpec("one", "NUMBER", "1"), FieldSpec("word", "VARCHAR", "'a.b'"), FieldSpec("half", "NUMBER(1)", "0.5D"), FieldSpec("yes", "VARCHAR", "true"))


@query
def project_field(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, "lineitem", FieldSpec("okey", "NUMBER", "l_orderkey"), FieldSpec("line", "NUMBER", "l_linenumber"), FieldSpec("flag", "VARCHAR", "l_returnflag"), FieldSpec("price", "NUMBER(2)", "l_extendedprice"))


@query
def project_expr(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, "lineitem", FieldSpec("okey", "NUMBER", "l_orderkey"), FieldSpec("line", "NUMBER", "l_linenumber"), FieldSpec("net", "NUMBER(4)", "round(l_extendedprice * (1 - l_discount), 4)"), FieldSpec("big", "VARCHAR", "if(l_quantity > 25, 'big', 'small')"))


@query
def expr_logical(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", ((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "O")).alias("both"), ((F.col("o_totalprice") > 300000) | ~(F.col("o_orderpriority") < "3")).alias("either"))


@query
def expr_arith_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus || ',' || o_custkey AS joined", "o_custkey * 2 - (o_orderkey + 1) AS number")


@query
def expr_regex_ternary(spark: SparkSession, d: str) -> DataFrame:
    props = F.coalesce(F.col("props"), F.lit(""))
    return table(spark, d, "events").select("event_id", capture(props, r'"(\w+)":\s*(\d+)', 2, F.lit("unknown")).alias("captured"), F.reverse(props).alias("reversed"))


@query
def expr_reverse2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", reverse_pair(F.col("event_type"), F.col("props")).alias("both"))


@query
def expr_date_to_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", date_to_string(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("text"), to_long(date_to_string(F.col("ts"), "yyyyMMdd")).alias("day"))


@query
def expr_long(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (to_long(F.regexp_extract("props", r"(\d+)", 1)) - 1).alias("number"), to_long(F.col("event_type")).alias("none"))


@query
def expr_digit_prefix(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.regexp_extract("props", r"(\d+)", 1), F.lit(".64364a"))
    return table(spark, d, "events").select("event_id", digit_prefix_long(text).alias("whole"), digit_prefix_double(text).alias("number"), digit_prefix_long(F.col("event_type")).alias("none"))


@query
def expr_truthy_filter(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    value = F.col("value") - 50
    return events.filter(truthy(value, "double") & truthy(F.col("event_type"), "string") & truthy(F.col("user_id"), "bigint")).select("event_id")


@query
def class_udf(spark: SparkSession, d: str) -> DataFrame:
    functions = FunctionRegistry()
    functions.register_python("swap", lambda a, b: f"{(b or '')[::-1]}{(a or '')[::-1]}")
    node = NodeSpec(1, "classes", (InputSpec(1, 10),), (FieldSpec("event_id", "NUMBER", "event_id"), FieldSpec("built_in", "VARCHAR", "class:reverse:event_type,user_id"), FieldSpec("python", "VARCHAR", "class:swap:event_type,user_id")))
    return only([node], Context({10: table(spark, d, "events")}, functions=functions), 1)


@query
def macro_dates(spark: SparkSession, d: str) -> DataFrame:
    now = datetime(2024, 1, 31, 4, 5, 6)
    names = ["N_YYYY", "N_YY", "N_MM", "N_M", "N_DD", "N_D", "N_HH", "N_MI", "N_SS", "N_YYYYMMDD", "N_YYYYMM", "N_YYYYMMP", "N_YYYYMMDDN", "N_YYYYMMN", "N_YYYYMMDDP"]
    return table(spark, d, "region").select("r_regionkey", *(F.lit(macro_value(n, now)).alias(n.lower()) for n in names))


def _order_node(**more) -> NodeSpec:
    fields = (FieldSpec("o_custkey", "NUMBER", "o_custkey", key=True), FieldSpec("orders", "NUMBER", method="COUNT"), FieldSpec("spent", "NUMBER(2)", "o_totalprice", "SUM"))
    return NodeSpec(1, "orders", (InputSpec(1, 10, filter=more.pop("input_filter", None)),), fields, **more)


@query
def filter_input(spark: SparkSession, d: str) -> DataFrame:
    return only([_order_node(input_filter="o_orderstatus = 'F'")], Context({10: table(spark, d, "orders")}), 1)


@query
def filter_output(spark: SparkSession, d: str) -> DataFrame:
    return only([_order_node(output_filter="orders > 10")], Context({10: table(spark, d, "orders")}), 1)


@query
def filter_store(spark: SparkSession, d: str) -> DataFrame:
    full = only([_order_node()], Context({10: table(spark, d, "orders")}), 1)
    return stored(full, StoreSpec("big", {"o_custkey": "customer", "spent": "spent"}, "spent - 1500000"))


@query
def filter_push(spark: SparkSession, d: str) -> DataFrame:
    rows = only([_order_node()], Context({10: table(spark, d, "orders")}), 1, delta=True)
    return filtered(rows, "spent > 400000")


@query
def push_keys(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    by_long = pushed(nation, PushSpec("kafka", "t", key_kind="long", key=("n_nationkey",))).select(F.lit("long").alias("kind"), "key", F.get_json_object("value", "$.n_name").alias("name"))
    by_text = pushed(nation, PushSpec("kafka", "t", "n_regionkey > 1", key_kind="text", key=("n_regionkey", "n_name"))).select(F.lit("text").alias("kind"), "key", F.get_json_object("value", "$.n_name").alias("name"))
    return by_long.unionByName(by_text)


@query
def sink_mapping(spark: SparkSession, d: str) -> DataFrame:
    return stored(table(spark, d, "orders"), StoreSpec("t", {"o_orderkey": "id", "o_orderstatus": "status", "o_totalprice": "price"}))


@query
def sink_key_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", key_text(["o_custkey", "o_orderstatus", F.lit(None)]).alias("key"))


@query
def sink_partition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", partition_of(F.col("o_custkey"), "bigint", 7).alias("by_number"), partition_of(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")), "string", 7).alias("by_text"))


@query
def coerce_types(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_extract("props", r"(\d+)", 1)
    events = table(spark, d, "events")
    return events.select("event_id", typed(text, "NUMBER").alias("number"), typed(F.col("event_type"), "NUMBER").alias("no_number"), typed(F.concat(F.lit("-"), text, F.lit(".5")), "NUMBER").alias("cut"), typed(text, "NUMBER(1)").alias("fraction"), typed(F.when(F.col("user_id") > 50, F.col("event_type")), "VARCHAR").alias("text"), F.unix_seconds(typed(F.col("event_type"), "DATE")).alias("no_date"), typed(F.col("value"), "INT").substr(1, 2).alias("other"))


@query
def lookup_memory(spark: SparkSession, d: str) -> DataFrame:
    # Keys of parts go beyond those of customers, so some find none.
    return lookup_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, d, "customer"), {"l_partkey": "c_custkey"}, {"segment": "c_mktsegment", "balance": "c_acctbal", "nation": "c_nationkey"}, {"segment": "VARCHAR", "balance": "NUMBER(2)", "nation": "NUMBER"})


@query
def lookup_store_composite_key(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    last = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    found = lookup_join(lines.select("l_orderkey", "l_linenumber").distinct(), lines, {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"}, {"part": "l_partkey", "price": "l_extendedprice"}, order=last)
    return found


@query
def lookup_chain_snowflake(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    return lookup_chain(
        t("orders").select("o_orderkey", "o_custkey"),
        [
            (t("customer"), {"o_custkey": "c_custkey"}, {"nation_key": "c_nationkey"}, {}),
            (t("nation").filter("n_nationkey <> 3"), {"nation_key": "n_nationkey"}, {"nation": "n_name", "region_key": "n_regionkey"}, {"nation": "VARCHAR"}),
            (t("region"), {"region_key": "r_regionkey"}, {"region": "r_name"}, {"region": "VARCHAR"}),
        ],
    ).select("o_orderkey", "nation", "region")


@query
def lookup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return lookup_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), events, {"o_custkey": "user_id"}, {"last_type": "event_type", "last_value": "value"}, {"last_type": "VARCHAR", "last_value": "NUMBER(2)"}, ARRIVAL, "event_type <> 'view'")


@query
def lookup_group_by_joined(spark: SparkSession, d: str) -> DataFrame:
    customer = LookupSpec(5, "customer", (("c_custkey",),), {"c_mktsegment": "VARCHAR"})
    node = NodeSpec(
        1, "by_segment", (InputSpec(1, 10),),
        (FieldSpec("segment", "VARCHAR", "segment", key=True), FieldSpec("orders", "NUMBER", method="COUNT"), FieldSpec("spent", "NUMBER(2)", "o_totalprice", "SUM")),
        (JoinSpec(5, {"o_custkey": "c_custkey"}, {"segment": "c_mktsegment"}),),
    )
    return only([node], Context({10: table(spark, d, "orders")}, {5: (customer, table(spark, d, "customer"))}), 1)


@query
def lookup_sharded_union(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    for status in "FOP":
        orders.filter(F.col("o_orderstatus") == status).createOrReplaceTempView(f"orders_{status.lower()}")
    return sharded_query(spark, "SELECT o_orderkey, o_orderstatus, o_custkey FROM {JOIN_TABLE}", ["orders_f", "orders_o", "orders_p"])


def _multi(spark: SparkSession, d: str, *fields: FieldSpec, **more) -> DataFrame:
    node = NodeSpec(1, "meeting", (InputSpec(1, 10), InputSpec(2, 11)), (FieldSpec("person", "NUMBER", "1:o_custkey;2:user_id", key=True), *fields), **more)
    return only([node], Context({10: table(spark, d, "orders"), 11: table(spark, d, "events")}), 1)


@query
def multi_group(spark: SparkSession, d: str) -> DataFrame:
    return _multi(spark, d, FieldSpec("spent", "NUMBER(2)", "o_totalprice", "SUM"), FieldSpec("greatest_order", "NUMBER", "o_orderkey", "MAX"), FieldSpec("mean_value", "NUMBER(2)", "value", "AVG"), FieldSpec("least_type", "VARCHAR", "event_type", "MIN"))


@query
def multi_count_per_input(spark: SparkSession, d: str) -> DataFrame:
    return _multi(spark, d, FieldSpec("orders", "NUMBER", "o_orderkey", "COUNT"), FieldSpec("events", "NUMBER", "event_id", "COUNT"), FieldSpec("rows", "NUMBER", "1", "COUNT"))


def _meeting(spark: SparkSession, d: str) -> list:
    orders, events = table(spark, d, "orders"), table(spark, d, "events")
    return [
        (orders, {"person": F.col("o_custkey")}, {"last_price": F.col("o_totalprice"), "last_status": F.col("o_orderstatus")}, ["o_orderdate", "o_orderkey"]),
        (events, {"person": F.col("user_id")}, {"last_value": F.col("value"), "last_type": F.col("event_type")}, ARRIVAL),
    ]


@query
def multi_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge_latest(_meeting(spark, d))


def _merging(**more) -> NodeSpec:
    """Newest order and newest event of a person; the texts hold names of columns as plain words."""
    fields = (
        FieldSpec("person", "NUMBER", "1:o_custkey;2:user_id", key=True),
        FieldSpec("last_price", "NUMBER(2)", "o_totalprice"),
        FieldSpec("last_type", "VARCHAR", "event_type"),
        FieldSpec("both", "NUMBER(2)", "o_totalprice + value"),
        FieldSpec("text", "VARCHAR", "concat(o_orderstatus, ' value of ', event_type)"),
        FieldSpec("renamed", "VARCHAR", "concat(a, ':', b)", variables={"a": (0, 10, "o_orderpriority"), "b": (0, 11, "event_type")}),
    )
    return NodeSpec(1, "meeting", (InputSpec(1, 10), InputSpec(2, 11)), fields, arrival_order=("at", "number"), **more)


def _arriving(orders: DataFrame, events: DataFrame) -> Context:
    return Context({10: orders.withColumns({"at": F.col("o_orderdate").cast("timestamp"), "number": F.col("o_orderkey")}), 11: events.withColumns({"at": F.col("ts").cast("timestamp"), "number": F.col("event_id")})})


@query
def multi_deferred_expr(spark: SparkSession, d: str) -> DataFrame:
    return only([_merging()], _arriving(table(spark, d, "orders"), table(spark, d, "events")), 1)


@query
def stream_multi_merge(spark: SparkSession, d: str) -> DataFrame:
    return drained(only([_merging()], _arriving(table_stream(spark, d, "orders"), table_stream(spark, d, "events")), 1), ["person"])


@query
def project_variables(spark: SparkSession, d: str) -> DataFrame:
    customer = LookupSpec(5, "customer", (("c_custkey",),), {"segment": "VARCHAR"})
    text = FieldSpec("text", "VARCHAR", "concat(status, ' status ', segment, n)", variables={"status": (0, 10, "o_orderstatus"), "segment": (2, 5, "c_mktsegment"), "n": (0, 10, "o_custkey")})
    node = NodeSpec(1, "variables", (InputSpec(1, 10),), (FieldSpec("o_orderkey", "NUMBER", "o_orderkey"), text), (JoinSpec(5, {"o_custkey": "c_custkey"}, {"kind": "c_mktsegment"}),))
    return only([node], Context({10: table(spark, d, "orders")}, {5: (customer, table(spark, d, "customer"))}), 1)


@query
def multi_union_disjoint(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("place"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("above"))
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("name"))
    return union_inputs([nation, region])


def _deduped(spark: SparkSession, d: str, rule: str) -> DataFrame:
    found = first_in_bucket(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", ARRIVAL, rule)
    return found.select("event_id", "user_id", "event_type", F.unix_seconds("bucket").alias("bucket_seconds"))


@query
def dedup_minute30(spark: SparkSession, d: str) -> DataFrame:
    return _deduped(spark, d, "1:30")


@query
def dedup_hour(spark: SparkSession, d: str) -> DataFrame:
    return _deduped(spark, d, "2:1")


@query
def dedup_day(spark: SparkSession, d: str) -> DataFrame:
    return _deduped(spark, d, "3:1")


@query
def dedup_membership(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return contains(events.filter("event_type = 'click'"), events.filter("event_type = 'purchase'"), ["user_id"], "ts", "3:1").select("event_id", "user_id")


@query
def dedup_seen_flag(spark: SparkSession, d: str) -> DataFrame:
    return seen_before(table(spark, d, "events"), ["user_id", "event_type"], "ts", ARRIVAL, "3:1").select("event_id", "seen")


PER_ORDER = NodeSpec(1, "per_order", (InputSpec(1, 10),), (FieldSpec("okey", "NUMBER", "l_orderkey", key=True), FieldSpec("lines", "NUMBER", method="COUNT"), FieldSpec("qty", "NUMBER(2)", "l_quantity", "SUM")))


@query
def chain_full(spark: SparkSession, d: str) -> DataFrame:
    above = NodeSpec(2, "per_count", (InputSpec(1, 1, from_node=True),), (FieldSpec("lines", "NUMBER", "lines", key=True), FieldSpec("orders", "NUMBER", method="COUNT"), FieldSpec("qty", "NUMBER(2)", "qty", "SUM")))
    return only([above, PER_ORDER], Context({10: table(spark, d, "lineitem")}), 2)


@query
def chain_delta(spark: SparkSession, d: str) -> DataFrame:
    above = NodeSpec(2, "totals", (InputSpec(1, 1, from_node=True, delta=True),), (FieldSpec("lines", "NUMBER", "lines", key=True), FieldSpec("rows", "NUMBER", method="COUNT"), FieldSpec("qty", "NUMBER(2)", "qty", "SUM")))
    return only([PER_ORDER, above], Context({10: table(spark, d, "lineitem")}), 2)


@query
def fanout_two_consumers(spark: SparkSession, d: str) -> DataFrame:
    one = NodeSpec(2, "by_type", (InputSpec(1, 10),), (FieldSpec("user_id", "NUMBER", "user_id", key=True), FieldSpec("events", "NUMBER", method="COUNT")))
    two = NodeSpec(3, "by_value", (InputSpec(1, 10),), (FieldSpec("user_id", "NUMBER", "user_id", key=True), FieldSpec("greatest", "NUMBER(2)", "value", "MAX")))
    both = NodeSpec(4, "both", (InputSpec(1, 2, from_node=True), InputSpec(2, 3, from_node=True)), (FieldSpec("person", "NUMBER", "1:user_id;2:user_id", key=True), FieldSpec("events", "NUMBER", "events", "MAX"), FieldSpec("greatest", "NUMBER(2)", "greatest", "MAX")))
    return only([both, one, two], Context({10: table(spark, d, "events")}), 4)


@query
def wire_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    layout = [("event_id", "NUMBER"), ("event_type", "VARCHAR"), ("value", "NUMBER(2)"), ("ts", "DATE"), ("props", "VARCHAR")]
    back = decode_records(encode_records(table(spark, d, "events"), layout), layout)
    return back.select("event_id", "event_type", "value", F.unix_millis("ts").alias("ms"), "props")


@query
def text_scheme(spark: SparkSession, d: str) -> DataFrame:
    return decode_texts(table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("value")))


@query
def run_log_summary(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("event_type", (F.col("event_id") % 97).alias("elapsed"))
    return run_summary(log, ["event_type"], "elapsed")


@query
def stream_agg(spark: SparkSession, d: str) -> DataFrame:
    measures = [Measure("n", "COUNT"), Measure("total", "SUM", "value", "NUMBER(2)"), Measure("greatest", "MAX", "value", "NUMBER(2)"), Measure("last_type", "LAST", "event_type", "VARCHAR")]
    return drained(aggregate(table_stream(spark, d, "events"), ["user_id"], measures, ARRIVAL), ["user_id"])


@query
def stream_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = lookup_join(table_stream(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, d, "customer"), {"l_partkey": "c_custkey"}, {"segment": "c_mktsegment"}, {"segment": "VARCHAR"})
    return drained(found, mode="append")


@query
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = drained(first_in_bucket_stream(table_stream(spark, d, "events"), ["user_id", "event_type"], "ts"), mode="append")
    return found.select(F.unix_seconds("bucket").alias("bucket_seconds"), "user_id", "event_type")


def _meeting_node() -> NodeSpec:
    return NodeSpec(1, "meeting", (InputSpec(1, 10), InputSpec(2, 11)), (FieldSpec("person", "NUMBER", "1:o_custkey;2:user_id", key=True), FieldSpec("spent", "NUMBER(2)", "o_totalprice", "SUM"), FieldSpec("orders", "NUMBER", "o_orderkey", "COUNT"), FieldSpec("events", "NUMBER", "event_id", "COUNT"), FieldSpec("total_value", "NUMBER(2)", "value", "SUM")))


@query
def stream_multi_group(spark: SparkSession, d: str) -> DataFrame:
    return drained(only([_meeting_node()], Context({10: table_stream(spark, d, "orders"), 11: table_stream(spark, d, "events")}), 1), ["person"])


@query
def stream_running(spark: SparkSession, d: str) -> DataFrame:
    measures = [Measure("n", "COUNT"), Measure("total", "SUM", "value", "NUMBER(2)"), Measure("mean", "AVG", "value", "NUMBER(2)"), Measure("least", "MIN", "value", "NUMBER(2)"), Measure("greatest", "MAX", "value", "NUMBER(2)"), Measure("first_type", "FIRST", "event_type", "VARCHAR"), Measure("last_type", "LAST", "event_type", "VARCHAR")]
    out = drained(running_stream(table_stream(spark, d, "events"), ["user_id"], ARRIVAL, measures), mode="append")
    return out.select("event_id", "user_id", *(m.name for m in measures))


def _delivered(spark: SparkSession, d: str, delta: bool) -> DataFrame:
    """Orders of customers, run as a graph of continuous queries with a store and a push; what these got."""
    node = NodeSpec(
        1, "orders", (InputSpec(1, 10),),
        (FieldSpec("segment", "VARCHAR", "segment", key=True), FieldSpec("orders", "NUMBER", method="COUNT"), FieldSpec("spent", "NUMBER(2)", "o_totalprice", "SUM")),
        (JoinSpec(5, {"o_custkey": "c_custkey"}, {"segment": "c_mktsegment"}),),
        stores=(StoreSpec("table", {"segment": "name", "orders": "n", "spent": "spent"}, key=("name",)),),
        pushes=(PushSpec("kafka", "topic", delta=True, key_kind="text", key=("segment",)),),
    )
    folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    writers = {"table": folder_writer(f"{folder}/table"), "kafka": folder_writer(f"{folder}/topic")}
    lookups = {5: (LookupSpec(5, "customer", (("c_custkey",),), {"c_mktsegment": "VARCHAR"}), lambda: table(spark, d, "customer"))}
    graph = RunningGraph([node], {10: table_stream(spark, d, "orders")}, writers, f"{folder}/checkpoints", lookups, once=True)
    graph.start().stop()
    if delta:
        got = spark.read.schema("key string, value string, batch long").parquet(f"{folder}/topic")
        return got.groupBy("key").agg(F.count(F.lit(1)).alias("pushed"), F.sum(F.get_json_object("value", "$.orders").cast("long")).alias("ones"))
    return newest_rows(spark.read.schema("name string, n long, spent double, batch long").parquet(f"{folder}/table"), ["name"])


@query
def graph_store(spark: SparkSession, d: str) -> DataFrame:
    return _delivered(spark, d, False)


@query
def graph_push_delta(spark: SparkSession, d: str) -> DataFrame:
    return _delivered(spark, d, True)


@query
def time_bucket(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select("event_id", *(F.unix_seconds(bucket_start(F.col("ts"), r)).alias(n) for r, n in (("1:30", "half_hour"), ("2:6", "six_hours"), ("3:7", "week"))))


@query
def inputs_full_join(spark: SparkSession, d: str) -> DataFrame:
    orders, events, customer = (table(spark, d, n) for n in ("orders", "events", "customer"))
    return aggregate_inputs([(orders, [F.col("o_custkey")], [Measure("orders", "COUNT")]), (events, [F.col("user_id")], [Measure("events", "COUNT")]), (customer, [F.col("c_custkey")], [Measure("balance", "SUM", "c_acctbal", "NUMBER(2)")])], ["person"])
