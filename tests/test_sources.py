import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.plans.specs import PushSpec, SpecError, StoreSpec
from millrace.sources.readers import kafka_options
from millrace.sources.records import decode_columns, decode_records, encode_columns, encode_records
from millrace.sources.sinks import deliver, filtered, key_text, newest_rows, partition_of, push_options, pushed, stored

KINDS = ["NUMBER", "VARCHAR", "DECIMAL", "DATE"]


def encode_row(row, kinds):
    return encode_columns([pa.array([v]) for v in row], kinds)[0].as_py()


def decode_row(data, kinds):
    """Between other records, which must not be read into it."""
    columns = decode_columns(pa.array([b"\x7f" * 40, data, None, b"\x7f" * 9], pa.binary()), kinds)
    return [c[1].as_py() for c in columns]


def test_record_format():
    data = encode_row((-7, "abc", 1.5, 0), KINDS)
    assert len(data) == 31 and data == struct.pack(">qi3sdq", -7, 3, b"abc", 1.5, 0)
    assert decode_row(data, KINDS) == [-7, "abc", 1.5, 0]
    assert decode_row(data[:15], KINDS) == [-7, "abc", 0.0, 0]
    assert decode_row(struct.pack(">qi", 1, 99) + b"ab", KINDS) == [1, "", 0.0, 0]
    assert decode_row(struct.pack(">qi", 1, -1) + b"ab", KINDS)[:2] == [1, ""]
    assert decode_row(b"", KINDS) == [0, "", 0.0, 0]
    assert decode_row(encode_row((1, "größe ☃", 0.0, 1), KINDS), KINDS)[1] == "größe ☃"


def test_odd_bytes_become_replacement_characters():
    columns = decode_columns(pa.array([struct.pack(">i", 2) + b"\xff\xfe", struct.pack(">i", 1) + b"a"], pa.binary()), ["VARCHAR"])
    assert columns[0].to_pylist() == ["\ufffd\ufffd", "a"]


def test_records_of_rows(spark):
    layout = [("a", "NUMBER"), ("b", "VARCHAR"), ("c", "NUMBER(2)"), ("d", "DATE")]
    df = spark.sql("SELECT * FROM VALUES (1, 'x', 2.5D, timestamp_millis(1500)), (NULL, NULL, NULL, NULL), (3, '', -0.5D, timestamp_millis(-1)) AS t(a, b, c, d)")
    back = decode_records(encode_records(df, layout, ["a"]).withColumnRenamed("a", "kept"), layout, keep=["kept"])
    got = sorted(map(tuple, back.select("kept", "a", "b", "c", F.unix_millis("d")).collect()), key=str)
    assert got == [(1, 1, "x", 2.5, 1500), (3, 3, "", -0.5, -1), (None, 0, "", 0.0, 0)]
    assert encode_records(df.limit(0), layout).count() == 0
    assert decode_records(spark.createDataFrame([(None,)], "value binary"), layout).first().b == ""


def test_stores_are_independent(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b"), (3, 0.0, None)], "id int, v double, s string")
    assert [r.id for r in filtered(df, "v").collect()] == [1]
    assert [r.id for r in filtered(df, "s").collect()] == [1, 2]
    assert filtered(df, None).count() == 3
    assert stored(df, StoreSpec("t", {"id": "key"}, "v > 1")).collect()[0].asDict() == {"key": 1}
    assert stored(df, StoreSpec("t")).columns == ["id", "v", "s"]
    with pytest.raises(SpecError):
        stored(df, StoreSpec("t", {"none": "x"}))
    taken = {}
    writers = {"bad": lambda rows, batch: 1 / 0, "good": lambda rows, batch: taken.update({batch: rows.count()}), "call": lambda rows, batch: taken.update(push=rows.first().key)}
    with pytest.raises(RuntimeError):
        deliver(df, 7, [StoreSpec("bad"), StoreSpec("good", filter="v > 1")], [PushSpec("call", "x", "id = 3", key_kind="long", key=("id",))], writers)
    assert taken == {7: 1, "push": "3"}
    with pytest.raises(SpecError):
        deliver(df, 0, [StoreSpec("nowhere")], [], writers)


def test_keys_and_partitions(spark):
    df = spark.createDataFrame([(5, "n-12"), (-1, "none"), (None, None)], "n bigint, s string")
    got = df.select(key_text(["n", "s"]).alias("k"), partition_of(F.col("n"), "bigint", 4).alias("a"), partition_of(F.col("s"), "string", 5).alias("b")).collect()
    assert [r.k for r in got] == ["5:n-12", "-1:none", ":"]
    assert [r.a for r in got] == [1, 3, None] and got[0].b == 2 and 0 <= got[1].b < 5
    assert pushed(df, PushSpec("kafka", "t", key=("n",))).count() == 3
    for bad in (PushSpec("kafka", "t", key_kind="long"), PushSpec("kafka", "t", key_kind="odd")):
        with pytest.raises(SpecError):
            pushed(df, bad)
    assert push_options(PushSpec("kafka", "t", options={"acks": "1", "compression": "gzip"})) == {"topic": "t", "kafka.acks": "1", "kafka.compression.type": "gzip"}


def test_stream_options():
    assert kafka_options("h:1", "t") == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "latest"}
    assert kafka_options("h:1", "t", {"start": "1700000000000", "max_pending": "5", "kafka.x": "y"})["startingTimestamp"] == "1700000000000"
    for bad in ({"start": "middle"}, {"odd": "1"}):
        with pytest.raises(ValueError):
            kafka_options("h:1", "t", bad)


def test_newest_rows(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (2, "c", 1)], "k int, v string, batch long")
    assert sorted(map(tuple, newest_rows(df, ["k"]).collect())) == [(1, "b"), (2, "c")]
