from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.macros import expand_macros, macro_value
from millrace.functions.scalar import FunctionRegistry
from millrace.functions.types import digit_prefix_double, digit_prefix_long, kind, scale, spark_type, truthy, typed


@pytest.mark.parametrize(
    "declared, expected",
    [("VARCHAR", "VARCHAR"), ("INT", "VARCHAR"), ("NUMBER", "NUMBER"), ("NUMBER(3)", "DECIMAL"), ("DATE", "DATE"), ("TIME_LONG", "DATE"), ("TIME_STR(yyyy)", "DATE"), (" number ", "NUMBER")],
)
def test_kinds(declared, expected):
    assert kind(declared) == expected


def test_scale_and_types():
    assert scale("NUMBER(4)") == 4
    assert scale("NUMBER(x)") == 6
    assert spark_type("NUMBER(2)").simpleString() == "double"
    assert spark_type("TIME_LONG").simpleString() == "timestamp"


def test_typed_values_and_defaults(spark):
    df = spark.createDataFrame([("12",), ("-5",), ("3.9",), ("x",), ("",), (None,)], "t string")
    got = df.select(typed(F.col("t"), "NUMBER"), typed(F.col("t"), "NUMBER(1)"), typed(F.col("t"), "VARCHAR"), F.unix_seconds(typed(F.col("t"), "DATE"))).collect()
    assert [tuple(r)[:3] for r in got] == [(12, 12.0, "12"), (-5, -5.0, "-5"), (3, 3.9, "3.9"), (0, 0.0, "x"), (0, 0.0, ""), (0, 0.0, "")]
    assert got[3][3] == got[5][3] == 0


def test_truthiness(spark):
    df = spark.createDataFrame([(True, 1, 1e-5, "a"), (False, 0, 1e-7, "  "), (None, -1, None, None)], "b boolean, n int, d double, s string")
    got = df.select(*(truthy(F.col(f.name), f.dataType).alias(f.name) for f in df.schema)).collect()
    assert [tuple(r) for r in got] == [(True,) * 4, (False,) * 4, (False,) * 4]


def test_digit_prefix(spark):
    df = spark.createDataFrame([("2353.64364a",), ("a1",), ("",), (None,), ("-7x",)], "t string")
    got = [tuple(r) for r in df.select(digit_prefix_long(F.col("t")), digit_prefix_double(F.col("t"))).collect()]
    assert got == [(2353, 2353.64364), (None, None), (None, None), (None, None), (-7, -7.0)]


def test_macros():
    now = datetime(2024, 12, 31, 4, 5, 6)
    assert macro_value("N_M", now) == "12" and macro_value("N_YYYYMMDDN", now) == "20250101" and macro_value("N_YYYYMMN", now) == "202501"
    assert macro_value("N_YYYYMMP", datetime(2024, 1, 9)) == "202312" and macro_value("N_D", datetime(2024, 1, 9)) == "9"
    assert macro_value("NO_SUCH", now) is None
    assert expand_macros("t_eval(N_YYYYMM) eval(x) {JOIN_TABLE}", now, "a") == "t_202412 eval(x) a"


def test_registry(spark):
    functions = FunctionRegistry()
    functions.register("twice", lambda a: F.concat(a, a))
    functions.register_python("size", lambda a: None if a is None else str(len(a)))
    df = spark.createDataFrame([("ab", 12), (None, None)], "a string, b int")
    got = df.select(functions.call("twice", F.col("b")), functions.call("size", F.col("a")), functions.call("reverse", F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("1212", "2", "ba21"), (None, None, "")]
    with pytest.raises(KeyError):
        functions.call("none", F.col("a"))
    with pytest.raises(ValueError):
        functions.register("twice", lambda a: a)
