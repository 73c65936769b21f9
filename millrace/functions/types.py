"""Declared column types, and what nulls and foreign values become under them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest number of digits of exact sums.
DIGITS = 38


def kind(declared: str) -> str:
    """VARCHAR, NUMBER, DECIMAL (that is NUMBER(n)) or DATE; a name that is not known is VARCHAR."""
    name = declared.strip().upper()
    if name == "NUMBER":
        return "NUMBER"
    if name.startswith("NUMBER"):
        return "DECIMAL"
    if name == "DATE" or name.startswith("TIME_"):
        return "DATE"
    return "VARCHAR"


def scale(declared: str) -> int:
    """n of NUMBER(n)."""
    found = re.search(r"\(\s*(\d+)\s*\)", declared)
    return int(found[1]) if found else 6


def spark_type(declared: str) -> T.DataType:
    return {"VARCHAR": T.StringType(), "NUMBER": T.LongType(), "DECIMAL": T.DoubleType(), "DATE": T.TimestampType()}[kind(declared)]


def default(declared: str) -> Column:
    """What a null or a value that can't be read becomes: '', 0, 0.0 or the epoch."""
    return {"VARCHAR": F.lit(""), "NUMBER": F.lit(0).cast("long"), "DECIMAL": F.lit(0.0), "DATE": F.timestamp_seconds(F.lit(0))}[kind(declared)]


def nullable(value: Column, declared: str) -> Column:
    """value as its declared type; null where it is null or can't be read."""
    k = kind(declared)
    if k == "VARCHAR":
        return value.cast("string")
    if k == "NUMBER":
        # Text with a fraction is cut to its whole part.
        return F.coalesce(value.try_cast("bigint"), value.try_cast("decimal(38,6)").try_cast("bigint"))
    if k == "DECIMAL":
        return value.try_cast("double")
    return value.try_cast("timestamp")


def typed(value: Column, declared: str) -> Column:
    """value as its declared type, never null."""
    return F.coalesce(nullable(value, declared), default(declared))


def truthy(value: Column, of: T.DataType | str) -> Column:
    """Booleans as they are; whole numbers above 0; fractions above 1e-6; strings not blank; others if not null."""
    name = of if isinstance(of, str) else of.simpleString()
    if name == "boolean":
        test = value
    elif name in ("tinyint", "smallint", "int", "bigint"):
        test = value > 0
    elif name in ("float", "double") or name.startswith("decimal"):
        test = value > 1e-6
    elif name == "string":
        test = F.trim(value) != ""
    else:
        test = value.isNotNull()
    return F.coalesce(test, F.lit(False))


def digit_prefix_long(text: Column) -> Column:
    """The whole number that a text begins with; null if it begins with none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def digit_prefix_double(text: Column) -> Column:
    """The number that a text begins with; null if it begins with none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")
