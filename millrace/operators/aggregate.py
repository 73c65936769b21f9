"""Keyed aggregation: COUNT, SUM, MIN, MAX, AVG, FIRST and LAST, final, running and per input.

FIRST, LAST and sums of texts or dates need an order of arrival, which a shuffled table has not: the
caller names its columns. Sums and means of NUMBER(n) are added as decimals with n places, so they
come out alike however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import DIGITS, kind, nullable, scale, typed

METHODS = ("COUNT", "MAX", "MIN", "SUM", "AVG", "FIRST", "LAST")
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"


@dataclass(frozen=True)
class Measure:
    """An aggregated column: name, method, Spark SQL text or column (none for COUNT) and declared type."""

    name: str
    method: str
    value: str | Column | None = None
    type: str = "NUMBER"

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"{self.name}: no group method {self.method}")
        if self.value is None and self.method != "COUNT":
            raise ValueError(f"{self.name}: {self.method} needs a value")

    def column(self) -> Column:
        return F.expr(self.value) if isinstance(self.value, str) else self.value


def _value(m: Measure, null_policy: str) -> Column:
    value = typed(m.column(), m.type) if null_policy == "zero" else nullable(m.column(), m.type)
    return F.round(value, scale(m.type)).cast(f"decimal({DIGITS - 10},{scale(m.type)})") if kind(m.type) == "DECIMAL" and m.method in ("SUM", "AVG") else value


def _ordered(m: Measure) -> bool:
    return m.method in ("FIRST", "LAST") or m.method == "SUM" and kind(m.type) in ("VARCHAR", "DATE")


def _need_order(m: Measure, order: Sequence[str | Column]) -> None:
    if not order and _ordered(m):
        raise ValueError(f"{m.name}: {m.method} over {m.type} needs the columns of arrival order")


def aggregate_column(m: Measure, order: Sequence[str] = (), null_policy: str = "zero", where: Column | None = None) -> Column:
    """The aggregate of one measure over the rows of a key, or over those of them that meet a condition."""
    _need_order(m, order)
    only = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    if m.method == "COUNT":
        return F.count(only(F.lit(1) if m.value is None else m.column())).alias(m.name)
    value, k = only(_value(m, null_policy)), kind(m.type)
    if m.method in ("MIN", "MAX"):
        out = (F.min if m.method == "MIN" else F.max)(value)
    elif m.method in ("FIRST", "LAST"):
        out = (F.min_by if m.method == "FIRST" else F.max_by)(value, only(F.struct(*order)))
    elif m.method == "SUM" and k in ("VARCHAR", "DATE"):
        # The result itself holds every value of the key; the order columns decide between equals.
        text = value if k == "VARCHAR" else F.date_format(value, DATE_FORMAT)
        listed = F.array_sort(F.collect_list(only(F.struct(*order, text.alias("listed_text")))))
        out = F.array_join(F.transform(listed, lambda x: x["listed_text"]), ",")
    elif m.method == "SUM":
        out = F.sum(value).cast("double" if k == "DECIMAL" else "long")
    elif k == "DATE":
        # The mean of whole seconds, cut to a whole second.
        out = F.timestamp_seconds(F.floor(F.sum(F.unix_seconds(value)) / F.count(value)))
    elif k == "VARCHAR":
        out = F.lit(None).cast("double")
    else:
        out = F.sum(value).cast("double") / F.count(value)
    return out.alias(m.name)


def aggregate(df: DataFrame, keys: Sequence[str | Column], measures: Sequence[Measure], order: Sequence[str] = (), null_policy: str = "zero") -> DataFrame:
    """One row for each key. Under the policy "zero" null values count as 0 or empty, under "sql" not at all.

    Aggregates are combined before the one shuffle on the keys. Null keys are a key of their own.
    """
    return df.groupBy(*keys).agg(*(aggregate_column(m, order, null_policy) for m in measures))


def deltas(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], keep: Sequence[str] = (), null_policy: str = "zero") -> DataFrame:
    """Each row as an aggregate of itself: COUNT is 1. What an incremental edge hands on."""
    out = [F.lit(1).cast("long").alias(m.name) if m.method == "COUNT" else (typed if null_policy == "zero" else nullable)(m.column(), m.type).alias(m.name) for m in measures]
    return df.select(*keys, *keep, *out)


#: How partial aggregates of a slice are merged with those before it.
_LESS, _MORE = "less", "more"


def running(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], order: Sequence[str], slices: Column, keep: Sequence[str] = (), null_policy: str = "zero") -> DataFrame:
    """Each row with the aggregates of its key up to and including it, in the order given.

    slices must not decrease along the order (a day of the time column, say). Sums run inside a
    slice of a key; what came before is added from one row for each key and slice. So a hot key is
    worked on by as many tasks as it has slices. Sums of texts and dates are not offered here.
    """
    for m in measures:
        _need_order(m, order)
        if m.method == "SUM" and kind(m.type) in ("VARCHAR", "DATE"):
            raise ValueError(f"{m.name}: no running sum of {m.type}")
    parts: dict[str, tuple[Column, Column]] = {}  # name: (value of a row, how values combine)
    for i, m in enumerate(measures):
        if m.method in ("COUNT", "AVG"):
            counted = F.lit(1) if m.value is None or null_policy == "zero" else F.when(m.column().isNotNull(), 1).otherwise(0)
            parts[f"n{i}"] = (counted.cast("long"), F.sum)
        if m.method in ("SUM", "AVG"):
            value = F.unix_seconds(_value(m, null_policy)) if kind(m.type) == "DATE" else _value(m, null_policy)
            parts[f"s{i}"] = (value, F.sum)
        if m.method in ("MIN", "FIRST", "MAX", "LAST"):
            value = _value(m, null_policy) if m.method in ("MIN", "MAX") else F.struct(*order, _value(m, null_policy).alias("value"))
            parts[f"x{i}"] = (value, F.min if m.method in ("MIN", "FIRST") else F.max)
    rows = df.select(*keys, *order, *keep, slices.alias("_slice"), *(v.alias(f"_{n}") for n, (v, _) in parts.items()))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select(*keys, *order, *keep, "_slice", *(f(f"_{n}").over(inside).alias(f"_{n}") for n, (_, f) in parts.items()))
    totals = rows.groupBy(*keys, "_slice").agg(*(f(f"_{n}").alias(f"_{n}") for n, (_, f) in parts.items()))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_at"), *(f(f"_{n}").over(before).alias(f"_before_{n}") for n, (_, f) in parts.items()))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_slice").eqNullSafe(F.col("_at"))])
    joined = within.join(carried, same, "left")

    def merged(name: str) -> Column:
        now, old, f = F.col(f"_{name}"), F.col(f"_before_{name}"), parts[name][1]
        if f is F.sum:
            return F.coalesce(now + old, now, old)
        return F.least(now, old) if f is F.min else F.greatest(now, old)

    out = []
    for i, m in enumerate(measures):
        k = kind(m.type)
        if m.method == "COUNT":
            column = merged(f"n{i}")
        elif m.method == "SUM":
            column = merged(f"s{i}").cast("double" if k == "DECIMAL" else "long")
        elif m.method == "AVG":
            column = F.timestamp_seconds(F.floor(merged(f"s{i}") / merged(f"n{i}"))) if k == "DATE" else merged(f"s{i}").cast("double") / merged(f"n{i}")
        else:
            column = merged(f"x{i}") if m.method in ("MIN", "MAX") else merged(f"x{i}")["value"]
        out.append(column.alias(m.name))
    return joined.select(*keys, *order, *keep, *out)


def tagged(inputs: Sequence[tuple[DataFrame, Mapping[str, Column], Sequence[str]]], keys: Sequence[str]) -> DataFrame:
    """Rows of several inputs one after the other: keys, ``in_<i>`` (the row's columns, null in rows of others).

    inputs: (table, the key's expressions there, columns to keep). One shuffle on the keys then brings
    all inputs together, in a batch as in a stream.
    """
    out: DataFrame | None = None
    for i, (df, columns, keep) in enumerate(inputs):
        part = df.select(*(columns[k].alias(k) for k in keys), F.struct(F.lit(i).alias("_input"), *keep).alias(f"in_{i}"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs")
    return out


def aggregate_inputs(inputs: Sequence[tuple[DataFrame, Sequence[Column], Sequence[Measure]]], keys: Sequence[str], order: Sequence[str] = (), null_policy: str = "zero") -> DataFrame:
    """Several inputs aggregated on a common key: each measure belongs to one input.

    inputs: (table, the key's expressions there, measures). Rows of all inputs are tagged, follow each
    other and meet in one aggregate that is combined before its shuffle, so no input multiplies
    another, and streams need the state of one aggregate only. A key that an input has not gets 0,
    empty or the epoch for its measures under the policy "zero", else null. Null keys are one key.
    """
    sides, measures = [], []
    for i, (df, columns, some) in enumerate(inputs):
        values = [m.column().alias(f"v{j}") for j, m in enumerate(some) if m.value is not None]
        ordered = [F.col(c).alias(f"o{j}") for j, c in enumerate(order)] if any(_ordered(m) for m in some) else []
        sides.append((df, dict(zip(keys, columns, strict=True)), [*values, *ordered]))
        for j, m in enumerate(some):
            own = Measure(m.name, m.method, None if m.value is None else F.col(f"in_{i}.v{j}"), m.type)
            measures.append((aggregate_column(own, [F.col(f"in_{i}.o{k}").alias(f"o{k}") for k in range(len(ordered))], null_policy, F.col(f"in_{i}").isNotNull()), m))
    out = tagged(sides, keys).groupBy(*keys).agg(*(column for column, _ in measures))
    if null_policy != "zero":
        return out
    return out.select(*keys, *(F.coalesce(F.col(m.name), _missing(m)).alias(m.name) for _, m in measures))


def _missing(m: Measure) -> Column:
    if m.method in ("COUNT",):
        return F.lit(0).cast("long")
    if m.method == "AVG" and kind(m.type) in ("NUMBER", "DECIMAL"):
        return F.lit(0.0)
    if m.method == "SUM" and kind(m.type) == "DATE":
        return F.lit("")
    return typed(F.lit(None), m.type)
