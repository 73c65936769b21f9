"""Several inputs that meet on a business key, without grouping: the newest row of each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import tagged


def merge_latest(sides: Sequence[tuple[DataFrame, Mapping[str, Column], Mapping[str, Column], Sequence[str | Column]]], deferred: Mapping[str, Column] | None = None) -> DataFrame:
    """(table, keys, columns, order) of each input: one row for each key that any has.

    Deferred columns need all inputs: they stay null until every one has a row of the key. Null keys
    are left out, as a stored row needs a key. Rows of all inputs meet in one aggregate, so streams
    can be merged too.
    """
    wide = merged_rows(sides)
    names = list(sides[0][1])
    extra = [F.when(F.col("_complete"), c).alias(n) for n, c in (deferred or {}).items()]
    flat = wide.select(*names, "_complete", *(F.col(f"row_{i}.{n}").alias(n) for i, (_, _, columns, _) in enumerate(sides) for n in columns))
    return flat.select(*names, *(n for _, _, columns, _ in sides for n in columns), *extra)


def merged_rows(sides: Sequence[tuple[DataFrame, Mapping[str, Column], Mapping[str, Column], Sequence[str | Column]]]) -> DataFrame:
    """keys, row_<i> (the newest row of each input, null if it has none) and _complete: whether all have one."""
    names = list(sides[0][1])
    if any(list(keys) != names for _, keys, _, _ in sides):
        raise ValueError("every input must give the same keys")
    parts = [(df, keys, [F.struct(F.lit(True).alias("_has"), *(c.alias(n) for n, c in columns.items())).alias("row"), F.struct(*order).alias("at")]) for df, keys, columns, order in sides]
    rows = tagged(parts, names).dropna(subset=names)
    opened = rows.groupBy(*names).agg(*(F.max_by(F.col(f"in_{i}.row"), F.col(f"in_{i}.at")).alias(f"row_{i}") for i in range(len(sides))))
    complete = reduce(lambda a, b: a & b, [F.col(f"row_{i}").isNotNull() for i in range(len(sides))])
    return opened.withColumn("_complete", complete)


def union_inputs(inputs: Sequence[DataFrame]) -> DataFrame:
    """Inputs whose keys never meet: all rows, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)
