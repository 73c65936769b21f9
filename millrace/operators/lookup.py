"""Lookup joins: left, on a unique key, the last loaded row wins, misses get typed defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import default
from .names import free_prefix


def unique_rows(lookup: DataFrame, key: Sequence[str], order: Sequence[str] = (), check: str | None = None) -> DataFrame:
    """One row for each key: the last in the given order (of all columns if none is given).

    check is a condition that rows must meet to count at all. Rows with a null in the key never
    match and are left out. Pre-aggregated, so a key that occurs very often is no hot spot.
    """
    valid = lookup.filter(check) if check else lookup
    rest = [c for c in lookup.columns if c not in key]
    order_by = F.struct(*order) if order else F.struct(*(rest or key))
    found = valid.dropna(subset=list(key)).groupBy(*key).agg(F.max_by(F.struct(*(rest or key)), order_by).alias("_last"))
    return found.select(*key, *(F.col(f"_last.{c}").alias(c) for c in rest))


def lookup_join(df: DataFrame, lookup: DataFrame, on: Mapping[str, str], take: Mapping[str, str], types: Mapping[str, str] | None = None, order: Sequence[str] = (), check: str | None = None, unique: bool = False) -> DataFrame:
    """df with columns of the lookup: every row of df once.

    on: column of df to key column of the lookup; take: new name to column of the lookup; types:
    declared types of new names, whose defaults stand for misses and nulls (others stay null). The
    lookup's rows are made unique first, unless they are known to be (``unique``). Spark broadcasts the lookup if its size allows, by its
    statistics or as it has found it at run time.
    """
    small = lookup.select(*dict.fromkeys([*on.values(), *take.values(), *order, *lookup_columns(lookup, check)]))
    found = (small.filter(check) if check else small) if unique else unique_rows(small, list(on.values()), order, check)
    own = free_prefix(df.columns)
    side = found.select(*(F.col(k).alias(f"{own}on{i}") for i, k in enumerate(on.values())), *(F.col(c).alias(f"{own}take{i}") for i, c in enumerate(take.values())))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{own}on{i}") for i, c in enumerate(on)])
    types = types or {}
    taken = [(F.coalesce(F.col(f"{own}take{i}"), default(types[n])) if n in types else F.col(f"{own}take{i}")).alias(n) for i, n in enumerate(take)]
    return df.join(side, same, "left").select(*(F.col(c) for c in df.columns if c not in take), *taken)


def lookup_columns(lookup: DataFrame, check: str | None) -> list[str]:
    """Columns that a check may read: all if there is one."""
    return lookup.columns if check else []


def lookup_chain(df: DataFrame, steps: Sequence[tuple[DataFrame, Mapping[str, str], Mapping[str, str], Mapping[str, str]]]) -> DataFrame:
    """Lookups one after the other: (lookup, on, take, types); keys may come from earlier ones."""
    return reduce(lambda out, s: lookup_join(out, *s), steps, df)


def shards(tables: Sequence[DataFrame]) -> DataFrame:
    """A lookup kept in several tables: their rows together, columns by name, null where one has none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def missed(column: Column, declared: str) -> Column:
    """A lookup's value, or the default of its type."""
    return F.coalesce(column, default(declared))
