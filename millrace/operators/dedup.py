"""Duplicates inside time buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free_prefix

# Units of a bucket rule ``type:interval`` in seconds, and the interval it has if none is given.
UNITS = {1: (60, 30), 2: (3600, 1), 3: (86400, 1)}


def bucket_seconds(rule: str = "2:1") -> int:
    """Length of the buckets of a rule: 1 minutes, 2 hours, 3 days."""
    unit, _, interval = rule.partition(":")
    if int(unit) not in UNITS:
        raise ValueError(f"no bucket rule {rule}")
    seconds, usual = UNITS[int(unit)]
    length = int(interval) if interval else usual
    if length < 1:
        raise ValueError(f"no bucket rule {rule}")
    return seconds * length


def bucket_start(ts: Column, rule: str = "2:1") -> Column:
    """Start of the tumbling bucket, aligned to the epoch in UTC."""
    seconds = bucket_seconds(rule)
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds)


def first_in_bucket(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], rule: str = "2:1") -> DataFrame:
    """The first row of each key and bucket, with the column bucket. Rows without a time share one bucket.

    Equality is that of the keys themselves (nulls equal each other). Rows are combined before the
    shuffle, so a key with very many repeats sends one row from each task.
    """
    df = df.drop("bucket")
    bucketed = df.withColumn("bucket", bucket_start(F.col(ts), rule))
    found = bucketed.groupBy("bucket", *keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first"))
    return found.select(*(F.col(f"_first.{c}").alias(c) for c in df.columns), "bucket")


def seen_before(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], rule: str = "2:1") -> DataFrame:
    """Every row with bucket and seen: whether an earlier row of its bucket has its keys."""
    df = df.drop("bucket", "seen")
    own = free_prefix(df.columns)
    bucketed = df.withColumn("bucket", bucket_start(F.col(ts), rule))
    firsts = bucketed.groupBy("bucket", *keys).agg(F.min(F.struct(*order)).alias(f"{own}first")).select(F.col("bucket").alias(f"{own}bucket"), *(F.col(k).alias(f"{own}key{i}") for i, k in enumerate(keys)), f"{own}first")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{own}key{i}")) for i, k in enumerate(keys)] + [F.col("bucket").eqNullSafe(F.col(f"{own}bucket"))])
    return bucketed.join(firsts, same, "left").select(*df.columns, "bucket", (F.struct(*order) > F.col(f"{own}first")).alias("seen"))


def contains(df: DataFrame, known: DataFrame, keys: Sequence[str], ts: str, rule: str = "2:1") -> DataFrame:
    """The rows of df whose keys some row of known has in the same bucket."""
    there = known.select(bucket_start(F.col(ts), rule).alias("bucket"), *keys).distinct()
    return df.withColumn("bucket", bucket_start(F.col(ts), rule)).join(there, ["bucket", *keys], "left_semi")
