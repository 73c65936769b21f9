"""Where rows of nodes go: filtered, renamed, keyed; each sink by itself."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import truthy
from ..plans.specs import PushSpec, SpecError, StoreSpec


def filtered(df: DataFrame, condition: str | None) -> DataFrame:
    """Rows for which an expression of any type is true in the sense of truthy()."""
    if not condition:
        return df
    of = df.select(F.expr(condition).alias("c")).schema["c"].dataType
    return df.filter(truthy(F.expr(condition), of))


def stored(df: DataFrame, store: StoreSpec) -> DataFrame:
    """The rows that a store takes, under its names (all columns if it maps none)."""
    rows = filtered(df, store.filter)
    missing = [c for c in store.mapping if c not in df.columns]
    if missing:
        raise SpecError(f"store {store.target}: no column {', '.join(missing)}")
    return rows.select(*(F.col(a).alias(b) for a, b in store.mapping.items())) if store.mapping else rows


def key_text(columns: Sequence[str | Column]) -> Column:
    """Key values joined by a colon; null counts as empty."""
    return F.concat_ws(":", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))


def partition_of(key: Column, of: T.DataType | str, partitions: int) -> Column:
    """Numbers by their remainder; texts by that of their digits, or of a hash if they have none."""
    name = of if isinstance(of, str) else of.simpleString()
    if name in ("tinyint", "smallint", "int", "bigint"):
        return F.pmod(key.cast("long"), F.lit(partitions)).cast("int")
    digits = F.regexp_replace(key, "[^0-9]", "")
    return F.coalesce(F.pmod(digits.try_cast("decimal(38,0)"), F.lit(partitions)).cast("int"), F.pmod(F.hash(key), F.lit(partitions)).cast("int"))


def pushed(df: DataFrame, push: PushSpec) -> DataFrame:
    """key and value (JSON) of each row that a push takes."""
    rows = filtered(df, push.filter)
    if push.key_kind == "hash":
        key = F.hash(*(push.key or df.columns)).cast("string")
    elif push.key_kind == "long":
        if len(push.key) != 1:
            raise SpecError(f"push {push.target}: a long key is one column")
        key = F.col(push.key[0]).cast("long").cast("string")
    elif push.key_kind == "text":
        key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in push.key))
    else:
        raise SpecError(f"push {push.target}: no kind of key {push.key_kind}")
    return rows.select(key.alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


# Settings of message producers in catalogues, and Kafka's names for them.
PRODUCER = {"acks": "kafka.acks", "compression": "kafka.compression.type", "batch": "kafka.batch.size", "linger": "kafka.linger.ms"}


def push_options(push: PushSpec) -> dict[str, str]:
    """Options of the Kafka sink."""
    return {"topic": push.target} | {PRODUCER.get(k, k): v for k, v in push.options.items()}


#: Called with (rows, batch id): how a kind of push delivers a batch.
Delivery = Callable[[DataFrame, int], None]


def deliver(df: DataFrame, batch: int, stores: Sequence[StoreSpec], pushes: Sequence[PushSpec], writers: Mapping[str, Delivery]) -> None:
    """A batch to every sink. A sink that fails fails the batch, which Spark then repeats; none depends on another."""
    errors = []
    for spec, rows, name in [*((s, stored(df, s), s.target) for s in stores), *((p, pushed(df, p), p.kind) for p in pushes)]:
        if name not in writers:
            raise SpecError(f"no writer for {name}")
        try:
            writers[name](rows, batch)
        except Exception as e:  # the other sinks still get the batch; the failure is raised below
            errors.append((spec, e))
    if errors:
        raise RuntimeError(f"{len(errors)} sinks failed, first {errors[0][0]}") from errors[0][1]


def folder_writer(path: str) -> Delivery:
    """Batches as folders: one that is repeated replaces itself."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def newest_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a folder of batches holds now: of each key the row of the last batch."""
    rest = [c for c in df.columns if c not in (*key, "batch")]
    found = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_row"))
    return found.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))
