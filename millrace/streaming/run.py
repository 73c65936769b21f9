"""Nodes as continuous queries."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.types import DIGITS, kind, nullable, scale, spark_type, typed
from ..operators.aggregate import Measure
from ..operators.dedup import bucket_start
from ..sources.readers import shared_folder
from ..sources.sinks import folder_writer, newest_rows


def start(df: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", every: str | None = None, name: str | None = None) -> StreamingQuery:
    """Runs until stopped (or over what is there, if ``every`` is None), handing each batch to deliver.

    In the mode "update" a batch has one row for each key that changed. Offsets and state lie in
    the checkpoint: a restart goes on where the last finished batch ended.
    """
    writer = df.writeStream.outputMode(mode).foreachBatch(deliver).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drained(df: DataFrame, key: Sequence[str] = (), mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there and reads its result: of each key the last row, or all rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    start(df, folder_writer(f"{path}/rows"), f"{path}/checkpoint", mode).awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch long").parquet(f"{path}/rows")
    return newest_rows(rows, key) if key else rows.drop("batch")


def first_in_bucket_stream(df: DataFrame, keys: Sequence[str], ts: str, rule: str = "2:1", delay: str = "0 seconds") -> DataFrame:
    """keys and bucket, once for each. Buckets older than the watermark are forgotten, and rows that
    come later than that are dropped (a batch run would keep them)."""
    bucketed = df.select(bucket_start(F.col(ts), rule).alias("bucket"), *keys)
    return bucketed.withWatermark("bucket", delay).dropDuplicates(["bucket", *keys])


def running_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Sequence[Measure], null_policy: str = "zero") -> DataFrame:
    """Each row with the aggregates of its key so far: one row for each row, as operators.aggregate.running gives.

    COUNT, SUM, AVG, MIN, MAX, FIRST and LAST; sums of NUMBER(n) are added as whole numbers of n
    places, so they are those of a batch run. Rows of a batch are taken in the given order inside each
    key; the rows of a key in one batch are held together, so the source's batch size (files or
    offsets for each trigger) bounds them.
    """
    shape = {c: df.schema[c].dataType.simpleString() for c in dict.fromkeys([*keys, *order])}
    ordered, values = list(order), []
    for i, m in enumerate(measures):
        if m.method == "SUM" and kind(m.type) in ("VARCHAR", "DATE") or m.method == "AVG" and kind(m.type) in ("VARCHAR", "DATE"):
            raise ValueError(f"{m.name}: no running {m.method} of {m.type} in a stream")
        value = F.lit(1) if m.value is None else (typed if null_policy == "zero" else nullable)(m.column(), m.type)
        if m.method in ("SUM", "AVG"):
            value = F.round(value.cast(f"decimal({DIGITS - 10},{places(m)})") * F.lit(10 ** places(m)), 0).cast("string")
        values.append(value.alias(f"_v{i}"))
    results = {m.name: "long" if m.method == "COUNT" or m.method == "SUM" and kind(m.type) == "NUMBER" else "double" if m.method in ("SUM", "AVG") else spark_type(m.type).simpleString() for m in measures}
    out = ", ".join(f"`{c}` {t}" for c, t in (shape | results).items())
    held = ", ".join(f"n{i} long, s{i} string, x{i} {'long' if m.method in ('COUNT', 'SUM', 'AVG') else results[m.name]}" for i, m in enumerate(measures))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(ordered, ignore_index=True, kind="stable")
        before = state.get if state.exists else (0, "0", None) * len(measures)
        result, after = rows[list(shape)].copy(), []
        for i, m in enumerate(measures):
            n, total, extreme = before[3 * i : 3 * i + 3]
            column = rows[f"_v{i}"]
            there = column.notna()
            counts = there.cumsum() + n
            if m.method in ("SUM", "AVG"):
                sums = list(accumulate((int(x) if ok else 0 for x, ok in zip(column, there)), initial=int(total)))[1:]
                unit = 10 ** places(m)
                whole = [x // unit if results[m.name] == "long" else x / unit for x in sums]
                result[m.name] = whole if m.method == "SUM" else [x / c if c else None for x, c in zip(whole, counts)]
                total = str(sums[-1])
            elif m.method == "COUNT":
                result[m.name] = counts
            else:
                pick = {"MIN": lambda a, b: a if a <= b else b, "MAX": lambda a, b: a if a >= b else b, "FIRST": lambda a, b: a, "LAST": lambda a, b: b}[m.method]
                seen, started = [], state.exists
                for x, ok in zip(column, there):
                    if m.method in ("FIRST", "LAST"):
                        extreme, started = (pick(extreme, x if ok else None) if started else x if ok else None), True
                    elif ok:
                        extreme = x if extreme is None else pick(extreme, x)
                    seen.append(extreme)
                result[m.name] = pd.Series(seen, dtype=column.dtype if column.dtype != object and not pd.isna(seen).any() else object)
            after += [int(counts.iloc[-1]), total, extreme]
        state.update(tuple(after))
        yield result

    picked = df.select(*shape, *values)
    return picked.groupBy(*keys).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.NoTimeout)


def places(m: Measure) -> int:
    return scale(m.type) if kind(m.type) == "DECIMAL" else 0


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """What a query has done: a row for each finished batch of those Spark remembers."""
    rows = [(str(p.name or p.id), int(p.batchId), str(s.description), int(s.numInputRows or 0), float(s.processedRowsPerSecond or 0.0), int(p.durationMs.get("triggerExecution", 0))) for p in query.recentProgress for s in p.sources]
    return spark.createDataFrame(rows, "query string, batch long, source string, rows long, rows_per_second double, elapsed_ms long")


def source_lag(spark: SparkSession, sources: Sequence[tuple[str, str | None, str | None]]) -> DataFrame:
    """source, topic, partition, reached, latest, behind: how far each partition of a source is behind.

    sources: a source's name, the offsets that the last batch ended at and the newest ones, as the
    progress of a query gives them: ``{"topic": {"0": 17}}``. Sources without such offsets have no rows.
    """
    rows = []
    for name, reached, latest in sources:
        ends, newest = (json.loads(x) if x else {} for x in (reached, latest))
        for topic, parts in (ends.items() if isinstance(ends, dict) else ()):
            for part, offset in (parts.items() if isinstance(parts, dict) else ()):
                known = newest.get(topic, {}).get(part) if isinstance(newest, dict) else None
                rows.append((name, topic, int(part), int(offset), known, None if known is None else max(0, known - int(offset))))
    return spark.createDataFrame(rows, "source string, topic string, partition int, reached long, latest long, behind long")


def query_lag(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """source_lag of a query's last batch."""
    last = query.lastProgress
    return source_lag(spark, [(str(s.description), s.endOffset, s.latestOffset) for s in last.sources] if last else [])


def run_summary(log: DataFrame, keys: Sequence[str], elapsed: str) -> DataFrame:
    """Log entries rolled up: how many, and their time in total, least and greatest."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.sum(elapsed).alias("total_elapsed"), F.min(elapsed).alias("least_elapsed"), F.max(elapsed).alias("greatest_elapsed"))
