"""Tables and streams that nodes and lookups read."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.macros import expand_macros
from ..operators.lookup import shards


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; the warehouse, or a local run's own, only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local"):  # driver and executors are one process
            named = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        else:
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/millrace-work"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream of its files; times without a zone are read as UTC, as watermarks need."""
    schema = table(spark, folder, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A table is one file or a folder of them; the glob finds either.
    return with_zones(reader.parquet(f"{folder}/{name}.parque[t]"), schema)


def with_zones(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in schema))


def sharded_query(spark: SparkSession, query: str, tables: Sequence[str], now: datetime | None = None) -> DataFrame:
    """A lookup kept in several tables or views: ``{JOIN_TABLE}`` of the query is each in turn."""
    return shards([spark.sql(expand_macros(query, now, t)) for t in tables])


def sharded_jdbc(spark: SparkSession, url: str, query: str, tables: Sequence[str], options: Mapping[str, str] | None = None, now: datetime | None = None) -> DataFrame:
    """The same from a database: one scan for each table, in parallel."""
    return shards([spark.read.format("jdbc").options(url=url, query=expand_macros(query, now, t), **(options or {})).load() for t in tables])


# Names of stream options in catalogues, and what the Kafka source calls them.
START = {"head": "latest", "earliest": "earliest", "latest": "latest"}


def kafka_options(servers: str, topic: str, options: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of ``spark.readStream.format("kafka")`` from a stream's ``key=value`` options.

    start: head, earliest or milliseconds since the epoch; max_pending: records in a batch. Others
    with the prefix ``kafka.`` are handed on. A checkpoint's offsets go before any start.
    """
    given = dict(options or {})
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic}
    start = given.pop("start", "head")
    if start.lstrip("-").isdigit():
        out["startingTimestamp"] = start
    elif start in START:
        out["startingOffsets"] = START[start]
    else:
        raise ValueError(f"no start position {start}")
    if "max_pending" in given:
        out["maxOffsetsPerTrigger"] = given.pop("max_pending")
    unknown = [k for k in given if not k.startswith("kafka.")]
    if unknown:
        raise ValueError(f"no stream option {', '.join(sorted(unknown))}")
    return out | given


def kafka_stream(spark: SparkSession, servers: str, topic: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """key, value, topic, partition, offset, timestamp of a topic; needs Spark's Kafka package."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, options)).load()
