"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: space, and tab to carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: A word, as a Java and Python regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task works on at once; a longer text is worked on alone.
CHUNK = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; the warehouse, or a local run's own, only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local"):  # driver and executors are one process
            named = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        else:
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/millrace-work"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage.

    Readers depend on the files alone, so an executor lost later costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes the files of a staged() frame that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", least: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """rows joined with side, which has one row for each key, on keys; a key of very many rows is dealt out.

    Keys of more than ``least`` rows, and of more than one in 10,000 rows, get a salt from the rest of
    the row, and side's row of such a key is there once for each salt. Fewer than 10,000 keys can be
    that frequent, so they are broadcast. rows are read twice: they should be staged. counts: keys and
    count of rows, if they are known. Rows with null in a key find no partner.
    """
    total = rows.count()
    limit = max(least, total // 10_000)
    counted = rows.groupBy(*keys).count() if counts is None else counts
    hot = counted.filter(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("salts"))
    hot = staged(hot, "hot-keys")
    if hot.isEmpty():
        unstage(hot)
        return rows.join(side, keys, how)
    of_key = F.coalesce("salts", F.lit(1))
    # Rows that find no partner anyway may lie anywhere.
    lost = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.when(lost, F.lit(10_000)).otherwise(of_key)).cast("int")).drop("salts")
    copies = side.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), of_key - 1))).drop("salts")
    return salted.join(copies, [*keys, "salt"], how).drop("salt")


#: Caches of functions that Python workers keep between tasks.
KEPT: list = []


def release(keep: Callable | None = None) -> None:
    """Empties all KEPT caches but ``keep``, and gives memory that nothing uses back to the system."""
    for cache in KEPT:
        if cache is not keep:
            cache.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for a task whose worker takes over nothing from other operators' tasks, and leaves nothing but ``keep``.

    Idle workers stay for later stages, so what each of them kept would add up beside the JVM.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep)
        yield from run(batches)
        release(keep)

    return tidy


def unit_from_md5(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5; SQL engines agree on it."""
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)
