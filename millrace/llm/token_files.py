"""Token files: frequency-ranked ids in byte-aligned codes of one to four bytes.

A document's ids become their ranks by frequency in the whole corpus (0 is the most frequent), so
common ids take one byte. The length of each rank, less one, goes to a control byte of its own
stream (two bits each, the first id in the lowest bits); rank bytes, lowest first, go to a data
stream. Decoding looks lengths and masks up in numpy tables, without a branch for any id.

A file set is a folder: ``ids`` has rows (doc_id, start, n_tokens, control, data) in Parquet, dealt
into ``shard=N`` folders that ascend by doc_id, and ascending inside each file. A shard that Spark has
read in several parts has several files, each a range of its own: ``start``, of which Parquet keeps
the least and greatest, orders them. ``ranks`` has id by rank.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, shared_dir, staged, unstage
from .tokenizing import encoder

#: Lengths of the four codes that a control byte describes, and the bits that a code of a length has.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
#: Words that a worker remembers, about 200 bytes each: more than beside the pipeline's network.
REMEMBER = 1_600_000
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    four.reshape(-1)[: len(ranks)] = more
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of pack()."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    # The four bytes from every place on, as one number each, without a copy.
    wide = np.ndarray(len(data), "<u4", data + b"\0\0\0", strides=(1,))
    return wide[ends - lengths] & MASKS[lengths]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """shard, place, doc_id, local_start, n_tokens, ids: one row for each document, shards ascending by id.

    Null text counts as empty: its only id is the end id. Null ids come first; rows with one id stay
    next to each other, ordered by a hash of the text.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, REMEMBER)
        end = np.array([end_id], coder.kind).tobytes()
        shard, place, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids = [x + end for x in coder.encode(batch.column("text").cast(pa.binary()).to_pylist())]
            counts = np.array([len(x) // coder.kind.itemsize for x in ids], np.int64)
            ends = np.cumsum(counts) + start
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(place, place + n)), batch.column("doc_id"), pa.array(ends - counts), pa.array(counts), pa.array(ids, pa.binary())],
                ["shard", "place", "doc_id", "local_start", "n_tokens", "ids"],
            )
            place, start = place + n, int(ends[-1]) if n else start

    return ordered.mapInArrow(run, f"shard int, place long, doc_id {id_type}, local_start long, n_tokens long, ids binary")


def rank_ids(encoded: DataFrame, tokenizer_path: str, end_id: int) -> np.ndarray:
    """Every id of the vocabulary in order of its count over all documents, then by id.

    The driver gets one row for each id that occurs: as many as the vocabulary has at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, REMEMBER)
        total = np.zeros(max(coder.size, end_id + 1), np.int64)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for a, b in chunks(ids):
                total += np.bincount(np.frombuffer(b"".join(ids[a:b]), coder.kind), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max(encoder(tokenizer_path, REMEMBER).size, end_id + 1), np.int64)
    for r in rows:
        total[r.id] = r.n
    return np.lexsort((np.arange(len(total)), -total))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole documents and writes a file set; empty tables give an empty one.

    Null texts have the end id alone. Null ids come first, rows with one id stay together, equal rows
    are written as often as they are there. Very long texts are one row each, whole. Other columns are
    not looked at.
    """
    spark = docs.sparkSession
    encoded = staged(encode_documents(docs, tokenizer_path, end_id, id_col, text_col), "token-ids")
    by_rank = rank_ids(encoded, tokenizer_path, end_id)
    rank_of = np.empty(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)  # four bytes for each id of the vocabulary
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    totals = encoded.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # One row for each task that encoded, whatever the number of documents.
    placed = encoded.join(F.broadcast(offsets), "shard").withColumn("start", F.col("offset") + F.col("local_start"))
    placed = placed.sortWithinPartitions("shard", "place").select("shard", "doc_id", "start", "n_tokens", "ids")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, table = encoder(tokenizer_path, REMEMBER).kind, ranks.value
        for batch in batches:
            coded = [pack(table[np.frombuffer(x.as_buffer(), kind)]) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())], ["shard", "doc_id", "start", "n_tokens", "control", "data"])

    coded = placed.mapInArrow(code, f"shard int, doc_id {id_type}, start long, n_tokens long, control binary, data binary")
    coded.sortWithinPartitions("shard", "start").write.partitionBy("shard").parquet(f"{path}/ids")
    coded.drop("shard").limit(0).write.parquet(f"{path}/layout")  # of a set without documents
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(by_rank.tolist())], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    unstage(encoded)


def _decoded(spark: SparkSession, path: str, column: str, kind: str, of_ids) -> DataFrame:
    table = np.zeros(spark.read.parquet(f"{path}/ranks").count(), "<u4")
    for r in spark.read.parquet(f"{path}/ranks").collect():  # as many rows as the vocabulary has
        table[r["rank"]] = r["id"]
    ids = spark.sparkContext.broadcast(table)
    layout = spark.read.parquet(f"{path}/layout").schema
    files = spark.read.schema(layout.add("shard", T.IntegerType())).parquet(f"{path}/ids")
    id_type = files.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = zip(batch.column("control"), batch.column("data"), batch.column("n_tokens").to_pylist())
            out = [of_ids(ids.value[unpack(c.as_py(), d.as_py(), n)]) for c, d, n in streams]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out)], ["doc_id", "start", "n_tokens", column])

    return files.select("doc_id", "start", "n_tokens", "control", "data").mapInArrow(decode, f"doc_id {id_type}, start long, n_tokens long, {column} {kind}")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of long) of a file set."""
    return _decoded(spark, path, "ids", "array<long>", lambda ids: ids.astype(np.int64))


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a file set; the checksum is of the decoded ids."""
    return _decoded(spark, path, "ids_crc32", "long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
