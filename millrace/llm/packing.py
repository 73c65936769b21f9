"""Packing: documents into sequences of a fixed number of tokens, with little padding.

Documents are cut into pieces of the sequence length and a rest; pieces are dealt at random into
groups of a bounded expected size, and each group is packed by first-fit decreasing by itself. A
tournament tree over the bins' free capacities finds the first bin that a piece fits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, tidied
from .tokenizing import encoder


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces of one length are placed in their given order."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    free = [capacity] * (2 * leaves)  # node i has the larger capacity of 2i and 2i+1
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for piece in sorted(range(n), key=lambda i: -lengths[i]):
        size, node = lengths[piece], 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[piece], offsets[piece] = node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            left, right = free[2 * node], free[2 * node + 1]
            free[node] = left if left >= right else right
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, length: int, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, start, length, ids_crc32, doc_tokens: the pieces of each document, whole ones first."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        end = np.array([end_id], coder.kind).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, ids in enumerate(coder.encode(batch.column("text").cast(pa.binary()).to_pylist())):
                wide = np.frombuffer(ids + end, coder.kind).astype("<u4")
                for start in range(0, len(wide), length):
                    piece = wide[start : start + length]
                    for column, value in zip(out, (i, start, len(piece), zlib.crc32(piece.tobytes()), len(wide))):
                        column.append(value)
            of = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(of), batch.column("doc_id").take(of), *(pa.array(c, pa.int64()) for c in out[1:])], ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(tidied(run, encoder), f"row long, doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, group_pieces: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Every id of every document lies in exactly one piece. Null text counts as empty and gives a
    piece with the end id alone. Rows are packed one by one, whatever their ids: null and repeated
    ids are carried along. Very long texts give many whole pieces, which are dealt over all groups.
    An empty table gives an empty result; other columns are not looked at.
    """
    pieces = staged(cut_pieces(docs, tokenizer_path, end_id, length, id_col, text_col), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    id_type = pieces.schema["doc_id"].dataType.simpleString()

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "start"], ignore_index=True)
        bins, group["offset"] = first_fit_decreasing(group["length"].tolist(), length)
        group["sequence_id"] = group["group"] * (1 << 24) + bins
        return group.drop(columns=["group", "row"])

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(fill, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, offset long, sequence_id long")
