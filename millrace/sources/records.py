"""Binary records: columns one after the other, big-endian, without marks for null.

Texts are a 32-bit length and UTF-8 bytes; whole numbers and milliseconds of dates 64-bit integers;
fractions 64-bit floats. A record that ends early gives defaults for what it lacks; a text whose
length goes beyond the record is empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import kind, spark_type, typed

Layout = Sequence[tuple[str, str]]


#: Types on the wire of all but texts.
FIXED = {"NUMBER": ">i8", "DATE": ">i8", "DECIMAL": ">f8"}


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text ends in the bytes of all, and these."""
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return ends, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _copied(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies spans of data to places of out, all at once."""
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + within] = data[np.repeat(start, length) + within]


def encode_columns(columns: Sequence[pa.Array], kinds: Sequence[str]) -> pa.Array:
    """One record for each row of columns without nulls."""
    n = len(columns[0])
    parts, width = [], np.zeros(n, np.int64)
    for column, k in zip(columns, kinds):
        if k == "VARCHAR":
            ends, data = _texts(column)
            parts.append((width.copy(), np.diff(ends), ends[:-1], data))
            width += 4 + np.diff(ends)
        else:
            parts.append((width.copy(), None, None, np.ascontiguousarray(column.to_numpy(zero_copy_only=False).astype(FIXED[k])).view(np.uint8).reshape(n, 8)))
            width += 8
    ends = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(int(ends[-1]), np.uint8)
    for at, length, start, data in parts:
        place = ends[:-1] + at
        if length is None:
            out[place[:, None] + np.arange(8)] = data
        else:
            out[place[:, None] + np.arange(4)] = np.ascontiguousarray(length.astype(">i4")).view(np.uint8).reshape(n, 4)
            _copied(out, place + 4, data, start, length)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def decode_columns(records: pa.Array, kinds: Sequence[str]) -> list[pa.Array]:
    """The columns of records; what a record lacks has the default of its type."""
    ends, data = _texts(records.fill_null(b""))
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    at, stop, out = ends[:-1].copy(), ends[1:], []
    last = len(data) - 8
    for k in kinds:
        if k == "VARCHAR":
            there = at + 4 <= stop
            length = data[np.minimum(at, last)[:, None] + np.arange(4)].view(">i4")[:, 0].astype(np.int64)
            length = np.where(there, length, 0)
            at += 4
            whole = (length >= 0) & (length <= stop - at)
            length = np.where(whole, length, 0)
            begin = np.minimum(at, last)
            cuts = np.concatenate([[0], np.cumsum(length)])
            text = np.zeros(int(cuts[-1]), np.uint8)
            _copied(text, cuts[:-1], data, begin, length)
            column = pa.Array.from_buffers(pa.large_binary(), len(records), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(text.tobytes())])
            try:
                out.append(column.cast(pa.large_string()).cast(pa.string()))
            except pa.ArrowInvalid:  # bytes that are no UTF-8 become replacement characters
                out.append(pa.array([x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string()))
            at = np.where(whole, at + length, stop)
        else:
            there = at + 8 <= stop
            value = data[np.minimum(at, last)[:, None] + np.arange(8)].view(FIXED[k])[:, 0]
            value = np.where(there, value, 0)
            out.append(pa.array(value.astype(np.float64 if k == "DECIMAL" else np.int64)))
            at += 8
    return out


def encode_records(df: DataFrame, layout: Layout, keep: Sequence[str] = ()) -> DataFrame:
    """keep and value (binary): one record for each row. Nulls become the defaults of their types."""
    kinds = [kind(t) for _, t in layout]
    columns = [F.unix_millis(typed(F.col(c), t)).alias(f"_{i}") if k == "DATE" else typed(F.col(c), t).alias(f"_{i}") for i, ((c, t), k) in enumerate(zip(layout, kinds))]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), encode_columns(batch.columns[n:], kinds)], [*keep, "value"])

    read = df.select(*keep, *columns)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "value binary"])
    return read.mapInArrow(run, schema)


def decode_records(df: DataFrame, layout: Layout, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """keep and the layout's columns of each record. A null record has nothing but defaults."""
    kinds = [kind(t) for _, t in layout]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *decode_columns(batch.column(n), kinds)], [*keep, *(f"_{i}" for i in range(len(kinds)))])

    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    read = df.select(*keep, value).mapInArrow(run, ", ".join([*kept, *(f"_{i} {'long' if k == 'DATE' else spark_type(t).simpleString()}" for i, ((_, t), k) in enumerate(zip(layout, kinds)))]))
    return read.select(*keep, *((F.timestamp_millis(F.col(f"_{i}")) if k == "DATE" else F.col(f"_{i}")).alias(c) for i, ((c, _), k) in enumerate(zip(layout, kinds))))


def decode_texts(df: DataFrame, value: str = "value") -> DataFrame:
    """The whole record as one column of text, logInfo."""
    return df.select(F.col(value).cast("string").alias("logInfo"))
