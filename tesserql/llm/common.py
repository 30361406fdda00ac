"""What the operators share: staged tables, and bytes of Arrow texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import numbered, partitions, scratch, shared_folder, stage, unstage  # noqa: F401

#: Bytes that separate words: space and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, without decoding; None for a null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield None if valid is not None and not valid[i] else bytes(data[offsets[i] : offsets[i + 1]])


def int64s(column: pa.Array, null: int = 0) -> np.ndarray:
    """A column of integers as int64, with another value for null."""
    if column.null_count:
        column = column.fill_null(null)
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def nullable(values: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.array(values, type=pa.int64(), mask=nulls)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
