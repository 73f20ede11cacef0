"""Texts that have to move between tasks, compressed on the way."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import few


def unpack_text(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode()


def _with_type(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, kind if f.name == column else f.dataType) for f in df.schema])


def packed(df: DataFrame, column: str) -> DataFrame:
    """df with a text column as compressed bytes; nulls stay."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in few(batches):
            yield b.set_column(at, column, pa.array([None if t is None else pack(t.encode()) for t in b.column(at).to_pylist()], pa.binary()))

    return df.mapInArrow(run, _with_type(df, column, T.BinaryType()))


def unpacked(df: DataFrame, column: str) -> DataFrame:
    """packed() undone."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            yield b.set_column(at, column, pa.array([None if x is None else unpack_text(x) for x in b.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, _with_type(df, column, T.StringType()))
