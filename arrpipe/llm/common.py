"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import struct
import time

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import stage

#: Words of the decontamination and near-duplicate operators, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White-space separated tokens of the mixing and language-model operators.
TOKEN = r"[^\x20\x09-\x0D]+"

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Stands for a null document id where rows are ordered: after all others.
LAST_ID = 2**63 - 1

__all__ = [
    "LAST_ID", "TOKEN", "WORD", "binary_column", "crc_of_id", "id_key", "mix64",
    "pack_columns", "pieces", "release", "stage", "table", "text_tag", "total_bytes", "trim", "unpack_columns", "words_of",
]


def words_of(text: str | None) -> list[bytes]:
    """The words ``WORD`` of a text with A-Z lowered, as UTF-8: all other ASCII is made blank, and blanks cut."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(column: str = "doc_id") -> Column:
    """The id as an orderable long; null ids stand last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def text_tag(column: str = "text") -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(F.col(column))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as decimal text; null where the id is null."""
    return F.crc32(F.col(column).cast("long").cast("string").cast("binary"))


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def pieces(total: int, each: int, least: int = 8) -> int:
    """How many groups of about ``each`` units ``total`` makes."""
    return max(least, -(-total // each))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced.

    The first collection finds the plans, the second what only they referenced.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def trim() -> None:
    """Give memory that is free in a Python worker back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Arrays of numbers as one compressed value; equal bytes of a column's numbers stand together."""
    head, body = [struct.pack("<B", len(columns))], []
    for c in columns:
        c = np.ascontiguousarray(c)
        head.append(struct.pack("<3sI", c.dtype.newbyteorder("<").str[-3:].encode(), len(c)))
        body.append(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack_columns(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    at, columns = 1 + 7 * raw[0], []
    for i in range(raw[0]):
        code, n = struct.unpack_from("<3sI", raw, 1 + 7 * i)
        kind = np.dtype(code.decode())
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        columns.append(np.ascontiguousarray(planes.T).view(kind).reshape(n) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return columns


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where its values start and end."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets
