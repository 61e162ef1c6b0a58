"""Hashes and encodings of byte strings: rolling digest, chunk ids, adler32, hexadecimal, size suffixes."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: base of the rolling digest, which is a Horner fold from 1 modulo 2^64.
BASE = 257
#: Units of sizes.
UNITS = {"b": 1, "kib": 2**10, "mib": 2**20, "gib": 2**30, "kb": 10**3, "mb": 10**6, "gb": 10**9}


def powers(n: int) -> np.ndarray:
    """BASE ** 0 ... BASE ** n modulo 2^64."""
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def digest(data: bytes) -> int:
    """The rolling digest of a whole byte string."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    p = powers(len(b))
    return (int((b * p[:-1][::-1]).sum(dtype=np.uint64)) + int(p[-1])) % 2**64


def window_digests(data: bytes, width: int) -> np.ndarray:
    """Digests of all windows of `width` bytes at once: base 257 is odd, so it has an inverse modulo 2^64."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(b)
    if n < width:
        return np.empty(0, np.uint64)
    inverse = np.full(n + 1, pow(BASE, -1, 2**64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * inverse[1:])])
    p = powers(n)
    return (sums[width:] - sums[:-width]) * p[width:] + p[width]


def rotate(value: int, leaves: int, enters: int, width: int) -> int:
    """The digest of the next window: one byte leaves, one enters."""
    gone = (leaves + BASE - 1) * pow(BASE, width, 2**64)
    return (value * BASE + enters - gone) % 2**64


@F.pandas_udf(T.StringType())
def rolling_hex(data: pd.Series) -> pd.Series:
    """The rolling digest as 16 hexadecimal digits; null for null."""
    return data.map(lambda x: None if x is None else f"{digest(x):016x}")


def rolling_digests(pieces: DataFrame) -> DataFrame:
    """`pieces` with rolling_hex of bytes, as digest, in their place.

    Spark puts off a cut until rolling_hex takes it, and each row that waits there for its result, on disk if need be,
    has the stream's whole payload. Here rows are cut first, and none waits.
    """
    at = pieces.columns.index("bytes")
    schema = T.StructType([T.StructField("digest", T.StringType()) if f.name == "bytes" else f for f in pieces.schema])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [None if x is None else f"{digest(x):016x}" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()) if i == at else x for i, x in enumerate(batch.columns)], names=schema.names)

    return pieces.mapInArrow(rows, schema)


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    """Adler-32 checksum, 1 for the empty string; null for null."""
    return data.map(lambda x: None if x is None else zlib.adler32(x)).astype("Int64")


def signed(digits: Column) -> Column:
    """16 hexadecimal digits as the signed long of the same bits."""
    return F.conv(digits, 16, -10).cast("long")


def lower_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def crypto(data: Column) -> Column:
    """The first 16 bytes of SHA-1, in hexadecimal."""
    return F.substring(F.sha1(data), 1, 32)


def little_endian(digits: Column) -> Column:
    """16 hexadecimal digits of a number to those of its little-endian bytes (reverse() of binary goes by characters)."""
    return F.concat(*[F.substring(digits, p, 2) for p in range(15, 0, -2)])


def chunk_id(data: Column) -> Column:
    """48 hexadecimal digits: truncated SHA-1, then the little-endian rolling digest."""
    return F.concat(crypto(data), little_endian(rolling_hex(data)))


def chunk_id_of(data: bytes) -> bytes:
    """chunk_id() of one byte string, as its 24 bytes."""
    return hashlib.sha1(data).digest()[:16] + digest(data).to_bytes(8, "little")


def from_chunk_id(digits: Column) -> tuple[Column, Column]:
    """The truncated SHA-1 and the rolling digest (16 digits, big-endian) of a chunk id; any other length is an error."""
    checked = F.when(F.length(digits) == 48, digits).otherwise(F.raise_error(F.lit("a chunk id has 24 bytes")))
    return F.substring(checked, 1, 32), little_endian(F.substring(checked, 33, 16))


def parse_size(said: str) -> int:
    """Bytes of a number with its unit, e.g. 64KiB; the unit must be there."""
    m = re.fullmatch(r"(\d+)\s*([A-Za-z]+)", said.strip())
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"no size: {said!r}")
    return int(m[1]) * UNITS[m[2].lower()]
