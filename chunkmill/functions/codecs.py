"""Compression by name and encryption of byte columns."""

from __future__ import annotations

import hashlib
import hmac
import lzma
import os
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def codec(method: str, level: int = 6) -> tuple:
    """Compressor and decompressor by name: lzma (xz with CRC-64; levels above 9 are extreme ones), zlib, zero (identity)."""
    if method == "lzma":
        preset = level if level <= 9 else (level - 10) | lzma.PRESET_EXTREME
        return lambda b: lzma.compress(b, lzma.FORMAT_XZ, lzma.CHECK_CRC64, preset), lzma.decompress
    if method == "zlib":
        return lambda b: zlib.compress(b, min(level, 9)), zlib.decompress
    if method == "zero":
        return bytes, bytes
    raise ValueError(f"no such compression: {method}")


def compress(data: Column, method: str, level: int = 6) -> Column:
    if method == "zero":
        return data
    pack, _ = codec(method, level)
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else pack(x)), "binary")(data)


def decompress(data: Column, method: Column) -> Column:
    """Each value by the codec that its own row names."""

    def unpack(values: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else codec(n)[1](v) for v, n in zip(values, names, strict=True)])

    return F.when(method == "zero", data).otherwise(F.pandas_udf(unpack, "binary")(data, method))


def encrypt(data: Column, key: Column) -> Column:
    """AES-128 in CBC mode with PKCS padding; a random IV comes first."""
    return F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def decrypt(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


@dataclass(frozen=True)
class KeyInfo:
    """A data key wrapped by a password: what a repository stores of it."""

    salt: bytes
    rounds: int
    encrypted_key: bytes
    check_input: bytes
    check_hmac: bytes


ROUNDS = 10_000


def _wrapping_key(password: str, salt: bytes, rounds: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha1", password.encode(), salt, rounds, 16)


def _mask(spark, key: bytes, data: bytes, back: bool) -> bytes:
    """One AES block of 16 bytes, without padding."""
    f = F.aes_decrypt if back else F.aes_encrypt
    return bytes(spark.range(1).select(f(F.lit(data), F.lit(key), F.lit("ECB"), F.lit("PKCS"))).first()[0])


def wrap(spark, data_key: bytes, password: str) -> KeyInfo:
    salt, check = os.urandom(16), os.urandom(16)
    wrapped = _mask(spark, _wrapping_key(password, salt, ROUNDS), data_key, False)
    return KeyInfo(salt, ROUNDS, wrapped, check, hmac.digest(data_key, check, "sha1"))


def unwrap(spark, info: KeyInfo, password: str) -> bytes:
    """The data key; ValueError if the password is wrong."""
    try:
        key = _mask(spark, _wrapping_key(password, info.salt, info.rounds), info.encrypted_key, True)
    except Exception as e:
        raise ValueError("wrong password") from e
    if not hmac.compare_digest(hmac.digest(key, info.check_input, "sha1"), info.check_hmac):
        raise ValueError("wrong password")
    return key


def new_password(spark, info: KeyInfo, old: str, new: str) -> KeyInfo:
    """The same data key under another password."""
    return wrap(spark, unwrap(spark, info, old), new)
