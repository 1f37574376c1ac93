"""Compression of byte columns, checksums, big-endian numbers and sortable ids."""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CODECS = ("none", "snappy", "zlib", "lz4", "zstd")
#: Digits of sortable 26-character ids, fixed by their format.
ID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


class UnknownCodec(ValueError):
    """A codec name outside ``CODECS``."""


def _pick(name: str):
    if name not in CODECS:
        raise UnknownCodec(name)
    return None if name in ("none", "zlib") else pa.Codec(name)


def compress_bytes(data: bytes, codec: str) -> bytes:
    """Compressed bytes; all but ``none`` begin with the plain length in four bytes."""
    c = _pick(codec)
    if codec == "none":
        return data
    body = zlib.compress(data) if codec == "zlib" else c.compress(data, asbytes=True)
    return len(data).to_bytes(4, "big") + body


def decompress_bytes(data: bytes, codec: str) -> bytes:
    c = _pick(codec)
    if codec == "none":
        return data
    if len(data) < 4:
        raise ValueError("corrupt compressed data: too short")
    size = int.from_bytes(data[:4], "big")
    out = zlib.decompress(data[4:]) if codec == "zlib" else c.decompress(data[4:], size, asbytes=True) if size else b""
    if len(out) != size:
        raise ValueError("corrupt compressed data: wrong length")
    return out


def compressed(data: Column, codec: Column) -> Column:
    """Column form of ``compress_bytes``; null stays null."""

    @F.pandas_udf("binary")
    def run(values: pd.Series, codecs: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else compress_bytes(v, c) for v, c in zip(values, codecs)])

    return run(data, codec)


def decompressed(data: Column, codec: Column) -> Column:
    """Column form of ``decompress_bytes``; null stays null."""

    @F.pandas_udf("binary")
    def run(values: pd.Series, codecs: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else decompress_bytes(v, c) for v, c in zip(values, codecs)])

    return run(data, codec)


def big_endian(number: Column, size: int) -> Column:
    """A number as ``size`` bytes, most significant first; negative numbers in two's complement of 8 bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), size * 2, "0"))


def number_at(data: Column, at: Column, size: int) -> Column:
    """The unsigned number of ``size`` (up to 7) bytes from offset ``at``, counted from 0."""
    return F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(size))), 16, 10).cast("bigint")


def signed_at(data: Column, at: Column) -> Column:
    """The signed number of 8 bytes from offset ``at``."""
    high, low = number_at(data, at, 4), number_at(data, at + 4, 4)
    return F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high) * (1 << 32) + low


def with_checksum(data: Column) -> Column:
    """Bytes followed by their CRC-32 in four bytes."""
    return F.concat(data, big_endian(F.crc32(data), 4))


def checksum_holds(data: Column) -> Column:
    n = F.octet_length(data)
    return (n >= 4) & (F.crc32(F.substring(data, F.lit(1), n - 4)) == number_at(data, n - 4, 4))


def id_millis(sst_id: Column) -> Column:
    """Milliseconds since 1970 in the first ten digits of a sortable id."""
    value = F.lit(0).cast("bigint")
    for i in range(1, 11):
        value = value * 32 + (F.instr(F.lit(ID_DIGITS), F.substring(sst_id, i, 1)) - 1)
    return F.when(F.length(sst_id) == 26, value)


def id_halves(sst_id: Column) -> Column:
    """Struct ``high, low``: the 128 bits of a sortable id as two numbers of 16 hex digits."""
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(26)), lambda i: F.lpad(F.conv((F.instr(F.lit(ID_DIGITS), F.substring(sst_id, i, F.lit(1))) - 1).cast("string"), 10, 2), 5, "0")), "")
    half = lambda at: F.lpad(F.conv(F.substring(bits, at, 64), 2, 16), 16, "0")
    return F.struct(half(3).alias("high"), half(67).alias("low"))
