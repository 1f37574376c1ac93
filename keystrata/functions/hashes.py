"""Key hashes and filter probes.

The hash is 64-bit FNV-1, computed over Arrow batches: byte position by byte position over all keys of a
batch, longest keys first, so every step is one vector operation. Probes are plain column expressions on
the two 32-bit halves of the hash, which keep every intermediate within signed 64-bit numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the hash
BASIS, PRIME = 14695981039346656037, 1099511628211
MASK = 0xFFFFFFFF


def fnv1(keys: pa.BinaryArray) -> np.ndarray:
    """FNV-1 of every key as unsigned 64-bit numbers; nulls hash as empty keys."""
    keys = keys.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = ends[:-1][order], sizes[order]
    h = np.full(len(order), BASIS, np.uint64)
    longest = int(sizes[0]) if len(sizes) else 0
    # how many keys are longer than i bytes, for every i
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    for i in range(longest):
        n = active[i]
        h[:n] = (h[:n] * np.uint64(PRIME)) ^ data[starts[:n] + i]
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1_hash(key: Column) -> Column:
    """The hash of a binary column as a bigint of the same 64 bits; null for null."""

    @F.arrow_udf("long")
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(fnv1(keys).view(np.int64), mask=keys.is_null().to_numpy(zero_copy_only=False))

    return run(key)


def fnv1_halves(key: Column) -> Column:
    """Struct ``hi, lo`` (bigint, 32 bits each) of the FNV-1 hash; null for null."""
    h = fnv1_hash(key)
    halves = F.struct(F.shiftrightunsigned(h, 32).alias("hi"), h.bitwiseAND(F.lit(MASK).cast("bigint")).alias("lo"))
    return F.when(h.isNotNull(), halves)


def fnv1_hex(key: Column) -> Column:
    """The hash as 16 upper-case hex digits."""
    return F.lpad(F.hex(fnv1_hash(key)), 16, "0")


def probe_bits(halves: Column, bits: Column, probes: int) -> Column:
    """Array of bit positions of a key in a filter of ``bits`` bits, by enhanced double hashing.

    The sum of steps in closed form: position i is h + i*d + (i-1)*i*(i+1)/6, modulo the bits.
    """
    h, d = halves["lo"] % bits, halves["hi"] % bits
    return F.array(*[((h + F.lit(i) * d + F.lit((i - 1) * i * (i + 1) // 6)) % bits).cast("bigint") for i in range(probes)])


def probe_bits_n(halves: Column, bits: Column, probes: Column) -> Column:
    """As ``probe_bits`` with the number of probes from a column; empty for no probes."""
    h, d = halves["lo"] % bits, halves["hi"] % bits
    index = F.when(probes > 0, F.sequence(F.lit(0).cast("bigint"), probes.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(index, lambda i: (h + i * d + F.floor((i - 1) * i * (i + 1) / 6)) % bits)


def filter_bits(keys: Column, bits_per_key: int) -> Column:
    """Size in bits of a filter: whole bytes."""
    return (F.ceil(keys * bits_per_key / 8) * 8).cast("bigint")


def optimal_probes(bits_per_key: int) -> int:
    return int(bits_per_key * 0.69)


def bit_is_set(data: Column, bit: Column) -> Column:
    """Whether a bit of a byte string is set, lowest bit of a byte first."""
    byte = F.conv(F.hex(F.substring(data, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.floor(byte / F.pow(F.lit(2.0), bit % 8)).cast("bigint") % 2 == 1


def word_is_set(mask: Column, bit: Column) -> Column:
    """Whether a bit is set in the 64-bit word that holds it."""
    return mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int"))) != 0


def words_of(data: Column) -> Column:
    """A byte string as an array of 64-bit words, lowest byte first; the last word is filled with zeros."""

    @F.arrow_udf("array<bigint>")
    def run(values: pa.Array) -> pa.Array:
        out = [None if v is None else np.frombuffer(v + bytes(-len(v) % 8), np.int64) for v in values.to_pylist()]
        return pa.array(out, pa.list_(pa.int64()))

    return run(data)
