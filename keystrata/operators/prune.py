"""Skipping what cannot hold a key: ranges, sparse indexes, filters."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from keystrata.functions.hashes import filter_bits, fnv1_halves, optimal_probes, probe_bits, word_is_set
from keystrata.operators.ordering import key_stretch, with_last_event
from keystrata.sources.scratch import SENT_BYTES, row_bytes, written


def covers(first_key: Column, key: Column, last_key: Column | None = None) -> Column:
    """Whether a table may hold a key by its range; a table without a first key holds nothing."""
    low = first_key.isNotNull() & (key >= first_key)
    return low if last_key is None else low & (key <= last_key)


def table_for_key(keys: DataFrame, tables: DataFrame, group: list[str], table: str, clamp: bool = False) -> DataFrame:
    """As-of lookup: per group the last table whose first key is not after the key.

    ``keys``: ``key`` and the ``group`` columns; ``tables``: ``group``, ``first_key`` and ``table``; tables
    without a first key hold nothing. Keys and first keys are sorted together once, stretch by stretch of
    the keys, no pair of them is formed. Below the first table the answer is null, or with ``clamp`` the
    first table. Equal keys give one row each.
    """
    bounds = tables.filter("first_key is not null").select(*group, "first_key", table)
    stretch = key_stretch(bounds.select(F.col("first_key").alias("key")).unionByName(keys.select("key")), "key")
    found = with_last_event(keys.select(*group, "key"), "key", bounds, "first_key", group, [table], stretch, "__found").select(*group, "key", F.col(f"__found.{table}").alias(table))
    if not clamp:
        return found
    least = bounds.groupBy(*group).agg(F.min_by(table, "first_key").alias("__first"))
    return found.join(least, group, "left").select(*group, "key", F.coalesce(F.col(table), F.col("__first")).alias(table))


def table_in_each(keys: DataFrame, tables: DataFrame, run: str, table: str, clamp: bool = False, max_bytes: int = SENT_BYTES) -> DataFrame:
    """``run, key, table``: ``table_for_key`` for every key in every run.

    ``tables`` is an index (one row per table: ``run``, ``first_key``, ``table``). It is written, and as
    long as its rows take at most ``max_bytes`` it goes to the tasks that read the keys, which search it:
    the keys are not shuffled. A larger one is sorted together with the keys.
    """
    index = written(tables.filter("first_key is not null").select(run, "first_key", table), "table-index")
    if (index.agg(F.sum(row_bytes(index))).first()[0] or 0) > max_bytes:
        runs = index.agg(F.collect_set(run)).scalar()  # by then the runs are few against their tables
        return table_for_key(keys.select("key", F.explode(runs).alias(run)), index, [run], table, clamp).select(run, "key", table)
    by_run: dict = {}
    for r, first, t in index.collect():
        by_run.setdefault(r, []).append((bytes(first), t))
    ordered = [(r, [f for f, _ in x], [t for _, t in x]) for r, x in sorted((r, sorted(x)) for r, x in by_run.items())]
    shared = keys.sparkSession.sparkContext.broadcast(ordered)
    types = {f.name: f.dataType.simpleString() for f in index.schema}
    kinds = [to_arrow_type(index.schema[c].dataType) for c in (run, table)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for r, firsts, numbers in shared.value:
                at = [bisect.bisect_right(firsts, k) - 1 if k is not None else -1 for k in wanted]
                found = [numbers[i] if i >= 0 else numbers[0] if clamp and k is not None else None for i, k in zip(at, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(wanted), kinds[0]), batch.column(0), pa.array(found, kinds[1])], [run, "key", table])

    return keys.select("key").mapInArrow(search, f"{run} {types[run]}, key binary, {table} {types[table]}")


def filter_words(rows: DataFrame, group: list[str], bits_per_key: int = 10, min_keys: int = 0) -> DataFrame:
    """One filter per group as words of 64 bits: ``group, num_keys, bits, word, mask``, only words with a bit set.

    Keys are made distinct before they are counted, bits are gathered into words before they are shuffled,
    and a group's words are spread over the cluster. Groups below ``min_keys`` get none.
    """
    keys = rows.filter(F.octet_length("key") > 0).select(*group, "key").distinct()
    sizes = keys.groupBy(*group).agg(F.count("*").alias("num_keys")).filter(F.col("num_keys") >= min_keys)
    sized = keys.withColumn("__h", fnv1_halves(F.col("key"))).join(sizes, group).withColumn("bits", filter_bits(F.col("num_keys"), bits_per_key))
    spread = sized.select(*group, "num_keys", "bits", F.explode(probe_bits(F.col("__h"), F.col("bits"), optimal_probes(bits_per_key))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))
    return spread.groupBy(*group, "num_keys", "bits", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("mask"))


def pack_filters(words: DataFrame, group: list[str]) -> DataFrame:
    """Filters of bounded tables, one row each: ``group, num_keys, bits, data``, lowest bit of a byte first.

    The words of a filter meet in one row: eight bytes for every 6.4 keys of its table.
    """

    @F.pandas_udf("binary")
    def pack(bits: pd.Series, at: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for n, w, m in zip(bits, at, masks):
            full = np.zeros(-(-int(n) // 64), np.uint64)
            full[np.asarray(w, np.int64)] = np.asarray(m, np.int64).view(np.uint64)
            out.append(full.tobytes()[: -(-int(n) // 8)])
        return pd.Series(out)

    lists = words.groupBy(*group, "num_keys", "bits").agg(F.collect_list(F.struct("word", "mask")).alias("w"))
    return lists.select(*group, "num_keys", "bits", pack("bits", "w.word", "w.mask").alias("data"))


def probe_filters(keys: DataFrame, words: DataFrame, group: list[str], bits_per_key: int = 10) -> DataFrame:
    """``group, key, maybe`` for distinct keys per group: all probe bits set. Without a filter: false."""
    sizes = words.groupBy(*group).agg(F.max("bits").alias("bits"))
    asked = keys.select(*group, "key").distinct().withColumn("__h", fnv1_halves(F.col("key"))).join(sizes, group, "left")
    probes = F.when(F.col("bits").isNotNull(), probe_bits(F.col("__h"), F.col("bits"), optimal_probes(bits_per_key)))
    spread = asked.select(*group, "key", F.explode_outer(probes).alias("bit")).withColumn("word", F.shiftright("bit", 6))
    hits = spread.join(words.select(*group, "word", "mask"), [*group, "word"], "left")
    return hits.groupBy(*group, "key").agg(F.min(F.coalesce(word_is_set(F.col("mask"), F.col("bit")), F.lit(False))).alias("maybe"))


def may_include(data: bytes, num_probes: int, hashes: np.ndarray) -> np.ndarray:
    """Answers of one filter for key hashes; a filter without data or probes says maybe to everything."""
    bits = len(data) * 8
    if not bits or not num_probes:
        return np.ones(len(hashes), bool)
    h = hashes.view(np.uint64)
    low, high = (h & np.uint64(0xFFFFFFFF)) % np.uint64(bits), (h >> np.uint64(32)) % np.uint64(bits)
    held, found = np.frombuffer(data, np.uint8), np.ones(len(h), bool)
    for i in range(num_probes):
        bit = (low + np.uint64(i) * high + np.uint64((i - 1) * i * (i + 1) // 6)) % np.uint64(bits)
        found &= (held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found
