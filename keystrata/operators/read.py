"""Reading a change log: by key, range and read level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.entries import DURABLE, latest, live

COMMITTED, UNCOMMITTED = "committed", "uncommitted"


def at_level(log: DataFrame, level: str = COMMITTED, flushed: int | Column | None = None) -> DataFrame:
    """Rows visible at a read level: committed reads see WAL ids up to the last flushed one.

    That id is given or stands in the log's own column ``durable_wal_id``.
    """
    if level not in (COMMITTED, UNCOMMITTED):
        raise ValueError(f"unknown read level {level}")
    if flushed is None and DURABLE in log.columns:
        flushed = F.col(DURABLE)
    rows = log if level == UNCOMMITTED or flushed is None else log.filter(F.col("wal_id") <= flushed)
    return rows.drop(DURABLE)


def get_all(log: DataFrame, level: str = COMMITTED, flushed: int | Column | None = None) -> DataFrame:
    """Live rows of every key at a level."""
    return live(latest(at_level(log, level, flushed)))


def get(log: DataFrame, key: bytes, level: str = COMMITTED, flushed: int | Column | None = None) -> DataFrame:
    """Zero or one live row of a key; the equality reaches the scan."""
    return get_all(log.filter(F.col("key") == F.lit(key)), level, flushed)


def multi_get(log: DataFrame, keys: DataFrame, level: str = COMMITTED, flushed: int | Column | None = None) -> DataFrame:
    """One row per distinct wanted key: ``key, found, value, seq``; not-found keys have nulls.

    The log is reduced by a semi-join before the winner is picked; the optimizer broadcasts the keys when
    their size is known to be small and shuffles both sides otherwise.
    """
    wanted = keys.select("key").distinct()
    hits = get_all(log.join(wanted, "key", "left_semi"), level, flushed).select("key", "value", "seq")
    return wanted.join(hits.withColumn("__hit", F.lit(True)), "key", "left").select("key", F.coalesce("__hit", F.lit(False)).alias("found"), "value", "seq")


def scan(log: DataFrame, start: bytes | None = None, end: bytes | None = None, level: str = COMMITTED, flushed: int | Column | None = None) -> DataFrame:
    """Live rows with ``start <= key < end`` in key order; an open side is unbounded."""
    rows = log
    if start is not None:
        rows = rows.filter(F.col("key") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("key") < F.lit(end))
    return get_all(rows, level, flushed).orderBy("key")


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above every key with the prefix; null if there is none."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def scan_prefix(log: DataFrame, prefix: bytes, level: str = COMMITTED, flushed: int | Column | None = None) -> DataFrame:
    """Live rows whose key begins with the prefix, as a range of keys."""
    return scan(log, prefix, prefix_end(prefix), level, flushed)


def deleted_keys(log: DataFrame, level: str = COMMITTED, flushed: int | Column | None = None) -> DataFrame:
    """Keys whose winning row is a tombstone."""
    return latest(at_level(log, level, flushed)).filter("kind = 1")
