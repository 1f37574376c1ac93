"""The change log: one row per put or delete, and what it means for a key.

Schema everywhere: ``key binary, kind tinyint, value binary, seq bigint, wal_id bigint``; ``kind`` 0 is a
put, 1 a delete. ``seq`` orders changes; a DataFrame has no order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators.ordering import with_previous

PUT, TOMBSTONE = 0, 1
MAX_KEY_BYTES = 65535
#: Column that a log may carry beside its rows: the last durable WAL id. Reads consume it.
DURABLE = "durable_wal_id"
SCHEMA = "key binary, kind tinyint, value binary, seq bigint, wal_id bigint"


class InvalidArgument(ValueError):
    """A key or value that the table does not take."""


def entries(spark: SparkSession, rows) -> DataFrame:
    """A change log from literal rows ``(key, kind, value, seq, wal_id)``."""
    return spark.createDataFrame(rows, SCHEMA)


def checked(changes: DataFrame) -> DataFrame:
    """The changes, failing the job on the first that is not allowed.

    Keys have 1 to 65535 bytes; kind is put or delete; seq is not null. A delete carries no value.
    """
    size = F.octet_length("key")
    ok = size.between(1, MAX_KEY_BYTES) & F.col("kind").isin(PUT, TOMBSTONE) & F.col("seq").isNotNull()
    return changes.withColumn("key", F.when(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("change with an invalid key, kind or seq")).isNull(), F.col("key"))).withColumn("value", F.when(F.col("kind") == PUT, F.col("value")))


def puts(rows: DataFrame) -> DataFrame:
    """``key, value, seq, wal_id`` rows as puts; a null value is an empty one."""
    return rows.select("key", F.lit(PUT).cast("tinyint").alias("kind"), F.coalesce("value", F.lit(b"")).alias("value"), "seq", "wal_id")


def deletes(rows: DataFrame) -> DataFrame:
    """``key, seq, wal_id`` rows as deletes; the key need not exist."""
    return rows.select("key", F.lit(TOMBSTONE).cast("tinyint").alias("kind"), F.lit(None).cast("binary").alias("value"), "seq", "wal_id")


def encoded_value() -> Column:
    """Stored form of a value: a kind byte, then the bytes; a tombstone is its kind byte alone."""
    return F.when(F.col("kind") == TOMBSTONE, F.lit(b"\x01")).otherwise(F.concat(F.lit(b"\x00"), F.coalesce("value", F.lit(b""))))


def decoded_value(stored: Column) -> Column:
    """Struct ``kind, value`` of a stored value."""
    dead = F.substring(stored, 1, 1) == F.lit(b"\x01")
    return F.struct(F.when(dead, TOMBSTONE).otherwise(PUT).cast("tinyint").alias("kind"), F.when(~dead, F.substring(stored, 2, 2147483646)).alias("value"))


def entry_size() -> Column:
    """Bytes an entry takes in memory: key, kind byte, value."""
    return F.octet_length("key").cast("bigint") + 1 + F.coalesce(F.octet_length("value"), F.lit(0))


def empty_as_tombstone(rows: DataFrame, stored: Column | None = None) -> DataFrame:
    """What storing does to entries: a put of an empty value becomes a tombstone; only where ``stored``, if given."""
    dead = (F.col("kind") == TOMBSTONE) | (F.coalesce(F.octet_length("value"), F.lit(0)) == 0)
    if stored is not None:
        dead = F.when(stored, dead).otherwise(F.col("kind") == TOMBSTONE)
    return rows.withColumn("__dead", dead).withColumn("kind", F.when(F.col("__dead"), TOMBSTONE).otherwise(PUT).cast("tinyint")).withColumn("value", F.when(~F.col("__dead"), F.col("value"))).drop("__dead")


def latest(rows: DataFrame, by: list[str] | None = None, rank: list[str] | None = None) -> DataFrame:
    """One row per key (and ``by``): the one with the greatest ``rank`` (default ``seq``), tombstones included.

    The winner is picked by an aggregate, so every task sends one row per key, however hot a key is.
    """
    by, rank = by or [], rank or ["seq"]
    keys = [*by, "key"]
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*rows.columns)


def live(rows: DataFrame) -> DataFrame:
    """Without tombstones."""
    return rows.filter(F.col("kind") == PUT)


def history(rows: DataFrame, bits: int = 16) -> DataFrame:
    """Every version with the seq from which it no longer holds (``until_seq``; null for the current one).

    Solved in stretches of ``2**bits`` sequence numbers, so the versions of a hot key go to many tasks.
    """
    back = rows.withColumn("__back", -F.col("seq"))
    return with_previous(back, ["key"], ["__back"], ["seq"], F.shiftright("__back", bits), "__next").withColumn("until_seq", F.col("__next.seq")).drop("__back", "__next")
