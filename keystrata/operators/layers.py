"""Layers of a table: unflushed log, memory, level 0, sorted runs; how rows move through them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.operators.entries import empty_as_tombstone, entry_size, latest, live
from keystrata.operators.ordering import with_previous

#: Rank of a layer; the higher one is newer.
RUN, LEVEL0, MEMORY, LOG = 0, 1, 2, 3


def number_wals(changes: DataFrame, tick: str) -> DataFrame:
    """Give every non-empty hour the next WAL id (from 1, without gaps): adds ``wal_id`` and ``last_wal_id``.

    ``tick`` is a number of hours (any bigint that stays within the calendar). Hours are gathered 64 to a
    row, a bit each: a year is 137 rows of 32 bytes and all years a timestamp can hold are under 1.4
    million, so the rows are sent to the tasks that read the changes, whatever their number. Ids are then
    counted bits; the changes are not shuffled and nothing runs before the result does. Null ticks are no
    batch.
    """
    block, bit = F.floor(F.col(tick) / 64), F.pmod(F.col(tick), F.lit(64)).cast("int")
    blocks = changes.select(block.alias("__block"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("__bit")).filter("__block is not null").groupBy("__block").agg(F.bit_or("__bit").alias("__bits"))
    whole = Window.orderBy("__block")  # at most the rows of the calendar
    ids = blocks.withColumn("__n", F.bit_count("__bits").cast("bigint"))
    ids = ids.withColumn("__before", F.sum("__n").over(whole) - F.col("__n")).withColumn("last_wal_id", F.sum("__n").over(Window.partitionBy(F.lit(0)))).drop("__n")
    upto = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(63) - bit)
    counted = F.col("__before") + F.bit_count(F.col("__bits").bitwiseAND(upto))
    return changes.join(F.broadcast(ids), block == F.col("__block")).withColumn("wal_id", counted.cast("bigint")).drop("__block", "__bits", "__before")


def place(log: DataFrame, per_level0: int, level0_per_run: int, flushed: int | Column) -> DataFrame:
    """Add ``layer`` and ``unit`` under a fixed policy.

    WAL ids above ``flushed`` stay in the log; of the others every ``per_level0`` ids freeze into one
    level-0 table, every ``level0_per_run`` complete level-0 tables are merged into one run, and the
    rest of the ids is memory. ``unit`` orders tables within a layer; the higher one is newer.
    """
    flushed = flushed if isinstance(flushed, Column) else F.lit(flushed)
    tables = F.floor(flushed / per_level0)
    l0 = F.floor((F.col("wal_id") - 1) / per_level0)
    layer = F.when(F.col("wal_id") > flushed, LOG).when(l0 >= tables, MEMORY).when(l0 >= F.floor(tables / level0_per_run) * level0_per_run, LEVEL0).otherwise(RUN)
    unit = F.when(layer == LEVEL0, l0).when(layer == RUN, F.floor(l0 / level0_per_run)).otherwise(0)
    return log.withColumn("layer", layer.cast("bigint")).withColumn("unit", unit.cast("bigint"))


def flush(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Tables written from memory: the last row of a key per unit, empty values as tombstones."""
    return empty_as_tombstone(latest(rows, unit))


def layered(placed: DataFrame, committed: bool = True) -> DataFrame:
    """Winning row per key over all layers, tombstones included.

    Stored layers hold empty values as tombstones, memory and the log keep them; the newest layer, in it
    the newest unit, in it the greatest seq wins. ``committed`` reads leave the log out.
    """
    rows = placed.filter(F.col("layer") < LOG) if committed else placed
    return latest(empty_as_tombstone(rows, F.col("layer") <= LEVEL0), rank=["layer", "unit", "seq"])


def layered_live(placed: DataFrame, committed: bool = True) -> DataFrame:
    return live(layered(placed, committed))


def table_meta(tables: DataFrame, unit: list[str]) -> DataFrame:
    """What a manifest keeps of each table: first and last key, rows, tombstones, bytes."""
    return tables.groupBy(*unit).agg(
        F.min("key").alias("first_key"),
        F.max("key").alias("last_key"),
        F.count("*").alias("num_rows"),
        F.sum((F.col("kind") == 1).cast("bigint")).alias("num_tombstones"),
        F.sum(entry_size()).alias("bytes"),
    )


def memory_size(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Bytes held per unit: overwritten entries no longer count."""
    return latest(rows, unit).groupBy(*unit).agg(F.sum(entry_size()).alias("bytes"))


def freeze_by_size(log: DataFrame, limit: int) -> DataFrame:
    """Which WAL ids freeze memory when its net size reaches ``limit``, tested after each WAL is applied.

    Returns ``wal_id, memory_bytes, frozen`` per WAL. What a WAL adds to memory is the last size of each of
    its keys, less the size the key had in the WAL before it in which it stood, if that is still in
    memory. Those sums are made per pair of WALs over the whole cluster; the fold over them, which is
    sequential by nature, reads no key and keeps two counters.
    """
    per_wal = latest(log, ["wal_id"]).select("wal_id", "key", entry_size().alias("b"))
    per_wal = with_previous(per_wal, ["key"], ["wal_id"], ["wal_id", "b"], F.floor(F.col("wal_id") / 1024), "p")
    steps = per_wal.groupBy("wal_id", F.coalesce("p.wal_id", F.lit(-1).cast("bigint")).alias("earlier")).agg(F.sum("b").alias("adds"), F.sum(F.coalesce("p.b", F.lit(0))).cast("bigint").alias("replaces"))
    rows = steps.repartition(1).sortWithinPartitions("wal_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, current, since, out = 0, None, None, []

        def close(wal: int) -> None:
            nonlocal total, since
            full = total >= limit
            out.append((wal, total, full))
            if full:
                total, since = 0, None

        for batch in batches:
            for wal, earlier, adds, replaces in zip(*[batch[c].tolist() for c in ("wal_id", "earlier", "adds", "replaces")]):
                if current is not None and wal != current:
                    close(current)
                current = wal
                since = wal if since is None else since
                total += adds - (replaces if earlier >= since else 0)
            if out:
                yield pd.DataFrame(out, columns=["wal_id", "memory_bytes", "frozen"])
                out.clear()
        if current is not None:
            close(current)
        yield pd.DataFrame(out, columns=["wal_id", "memory_bytes", "frozen"])

    return rows.mapInPandas(fold, "wal_id bigint, memory_bytes bigint, frozen boolean")


def last_compacted(flushed: int | Column, per_level0: int) -> Column:
    """The last WAL id that has gone to level 0 under the policy of ``place``."""
    flushed = flushed if isinstance(flushed, Column) else F.lit(flushed)
    return F.floor(flushed / per_level0) * per_level0


def replay(log: DataFrame, compacted: int | Column) -> DataFrame:
    """Memory after recovery: rows of WAL ids above the last compacted one, the last per key."""
    return latest(log.filter(F.col("wal_id") > compacted))
