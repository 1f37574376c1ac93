"""Merging sorted sources by key, and cutting what comes out into tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.operators.ordering import key_stretch, with_running_total


def merge(sources: list[DataFrame]) -> DataFrame:
    """One row per key over several sources; the source listed first wins. Adds ``source``."""
    numbered = [s.withColumn("source", F.lit(i).cast("bigint")) for i, s in enumerate(sources)]
    return merge_numbered(reduce(DataFrame.unionByName, numbered))


def merge_numbered(rows: DataFrame, by: list[str] | None = None, newest: str | None = None) -> DataFrame:
    """One row per key (and ``by``): the one with the smallest ``source``.

    A source may hold several versions of a key if ``newest`` names the column that orders them.
    """
    keys = [*(by or []), "key"]
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct("source", -F.col(newest)) if newest else F.col("source")
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*rows.columns)


def group_starts(batch: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """Positions of a sorted batch at which a new group begins, 0 first."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for g in group:
        codes = pc.dictionary_encode(batch.column(g), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= np.diff(codes) != 0
    return np.flatnonzero(new)


def byte_lengths(column: pa.Array) -> np.ndarray:
    """Length of every value, 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def roll(rows: DataFrame, group: list[str], limit: int) -> DataFrame:
    """Cut every sorted run into tables: a table ends after the row that takes its bytes over ``limit``.

    Adds ``table_no`` from 0 per group. Bytes are those of key and value. Where a table ends depends on
    where the one before ended, so a run is cut by one task, in one pass over sums of its batches: each
    table is one search, no row is looked at by itself. For cutting one large run over many tasks see
    ``cut_by_bytes``.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", table_no bigint"
    placed = rows.repartition(*group).sortWithinPartitions(*group, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, number, size = None, 0, 0
        for batch in batches:
            total = np.cumsum(byte_lengths(batch.column("key")) + byte_lengths(batch.column("value")))
            numbers = np.empty(batch.num_rows, np.int64)
            starts = group_starts(batch, group).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                of = tuple(batch.column(g)[a].as_py() for g in group)
                if of != run:
                    run, number, size = of, 0, 0
                while a < b:
                    past = int(total[a - 1]) if a else 0
                    end = min(b, a + int(np.searchsorted(total[a:b], limit - size + past, side="right")) + 1)
                    numbers[a:end] = number
                    size += int(total[end - 1]) - past
                    if size > limit:
                        number, size = number + 1, 0
                    a = end
            yield batch.append_column("table_no", pa.array(numbers))

    return placed.mapInArrow(cut, schema)


def cut_by_bytes(rows: DataFrame, size: str, limit: int) -> DataFrame:
    """Add ``table_no``: tables of about ``limit`` bytes along the keys, by running totals over all tasks.

    ``key`` is unique. A table holds the rows that begin within its ``limit`` bytes, so it exceeds them by
    less than its last row. Nothing is sequential but a summary of stretches of keys.
    """
    total = with_running_total(rows, [], "key", size, key_stretch(rows, "key")(F.col("key")), "__before")
    return total.withColumn("table_no", F.floor(F.col("__before") / limit).cast("bigint")).drop("__before")
