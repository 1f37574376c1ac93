"""Applying a stream of inserts, updates and deletes to a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PUT, DELETE = 0, 1


def effective(feed: DataFrame) -> Column:
    """Changes that have an effect: kind put or delete, a key of at least one byte, a log sequence number."""
    return F.col("kind").isin(PUT, DELETE) & (F.octet_length("key") > 0) & F.col("seq").isNotNull()


def apply_changes(feed: DataFrame, partition: list[str], base: DataFrame | None = None, payload: list[str] | None = None, tombstones: bool = False) -> DataFrame:
    """Current state of a table after all changes of a feed.

    ``feed``: the ``partition`` columns, ``key, kind, value, seq`` and any others. Per partition and key
    the change with the greatest ``seq`` decides, whatever order changes arrive in; repeats of a change
    share its ``seq`` and are equal, so ranking keeps one of them. A put of a null or empty value acts as
    a delete, the value of a delete is ignored, and rows without effect (other or null kind, null or empty
    key, null seq) are skipped. Null partition values form a partition of their own.

    ``base``: an earlier result (``partition, key, seq`` and the payload); its rows take part as puts
    under the ``seq`` that made them. An empty feed gives the base back. A base of live rows has forgotten
    its deletes: a put that arrives later with a smaller ``seq`` than a delete brings the key back. Where
    changes may arrive late, keep the base with ``tombstones``: rows whose column ``deleted`` is true take
    part as deletes.

    Returns one row per live key: ``partition, key, seq`` and the ``payload`` columns; with ``tombstones``
    one row per key, with ``deleted`` (and a null payload where it is true). Only the columns
    asked for are shuffled; the rank of one row per key is taken before the shuffle as well as after it,
    so a hot key sends one row per task.
    """
    payload = payload or []
    has_value = F.coalesce(F.octet_length("value"), F.lit(0)) > 0
    live = (F.col("kind") == PUT) & has_value
    rows = feed.filter(effective(feed)).select(*partition, "key", "seq", *[c for c in payload], live.alias("__live"))
    if base is not None:
        rows = rows.unionByName(base.select(*partition, "key", "seq", *payload, (~F.col("deleted") if "deleted" in base.columns and "deleted" not in [*partition, *payload] else F.lit(True)).alias("__live")))
    latest = Window.partitionBy(*partition, "key").orderBy(F.col("seq").desc(), F.col("__live").asc())
    decided = rows.withColumn("__rank", F.row_number().over(latest)).filter("__rank = 1")
    if tombstones:
        return decided.select(*partition, "key", "seq", *[F.when(F.col("__live"), F.col(c)).alias(c) for c in payload], (~F.col("__live")).alias("deleted"))
    return decided.filter("__live").select(*partition, "key", "seq", *payload)
