"""The events table read as a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators.entries import DURABLE
from keystrata.operators.layers import number_wals, place
from keystrata.sources.tables import table

#: Policy of the oracle queries: unflushed WALs, WALs per level-0 table, level-0 tables per run.
UNFLUSHED, PER_LEVEL0, LEVEL0_PER_RUN = 12, 24, 4


def user_key(user: Column) -> Column:
    return F.concat(F.lit("u"), F.lpad(user.cast("string"), 20, "0")).cast("binary")


def change_log(spark: SparkSession, d: str, durable: bool = False) -> DataFrame:
    """``key, kind, value, seq, wal_id``: errors delete, sign-ups put an empty value, the rest puts ``props``.

    Every hour with events is one WAL. With ``durable`` the last durable WAL id stands beside every row.
    """
    hour = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour("ts")
    events = number_wals(table(spark, d, "events").withColumn("tick", hour), "tick")
    error = F.col("event_type") == "error"
    value = F.when(error, None).when(F.col("event_type") == "signup", "").otherwise(F.col("props")).cast("binary")
    more = [(F.col("last_wal_id") - UNFLUSHED).alias(DURABLE)] if durable else []
    return events.select(user_key(F.col("user_id")).alias("key"), error.cast("int").cast("tinyint").alias("kind"), value.alias("value"), F.col("event_id").alias("seq"), "wal_id", *more)


def placed_log(spark: SparkSession, d: str) -> DataFrame:
    """The change log with layer and unit of every row."""
    return place(change_log(spark, d, durable=True), PER_LEVEL0, LEVEL0_PER_RUN, F.col(DURABLE)).drop(DURABLE)


#: The same in SQL: tables t, log(seq, k, kind, v, wal), b(f), p(log columns, layer, unit).
LOG_SQL = f"""
WITH t AS (SELECT h, dense_rank() OVER (ORDER BY h) AS w FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events)),
log AS (SELECT event_id AS seq, concat('u', lpad(CAST(user_id AS VARCHAR), 20, '0')) AS k, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind,
        CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN '' ELSE props END AS v, CAST(w AS BIGINT) AS wal
        FROM events JOIN t ON date_trunc('hour', ts) = h),
b AS (SELECT max(wal) - {UNFLUSHED} AS f FROM log),
p AS (SELECT seq, k, kind, v, wal, layer, CAST(CASE layer WHEN 1 THEN l0 WHEN 0 THEN l0 // {LEVEL0_PER_RUN} ELSE 0 END AS BIGINT) AS unit FROM (
      SELECT *, (wal - 1) // {PER_LEVEL0} AS l0, CAST(CASE WHEN wal > f THEN 3 WHEN (wal - 1) // {PER_LEVEL0} >= f // {PER_LEVEL0} THEN 2
        WHEN (wal - 1) // {PER_LEVEL0} >= (f // {PER_LEVEL0} // {LEVEL0_PER_RUN}) * {LEVEL0_PER_RUN} THEN 1 ELSE 0 END AS BIGINT) AS layer FROM log, b)),
committed AS (SELECT * FROM (SELECT log.*, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log, b WHERE wal <= f) WHERE rn = 1),
uncommitted AS (SELECT * FROM (SELECT log.*, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
stored AS (SELECT layer, unit, k, seq, wal, CASE WHEN kind = 1 OR v = '' THEN 1 ELSE 0 END AS kind, CASE WHEN kind = 1 OR v = '' THEN NULL ELSE v END AS v FROM
      (SELECT *, row_number() OVER (PARTITION BY layer, unit, k ORDER BY seq DESC) AS rn FROM p WHERE layer <= 1) WHERE rn = 1)
"""
