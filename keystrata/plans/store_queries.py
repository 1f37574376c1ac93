"""Queries over the persistent table: each writes one to the shared folder, maintains it and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators.changefeed import effective
from keystrata.plans.changelog import LOG_SQL, change_log, user_key
from keystrata.plans.table_queries import _FNV
from keystrata.sources.scratch import new_folder
from keystrata.sources.store import KeyedTable
from keystrata.sources.tables import table


def _batches(spark: SparkSession, d: str) -> list[DataFrame]:
    """The change feed of all stores in three batches by WAL id; keys begin with their store in eight bytes."""
    feed = table(spark, d, "row_entry")
    feed = feed.filter(effective(feed) & F.col("store_id").isNotNull())
    key = F.concat(F.unhex(F.lpad(F.hex("store_id"), 16, "0")), F.col("key"))
    rows = feed.select(key.alias("key"), "kind", "value", "seq", F.coalesce(F.col("wal_id"), F.lit(81)).alias("w"))
    return [rows.filter(c).drop("w") for c in ("w <= 40", "w > 40 and w <= 80", "w > 80")]


def _open(spark: SparkSession) -> KeyedTable:
    return KeyedTable(spark, f"{new_folder(spark, 'keyed-table')}/t")


def _hex(rows: DataFrame) -> DataFrame:
    return rows.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Three batches written as WALs and scanned: the last change per key, by sequence number."""
    t = _open(spark)
    for batch in _batches(spark, d):
        t.write(batch)
    return _hex(t.scan())


def store_after_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Two batches flushed to level 0 and compacted into a run, a third on top in memory: the newest layer wins."""
    t = _open(spark)
    first, second, third = _batches(spark, d)
    for batch in (first, second):
        t.write(batch)
        t.flush_memory()
    t.compact(limit=2)
    t.write(third)
    return _hex(t.scan())


def store_reopened(spark: SparkSession, d: str) -> DataFrame:
    """One batch stored, one left in the log; opened again, every key of the third batch is asked for."""
    t = _open(spark)
    first, second, third = _batches(spark, d)
    t.write(first)
    t.flush_memory()
    t.write(second)
    t.close()
    found = KeyedTable(spark, t.root).multi_get(third)
    return found.select(F.hex("key").alias("key_hex"), "found", F.hex("value").alias("value_hex"))


def store_skips(spark: SparkSession, d: str) -> DataFrame:
    """Per wanted key, how many of three level-0 tables its lookup leaves out by range, and by filter."""
    t = _open(spark)
    log = change_log(spark, d)
    for condition in ("wal_id <= 200", "wal_id > 200 and wal_id <= 400", "wal_id > 400"):
        t.write(log.filter(condition).drop("wal_id"))
        t.flush_memory()
    wanted = table(spark, d, "customer").select(user_key(F.col("c_custkey")).alias("key"))
    return t.skips(wanted).withColumn("key", F.col("key").cast("string"))


QUERIES = {f.__name__: f for f in (store_roundtrip, store_after_compaction, store_reopened, store_skips)}

_FEED = """
WITH feed AS (SELECT concat(lpad(to_hex(store_id), 16, '0'), hex(key)) AS k, kind, value AS v, seq, CASE WHEN coalesce(wal_id, 81) <= 40 THEN 1 WHEN coalesce(wal_id, 81) <= 80 THEN 2 ELSE 3 END AS b
  FROM row_entry WHERE kind IN (0, 1) AND octet_length(key) > 0 AND seq IS NOT NULL AND store_id IS NOT NULL)
"""

ORACLE = {
    "store_roundtrip": _FEED + "SELECT k AS key_hex, hex(v) AS value_hex FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM feed) WHERE rn = 1 AND kind = 0",
    "store_after_compaction": _FEED + "SELECT k AS key_hex, hex(v) AS value_hex FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b DESC, seq DESC) AS rn FROM feed) WHERE rn = 1 AND kind = 0 AND (b = 3 OR octet_length(v) > 0)",
    "store_reopened": _FEED + """, won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b DESC, seq DESC) AS rn FROM feed WHERE b < 3) WHERE rn = 1 AND kind = 0 AND (b = 2 OR octet_length(v) > 0))
SELECT w.k AS key_hex, won.k IS NOT NULL AS found, hex(won.v) AS value_hex FROM (SELECT DISTINCT k FROM feed WHERE b = 3) w LEFT JOIN won ON w.k = won.k""",
    "store_skips": LOG_SQL + f""", tb AS (SELECT DISTINCT CASE WHEN wal <= 200 THEN 1 WHEN wal <= 400 THEN 2 ELSE 3 END AS t, k FROM log),
m AS (SELECT t, min(k) AS lo, max(k) AS hi, CAST(ceil(count(*) * 10 / 8) * 8 AS HUGEINT) AS bits FROM tb GROUP BY t),
ask AS (SELECT DISTINCT concat('u', lpad(CAST(c_custkey AS VARCHAR), 20, '0')) AS k FROM customer),
q AS (SELECT t, k, true AS inside FROM tb UNION ALL SELECT t, ask.k, false FROM ask, m),
hs AS (SELECT q.*, lo, hi, bits, ({_FNV.format(k='k')}) AS h FROM q JOIN m USING (t)),
pr AS (SELECT t, k, inside, lo, hi, unnest(list_transform(range(6), lambda i: ((h % 4294967296) % bits + i::HUGEINT * ((h // 4294967296) % bits) + ((i - 1) * i * (i + 1) // 6)::HUGEINT) % bits)) AS bit FROM hs),
s AS (SELECT DISTINCT t, bit FROM pr WHERE inside),
a AS (SELECT pr.t, k, k >= lo AND k <= hi AS in_range, bool_and(s.bit IS NOT NULL) AS maybe FROM pr LEFT JOIN s ON pr.t = s.t AND pr.bit = s.bit WHERE NOT inside GROUP BY ALL)
SELECT k AS key, count(*) AS tables, count(*) FILTER (NOT in_range) AS by_range, count(*) FILTER (in_range AND NOT maybe) AS by_filter FROM a GROUP BY k""",
}
