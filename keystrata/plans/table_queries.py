"""One query per operator of the table engine, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions import codecs
from keystrata.functions.hashes import fnv1_halves, fnv1_hex, probe_bits, probe_bits_n, word_is_set, words_of
from keystrata.functions.paths import clean_path, clean_segments, extension
from keystrata.operators import compaction, entries, layers, merge, prune, read, rowformat
from keystrata.operators.ordering import key_stretch, with_running_max, with_running_total
from keystrata.plans.changelog import LOG_SQL, PER_LEVEL0, change_log, placed_log, user_key
from keystrata.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and, if SQL can state it, its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def text(name: str):
    return F.col(name).cast("string").alias(name)


def long(name: str):
    return F.col(name).cast("bigint").alias(name)


# reads


@query(LOG_SQL + "SELECT k AS key, v AS value, seq FROM committed WHERE kind = 0")
def get_committed_all(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d, durable=True)
    return read.get_all(log, read.COMMITTED).select(text("key"), text("value"), "seq")


@query(LOG_SQL + "SELECT k AS key, v AS value, seq FROM uncommitted WHERE kind = 0")
def get_uncommitted_all(spark: SparkSession, d: str) -> DataFrame:
    return read.get_all(change_log(spark, d), read.UNCOMMITTED).select(text("key"), text("value"), "seq")


@query(LOG_SQL + """SELECT coalesce(c.k, u.k) AS key, c.seq AS committed_seq, u.seq AS uncommitted_seq FROM
(SELECT * FROM committed WHERE kind = 0) c FULL JOIN (SELECT * FROM uncommitted WHERE kind = 0) u ON c.k = u.k WHERE c.seq IS DISTINCT FROM u.seq""")
def read_level_diff(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d, durable=True)
    c = read.get_all(log, read.COMMITTED).select("key", F.col("seq").alias("committed_seq"))
    u = read.get_all(log, read.UNCOMMITTED).select("key", F.col("seq").alias("uncommitted_seq"))
    return c.join(u, "key", "full").filter(~F.col("committed_seq").eqNullSafe(F.col("uncommitted_seq"))).select(text("key"), "committed_seq", "uncommitted_seq")


@query(LOG_SQL + """SELECT w.k AS key, c.k IS NOT NULL AS found, c.v AS value FROM
(SELECT DISTINCT concat('u', lpad(CAST(c_custkey AS VARCHAR), 20, '0')) AS k FROM customer) w LEFT JOIN (SELECT * FROM committed WHERE kind = 0) c ON w.k = c.k""")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d, durable=True)
    wanted = table(spark, d, "customer").select(user_key(F.col("c_custkey")).alias("key"))
    return read.multi_get(log, wanted, read.COMMITTED).select(text("key"), "found", text("value"))


@query(LOG_SQL + "SELECT k AS key, v AS value, seq FROM committed WHERE kind = 0 AND k = 'u00000000000000000007'")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d, durable=True)
    return read.get(log, b"u00000000000000000007", read.COMMITTED).select(text("key"), text("value"), "seq")


@query(LOG_SQL + "SELECT k AS key, seq FROM committed WHERE kind = 1")
def deleted_keys(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d, durable=True)
    return read.deleted_keys(log, read.COMMITTED).select(text("key"), "seq")


@query(LOG_SQL + "SELECT k AS key, seq FROM log l WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM log o WHERE o.k = l.k AND o.kind = 0 AND o.seq < l.seq)")
def delete_missing_key(spark: SparkSession, d: str) -> DataFrame:
    """Deletes of keys that no earlier put made: legal, they only leave a tombstone."""
    log = change_log(spark, d)
    first = log.filter("kind = 0").groupBy("key").agg(F.min("seq").alias("first_put"))
    return log.filter("kind = 1").join(first, "key", "left").filter("first_put is null or first_put > seq").select(text("key"), "seq")


@query(LOG_SQL + "SELECT k AS key, seq FROM uncommitted WHERE kind = 0 AND v = ''")
def empty_value_memory(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose value reads as empty while nothing was stored."""
    return read.get_all(change_log(spark, d), read.UNCOMMITTED).filter("octet_length(value) = 0").select(text("key"), "seq")


@query(LOG_SQL + "SELECT k AS key, v AS value, seq FROM uncommitted WHERE kind = 0 AND v <> ''")
def empty_value_flushed(spark: SparkSession, d: str) -> DataFrame:
    """Live keys once everything is stored: empty values have become tombstones."""
    return entries.live(entries.empty_as_tombstone(entries.latest(change_log(spark, d)))).select(text("key"), text("value"), "seq")


@query(LOG_SQL + "SELECT k AS key, seq, CAST(kind AS BIGINT) AS kind, v AS value, lead(seq) OVER (PARTITION BY k ORDER BY seq) AS until_seq FROM log")
def key_history(spark: SparkSession, d: str) -> DataFrame:
    return entries.history(change_log(spark, d)).select(text("key"), "seq", long("kind"), text("value"), "until_seq")


@query(LOG_SQL + "SELECT k AS key, v AS value FROM committed WHERE kind = 0 AND k >= 'u00000000000000000040' AND k < 'u00000000000000000090'")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d, durable=True)
    return read.scan(log, b"u00000000000000000040", b"u00000000000000000090", read.COMMITTED).select(text("key"), text("value"))


@query(LOG_SQL + "SELECT k AS key, v AS value FROM committed WHERE kind = 0 AND starts_with(k, 'u0000000000000000001')")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d, durable=True)
    return read.scan_prefix(log, b"u0000000000000000001", read.COMMITTED).select(text("key"), text("value"))


@query(LOG_SQL + "SELECT k AS key, CAST(kind AS BIGINT) AS kind, row_number() OVER (ORDER BY k) AS position FROM committed")
def ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    """All keys in byte order, tombstones included, with their position: counted per key range, then summed."""
    log = change_log(spark, d, durable=True)
    rows = entries.latest(read.at_level(log, read.COMMITTED))
    numbered = with_running_total(rows.withColumn("one", F.lit(1)), [], "key", "one", key_stretch(log, "key")(F.col("key")), "before")
    return numbered.select(text("key"), long("kind"), (F.col("before") + 1).cast("bigint").alias("position"))


# log and memory


@query(LOG_SQL + "SELECT wal AS wal_id, count(*) AS changes, count(DISTINCT k) AS keys, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY wal")
def wal_freeze(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d)
    return log.groupBy("wal_id").agg(F.count("*").alias("changes"), F.countDistinct("key").alias("keys"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(LOG_SQL + "SELECT DISTINCT wal AS wal_id, concat('wal/', lpad(CAST(wal AS VARCHAR), 20, '0'), '.sst') AS location FROM log WHERE wal > 100")
def wal_list_after(spark: SparkSession, d: str) -> DataFrame:
    ids = change_log(spark, d).filter("wal_id > 100").select("wal_id").distinct()
    return ids.select("wal_id", F.concat(F.lit("wal/"), F.lpad(F.col("wal_id").cast("string"), 20, "0"), F.lit(".sst")).alias("location")).orderBy("wal_id")


@query(LOG_SQL + "SELECT wal AS wal_id, k AS key, max(seq) AS seq FROM log GROUP BY wal, k")
def wal_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return entries.latest(change_log(spark, d), ["wal_id"]).select("wal_id", text("key"), "seq")


@query(LOG_SQL + """SELECT wal AS wal_id, CAST(sum(length(k) + 1 + coalesce(strlen(v), 0)) AS BIGINT) AS bytes FROM
(SELECT *, row_number() OVER (PARTITION BY wal, k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 GROUP BY wal""")
def memtable_size(spark: SparkSession, d: str) -> DataFrame:
    return layers.memory_size(change_log(spark, d), ["wal_id"]).select("wal_id", long("bytes"))


@query(LOG_SQL + "SELECT k AS key, CAST(kind AS BIGINT) AS kind, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM p WHERE layer = 2) WHERE rn = 1 AND k >= 'u00000000000000000050'")
def memtable_range_from(spark: SparkSession, d: str) -> DataFrame:
    """Rows of memory from a key on, tombstones included."""
    memory = placed_log(spark, d).filter(F.col("layer") == layers.MEMORY)
    return entries.latest(memory.filter(F.col("key") >= F.lit(b"u00000000000000000050"))).select(text("key"), long("kind"), "seq").orderBy("key")


@query(LOG_SQL + """, f AS (SELECT max(wal) AS w FROM p WHERE layer <= 1), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log, f WHERE wal > w)
SELECT k AS key, CAST(kind AS BIGINT) AS kind, v AS value, seq, wal AS wal_id FROM r WHERE rn = 1""")
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """Memory after recovery: the log above the last compacted WAL id."""
    log = change_log(spark, d, durable=True)
    memory = layers.replay(log, layers.last_compacted(F.col(entries.DURABLE), PER_LEVEL0))
    return memory.select(text("key"), long("kind"), text("value"), "seq", "wal_id")


@query(LOG_SQL.replace("WITH t AS", "WITH RECURSIVE t AS") + """, kw AS (SELECT wal, length(k) + 1 + coalesce(strlen(v), 0) AS b, lead(wal) OVER (PARTITION BY k ORDER BY wal) AS nxt FROM (SELECT *, row_number() OVER (PARTITION BY wal, k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
w AS (SELECT CAST(1 AS BIGINT) AS wal, CAST(1 AS BIGINT) AS since, (SELECT CAST(sum(b) AS BIGINT) FROM kw WHERE wal = 1) AS held
  UNION ALL SELECT n.wal, n.since, (SELECT CAST(sum(b) AS BIGINT) FROM kw WHERE kw.wal >= n.since AND kw.wal <= n.wal AND (nxt IS NULL OR nxt > n.wal)) FROM
  (SELECT wal + 1 AS wal, CASE WHEN held >= 4096 THEN wal + 1 ELSE since END AS since FROM w WHERE wal < (SELECT max(wal) FROM kw)) n)
SELECT wal AS wal_id, held AS memory_bytes, held >= 4096 AS frozen FROM w""")
def memtable_freeze_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Which WALs freeze memory at 4 KiB of net size."""
    return layers.freeze_by_size(change_log(spark, d), 4096)


@query(LOG_SQL + "SELECT seq, CASE WHEN kind = 1 THEN '01' ELSE concat('00', hex(v)) END AS stored, CAST(kind AS BIGINT) AS kind, v AS value FROM log")
def value_codec(spark: SparkSession, d: str) -> DataFrame:
    """Stored form of every value and what decoding it gives."""
    stored = change_log(spark, d).withColumn("stored", entries.encoded_value())
    back = entries.decoded_value(F.col("stored"))
    return stored.select("seq", F.hex("stored").alias("stored"), back["kind"].cast("bigint").alias("kind"), back["value"].cast("string").alias("value"))


# level 0, merge, compaction

_META = "min(k) AS first_key, max(k) AS last_key, count(*) AS num_rows, CAST(sum(kind) AS BIGINT) AS num_tombstones, CAST(sum(length(k) + 1 + coalesce(strlen(v), 0)) AS BIGINT) AS bytes"


def _meta(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("first_key", "last_key", "bytes")], text("first_key"), text("last_key"), long("bytes"))


@query(LOG_SQL + f"SELECT layer, unit, {_META} FROM stored GROUP BY layer, unit")
def l0_flush(spark: SparkSession, d: str) -> DataFrame:
    """Every stored table: last row per key, empty values as tombstones, and its metadata."""
    placed = placed_log(spark, d).filter(F.col("layer") <= layers.LEVEL0)
    return _meta(layers.table_meta(layers.flush(placed, ["layer", "unit"]), ["layer", "unit"]))


@query(LOG_SQL + """, m AS (SELECT layer, unit, min(k) AS a, max(k) AS z FROM stored GROUP BY layer, unit), w AS (SELECT DISTINCT concat('u', lpad(CAST(c_custkey AS VARCHAR), 20, '0')) AS k FROM customer)
SELECT layer, unit, count(*) FILTER (w.k >= a) AS by_first_key, count(*) FILTER (w.k >= a AND w.k <= z) AS by_range FROM m CROSS JOIN w GROUP BY layer, unit""")
def l0_may_include(spark: SparkSession, d: str) -> DataFrame:
    """How many wanted keys each table may hold, by its first key alone and by its range.

    Wanted keys and table bounds are sorted together once; a running count per bound answers both.
    """
    placed = placed_log(spark, d).filter(F.col("layer") <= layers.LEVEL0)
    meta = layers.table_meta(layers.flush(placed, ["layer", "unit"]), ["layer", "unit"])
    wanted = table(spark, d, "customer").select(user_key(F.col("c_custkey")).alias("key")).distinct()
    none = F.lit(None).cast("bigint")
    marks = wanted.select("key", F.lit(1).alias("n"), F.lit(1).alias("turn"), none.alias("layer"), none.alias("unit"), F.lit("key").alias("what"))
    marks = marks.unionByName(meta.select(F.col("first_key").alias("key"), F.lit(0).alias("n"), F.lit(0).alias("turn"), "layer", "unit", F.lit("first").alias("what")))
    marks = marks.unionByName(meta.select(F.col("last_key").alias("key"), F.lit(0).alias("n"), F.lit(2).alias("turn"), "layer", "unit", F.lit("last").alias("what")))
    marks = marks.withColumn("at", F.struct("key", "turn", "layer", "unit", "what"))
    counted = with_running_total(marks, [], "at", "n", key_stretch(marks, "key")(F.col("key")), "before")
    total = wanted.agg(F.count("*")).scalar()
    per = counted.filter("what <> 'key'").groupBy("layer", "unit").agg(F.max(F.when(F.col("what") == "first", F.col("before"))).alias("below"), F.max(F.when(F.col("what") == "last", F.col("before"))).alias("upto"))
    return per.select("layer", "unit", (total - F.col("below")).cast("bigint").alias("by_first_key"), (F.col("upto") - F.col("below")).cast("bigint").alias("by_range"))


_SOURCES = LOG_SQL + """, src AS (SELECT k, v, CASE layer WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS source, seq FROM (SELECT *, row_number() OVER (PARTITION BY layer, k ORDER BY seq DESC) AS rn FROM p) WHERE rn = 1),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source) AS rn FROM src) WHERE rn = 1)
"""


def _four_sources(spark: SparkSession, d: str) -> DataFrame:
    """Log, memory, level 0 and runs as sources 0 to 3, newest first, merged in one pass over the log."""
    rows = placed_log(spark, d).select("key", "value", "seq", (layers.LOG - F.col("layer")).alias("source"))
    return merge.merge_numbered(rows, newest="seq")


@query(_SOURCES + "SELECT k AS key, v AS value, CAST(source AS BIGINT) AS source, seq FROM merged")
def merge_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Four sorted sources merged, the first that has a key wins."""
    return _four_sources(spark, d).select(text("key"), text("value"), "source", "seq")


@query(_SOURCES + "SELECT source, k AS key, row_number() OVER (PARTITION BY source ORDER BY k) AS position FROM (SELECT CAST(source AS BIGINT) AS source, k FROM merged)")
def merge_sorted_position(spark: SparkSession, d: str) -> DataFrame:
    """Place of every winner in the key order of its source."""
    merged = _four_sources(spark, d)
    placed = with_running_total(merged.withColumn("one", F.lit(1)), ["source"], "key", "one", key_stretch(change_log(spark, d), "key")(F.col("key")), "before")
    return placed.select("source", text("key"), (F.col("before") + 1).cast("bigint").alias("position"))


@query(LOG_SQL + "SELECT unit AS run_id, k AS key, CAST(kind AS BIGINT) AS kind, v AS value, seq FROM stored WHERE layer = 0")
def compact_l0_to_sr(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every run made by merging level-0 tables, newest table first; tombstones stay."""
    placed = placed_log(spark, d).filter(F.col("layer") == layers.RUN)
    l0 = placed.withColumn("l0", F.floor((F.col("wal_id") - 1) / 24))
    tables = layers.flush(l0, ["unit", "l0"]).withColumn("source", -F.col("l0"))
    return merge.merge_numbered(tables, ["unit"]).select(F.col("unit").alias("run_id"), text("key"), long("kind"), text("value"), "seq")


@query(LOG_SQL + """, l AS (SELECT DISTINCT (wal - 1) // 24 AS l0 FROM log, b WHERE (wal - 1) // 24 < f // 24)
SELECT CAST(l0 // 4 AS BIGINT) AS run_id, count(*) AS tables, count(*) = 4 AS scheduled FROM l GROUP BY l0 // 4""")
def compaction_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Level-0 tables by the run they go to; a run is scheduled once it has four."""
    log = change_log(spark, d, durable=True)
    l0 = log.select(F.floor((F.col("wal_id") - 1) / PER_LEVEL0).alias("l0"), F.floor(F.col(entries.DURABLE) / PER_LEVEL0).alias("upto")).filter("l0 < upto").select("l0").distinct()
    return l0.groupBy(F.floor(F.col("l0") / 4).alias("run_id")).agg(F.count("*").alias("tables")).withColumn("scheduled", F.col("tables") == compaction.LEVEL0_LIMIT)


_LAYERED = LOG_SQL + """, all_rows AS (SELECT layer, unit, k, seq, kind, v FROM stored UNION ALL SELECT layer, unit, k, seq, kind, v FROM p WHERE layer = 2),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY layer DESC, unit DESC, seq DESC) AS rn FROM all_rows) WHERE rn = 1)
"""


@query(_LAYERED + "SELECT k AS key, v AS value, seq, layer FROM won WHERE kind = 0")
def layered_get(spark: SparkSession, d: str) -> DataFrame:
    return layers.layered_live(placed_log(spark, d)).select(text("key"), text("value"), "seq", "layer")


@query(_LAYERED + "SELECT layer, CAST(kind AS BIGINT) AS kind, count(*) AS keys FROM won GROUP BY layer, kind")
def layer_hit_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Which layer serves each key."""
    return layers.layered(placed_log(spark, d)).groupBy("layer", long("kind")).agg(F.count("*").alias("keys"))


@query(_LAYERED + "SELECT k AS key, v AS value, seq FROM won WHERE kind = 0")
def state_after_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Live rows when runs, level 0 and memory are merged as separate tables: the same as before compaction."""
    placed = placed_log(spark, d).filter(F.col("layer") < layers.LOG)
    tables = entries.latest(placed.withColumn("unit", F.when(F.col("layer") == layers.MEMORY, 0).otherwise(F.col("unit"))), ["layer", "unit"])
    every = entries.empty_as_tombstone(tables, F.col("layer") <= layers.LEVEL0)
    return entries.live(entries.latest(every, rank=["layer", "unit", "seq"])).select(text("key"), text("value"), "seq")


_SPLIT = LOG_SQL.replace("WITH t AS", "WITH RECURSIVE t AS") + """, o AS (SELECT unit, k, length(k) + coalesce(strlen(v), 0) AS s, row_number() OVER (PARTITION BY unit ORDER BY k) AS rn FROM stored WHERE layer = 0),
w AS (SELECT unit, k, rn, CAST(0 AS BIGINT) AS table_no, s AS total FROM o WHERE rn = 1
      UNION ALL SELECT o.unit, o.k, o.rn, w.table_no + CASE WHEN w.total > 1024 THEN 1 ELSE 0 END, CASE WHEN w.total > 1024 THEN 0 ELSE w.total END + o.s FROM w JOIN o ON o.unit = w.unit AND o.rn = w.rn + 1)
"""


@query(_SPLIT + "SELECT unit AS run_id, k AS key, table_no FROM w")
def sr_split_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Runs cut into tables after the row that takes a table over 1 KiB."""
    runs = layers.flush(placed_log(spark, d).filter(F.col("layer") == layers.RUN), ["layer", "unit"])
    return merge.roll(runs, ["unit"], 1024).select(F.col("unit").alias("run_id"), text("key"), "table_no")


# pruning


@query(_SPLIT + """, m AS (SELECT unit, table_no, min(k) AS a FROM w GROUP BY unit, table_no), q AS (SELECT DISTINCT unit, concat('u', lpad(CAST(c_custkey AS VARCHAR), 20, '0')) AS k FROM customer CROSS JOIN (SELECT DISTINCT unit FROM m))
SELECT q.unit AS run_id, q.k AS key, m.table_no FROM q ASOF LEFT JOIN m ON q.unit = m.unit AND q.k >= m.a""")
def sst_for_key(spark: SparkSession, d: str) -> DataFrame:
    """The table of each run that may hold each wanted key; none below the run's first key."""
    return _lookup(spark, d, clamp=False)


@query(_SPLIT + """, m AS (SELECT unit, table_no, min(k) AS a FROM w GROUP BY unit, table_no), q AS (SELECT DISTINCT unit, concat('u', lpad(CAST(c_custkey AS VARCHAR), 20, '0')) AS k FROM customer CROSS JOIN (SELECT DISTINCT unit FROM m))
SELECT q.unit AS run_id, q.k AS key, coalesce(m.table_no, 0) AS table_no FROM q ASOF LEFT JOIN m ON q.unit = m.unit AND q.k >= m.a""")
def block_for_key(spark: SparkSession, d: str) -> DataFrame:
    """As ``sst_for_key``, keys below the first block go to the first block."""
    return _lookup(spark, d, clamp=True)


def _lookup(spark: SparkSession, d: str, clamp: bool) -> DataFrame:
    runs = layers.flush(placed_log(spark, d).filter(F.col("layer") == layers.RUN), ["layer", "unit"])
    tables = merge.roll(runs.select("layer", "unit", "key", "value"), ["unit"], 1024).groupBy("unit", "table_no").agg(F.min("key").alias("first_key"))
    wanted = table(spark, d, "customer").select(user_key(F.col("c_custkey")).alias("key")).distinct()
    return prune.table_in_each(wanted, tables, "unit", "table_no", clamp).select(F.col("unit").alias("run_id"), text("key"), "table_no")


_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen({k}) + 1), lambda i: ascii(substr({k}, i, 1))::UHUGEINT)), lambda a, x: xor((a * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, x))"


@query(f"SELECT o_orderkey, lpad(upper(to_hex(({_FNV.format(k='k')})::UBIGINT)), 16, '0') AS hash FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)")
def key_hash(spark: SparkSession, d: str) -> DataFrame:
    """64-bit FNV-1 of every order key."""
    return table(spark, d, "orders").select("o_orderkey", fnv1_hex(F.col("o_orderkey").cast("string").cast("binary")).alias("hash"))


@query(f"""WITH h AS (SELECT o_orderkey, ({_FNV.format(k='k')}) AS h FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders))
SELECT o_orderkey, CAST(i AS BIGINT) AS probe, CAST(((h % 4294967296) % 1000000 + i * ((h // 4294967296) % 1000000) + (i - 1) * i * (i + 1) / 6) % 1000000 AS BIGINT) AS bit FROM h, (SELECT unnest(range(6))::HUGEINT AS i)""".replace("(i - 1) * i * (i + 1) / 6", "(i - 1) * i * (i + 1) // 6"))
def bloom_probes(spark: SparkSession, d: str) -> DataFrame:
    """The six probe positions of every order key in a filter of a million bits."""
    bits = probe_bits(fnv1_halves(F.col("o_orderkey").cast("string").cast("binary")), F.lit(1_000_000).cast("bigint"), 6)
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(bits).alias("probe", "bit")).select("o_orderkey", long("probe"), "bit")


@query(f"""WITH o AS (SELECT o_orderpriority AS grp, CAST(o_orderkey AS VARCHAR) AS k FROM orders),
n AS (SELECT grp, CAST(ceil(count(DISTINCT k) * 10 / 8) * 8 AS HUGEINT) AS bits FROM o GROUP BY grp),
q AS (SELECT grp, k, true AS present FROM o UNION SELECT grp, concat(k, '#'), false FROM o),
h AS (SELECT q.*, bits, ({_FNV.format(k='k')}) AS h FROM q JOIN n USING (grp)),
pr AS (SELECT grp, k, present, unnest(list_transform(range(6), lambda i: ((h % 4294967296) % bits + i::HUGEINT * ((h // 4294967296) % bits) + ((i - 1) * i * (i + 1) // 6)::HUGEINT) % bits)) AS bit FROM h),
s AS (SELECT DISTINCT grp, bit FROM pr WHERE present),
a AS (SELECT pr.grp, k, present, bool_and(s.bit IS NOT NULL) AS maybe FROM pr LEFT JOIN s ON pr.grp = s.grp AND pr.bit = s.bit GROUP BY ALL)
SELECT a.grp, CAST(max(bits) AS BIGINT) AS bits, count(*) FILTER (present AND NOT maybe) AS false_negatives, count(*) FILTER (NOT present) AS absent, count(*) FILTER (NOT present AND maybe) AS false_positives FROM a JOIN n USING (grp) GROUP BY a.grp""")
def bloom_false_positive(spark: SparkSession, d: str) -> DataFrame:
    """Filters over the order keys of each priority, probed with all of them and with as many absent keys."""
    keys = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").cast("string").alias("k"))
    filters = prune.filter_words(keys.select("grp", F.col("k").cast("binary").alias("key")), ["grp"])
    asked = keys.select("grp", F.col("k").cast("binary").alias("key")).unionByName(keys.select("grp", F.concat("k", F.lit("#")).cast("binary").alias("key")))
    answers = prune.probe_filters(asked, filters, ["grp"]).withColumn("present", ~F.col("key").cast("string").endswith("#"))
    sizes = filters.groupBy("grp").agg(F.max("bits").alias("bits"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    maybe = F.col("maybe")
    return answers.groupBy("grp").agg(count(F.col("present") & ~maybe).alias("false_negatives"), count(~F.col("present")).alias("absent"), count(~F.col("present") & maybe).alias("false_positives")).join(sizes, "grp").select("grp", "bits", "false_negatives", "absent", "false_positives")


_BYTE = "((instr('0123456789ABCDEF', substr({h}, 2 * ({i})::BIGINT + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr({h}, 2 * ({i})::BIGINT + 2, 1)) - 1)"
_FNV_BLOB = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(length(hx) // 2), lambda i: " + _BYTE.format(h="hx", i="i") + "::UHUGEINT)), lambda a, x: xor((a * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, x))"


@query(f"""WITH f AS (SELECT sst_id, store_id, first_wal_id, last_wal_id, num_probes, hex(data) AS dx, CAST(octet_length(data) * 8 AS HUGEINT) AS bits FROM
  (SELECT *, row_number() OVER (PARTITION BY sst_id) AS rn FROM sst_filter WHERE octet_length(data) > 0 AND num_probes > 0) WHERE rn = 1),
a AS (SELECT DISTINCT f.sst_id, hex(r.key) AS hx FROM f JOIN row_entry r ON r.store_id = f.store_id AND r.wal_id BETWEEN f.first_wal_id AND f.last_wal_id WHERE octet_length(r.key) > 0),
h AS (SELECT hx, ({_FNV_BLOB})::HUGEINT AS h FROM (SELECT DISTINCT hx FROM a)),
p AS (SELECT sst_id, dx, unnest(list_transform(range(num_probes), lambda i: ((h % 4294967296) % bits + i::HUGEINT * ((h // 4294967296) % bits) + ((i - 1) * i * (i + 1) // 6)::HUGEINT) % bits)) AS bit, hx FROM a JOIN f USING (sst_id) JOIN h USING (hx)),
m AS (SELECT sst_id, hx, bool_and(({_BYTE.format(h='dx', i='bit // 8')} // (1 << CAST(bit % 8 AS INTEGER))) % 2 = 1) AS maybe FROM p GROUP BY ALL)
SELECT sst_id, count(*) AS keys, count(*) FILTER (NOT maybe) AS missed FROM m GROUP BY sst_id""")
def stored_filter_probe(spark: SparkSession, d: str) -> DataFrame:
    """Every stored filter asked for each key of its WALs: there must be no wrong "no".

    Filters without data say nothing and are left out. One row per filter: keys asked, keys missed.
    """
    filters = table(spark, d, "sst_filter").filter("octet_length(data) > 0 and num_probes > 0").dropDuplicates(["sst_id"])
    spans = filters.select("sst_id", "store_id", F.explode(F.sequence("first_wal_id", "last_wal_id")).alias("wal_id"))
    keys = table(spark, d, "row_entry").filter("octet_length(key) > 0").select("store_id", "wal_id", "key").distinct()
    asked = keys.join(spans, ["store_id", "wal_id"]).select("sst_id", "key").distinct().withColumn("h", fnv1_halves(F.col("key")))
    held = filters.select("sst_id", "num_probes", (F.octet_length("data") * 8).cast("bigint").alias("bits"), words_of(F.col("data")).alias("words"))
    probes = asked.join(held, "sst_id").select("sst_id", F.forall(probe_bits_n(F.col("h"), F.col("bits"), F.col("num_probes")), lambda bit: word_is_set(F.element_at("words", (F.shiftright(bit, 6) + 1).cast("int")), bit)).alias("maybe"))
    return probes.groupBy("sst_id").agg(F.count("*").alias("keys"), F.sum(F.when(F.col("maybe"), 0).otherwise(1)).cast("bigint").alias("missed"))


# format


@query(LOG_SQL + "SELECT seq, CAST(13 + strlen(k) + 8 + CASE WHEN kind = 1 THEN 0 ELSE 4 + strlen(v) END AS BIGINT) AS bytes FROM log")
def row_encoded_size(spark: SparkSession, d: str) -> DataFrame:
    """Encoded bytes of every entry, with a creation time and without expiry."""
    size = rowformat.row_size(F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(0)), F.col("kind") == 1, F.lit(None).cast("timestamp"), F.lit(0).cast("timestamp"))
    return change_log(spark, d).select("seq", size.alias("bytes"))


@query("SELECT store_id, seq, key_hex, CAST(sum(f) AS BIGINT) AS flags FROM (SELECT DISTINCT store_id, seq, coalesce(hex(key), '') AS key_hex, coalesce(kind, -2) AS kd, hex(value), CASE WHEN kind = 1 THEN 1 ELSE 0 END + CASE WHEN expire_at IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN created_at IS NOT NULL THEN 4 ELSE 0 END AS f FROM row_entry) GROUP BY ALL")
def row_flags(spark: SparkSession, d: str) -> DataFrame:
    """Presence flags of the rows of the feed, summed over the distinct changes of a key and sequence number."""
    f = rowformat.flags(F.coalesce(F.col("kind") == 1, F.lit(False)), F.col("expire_at"), F.col("created_at"))
    rows = table(spark, d, "row_entry").select("store_id", "seq", F.coalesce(F.hex("key"), F.lit("")).alias("key_hex"), F.coalesce("kind", F.lit(-2)).alias("kd"), F.hex("value").alias("v"), f.alias("f")).distinct()
    return rows.groupBy("store_id", "seq", "key_hex").agg(F.sum("f").cast("bigint").alias("flags"))


@query("""WITH f AS (SELECT p_brand, min(p_name) AS first_name FROM part GROUP BY p_brand)
SELECT p_partkey, CAST(len(list_filter(range(1, least(strlen(p_name), strlen(first_name)) + 1), lambda i: substr(p_name, 1, i) = substr(first_name, 1, i))) AS BIGINT) AS prefix_bytes FROM part JOIN f USING (p_brand)""")
def prefix_len(spark: SparkSession, d: str) -> DataFrame:
    """Bytes each part name shares with the first name of its brand, and nothing lost in restoring it."""
    part = table(spark, d, "part")
    firsts = part.groupBy("p_brand").agg(F.min("p_name").alias("first_name"))
    shared = rowformat.common_prefix(F.col("p_name").cast("binary"), F.col("first_name").cast("binary"))
    return part.join(firsts, "p_brand").select("p_partkey", shared.alias("prefix_bytes"))


@query(LOG_SQL.replace("WITH t AS", "WITH RECURSIVE t AS") + """, o AS (SELECT layer, unit, k, kind, coalesce(strlen(v), 0) AS vs, row_number() OVER (PARTITION BY layer, unit ORDER BY k) AS rn FROM stored),
w AS (SELECT layer, unit, k, rn, CAST(0 AS BIGINT) AS block_no, k AS first_key, CAST(1 AS BIGINT) AS n, CAST(13 + strlen(k) + CASE WHEN kind = 1 THEN 0 ELSE 4 + vs END AS BIGINT) AS size FROM o WHERE rn = 1
  UNION ALL SELECT layer, unit, k, rn, CASE WHEN big THEN block_no + 1 ELSE block_no END, CASE WHEN big THEN k ELSE first_key END, CASE WHEN big THEN 1 ELSE n + 1 END, CASE WHEN big THEN whole ELSE size + whole - shared END
  FROM (SELECT *, 2 + (n + 1) * 2 + size + whole - shared > 512 AS big FROM (
    SELECT o.layer, o.unit, o.k, o.rn, w.block_no, w.first_key, w.n, w.size, CAST(13 + strlen(o.k) + CASE WHEN o.kind = 1 THEN 0 ELSE 4 + o.vs END AS BIGINT) AS whole,
      len(list_filter(range(1, least(strlen(o.k), strlen(w.first_key)) + 1), lambda i: substr(o.k, 1, i) = substr(w.first_key, 1, i))) AS shared
    FROM w JOIN o ON o.layer = w.layer AND o.unit = w.unit AND o.rn = w.rn + 1)))
SELECT layer, unit, block_no, max(first_key) AS first_key, max(n) AS num_rows, CAST(2 + max(n) * 2 + max(size) + 4 AS BIGINT) AS encoded_bytes FROM w GROUP BY layer, unit, block_no""")
def block_cut(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 512 bytes of every stored table."""
    stored = layers.flush(placed_log(spark, d).filter(F.col("layer") <= layers.LEVEL0), ["layer", "unit"])
    return rowformat.cut_blocks(stored, ["layer", "unit"], 512).select("layer", "unit", "block_no", text("first_key"), "num_rows", "encoded_bytes")


@query(LOG_SQL + "SELECT layer, unit, k AS key, CAST(kind AS BIGINT) AS kind, v AS value, seq, 0 AS problems FROM stored")
def block_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Stored tables encoded into blocks with checksums, decoded again; with the number of corrupt blocks."""
    stored = layers.flush(placed_log(spark, d).filter(F.col("layer") <= layers.LEVEL0), ["layer", "unit"])
    blocks = rowformat.encode_blocks(rowformat.place_in_blocks(stored, ["layer", "unit"], 512), ["layer", "unit"], "zstd")
    rows, warnings = rowformat.decode_blocks(blocks, ["layer", "unit"], "zstd")
    problems = warnings.agg(F.count("*").cast("int")).scalar()
    return rows.select("layer", "unit", text("key"), long("kind"), text("value"), "seq", problems.alias("problems"))


@query("""SELECT doc_id, c.codec, CASE c.codec WHEN 'none' THEN substr(hex(encode(text)), 1, 8) ELSE lpad(to_hex(octet_length(encode(text))), 8, '0') END AS head, true AS "equal"
FROM documents, (SELECT unnest(['none', 'snappy', 'zlib', 'lz4', 'zstd']) AS codec) c""")
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every text through every codec and back, and what the compressed form begins with: the plain length."""
    data = F.col("text").cast("binary")
    each = table(spark, d, "documents").select("doc_id", data.alias("data"), F.explode(F.array(*map(F.lit, codecs.CODECS))).alias("codec"))
    packed = each.withColumn("packed", codecs.compressed(F.col("data"), F.col("codec")))
    back = packed.withColumn("back", codecs.decompressed(F.col("packed"), F.col("codec")))
    return back.select("doc_id", "codec", F.hex(F.substring("packed", 1, 4)).alias("head"), F.col("data").eqNullSafe(F.col("back")).alias("equal"))


@query("SELECT sst_id, concat(lpad(to_hex(num_probes), 4, '0'), hex(data)) AS stored, true AS \"equal\" FROM sst_filter WHERE data IS NOT NULL")
def filter_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Stored form of every filter up to its checksum; read back plain and compressed."""
    f = table(spark, d, "sst_filter").filter("data is not null")
    stored = f.withColumn("stored", rowformat.encoded_filter(F.col("num_probes"), F.col("data")))
    packed = stored.withColumn("back", rowformat.decoded_filter(rowformat.encoded_filter(F.col("num_probes"), F.col("data"), "zstd"), "zstd"))
    plain = packed.withColumn("plain", rowformat.decoded_filter(F.col("stored")))
    equal = lambda c: F.col(f"{c}.num_probes").eqNullSafe(F.col("num_probes")) & F.col(f"{c}.data").eqNullSafe(F.col("data"))
    return plain.select("sst_id", F.hex(F.substring(F.col("stored"), F.lit(1), F.octet_length("stored") - 4)).alias("stored"), (equal("back") & equal("plain")).alias("equal"))


@query(LOG_SQL + "SELECT layer, unit, min(k) AS first_key, 'zstd' AS codec, CAST(ceil(count(*) * 10 / 8) * 8 AS BIGINT) AS filter_bits, CAST(6 AS BIGINT) AS num_probes, true AS index_in_order FROM stored GROUP BY layer, unit")
def table_infos(spark: SparkSession, d: str) -> DataFrame:
    """Info, index and filter read back from stored tables as bytes."""
    opened = _tables_as_bytes(spark, d).withColumn("info", rowformat.table_info(F.col("table")))
    opened = opened.withColumn("f", rowformat.decoded_filter(rowformat.table_filter(F.col("table"), F.col("info")), "zlib")).withColumn("index", rowformat.table_index(F.col("table"), F.col("info")))
    keys = F.transform("index", lambda x: x["first_key"])
    return opened.select("layer", "unit", F.col("info.first_key").cast("string").alias("first_key"), "info.codec", (F.octet_length("f.data") * 8).cast("bigint").alias("filter_bits"), F.col("f.num_probes").alias("num_probes"), keys.eqNullSafe(F.array_sort(keys)).alias("index_in_order"))


def _tables_as_bytes(spark: SparkSession, d: str) -> DataFrame:
    unit = ["layer", "unit"]
    stored = layers.flush(placed_log(spark, d).filter(F.col("layer") <= layers.LEVEL0), unit)
    blocks = rowformat.encode_blocks(rowformat.place_in_blocks(stored, unit, 512), unit, "zstd")
    packed = prune.pack_filters(prune.filter_words(stored, unit), unit)
    filters = packed.select(*unit, rowformat.encoded_filter(F.lit(6), F.col("data"), "zlib").alias("filter"))
    return rowformat.encode_tables(blocks, unit, filters, "zstd")


@query(LOG_SQL + "SELECT layer, unit, min(k) <= 'u00000000000000000007' AND max(k) >= 'u00000000000000000007' AS covers FROM stored GROUP BY layer, unit")
def range_covers_key(spark: SparkSession, d: str) -> DataFrame:
    """Whether the range of each stored table covers a key."""
    stored = layers.flush(placed_log(spark, d).filter(F.col("layer") <= layers.LEVEL0), ["layer", "unit"])
    meta = layers.table_meta(stored, ["layer", "unit"])
    return meta.select("layer", "unit", prune.covers(F.col("first_key"), F.lit(b"u00000000000000000007"), F.col("last_key")).alias("covers"))


@query("SELECT DISTINCT sst_id, CAST(list_sum(list_transform(range(1, 11), lambda i: (position(substr(sst_id, i, 1) IN '0123456789ABCDEFGHJKMNPQRSTVWXYZ') - 1) * CAST(32 AS BIGINT) ** (10 - i))) AS BIGINT) AS millis FROM sst_filter")
def sortable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Creation time in the id of every filter's table."""
    return table(spark, d, "sst_filter").select("sst_id", codecs.id_millis(F.col("sst_id")).alias("millis")).distinct()


@query()
def checksum(spark: SparkSession, d: str) -> DataFrame:
    """CRC32 of every document's bytes."""
    return table(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN concat(substr(text, 1, 57), '...') ELSE text END AS short FROM documents")
def truncate_dump(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rowformat.truncated(F.col("text"), 60).alias("short"))


@query(LOG_SQL + f"SELECT CASE layer WHEN 1 THEN 'L0' ELSE 'SR' END AS layer, unit AS ord, {_META} FROM stored GROUP BY layer, unit")
def sst_dump(spark: SparkSession, d: str) -> DataFrame:
    """The report of a state: its stored tables with ranges and counts."""
    stored = layers.flush(placed_log(spark, d).filter(F.col("layer") <= layers.LEVEL0), ["layer", "unit"])
    return _meta(layers.table_meta(stored, ["layer", "unit"])).withColumn("layer", F.when(F.col("layer") == layers.LEVEL0, "L0").otherwise("SR")).withColumnRenamed("unit", "ord")


@query("SELECT o_orderkey, concat(lpad(to_hex(97 + ((o_orderkey // 17576) % 26)), 2, '0'), lpad(to_hex(97 + ((o_orderkey // 676) % 26)), 2, '0'), lpad(to_hex(97 + ((o_orderkey // 26) % 26)), 2, '0'), lpad(to_hex(97 + (o_orderkey % 26)), 2, '0'), '2D') AS key FROM orders")
def ordered_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Byte counters: the order keys as base-26 counters of four letters."""
    keyed = rowformat.ordered_keys(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", b"-", 97, 122, 4)
    return keyed.select("o_orderkey", F.hex("key").alias("key"))


# manifests and objects

_COUNTED = "SELECT DISTINCT s.* EXCLUDE (delivered_at) FROM core_state_snapshot s JOIN (SELECT DISTINCT store_id, location FROM manifest_file WHERE id IS NOT NULL) m USING (store_id, location)"


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "manifest_file").filter("id is not null").select("store_id", "location").distinct()
    return table(spark, d, "core_state_snapshot").join(listed, ["store_id", "location"], "left_semi")


@query("SELECT store_id, max(id) AS manifest_id, lpad(CAST(max(id) AS VARCHAR), 20, '0') AS name FROM manifest_file WHERE id IS NOT NULL GROUP BY store_id")
def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest manifest of every store; foreign names do not count."""
    best = table(spark, d, "manifest_file").filter("id is not null").groupBy("store_id").agg(F.max("id").alias("manifest_id"))
    return best.withColumn("name", F.lpad(F.col("manifest_id").cast("string"), 20, "0"))


@query(f"""WITH c AS (SELECT DISTINCT store_id, manifest_id, writer_epoch, compactor_epoch FROM ({_COUNTED})), w AS (SELECT *, max(writer_epoch) OVER o AS mw, max(compactor_epoch) OVER o AS mc FROM c WINDOW o AS (PARTITION BY store_id ORDER BY manifest_id ROWS UNBOUNDED PRECEDING))
SELECT store_id, manifest_id, mw > writer_epoch AS writer_fenced, mc > compactor_epoch AS compactor_fenced FROM w""")
def epoch_fence(spark: SparkSession, d: str) -> DataFrame:
    """Whether a manifest was written by a holder that a later epoch had already fenced."""
    c = _manifests(spark, d).select("store_id", "manifest_id", "writer_epoch", "compactor_epoch").distinct()
    so_far = with_running_max(c, ["store_id"], "manifest_id", ["writer_epoch", "compactor_epoch"], F.floor(F.col("manifest_id") / 4096), ["w", "c"])
    return so_far.select("store_id", "manifest_id", (F.col("w") > F.col("writer_epoch")).alias("writer_fenced"), (F.col("c") > F.col("compactor_epoch")).alias("compactor_fenced"))


@query(f"""SELECT DISTINCT store_id, manifest_id, 'L0' AS layer, CAST(NULL AS BIGINT) AS run_id, unnest(l0).sst_id AS sst_id FROM ({_COUNTED})
UNION SELECT store_id, manifest_id, 'SR', r.id, unnest(r.ssts).sst_id FROM (SELECT store_id, manifest_id, unnest(compacted) AS r FROM ({_COUNTED}))""")
def manifest_dump(spark: SparkSession, d: str) -> DataFrame:
    """Every stored table listed by every manifest, once."""
    m = _manifests(spark, d)
    l0 = m.select("store_id", "manifest_id", F.lit("L0").alias("layer"), F.lit(None).cast("bigint").alias("run_id"), F.explode("l0").alias("s"))
    runs = m.select("store_id", "manifest_id", F.explode("compacted").alias("r")).select("store_id", "manifest_id", F.lit("SR").alias("layer"), F.col("r.id").alias("run_id"), F.explode("r.ssts").alias("s"))
    return l0.unionByName(runs).select("store_id", "manifest_id", "layer", "run_id", "s.sst_id").distinct()


@query(f"SELECT DISTINCT store_id, manifest_id, len(compacted) AS runs, len(list_filter(range(1, len(compacted)), lambda i: compacted[i].id <= compacted[i + 1].id)) = 0 AS in_order FROM ({_COUNTED})")
def runs_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Whether the run ids of a manifest strictly decrease, per delivered order of its list."""
    ids = F.transform("compacted", lambda r: r["id"])
    pairs = F.zip_with(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, 2, F.greatest(F.size(ids), F.lit(1))), lambda a, b: a > b)
    return _manifests(spark, d).select("store_id", "manifest_id", F.size("compacted").cast("bigint").alias("runs"), F.forall(pairs, lambda x: x).alias("in_order")).distinct()


@query(r"""SELECT object_id, regexp_extract(seg[-1], '\.[^.]*$') AS ext, CASE WHEN len(seg) = 2 AND seg[1] = 'wal' AND regexp_full_match(seg[2], '[0-9]{1,18}\.sst|0[0-9]{19}\.sst') THEN CAST(replace(seg[2], '.sst', '') AS BIGINT) END AS wal_id, array_to_string(seg, '/') AS path FROM (
SELECT object_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(location, '/'), lambda s: [s])), lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc WHEN x[1] = '..' THEN CASE WHEN len(acc) = 0 OR acc[-1] = '..' THEN list_append(acc, '..') ELSE acc[1:len(acc) - 1] END ELSE list_append(acc, x[1]) END) AS seg FROM object_meta)""")
def object_paths(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned path, extension and WAL id of every listed object."""
    parts = clean_segments(F.col("location"))
    name = F.element_at(parts, -1)
    number = F.regexp_extract(name, r"^([0-9]{1,18}|0[0-9]{19})\.sst$", 1)
    wal = F.when((F.size(parts) == 2) & (F.element_at(parts, 1) == "wal"), F.nullif(number, F.lit("")).try_cast("bigint"))
    return table(spark, d, "object_meta").select("object_id", extension(name).alias("ext"), wal.alias("wal_id"), clean_path(F.col("location")).alias("path"))


@query("SELECT store_id, min(id) AS first_id, max(id) AS last_id, count(DISTINCT id) AS ids, max(id) - min(id) + 1 = count(DISTINCT id) AS no_gaps FROM immutable_wal GROUP BY store_id")
def wal_gaps(spark: SparkSession, d: str) -> DataFrame:
    """WAL ids of a store have no gaps."""
    wals = table(spark, d, "immutable_wal").groupBy("store_id").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("id").alias("ids"))
    return wals.withColumn("no_gaps", F.col("last_id") - F.col("first_id") + 1 == F.col("ids"))


@query(LOG_SQL + "SELECT p.layer, count(*) AS versions, count(DISTINCT p.k) AS keys, CAST(sum(p.kind) AS BIGINT) AS tombstones, CAST(sum(CASE WHEN c.seq = p.seq AND c.kind = 0 THEN 1 ELSE 0 END) AS BIGINT) AS live FROM p LEFT JOIN uncommitted c ON p.k = c.k GROUP BY p.layer")
def space_amplification(spark: SparkSession, d: str) -> DataFrame:
    """Versions held per layer against those that are live."""
    placed = placed_log(spark, d)
    current = read.get_all(change_log(spark, d), read.UNCOMMITTED).select(F.col("key").alias("k"), F.col("seq").alias("live_seq"))
    joined = placed.join(current, F.col("key") == F.col("k"), "left")
    return joined.groupBy("layer").agg(F.count("*").alias("versions"), F.countDistinct("key").alias("keys"), F.sum(F.col("kind").cast("bigint")).alias("tombstones"), F.sum(F.when(F.col("seq") == F.col("live_seq"), 1).otherwise(0)).cast("bigint").alias("live"))
