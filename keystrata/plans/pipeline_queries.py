"""Queries of the general training-data problems (snapshots, increments, change feeds, small files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators.changefeed import apply_changes
from keystrata.operators.incremental import IncrementalTable, visible_changes
from keystrata.operators.smallfiles import consolidate_rows, plan_consolidation, row_digest, small_objects
from keystrata.operators.snapshots import handle_changes
from keystrata.sources.scratch import new_folder, sent_if_small, written
from keystrata.sources.tables import table


def _handle_changes(spark: SparkSession, d: str) -> DataFrame:
    return handle_changes(table(spark, d, "core_state_snapshot"), table(spark, d, "manifest_file"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Handles that appeared, vanished or differ between consecutive snapshots of a store."""
    return _handle_changes(spark, d).drop("changed_fields")


def p1_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields that differ of every changed handle, joined by commas in name order."""
    return _handle_changes(spark, d).filter("change_kind = 'changed'").withColumn("changed_fields", F.array_join("changed_fields", ",")).drop("change_kind")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """WAL objects every committed run has to take: added or replaced between its manifest and the one before."""
    return visible_changes(table(spark, d, "immutable_wal"), table(spark, d, "core_db_state")).filter("change <> 'removed'").drop("change")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files added, replaced and removed between the manifests of a committed run and of the one before."""
    return visible_changes(table(spark, d, "immutable_wal"), table(spark, d, "core_db_state"))


def p2_processed(spark: SparkSession, d: str) -> DataFrame:
    """The feed processed by three runs over manifests of its WALs; what stands in the output at the end.

    The first manifest lists the WALs up to 40, the second those from 21 to 80 without their deletes
    (named by deletion vectors), the third all from 21 on, deletes back again and rows without key
    deleted. A run gets the records inserted and deleted since the version in the last commit; the output
    of deleted records is taken back. A row's position is the digest of its content, so repeats share one.
    """
    feed = table(spark, d, "row_entry").filter("store_id is not null and wal_id is not null")
    rows = feed.select(F.concat_ws("/", "store_id", "wal_id").alias("name"), F.lit("1").alias("version"), F.xxhash64("store_id", "wal_id", "kind", "seq", "key", F.isnull("key"), "value", F.isnull("value"), F.isnull("seq"), F.isnull("kind")).alias("position"), "store_id", "wal_id", "kind", "seq", "key")
    out = IncrementalTable(spark, f"{new_folder(spark, 'incremental')}/t")
    for run, (files, gone) in enumerate((("wal_id <= 40", "false"), ("wal_id between 21 and 80", "kind = 1"), ("wal_id > 20", "key is null"))):
        vector = F.collect_set(F.when(F.expr(gone), F.col("position")))
        manifest = rows.filter(files).groupBy("name", "version").agg(vector.alias("deleted_rows"))
        read = lambda names: rows.join(names.withColumnRenamed("version", "__v"), "name").filter("version = __v").select(*rows.columns)
        out.run(manifest, lambda delta: delta.select("store_id", "wal_id", "kind", "seq", F.hex("key").alias("key_hex"), "change"), f"run-{run}", read)
    return out.read().select("store_id", "wal_id", F.col("kind").cast("bigint").alias("kind"), "seq", "key_hex")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Live keys of every store with the change that made them."""
    live = apply_changes(table(spark, d, "row_entry"), ["store_id"])
    return live.select("store_id", F.hex("key").alias("key_hex"), "seq")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    """Live keys of every store with their values."""
    live = apply_changes(table(spark, d, "row_entry"), ["store_id"], payload=["value"])
    return live.select("store_id", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "seq")


def p3_merge(spark: SparkSession, d: str) -> DataFrame:
    """The feed applied in two parts, WAL ids up to 40 first: equal to applying it at once."""
    feed = table(spark, d, "row_entry")
    base = apply_changes(feed.filter("wal_id <= 40"), ["store_id"], payload=["value"], tombstones=True)
    live = apply_changes(feed.filter("wal_id > 40 or wal_id is null"), ["store_id"], base, ["value"])
    return live.select("store_id", F.hex("key").alias("key_hex"), "seq")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Small objects to be gathered: each stands in one target of the written plan."""
    return plan_consolidation(table(spark, d, "object_meta"), table(spark, d, "db_config")).select("object_id")


def p5_targets(spark: SparkSession, d: str) -> DataFrame:
    """How the plan gathers, per store, configuration and folder: objects, bytes and targets, and their balance."""
    plan = plan_consolidation(table(spark, d, "object_meta"), table(spark, d, "db_config"))
    each = plan.groupBy("store_id", "config_id", "folder", "target_no").agg(F.count("*").alias("objects"), F.sum("size_bytes").alias("bytes"), F.max("block_size").alias("block_size"))
    full = F.col("bytes") / F.col("block_size")
    return each.groupBy("store_id", "config_id", "folder").agg(F.sum("objects").alias("objects"), F.sum("bytes").alias("bytes"), F.count("*").alias("targets"), F.round(F.avg(full), 3).alias("mean_fill"), F.round(F.max(full), 3).alias("most_fill"), F.sum(F.when(full < 0.5, 1).otherwise(0)).alias("below_half"))


def p5_planned(spark: SparkSession, d: str) -> DataFrame:
    """Objects and bytes that the plan gathers, per store, configuration and folder."""
    return p5_targets(spark, d).select("store_id", "config_id", "folder", "objects", "bytes")


def p5_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the small WAL objects written into balanced files; digests of source and destination.

    Only WAL objects have rows in the tables; those of the other folder are planned like them. One row per
    store: objects before and files after, rows before and after, whether the row digests are equal, the
    bytes of rows in the fullest file and the length of the longest. The digest before is taken from the
    feed itself, object by object, apart from the rows that are gathered; files after are those the rows
    were read from.
    """
    small = small_objects(table(spark, d, "object_meta"), table(spark, d, "db_config")).filter("folder = 'wal'")
    small = small.select("store_id", F.regexp_extract("name", r"^([0-9]{20})\.sst$", 1).try_cast("bigint").alias("wal_id"), "config_id", "block_size").filter("wal_id is not null")
    small = written(small, "small-wals")
    feed = table(spark, d, "row_entry")
    data = feed.columns
    # numbered where the files are read, so that a row keeps its number when a task runs again
    rows = feed.withColumn("__row", F.monotonically_increasing_id()).join(sent_if_small(small), ["store_id", "wal_id"]).withColumn("__bytes", F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)) + 21)
    number = lambda part: F.conv(F.hex(part), 16, 10).try_cast("bigint")
    rows = rows.withColumn("__prefix", number(F.substring("key", 1, 6))).withColumn("__tail", number(F.substring("key", -6, 6)))
    out = consolidate_rows(rows, ["store_id", "config_id"], ["__prefix", "__tail", "seq"], "__bytes", "block_size", "__row", f"{new_folder(spark, 'consolidated')}/t")
    objects = row_digest(feed, data, ["store_id", "wal_id"]).join(small, ["store_id", "wal_id"])
    before = objects.groupBy("store_id").agg(F.sum("rows").alias("rows"), F.bit_xor("xor_hash").alias("xor_hash"), F.sum("sum_hash").alias("sum_hash"))
    files = small.groupBy("store_id").agg(F.count("*").alias("objects_before"))
    each = row_digest(out, data, ["store_id", "file_path"], F.sum("__bytes").alias("b"), F.max("file_bytes").alias("f"))
    after = each.groupBy("store_id").agg(F.sum("rows").alias("rows_after"), F.bit_xor("xor_hash").alias("x2"), F.sum("sum_hash").alias("s2"), F.count("*").alias("objects_after"), F.max("b").alias("largest_bytes"), F.max("f").alias("longest_file"))
    joined = before.join(after, "store_id", "left").join(files, "store_id")
    equal = F.col("rows").eqNullSafe(F.col("rows_after")) & F.col("xor_hash").eqNullSafe(F.col("x2")) & F.col("sum_hash").eqNullSafe(F.col("s2"))
    return joined.select("store_id", "objects_before", "objects_after", F.col("rows").alias("rows_before"), "rows_after", equal.alias("digests_equal"), "largest_bytes", "longest_file")


QUERIES = {f.__name__: f for f in (p1_found, p1_changed_fields, p2_found, p2_changes, p2_processed, p3_found, p3_state, p3_merge, p5_found, p5_planned, p5_targets, p5_consolidated)}

_P1 = """
WITH counted AS (
  SELECT store_id, manifest_id, l0, compacted FROM core_state_snapshot
  WHERE manifest_id IS NOT NULL AND (store_id, location) IN (SELECT store_id, location FROM manifest_file WHERE id IS NOT NULL)),
steps AS (SELECT store_id, manifest_id, lag(manifest_id) OVER (PARTITION BY store_id ORDER BY manifest_id) AS prev
          FROM (SELECT DISTINCT store_id, manifest_id FROM counted)),
handles AS (
  SELECT store_id, manifest_id, 'l0' AS layer, NULL::BIGINT AS run_id, unnest(l0) AS s FROM counted
  UNION ALL
  SELECT store_id, manifest_id, 'run', r.id, unnest(r.ssts) FROM (SELECT store_id, manifest_id, unnest(compacted) AS r FROM counted)),
rec AS (SELECT DISTINCT store_id, manifest_id, s.sst_id AS sst_id, layer, run_id, s.first_key AS first_key, s.index_offset AS index_offset, s.index_len AS index_len,
        s.filter_offset AS filter_offset, s.filter_len AS filter_len, s.codec AS codec FROM handles WHERE s.sst_id IS NOT NULL),
cur AS (SELECT st.prev, r.* FROM rec r JOIN steps st USING (store_id, manifest_id) WHERE st.prev IS NOT NULL),
old AS (SELECT st.manifest_id AS mid, r.* FROM rec r JOIN steps st ON r.store_id = st.store_id AND r.manifest_id = st.prev),
both_sides AS (
  SELECT coalesce(c.store_id, o.store_id) AS store_id, coalesce(c.prev, o.manifest_id) AS prev_manifest_id, coalesce(c.manifest_id, o.mid) AS manifest_id,
         coalesce(c.sst_id, o.sst_id) AS sst_id,
         CASE WHEN o.sst_id IS NULL THEN 'added' WHEN c.sst_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
         concat_ws(',', CASE WHEN c.codec IS DISTINCT FROM o.codec THEN 'codec' END, CASE WHEN c.filter_len IS DISTINCT FROM o.filter_len THEN 'filter_len' END,
           CASE WHEN c.filter_offset IS DISTINCT FROM o.filter_offset THEN 'filter_offset' END, CASE WHEN c.first_key IS DISTINCT FROM o.first_key THEN 'first_key' END,
           CASE WHEN c.index_len IS DISTINCT FROM o.index_len THEN 'index_len' END, CASE WHEN c.index_offset IS DISTINCT FROM o.index_offset THEN 'index_offset' END,
           CASE WHEN c.layer IS DISTINCT FROM o.layer THEN 'layer' END, CASE WHEN c.run_id IS DISTINCT FROM o.run_id THEN 'run_id' END) AS changed_fields
  FROM cur c FULL JOIN old o ON c.store_id = o.store_id AND c.manifest_id = o.mid AND c.sst_id = o.sst_id)
"""
_P2 = """
WITH v AS (SELECT DISTINCT store_id, id AS wal_id, last_modified, checksum FROM immutable_wal
           WHERE store_id IS NOT NULL AND id IS NOT NULL AND last_modified IS NOT NULL),
r AS (SELECT DISTINCT store_id, run_id, started_at, next_wal_sst_id AS upto FROM core_db_state WHERE status = 'committed' AND started_at IS NOT NULL AND store_id IS NOT NULL),
p AS (SELECT *, lag(run_id) OVER w AS before_run FROM r WINDOW w AS (PARTITION BY store_id ORDER BY started_at, run_id)),
seen AS (SELECT r.store_id, r.run_id, v.wal_id, max_by(struct_pack(c := v.checksum), (v.last_modified, v.checksum)) AS s
         FROM r JOIN v ON r.store_id = v.store_id AND v.wal_id < r.upto AND v.last_modified <= r.started_at GROUP BY ALL),
pairs AS (SELECT p.store_id, p.run_id AS run_new, p.before_run AS run_old FROM p),
new_side AS (SELECT store_id, run_new AS run_id, s.wal_id, s.s.c AS c FROM pairs JOIN seen s USING (store_id) WHERE s.run_id = run_new),
old_side AS (SELECT store_id, run_new AS run_id, s.wal_id, s.s.c AS c FROM pairs JOIN seen s USING (store_id) WHERE s.run_id = run_old),
found AS (SELECT coalesce(n.store_id, o.store_id) AS store_id, coalesce(n.run_id, o.run_id) AS run_id, coalesce(n.wal_id, o.wal_id) AS wal_id,
            CASE WHEN o.wal_id IS NULL THEN 'added' WHEN n.wal_id IS NULL THEN 'removed' ELSE 'replaced' END AS change
          FROM new_side n FULL JOIN old_side o ON n.store_id = o.store_id AND n.run_id = o.run_id AND n.wal_id = o.wal_id
          WHERE o.wal_id IS NULL OR n.wal_id IS NULL OR o.c IS DISTINCT FROM n.c)
"""
_P3 = """
WITH ranked AS (SELECT store_id, key, kind, value, seq, row_number() OVER (PARTITION BY store_id, key ORDER BY seq DESC) AS rn
                FROM row_entry WHERE kind IN (0, 1) AND octet_length(key) > 0 AND seq IS NOT NULL),
live AS (SELECT * FROM ranked WHERE rn = 1 AND kind = 0 AND octet_length(value) > 0)
"""
_P5 = r"""
WITH parts AS (SELECT o.*, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(location, '/'), lambda s: [s])),
    lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc
                        WHEN x[1] = '..' THEN CASE WHEN len(acc) = 0 OR acc[-1] = '..' THEN list_append(acc, '..') ELSE acc[1:len(acc) - 1] END
                        ELSE list_append(acc, x[1]) END) AS seg
  FROM object_meta o WHERE location IS NOT NULL),
latest AS (SELECT *, row_number() OVER (PARTITION BY store_id, array_to_string(seg, '/') ORDER BY last_modified DESC NULLS LAST, object_id) AS rn FROM parts),
small AS (SELECT l.object_id, l.store_id, l.config_id, l.size_bytes, seg[1] AS folder FROM latest l JOIN db_config c ON l.config_id = c.config_id
          WHERE rn = 1 AND len(seg) = 2 AND seg[1] IN ('wal', 'compacted') AND regexp_extract(seg[2], '\.[^.]*$') = '.sst' AND size_bytes > 0 AND size_bytes < c.block_size)
"""

ORACLE = {
    "p1_found": _P1 + "SELECT store_id, prev_manifest_id, manifest_id, sst_id, change_kind FROM both_sides WHERE change_kind <> 'changed' OR changed_fields <> ''",
    "p1_changed_fields": _P1 + "SELECT store_id, prev_manifest_id, manifest_id, sst_id, changed_fields FROM both_sides WHERE change_kind = 'changed' AND changed_fields <> ''",
    "p2_found": _P2 + "SELECT store_id, run_id, wal_id FROM found WHERE change <> 'removed'",
    "p2_changes": _P2 + "SELECT store_id, run_id, wal_id, change FROM found",
    "p2_processed": "SELECT store_id, wal_id, CAST(kind AS BIGINT) AS kind, seq, hex(key) AS key_hex FROM row_entry WHERE store_id IS NOT NULL AND wal_id > 20 AND key IS NOT NULL",
    "p3_found": _P3 + "SELECT store_id, hex(key) AS key_hex, seq FROM live",
    "p3_state": _P3 + "SELECT store_id, hex(key) AS key_hex, hex(value) AS value_hex, seq FROM live",
    "p3_merge": _P3 + "SELECT store_id, hex(key) AS key_hex, seq FROM live",
    "p5_found": _P5 + "SELECT object_id FROM small",
    "p5_planned": _P5 + "SELECT store_id, config_id, folder, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM small GROUP BY store_id, config_id, folder",
}
