"""A persistent keyed table: log, level 0 and sorted runs as Parquet behind a fenced manifest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.hashes import fnv1
from keystrata.operators.compaction import LEVEL0_LIMIT, Manifest, TableFile, everything
from keystrata.operators.entries import SCHEMA, checked, empty_as_tombstone, entry_size, latest, live
from keystrata.operators.layers import replay
from keystrata.operators.prune import may_include
from keystrata.operators.read import COMMITTED, UNCOMMITTED, prefix_end
from keystrata.sources.compactor import Compactor
from keystrata.sources.manifest import Fenced, FencedManifest, ManifestStore, describe
from keystrata.sources.scratch import SENT_BYTES, delete
from keystrata.sources.tables import TABLE_BYTES, TableStore

#: Wanted keys up to which tables are skipped by their filters before a read.
PROBED_KEYS = 10_000
_CHANGES = "key binary, kind tinyint, value binary, seq bigint"


class KeyedTable:
    """Puts and deletes in batches, reads by key or range, flushes and compactions.

    A batch written is durable and visible to committed reads once its manifest version exists; a batch
    only buffered is visible to uncommitted reads. Each read pins the manifest of its moment.

    Data is always written to folders of its own that no reader knows; creating the next manifest, which
    only the holder of the latest epoch can, makes it part of the table. A writer that is fenced or dies
    before that leaves nothing but such a folder.
    """

    def __init__(self, spark: SparkSession, root: str, codec: str = "snappy", level0_bytes: int = 64 << 20, table_bytes: int = TABLE_BYTES, min_filter_keys: int = 0):
        self.spark, self.root = spark, root.rstrip("/")
        self.codec, self.level0_bytes = codec, level0_bytes
        self.tables = TableStore(spark, self.root, codec, table_bytes, min_filter_keys)
        self.manifests = ManifestStore(spark, self.root)
        self.held = FencedManifest(self.manifests, "writer")
        self._buffer: list[DataFrame] = []
        self._pool: ThreadPoolExecutor | None = None
        self._compactor: Compactor | None = None

    # writing

    def write(self, changes: DataFrame, source: str | None = None, batch: int | None = None) -> int | None:
        """Append a batch of changes (``key, kind, value, seq``) as one WAL; returns its id.

        An empty batch makes no WAL. A ``batch`` number of a ``source`` that is not above the last one
        applied is skipped, so a batch delivered again after a failure changes nothing.
        """
        marked = source is not None and batch is not None
        applied = lambda m: marked and dict(m.batches).get(source, -1) >= batch
        if applied(self.held.refresh()):
            return None
        rows = checked(changes.select("key", F.col("kind").cast("tinyint").alias("kind"), "value", F.col("seq").cast("bigint").alias("seq")))
        name = uuid.uuid4().hex
        folder = f"{self.root}/wal/{name}"
        rows.write.option("compression", self.codec).parquet(folder)
        empty = self.spark.read.schema(_CHANGES).parquet(folder).isEmpty()

        def committed(m: Manifest) -> Manifest:
            if applied(m):
                return m
            marks = tuple(sorted({**dict(m.batches), source: batch}.items())) if marked else m.batches
            return replace(m, batches=marks) if empty else replace(m, batches=marks, next_wal_id=m.next_wal_id + 1, wals=(*m.wals, (m.next_wal_id, name)))

        try:
            after = self.held.update(committed)
        except Fenced:
            delete(self.spark, folder)
            raise
        return {n: i for i, n in after.wals}.get(name)

    def write_async(self, changes: DataFrame) -> Future:
        """``write`` without waiting: the result is done once the batch is durable. Batches keep their order."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(1)
        return self._pool.submit(self.write, changes)

    def buffer(self, changes: DataFrame) -> None:
        """Keep a batch for the next ``flush_log``; only uncommitted reads see it."""
        self._buffer.append(changes.select("key", F.col("kind").cast("tinyint").alias("kind"), "value", F.col("seq").cast("bigint").alias("seq")))

    def flush_log(self) -> int | None:
        """Make the buffered batches durable, as one WAL."""
        if not self._buffer:
            return None
        pending, self._buffer = reduce(DataFrame.unionByName, self._buffer), []
        return self.write(pending)

    def log(self, manifest: Manifest | None = None) -> DataFrame:
        """Rows of the WALs a manifest names, with their ids."""
        m = manifest or self.held.refresh()
        if not m.wals:
            return self.spark.createDataFrame([], SCHEMA)
        ids = F.create_map(*[F.lit(x) for i, name in m.wals for x in (name, i)])
        rows = self.spark.read.schema(_CHANGES).parquet(*[f"{self.root}/wal/{name}" for _, name in m.wals])
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return rows.withColumn("wal_id", F.element_at(ids, name).cast("bigint"))

    def memory(self, manifest: Manifest | None = None) -> DataFrame:
        """Last row per key of the WALs not yet in level 0. After a restart this is the recovery of memory."""
        m = manifest or self.held.refresh()
        return replay(self.log(m), m.last_compacted_wal_id)

    def flush_memory(self, force: bool = True) -> tuple[TableFile, ...]:
        """Write memory to level-0 tables; without ``force`` only if it has reached the size limit.

        Usually that is one table; beyond ``table_bytes`` there are several, whose keys do not overlap.
        """
        m = self.held.refresh()
        upto = m.next_wal_id - 1
        if upto <= m.last_compacted_wal_id:
            return ()
        rows = empty_as_tombstone(self.memory(m))
        if not force and (rows.agg(F.sum(entry_size())).first()[0] or 0) < self.level0_bytes:
            return ()
        made = self.tables.write(rows)

        def done(x: Manifest) -> Manifest:
            if x.last_compacted_wal_id != m.last_compacted_wal_id:  # someone else flushed these WALs
                return x
            return replace(x, level0=made + x.level0, last_compacted_wal_id=upto, wals=tuple(w for w in x.wals if w[0] > upto))

        after = self.held.update(done)
        return made if after.level0[: len(made)] == made else ()

    # compaction

    def compactor(self, limit: int = LEVEL0_LIMIT) -> Compactor:
        """The compactor that runs beside this writer; opened on first use, which fences any other."""
        if self._compactor is None:
            self._compactor = Compactor(self.spark, self.root, self.tables, limit)
        self._compactor.limit = limit
        return self._compactor

    def compact(self, limit: int = LEVEL0_LIMIT) -> int | None:
        """Run what compaction is due; the id of the run made, None if nothing was."""
        return next(iter(self.compactor(limit).run_once()), None)

    def major_compact(self) -> int | None:
        """Merge everything stored into one run and drop tombstones, which then hide nothing."""
        job = everything(self.held.refresh())
        return None if job is None else self.compactor().run(job)

    # reading

    def rows(self, level: str = COMMITTED, version: int | None = None, low: bytes | None = None, high: bytes | None = None, key: bytes | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Winning row per key, tombstones included; ``version`` reads an earlier manifest.

        ``low`` and ``high`` (exclusive) leave out stored tables by their key range before any is opened;
        what is opened is filtered on the stored key, so pages are skipped as well. ``key`` asks for one
        key: tables are left out by range and filter, and the equality reaches the scan, where row groups
        are skipped by theirs. ``keys`` (column ``key``) reduces every layer by a semi-join before winners
        are picked; up to ``PROBED_KEYS`` of them are first put to the tables' ranges and filters.
        """
        m = self.manifests.read(version) if version is not None else self.held.refresh()
        wanted = None if key is None else [key]
        if keys is not None:
            keys = keys.select("key").distinct()
            first = keys.filter("key is not null").limit(PROBED_KEYS + 1).collect()
            wanted = [bytes(r[0]) for r in first] if len(first) <= PROBED_KEYS else None
        within = self._within(wanted, low, high)
        every = [self.memory(m).withColumn("layer", F.lit(3)).withColumn("unit", F.lit(0))]
        for i, f in enumerate(m.level0):
            if within(f):
                every.append(self.tables.read([f.table_id]).withColumn("layer", F.lit(2)).withColumn("unit", F.lit(-i)))
        for r, fs in m.runs:
            if some := [f.table_id for f in fs if within(f)]:
                every.append(self.tables.read(some).withColumn("layer", F.lit(1)).withColumn("unit", F.lit(r)))
        if level == UNCOMMITTED:
            every += [b.withColumn("wal_id", F.lit(m.next_wal_id).cast("bigint")).withColumn("layer", F.lit(4)).withColumn("unit", F.lit(i)) for i, b in enumerate(self._buffer)]
        rows = reduce(DataFrame.unionByName, every)
        if key is not None:
            rows = rows.filter(F.col("key") == F.lit(key))
        if low is not None:
            rows = rows.filter(F.col("key") >= F.lit(low))
        if high is not None:
            rows = rows.filter(F.col("key") < F.lit(high))
        if keys is not None:
            rows = rows.join(keys, "key", "left_semi")
        return latest(rows, rank=["layer", "unit", "seq"]).select("key", "kind", "value", "seq", "wal_id")

    def _within(self, wanted: list[bytes] | None, low: bytes | None, high: bytes | None):
        """A test whether a stored table may hold what a read asks for."""
        hashes = None if wanted is None else fnv1(pa.array(wanted, pa.binary())).view(np.int64)

        def test(f: TableFile) -> bool:
            if low is not None and bytes.fromhex(f.last_key) < low or high is not None and bytes.fromhex(f.first_key) >= high:
                return False
            return wanted is None or bool(self.tables.may_include(f, wanted, hashes).any())

        return test

    def get(self, key: bytes, level: str = COMMITTED) -> bytes | None:
        """Value of a key, or None."""
        found = live(self.rows(level, key=key)).select("value").first()
        return None if found is None else bytes(found[0] or b"")

    def multi_get(self, keys: DataFrame, level: str = COMMITTED) -> DataFrame:
        """``key, found, value`` per distinct key."""
        wanted = keys.select("key").distinct()
        hits = live(self.rows(level, keys=wanted)).select("key", "value", F.lit(True).alias("__hit"))
        return wanted.join(hits, "key", "left").select("key", F.coalesce("__hit", F.lit(False)).alias("found"), "value")

    def scan(self, start: bytes | None = None, end: bytes | None = None, level: str = COMMITTED) -> DataFrame:
        """Live rows with ``start <= key < end`` in key order."""
        return live(self.rows(level, low=start, high=end)).select("key", "value").orderBy("key")

    def scan_prefix(self, prefix: bytes, level: str = COMMITTED) -> DataFrame:
        return self.scan(prefix, prefix_end(prefix), level)

    def skips(self, keys: DataFrame) -> DataFrame:
        """``key, tables, by_range, by_filter`` per distinct key: stored tables, and those a lookup leaves out.

        Ranges and filters go to the tasks that hold the keys, as many tables at a time as fit.
        """
        m = self.held.refresh()
        files = [*m.level0, *[f for _, fs in m.runs for f in fs]]
        wanted, parts, batch, held = keys.select("key").filter("key is not null").distinct(), [], [], 0
        for f in files:
            kept = self.tables.filter(f.table_id)
            if batch and held + len(kept[1] if kept else b"") > SENT_BYTES:
                parts, batch, held = [*parts, batch], [], 0
            batch.append((bytes.fromhex(f.first_key), bytes.fromhex(f.last_key), kept))
            held += len(kept[1]) if kept else 0
        every = [self._skipped(wanted, b) for b in [*parts, batch]]
        return reduce(DataFrame.unionByName, every).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("tables", "by_range", "by_filter")])

    def _skipped(self, keys: DataFrame, tables: list) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(tables)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes, names = fnv1(batch.column(0)).view(np.int64), batch.column(0).to_pylist()
                outside, unset = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                for low, high, kept in shared.value:
                    inside = np.array([low <= k <= high for k in names], bool)
                    outside += ~inside
                    if kept is not None:
                        unset += inside & ~may_include(kept[1], kept[0], hashes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(names), len(shared.value))), pa.array(outside), pa.array(unset)], ["key", "tables", "by_range", "by_filter"])

        return keys.mapInArrow(count, "key binary, tables bigint, by_range bigint, by_filter bigint")

    def dump(self) -> DataFrame:
        """The current manifest as rows."""
        return describe(self.spark, self.held.refresh())

    def close(self) -> None:
        """Wait for pending batches and make the buffer durable; memory stays in the log and is recovered on opening."""
        if self._pool is not None:
            self._pool.shutdown(wait=True)
            self._pool = None
        self.flush_log()
        if self._compactor is not None:
            self._compactor.stop()
            self._compactor = None
