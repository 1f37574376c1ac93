"""Loading of the parquet tables a query reads, and the stored tables of a keyed table."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.hashes import optimal_probes
from keystrata.operators.compaction import TableFile
from keystrata.operators.entries import SCHEMA, entry_size
from keystrata.operators.layers import table_meta
from keystrata.operators.merge import cut_by_bytes
from keystrata.operators.prune import filter_words, may_include, pack_filters
from keystrata.operators.rowformat import decoded_filter, encoded_filter

_PARQUET = {"parquet.bloom.filter.enabled#key": "true"}
#: Level-0 tables and tables of runs are cut to about these bytes of keys and values.
TABLE_BYTES = 256 << 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory holding ``<name>.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


class TableStore:
    """Immutable key-sorted tables below ``<root>/compacted``, each one Parquet file with its filter beside it.

    A table is found by its id ``<folder>-<number>``; the folder holds all tables that one flush or
    compaction made. Parquet's footer is the index of a table: key range and filter of every row group,
    ranges and places of every page. The packed filter of a whole table lies in ``<root>/filters`` in the
    stored form of ``encoded_filter``, so that a table can be skipped without being opened. Filters read
    are kept, also that a table has none, the least lately used going first beyond ``cache_bytes``.
    """

    def __init__(self, spark: SparkSession, root: str, codec: str = "snappy", table_bytes: int = TABLE_BYTES, min_filter_keys: int = 0, bits_per_key: int = 10, cache_bytes: int = 256 << 20):
        self.spark, self.root, self.codec = spark, root.rstrip("/"), codec
        self.table_bytes, self.min_filter_keys, self.bits_per_key = table_bytes, min_filter_keys, bits_per_key
        self.cache_bytes = cache_bytes
        self._filters: OrderedDict[str, tuple[int, bytes] | None] = OrderedDict()
        self._held = 0

    def read(self, table_ids: list[str]) -> DataFrame:
        """Rows of tables."""
        paths = [f"{self.root}/compacted/{folder}/table_no={number}" for folder, _, number in (t.rpartition("-") for t in table_ids)]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def write(self, rows: DataFrame) -> tuple[TableFile, ...]:
        """Store rows of distinct keys as tables cut by bytes, in key order; their metadata in that order.

        Every table is written by one task, whatever else is; all tables of the call appear at once, when a
        manifest names them.
        """
        made = f"{int(time.time() * 1000):013d}{uuid.uuid4().hex[:13]}"
        path = f"{self.root}/compacted/{made}"
        sized = rows.select("key", "kind", "value", "seq", "wal_id").withColumn("__size", entry_size())
        total = sized.agg(F.sum("__size")).first()[0]
        if total is None:
            return ()
        numbered = cut_by_bytes(sized, "__size", self.table_bytes) if total > self.table_bytes else sized.withColumn("table_no", F.lit(0).cast("bigint"))
        placed = numbered.drop("__size").repartition("table_no").sortWithinPartitions("table_no", "key")
        placed.write.option("compression", self.codec).options(**_PARQUET).partitionBy("table_no").parquet(path)
        stored = self.spark.read.schema(f"{SCHEMA}, table_no bigint").parquet(path)
        probes = optimal_probes(self.bits_per_key)
        packed = pack_filters(filter_words(stored, ["table_no"], self.bits_per_key, self.min_filter_keys), ["table_no"])
        packed.select("table_no", encoded_filter(F.lit(probes), F.col("data"), "zlib").alias("filter")).write.parquet(f"{self.root}/filters/{made}")
        metas = table_meta(stored, ["table_no"]).orderBy("table_no").collect()
        return tuple(TableFile(f"{made}-{m.table_no}", bytes(m.first_key).hex().upper(), bytes(m.last_key).hex().upper(), m.num_rows, m.num_tombstones, m.bytes) for m in metas)

    def filter(self, table_id: str) -> tuple[int, bytes] | None:
        """Probes and bits of a table's filter, None if it has none or it cannot be read: it may hold any key."""
        if table_id in self._filters:
            self._filters.move_to_end(table_id)
            return self._filters[table_id]
        folder, _, number = table_id.rpartition("-")
        try:
            rows = self.spark.read.schema("table_no bigint, filter binary").parquet(f"{self.root}/filters/{folder}").filter(F.col("table_no") == int(number))
            found = rows.select(decoded_filter(F.col("filter"), "zlib").alias("f")).first()
            got = None if found is None or found.f is None else (found.f.num_probes, bytes(found.f.data))
        except Exception:  # noqa: BLE001
            return None
        self._filters[table_id] = got
        self._held += len(got[1]) if got else 0
        while self._held > self.cache_bytes and len(self._filters) > 1:
            _, old = self._filters.popitem(last=False)
            self._held -= len(old[1]) if old else 0
        return got

    def may_include(self, file: TableFile, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Which of some keys a table may hold: by its range, then by its filter."""
        low, high = bytes.fromhex(file.first_key), bytes.fromhex(file.last_key)
        answer = np.array([low <= k <= high for k in keys], bool)
        if answer.any() and (held := self.filter(file.table_id)) is not None:
            answer[answer] = may_include(held[1], held[0], hashes[answer])
        return answer
