"""Has this key been seen before? Sharded, blocked Bloom filters over 64-bit key hashes.

Keys are hash-partitioned into shards. The rows of a shard stream through one task in order: the keys of
the history are inserted, then every incoming key is queried and inserted. A task holds one shard's
filters, never the keys. A filter answers "new" only for new keys; "maybe seen" answers are confirmed
against keys of the history, so the result is exact: a second filter, of the incoming keys, picks the few
history keys that can matter as they stream by. The rate of wrong answers is measured with keys that
cannot occur in the history because they are longer than every key in it.

``seen_before`` decides one batch against a history at hand. ``SeenKeys`` keeps filters and keys between
batches: a batch reads the filters, inserts its new keys, and looks at earlier keys only where a filter
said maybe.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.sources.objects import ObjectFolder, sealed, unsealed
from keystrata.sources.scratch import written

BLOCK_BITS = 512
WORDS = BLOCK_BITS // 64
TARGET_RATE = 0.001
#: Expected keys per shard at most: with the bits of the target rate this bounds a task's filter.
SHARD_KEYS = 2_000_000
#: What a row is to its shard, in the order in which they come: a kept filter, an incoming key to look out
#: for, a history key, an incoming key to decide, a key known to be absent.
KEPT, WANTED, HISTORY, INCOMING, ABSENT = range(5)
_OUT = "role bigint, first_id bigint, key binary, maybe_seen boolean, probes bigint, hits bigint"


def blocked_rate(bits_per_key: float, probes: int) -> float:
    """Expected false-positive rate of a blocked filter: Poisson mix over the keys that share a block."""
    mean = BLOCK_BITS / bits_per_key
    rate, p = 0.0, math.exp(-mean)
    for keys in range(int(mean + 12 * math.sqrt(mean)) + 20):
        if keys:
            p *= mean / keys
        rate += p * (1 - (1 - 1 / BLOCK_BITS) ** (probes * keys)) ** probes
    return rate


def filter_shape(target: float) -> tuple[float, int]:
    """Fewest bits per key, in quarters of a bit, and the number of probes that reach the target rate."""
    bits = 4.0
    while bits < 64:
        rate, probes = min((blocked_rate(bits, k), k) for k in range(1, 15))
        if rate <= target:
            return bits, probes
        bits += 0.25
    raise ValueError(f"no filter of up to 64 bits a key reaches a rate of {target}")


class BlockedFilter:
    """Bloom filter whose probes of a key stay in one block of 512 bits."""

    def __init__(self, keys: int, bits_per_key: float, probes: int):
        self.blocks = max(1, math.ceil(keys * bits_per_key / BLOCK_BITS))
        self.probes = probes
        self.words = np.zeros(self.blocks * WORDS, np.uint64)

    def _places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = hashes.view(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
        mixed = h
        for i in range(self.probes):
            if i % 7 == 0:  # a fresh 64-bit mix gives seven 9-bit probes
                mixed = h + np.uint64(0x9E3779B97F4A7C15 * (1 + i // 7) % (1 << 64))
                mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                mixed = mixed ^ (mixed >> np.uint64(31))
            bit = (mixed >> np.uint64(9 * (i % 7))) & np.uint64(BLOCK_BITS - 1)
            yield (block * np.uint64(WORDS) + (bit >> np.uint64(6))).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        for word, mask in self._places(hashes):
            np.bitwise_or.at(self.words, word, mask)

    def query(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for word, mask in self._places(hashes):
            found &= (self.words[word] & mask) != 0
        return found


def usable(key: Column) -> Column:
    """Null and empty keys are never seen and never remembered."""
    return F.octet_length(key) > 0


def _answers(expected: int, wanted: int, target: float, keep: bool):
    bits, probes = filter_shape(target)
    names = ["role", "first_id", "key", "maybe_seen", "probes", "hits"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]

    def rows(role: int, n: int, **columns) -> pa.RecordBatch:
        made = [pa.array(np.full(n, role), pa.int64())]
        made += [columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names[1:], kinds[1:])]
        return pa.RecordBatch.from_arrays(made, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bloom, looked_for = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if keep and bloom is not None:
                yield rows(KEPT, 1, first_id=pa.array([shard], pa.int64()), key=pa.array([bloom.words.tobytes()], pa.binary()))

        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            role = batch.column("role").to_numpy(zero_copy_only=False)
            hashes = batch.column("hash").to_numpy(zero_copy_only=False)
            # rows come sorted by shard and role: cut the batch where either changes
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
                if a == b:
                    continue
                if shards[a] != shard:
                    yield from done()
                    shard, bloom, looked_for = shards[a], BlockedFilter(expected, bits, probes), None
                h, part = hashes[a:b], batch.slice(a, b - a)
                if role[a] == KEPT:
                    bloom.words = np.frombuffer(part.column("key")[0].as_py(), np.uint64).copy()
                elif role[a] == WANTED:
                    looked_for = looked_for or BlockedFilter(wanted, bits, probes)
                    looked_for.add(h)
                elif role[a] == HISTORY:
                    bloom.add(h)
                    if looked_for is not None and (hit := looked_for.query(h)).any():
                        keys = part.column("key").filter(pa.array(hit))
                        yield rows(HISTORY, len(keys), key=keys)
                elif role[a] == INCOMING:  # keys within a batch are distinct: query all, then insert all
                    hit = bloom.query(h)
                    bloom.add(h)
                    yield rows(INCOMING, b - a, first_id=part.column("first_id"), key=part.column("key"), maybe_seen=pa.array(hit))
                else:
                    yield rows(ABSENT, 1, probes=pa.array([b - a], pa.int64()), hits=pa.array([int(bloom.query(h).sum())], pa.int64()))
        yield from done()

    return run


def _thinned(rows: DataFrame) -> DataFrame:
    """Rows of keys without repeats inside a batch, so that a hot key sends a row per batch to its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(batch.column("hash").to_numpy(zero_copy_only=False), return_index=True)
            yield batch if len(first) == batch.num_rows else batch.take(pa.array(np.sort(first)))

    return rows.mapInArrow(run, rows.schema)


def _rows(keys: DataFrame, role: int, key: bool, first_id: Column | None = None, of: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return keys.select(F.xxhash64(of if of is not None else F.col("key")).alias("hash"), F.lit(role).cast("bigint").alias("role"), (first_id if first_id is not None else none.cast("bigint")).alias("first_id"), (F.col("key") if key else none.cast("binary")).alias("key"))


def _sizes(keys: DataFrame, shards: int | None, shard_keys: int) -> tuple[int, int, int]:
    """Distinct keys (estimated from sketches, without a shuffle), shards, and the longest key's bytes."""
    n, longest = keys.agg(F.approx_count_distinct("key", 0.02), F.max(F.octet_length("key"))).first()
    least = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n, shards or max(1, math.ceil(n / shard_keys), least), int(longest or 0)


def _expected(n: int, shards: int) -> int:
    return math.ceil(1.06 * n / shards + 6 * math.sqrt(n / shards) + 64)


def _streamed(rows: DataFrame, shards: int, expected: int, wanted: int, target: float, keep: bool = False) -> DataFrame:
    placed = rows.withColumn("shard", F.coalesce(F.when(F.col("role") == KEPT, F.col("first_id")), F.pmod("hash", F.lit(shards))).cast("bigint"))
    # one task for every shard: by a hash of their numbers several would meet in one
    placed = placed.withColumn("__task", F.col("shard").cast("int")).repartitionById(shards, "__task").drop("__task")
    return placed.sortWithinPartitions("shard", "role", "first_id").mapInArrow(_answers(expected, wanted, target, keep), _OUT)


def first_occurrences(incoming: DataFrame) -> DataFrame:
    """``key, first_id`` of every usable distinct key; combined before the shuffle."""
    return incoming.filter(usable(F.col("key"))).groupBy("key").agg(F.min("incoming_id").alias("first_id"))


def filter_answers(history: DataFrame, first: DataFrame, target: float = TARGET_RATE, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Stream the keys of a history and the first occurrences of incoming keys through the filters.

    Returns rows of two roles: per incoming key ``first_id, key, maybe_seen``; and the keys of the history
    that the filter of the incoming keys lets pass, some of them more than once. The history is shuffled
    once, repeated or not: a filter holds a key however often it comes.

    The number of shards follows an estimate of the distinct keys; the estimate sizes filters only, so an
    error in it moves the rate of wrong answers and never a result.
    """
    usable_keys = history.select("key").filter(usable(F.col("key")))
    n, shards, _ = _sizes(usable_keys.unionByName(first.select("key")), None, shard_keys)
    rows = _thinned(_rows(usable_keys, HISTORY, True)).unionByName(_rows(first, WANTED, False)).unionByName(_rows(first, INCOMING, True, F.col("first_id")))
    return _streamed(rows, shards, _expected(n, shards), _expected(n, shards), target)


def _verdicts(incoming: DataFrame, answers: DataFrame, known: DataFrame) -> DataFrame:
    """``incoming_id, maybe_seen, seen`` of every record from the answers for first occurrences.

    Only a key's first record needs its answer, and finds it by its own id; every later one was seen. So
    no record is joined by its key, however many share one.
    """
    first = answers.join(known.withColumn("__known", F.lit(True)), "key", "left").select("first_id", "maybe_seen", F.coalesce("__known", F.lit(False)).alias("seen"))
    rows = incoming.select("incoming_id", F.coalesce(usable(F.col("key")), F.lit(False)).alias("__usable"))
    joined = rows.join(first, rows["incoming_id"] == first["first_id"], "left")
    later = lambda c: F.when(F.col("__usable"), F.coalesce(F.col(c), F.lit(True))).otherwise(False).alias(c)
    return joined.select("incoming_id", later("maybe_seen"), later("seen"))


def seen_before(history: DataFrame, incoming: DataFrame, target: float = TARGET_RATE) -> DataFrame:
    """Decide for every incoming record whether its key occurred before.

    ``history``: ``key``; ``incoming``: ``incoming_id`` (unique, order of arrival) and ``key``. Returns
    ``incoming_id, maybe_seen, seen`` for every record: ``maybe_seen`` is the filter's answer, ``seen`` the
    exact one. A record is seen when any history row or an incoming record with a smaller id has the same
    bytes as key. Records with a null or an empty key get false, false.
    """
    out = written(filter_answers(history, first_occurrences(incoming), target), "filter-answers")
    answers = out.filter(F.col("role") == INCOMING).select("first_id", "key", "maybe_seen")
    maybe = answers.filter("maybe_seen").select("key")
    known = out.filter(F.col("role") == HISTORY).select("key").distinct().join(maybe, "key", "left_semi")
    return _verdicts(incoming, answers, known)


def error_rate(history: DataFrame, incoming: DataFrame, target: float = TARGET_RATE, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row: probes with known absent keys, wrong answers among them, their rate and the target rate.

    The filters are filled with all keys; the absent keys are the same keys made longer than any of them.
    """
    keys = history.select("key").unionByName(incoming.select("key")).filter(usable(F.col("key"))).distinct()
    n, shards, longest = _sizes(keys, None, shard_keys)
    absent = _rows(keys, ABSENT, False, of=F.expr(f"rpad(key, {longest + 1}, X'FE')"))
    rows = _rows(keys, HISTORY, False).unionByName(absent)
    counts = _streamed(rows, shards, _expected(n, shards), 1, target).agg(F.coalesce(F.sum("probes"), F.lit(0)).alias("absent_probes"), F.coalesce(F.sum("hits"), F.lit(0)).alias("false_positives"))
    return counts.withColumn("error_rate", F.col("false_positives") / F.nullif(F.col("absent_probes"), F.lit(0))).withColumn("target_rate", F.lit(target))


class SeenKeys:
    """Keys seen so far, kept as the filters of all shards and the distinct keys in order of arrival.

    ``check`` decides a batch and adds its keys. Filters of all shards and the batch's new keys are
    written to a folder of their own, then a numbered commit makes them the present state; a batch that
    dies before it changes nothing, and of two batches at once one fails. When the keys exceed what the
    filters were sized for, the filters are filled again from the kept keys at twice the size, so the rate
    of wrong answers holds.
    """

    def __init__(self, spark: SparkSession, root: str, target: float = TARGET_RATE, shard_keys: int = SHARD_KEYS):
        self.spark, self.root, self.target, self.shard_keys = spark, root.rstrip("/"), target, shard_keys
        self.log = ObjectFolder(spark, f"{self.root}/_commits")

    def state(self) -> dict | None:
        names = [n for n in self.log.names() if n.endswith(".json")]
        return json.loads(unsealed(self.log.read(names[-1]))) if names else None

    def keys(self) -> DataFrame:
        """All distinct keys so far."""
        state = self.state()
        parts = [f"{self.root}/data/{p}/keys" for p in state["parts"]] if state else []
        return self.spark.read.schema("key binary").parquet(*parts) if parts else self.spark.createDataFrame([], "key binary")

    def check(self, incoming: DataFrame) -> DataFrame:
        """``incoming_id, maybe_seen, seen`` of every record, as ``seen_before`` against all keys so far."""
        state, name = self.state(), uuid.uuid4().hex
        folder = f"{self.root}/data/{name}"
        first = written(first_occurrences(incoming), "first")
        n = first.count()
        total = n + (state["keys"] if state else 0)
        rows = _rows(first, INCOMING, True, F.col("first_id"))
        if state and total <= state["capacity"]:
            shards, capacity = state["shards"], state["capacity"]
            kept = self.spark.read.parquet(f"{self.root}/data/{state['filters']}/filters")
            rows = rows.unionByName(kept.select(F.lit(0).cast("bigint").alias("hash"), F.lit(KEPT).cast("bigint").alias("role"), F.col("shard").alias("first_id"), F.col("data").alias("key")))
        else:
            capacity = max(2 * total, 1)
            shards = max(1, math.ceil(capacity / self.shard_keys), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            rows = rows.unionByName(_rows(self.keys(), HISTORY, False))
        _streamed(rows, shards, _expected(capacity, shards), 1, self.target, keep=True).write.parquet(f"{folder}/answers")
        out = self.spark.read.schema(_OUT).parquet(f"{folder}/answers")
        out.filter(F.col("role") == KEPT).select(F.col("first_id").alias("shard"), F.col("key").alias("data")).write.parquet(f"{folder}/filters")
        answers = out.filter(F.col("role") == INCOMING).select("first_id", "key", "maybe_seen")
        known = written(self.keys().join(answers.filter("maybe_seen").select("key"), "key", "left_semi"), "known")
        answers.select("key").join(known, "key", "left_anti").write.parquet(f"{folder}/keys")
        number = (state["number"] if state else 0) + 1
        fresh = n - known.count()
        after = {"number": number, "keys": (state["keys"] if state else 0) + fresh, "capacity": capacity, "shards": shards, "filters": name, "parts": [*(state["parts"] if state else []), name]}
        self.log.create(f"{number:020d}.json", sealed(json.dumps(after)))
        return _verdicts(incoming, answers, known)
