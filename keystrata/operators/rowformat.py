"""Sizes and shapes of stored rows and blocks, as column expressions and one fold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.codecs import CODECS, big_endian, checksum_holds, compressed, decompressed, number_at, signed_at, with_checksum
from keystrata.functions.keys import common_prefix
from keystrata.operators.entries import encoded_value
from keystrata.operators.merge import byte_lengths, group_starts

FLAG_TOMBSTONE, FLAG_EXPIRES, FLAG_CREATED = 1, 2, 4
#: Bytes of a stored row besides key, times and value: two lengths, sequence number, flags.
ROW_BYTES = 2 + 2 + 8 + 1
TIME_BYTES, LENGTH_BYTES, OFFSET_BYTES, COUNT_BYTES, CHECKSUM_BYTES = 8, 4, 2, 2, 4


def flags(tombstone: Column, expire_at: Column, created_at: Column) -> Column:
    """Presence flags; a time is present if it is not null."""
    bit = lambda on, value: F.when(on, F.lit(value)).otherwise(F.lit(0))
    return bit(tombstone, FLAG_TOMBSTONE) + bit(expire_at.isNotNull(), FLAG_EXPIRES) + bit(created_at.isNotNull(), FLAG_CREATED)


def row_size(suffix_bytes: Column, value_bytes: Column, tombstone: Column, expire_at: Column, created_at: Column) -> Column:
    """Encoded bytes of a row."""
    times = F.when(expire_at.isNotNull(), TIME_BYTES).otherwise(0) + F.when(created_at.isNotNull(), TIME_BYTES).otherwise(0)
    return (F.lit(ROW_BYTES) + suffix_bytes + times + F.when(tombstone, 0).otherwise(F.lit(LENGTH_BYTES) + value_bytes)).cast("bigint")


def block_estimate(row_bytes: Column) -> Column:
    """Aggregate: encoded bytes of a block of the rows, each with its offset, plus count and checksum."""
    return (F.coalesce(F.sum(row_bytes + OFFSET_BYTES), F.lit(0)) + COUNT_BYTES + CHECKSUM_BYTES).cast("bigint")


def restore_key(first_key: Column, prefix_bytes: Column, suffix: Column) -> Column:
    """Full key of a row from its block's first key."""
    return F.concat(F.substring(first_key, F.lit(1), prefix_bytes.cast("int")), suffix)


def truncated(text: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters, the last three of a cut one being dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, max(0, limit - 3)), F.lit("..."))).otherwise(text)


def ordered_keys(df: DataFrame, index: str, suffix: bytes, low: int, high: int, width: int) -> DataFrame:
    """Add ``key``: the ``index``-th value of a counter of ``width`` bytes in ``[low, high]``, then ``suffix``."""
    base = high - low + 1
    digits = [F.lpad(F.hex((F.floor(F.col(index) / (base**p)) % base + low).cast("bigint")), 2, "0") for p in range(width - 1, -1, -1)]
    return df.withColumn("key", F.concat(F.unhex(reduce(lambda x, y: F.concat(x, y), digits)), F.lit(suffix)))


def shared_bytes(first: bytes, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Leading bytes that each of some keys, given by place and length in ``data``, shares with ``first``."""
    width = min(len(first), int(lengths.max()) if len(lengths) else 0)
    if not width:
        return np.zeros(len(starts), np.int64)
    steps = np.arange(width)
    inside = steps < lengths[:, None]
    same = inside & (data[np.where(inside, starts[:, None] + steps, 0)] == np.frombuffer(first[:width], np.uint8))
    return np.where(same.all(1), width, same.argmin(1)).astype(np.int64)


def place_in_blocks(rows: DataFrame, group: list[str], block_size: int) -> DataFrame:
    """Add ``block_no``, ``first_key`` of the block and ``prefix_bytes`` shared with it to every row.

    Rows (``key, kind, value`` and others) go to a block in key order until the next one would take it
    over ``block_size``; a block holds at least one row. Where a block ends depends on where the one
    before ended, so a table, which compaction bounds by its bytes, is one task's; each block is one step
    over arrays of the rows it could hold.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", block_no bigint, first_key binary, prefix_bytes bigint"
    placed = rows.repartition(*group).sortWithinPartitions(*group, "key")
    window = block_size // (ROW_BYTES + OFFSET_BYTES) + 1  # no block holds more rows

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, number, first, count, size = None, 0, b"", 0, 0
        for batch in batches:
            keys = batch.column("key").cast(pa.large_binary())
            ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
            data = np.frombuffer(keys.buffers()[2] or b"\x00", np.uint8)
            begin, length = ends[:-1], np.diff(ends)
            dead = pc.equal(batch.column("kind"), 1).to_numpy(zero_copy_only=False).astype(bool)
            whole = ROW_BYTES + length + np.where(dead, 0, LENGTH_BYTES + byte_lengths(batch.column("value")))
            n = batch.num_rows
            numbers, prefixes, firsts = np.empty(n, np.int64), np.empty(n, np.int64), []
            starts = group_starts(batch, group).tolist()
            for a, b in zip(starts, [*starts[1:], n]):
                now = tuple(batch.column(g)[a].as_py() for g in group)
                if now != of:
                    of, number, count, size = now, 0, 0, 0
                while a < b:
                    opening, z = not count, min(b, a + window)
                    if opening:
                        first, size = data[begin[a] : ends[a + 1]].tobytes(), 0
                    shared = shared_bytes(first, data, begin[a:z], length[a:z])
                    if opening:
                        shared[0] = 0
                    held = size + np.cumsum(whole[a:z] - shared)
                    over = COUNT_BYTES + (count + 1 + np.arange(z - a)) * OFFSET_BYTES + held > block_size
                    over[0] &= not opening
                    stop = int(over.argmax()) if over.any() else z - a
                    numbers[a : a + stop], prefixes[a : a + stop] = number, shared[:stop]
                    firsts += [first] * stop
                    if stop == z - a:
                        count, size = count + stop, int(held[-1])
                    else:
                        number, count = number + 1, 0
                    a += stop
            out = batch.append_column("block_no", pa.array(numbers)).append_column("first_key", pa.array(firsts, pa.binary()))
            yield out.append_column("prefix_bytes", pa.array(prefixes))

    return placed.mapInArrow(fold, schema)


def cut_blocks(rows: DataFrame, group: list[str], block_size: int) -> DataFrame:
    """Blocks of every table: ``group, block_no, first_key, num_rows, encoded_bytes``."""
    placed = place_in_blocks(rows.select(*group, "key", "kind", "value"), group, block_size)
    dead = F.col("kind") == 1
    size = row_size(F.octet_length("key") - F.col("prefix_bytes"), F.coalesce(F.octet_length("value"), F.lit(0)), dead, F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))
    return placed.groupBy(*group, "block_no").agg(F.min("first_key").alias("first_key"), F.count("*").alias("num_rows"), block_estimate(size).alias("encoded_bytes"))


def encoded_row(prefix_bytes: Column, suffix: Column, seq: Column, tombstone: Column, expire_millis: Column, created_millis: Column, value: Column) -> Column:
    """A row in its stored form: prefix and suffix length, suffix, sequence number, flags, times, value."""
    flag = flags(tombstone, expire_millis, created_millis)
    times = [F.coalesce(big_endian(t, 8), F.lit(b"")) for t in (expire_millis, created_millis)]
    body = F.coalesce(value, F.lit(b""))
    tail = F.when(tombstone, F.lit(b"")).otherwise(F.concat(big_endian(F.octet_length(body), 4), body))
    return F.concat(big_endian(prefix_bytes, 2), big_endian(F.octet_length(suffix), 2), suffix, big_endian(seq, 8), big_endian(flag, 1), *times, tail)


def decoded_row(data: Column, first_key: Column) -> Column:
    """Struct ``key, seq, kind, expire_millis, created_millis, value, prefix_bytes`` of a stored row."""
    zero = F.lit(0)
    prefix, suffix = number_at(data, zero, 2), number_at(data, zero + 2, 2)
    after = suffix + 4
    flag = number_at(data, after + 8, 1)
    has = lambda bit: F.floor(flag / bit) % 2 == 1
    expire_at = after + 9
    created_at = expire_at + F.when(has(FLAG_EXPIRES), 8).otherwise(0)
    value_at = created_at + F.when(has(FLAG_CREATED), 8).otherwise(0)
    dead = has(FLAG_TOMBSTONE)
    value = F.substring(data, (value_at + 5).cast("int"), number_at(data, value_at, 4).cast("int"))
    return F.struct(
        restore_key(first_key, prefix, F.substring(data, F.lit(5), suffix.cast("int"))).alias("key"),
        signed_at(data, after).alias("seq"),
        F.when(dead, 1).otherwise(0).cast("tinyint").alias("kind"),
        F.when(has(FLAG_EXPIRES), signed_at(data, expire_at)).alias("expire_millis"),
        F.when(has(FLAG_CREATED), signed_at(data, created_at)).alias("created_millis"),
        F.when(~dead, value).alias("value"),
        prefix.alias("prefix_bytes"),
    )


def encode_blocks(placed: DataFrame, group: list[str], codec: str = "none") -> DataFrame:
    """Stored blocks: ``group, block_no, first_key, block`` (rows, offsets, count; compressed; checksum).

    ``placed`` comes from ``place_in_blocks`` with ``seq`` and optionally ``expire_millis`` and
    ``created_millis``. Only the rows of one block, which its size bounds, meet in a list.
    """
    none = F.lit(None).cast("bigint")
    time = lambda c: F.col(c) if c in placed.columns else none
    row = encoded_row(F.col("prefix_bytes"), F.substring(F.col("key"), (F.col("prefix_bytes") + 1).cast("int"), F.lit(1 << 20)), F.col("seq"), F.col("kind") == 1, time("expire_millis"), time("created_millis"), F.col("value"))
    blocks = placed.select(*group, "block_no", "first_key", F.struct("key", row.alias("row")).alias("r")).groupBy(*group, "block_no").agg(F.min("first_key").alias("first_key"), F.array_sort(F.collect_list("r")).alias("rows"))
    rows = F.transform("rows", lambda r: r["row"])
    start = F.struct(F.lit(b"").alias("data"), F.lit(b"").alias("offsets"))
    folded = F.aggregate(rows, start, lambda acc, r: F.struct(F.concat(acc["data"], r).alias("data"), F.concat(acc["offsets"], big_endian(F.octet_length(acc["data"]), 2)).alias("offsets")))
    plain = F.concat(folded["data"], folded["offsets"], big_endian(F.size("rows"), 2))
    return blocks.select(*group, "block_no", "first_key", with_checksum(plain if codec == "none" else compressed(plain, F.lit(codec))).alias("block"))


def block_problem(block: Column, plain: Column) -> Column:
    """What is wrong with a stored block, null if nothing; ``plain`` is its body uncompressed."""
    size = F.octet_length(plain)
    count = number_at(plain, size - 2, 2)
    start = size - 2 - count * 2
    offsets = F.transform(F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: number_at(plain, start + i * 2, 2))
    return (
        F.when(F.octet_length(block) < 6, "block is too small")
        .when(~checksum_holds(block), "checksum mismatch")
        .when(size < 2, "uncompressed block is too small")
        .when(start <= 0, "invalid index offset")
        .when(count == 0, "no offsets")
        .when(F.exists(offsets, lambda o: o > start), "offset exceeds the rows")
    )


def decode_blocks(blocks: DataFrame, group: list[str], codec: str = "none") -> tuple[DataFrame, DataFrame]:
    """``(rows, warnings)`` of stored blocks: rows of sound blocks, and one warning per corrupt block.

    The first key is that of the first row stored whole. A block that fails a test gives no rows and
    stands in ``warnings`` with what is wrong; what to do with it is the caller's choice.
    """
    body = F.when(F.octet_length("block") >= 4, F.substring(F.col("block"), F.lit(1), F.octet_length("block") - 4))
    sound = checksum_holds(F.col("block"))
    plain = body if codec == "none" else decompressed(F.when(sound, body), F.lit(codec))
    opened = blocks.withColumn("__plain", plain)
    opened = opened.withColumn("warning", block_problem(F.col("block"), F.col("__plain")))
    warnings = opened.filter("warning is not null").select(*group, "block_no", "warning").distinct()
    size = F.octet_length("__plain")
    count = number_at(F.col("__plain"), size - 2, 2)
    start = size - 2 - count * 2
    at = lambda i: number_at(F.col("__plain"), start + i * 2, 2)
    slices = F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: F.substring(F.col("__plain"), (at(i) + 1).cast("int"), (F.when(i + 1 < count, at(i + 1)).otherwise(start) - at(i)).cast("int")))
    good = opened.filter("warning is null").select(*group, "block_no", slices.alias("slices"))
    whole = F.filter("slices", lambda s: number_at(s, F.lit(0), 2) == 0)
    first = F.substring(whole[0], F.lit(5), number_at(whole[0], F.lit(2), 2).cast("int"))
    rows = good.select(*group, "block_no", first.alias("first_key"), F.explode("slices").alias("s")).select(*group, "block_no", decoded_row(F.col("s"), F.col("first_key")).alias("r"))
    return rows.select(*group, "block_no", "r.*"), warnings


def merged_warnings(*parts: DataFrame) -> DataFrame:
    """Warnings of several reads, each once."""
    return reduce(DataFrame.unionByName, parts).distinct()


def encoded_filter(num_probes: Column, data: Column, codec: str = "none") -> Column:
    """A filter in its stored form: number of probes, bits (compressed), checksum."""
    body = F.concat(big_endian(num_probes, 2), data)
    return with_checksum(body if codec == "none" else compressed(body, F.lit(codec)))


def decoded_filter(stored: Column, codec: str = "none") -> Column:
    """Struct ``num_probes, data`` of a stored filter; null if the checksum fails."""
    size = F.octet_length(stored)
    body = F.when(checksum_holds(stored), F.substring(stored, F.lit(1), size - 4))
    body = body if codec == "none" else decompressed(body, F.lit(codec))
    return F.when(body.isNotNull(), F.struct(number_at(body, F.lit(0), 2).alias("num_probes"), F.substring(body, F.lit(3), F.octet_length(body) - 2).alias("data")))


def table_bytes(rows: DataFrame, group: list[str]) -> DataFrame:
    """``group, table``: the stored values of a small table of entries one behind the other in key order.

    Every entry is its key length and value length in four bytes each, the key, the stored value. Meant
    for tables of literal entries and for dumps: a table's bytes meet in one row.
    """
    stored = encoded_value()
    entry = F.concat(big_endian(F.octet_length("key"), 4), big_endian(F.octet_length(stored), 4), F.col("key"), stored)
    lists = rows.select(*group, F.struct("key", entry.alias("e")).alias("r")).groupBy(*group).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return lists.select(*group, F.aggregate(F.transform("r", lambda r: r["e"]), F.lit(b""), lambda a, e: F.concat(a, e)).alias("table"))


# a whole table as bytes: blocks, filter, index, info, and where the info begins

INFO_FIELDS = ("index_offset", "index_len", "filter_offset", "filter_len", "codec")


def encode_tables(blocks: DataFrame, group: list[str], filters: DataFrame | None = None, codec: str = "none") -> DataFrame:
    """Tables of bounded size as one byte string each: ``group, table``.

    ``blocks`` comes from ``encode_blocks``; ``filters`` has ``group`` and ``filter`` (see
    ``encoded_filter``), a table without one has none. The index holds, for every block, where it begins
    and its first key, so a reader of a range of keys needs the last few bytes, the info, the index and
    the blocks in question. Index and info carry checksums. Meant for tables cut by bytes.
    """
    item = F.struct("block_no", "first_key", "block")
    lists = blocks.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("b"))
    if filters is not None:
        lists = lists.join(filters.select(*group, "filter"), group, "left")
    else:
        lists = lists.withColumn("filter", F.lit(None).cast("binary"))
    join = lambda parts: F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
    body = join(F.transform("b", lambda x: x["block"]))
    starts = F.transform("b", lambda x, i: F.aggregate(F.slice("b", 1, i), F.lit(0).cast("bigint"), lambda n, y: n + F.octet_length(y["block"])))
    entries = join(F.transform(F.arrays_zip(starts.alias("s"), F.col("b").alias("x")), lambda e: F.concat(big_endian(e["s"], 8), big_endian(F.octet_length(e["x"]["first_key"]), 2))))
    index = with_checksum(F.concat(big_endian(F.size("b"), 4), entries, join(F.transform("b", lambda x: x["first_key"]))))
    lists = lists.select(*group, F.element_at("b", 1)["first_key"].alias("first_key"), body.alias("body"), F.coalesce("filter", F.lit(b"")).alias("filter"), index.alias("index"))
    size = lambda c: F.octet_length(c).cast("bigint")
    numbers = [size("body") + size("filter"), size("index"), F.when(size("filter") > 0, size("body")).otherwise(0), size("filter")]
    info = with_checksum(F.concat(*[big_endian(n, 8) for n in numbers], big_endian(F.lit(CODECS.index(codec)), 1), F.col("first_key")))
    begin = size("body") + size("filter") + size("index")
    return lists.select(*group, F.concat("body", "filter", "index", info, big_endian(begin, 4)).alias("table"))


def table_info(table: Column) -> Column:
    """Struct ``first_key, index_offset, index_len, filter_offset, filter_len, codec`` of a table; null if it is corrupt."""
    size = F.octet_length(table)
    begin = F.when(size >= 4, number_at(table, size - 4, 4))
    info = F.when(begin + 4 <= size, F.substring(table, (begin + 1).cast("int"), (size - 4 - begin).cast("int")))
    number = lambda i: signed_at(info, F.lit(8 * i)).alias(INFO_FIELDS[i])
    name = F.element_at(F.array(*[F.lit(c) for c in CODECS]), (number_at(info, F.lit(32), 1) + 1).cast("int"))
    key = F.substring(info, F.lit(34), F.octet_length(info) - 37)
    return F.when(checksum_holds(info), F.struct(key.alias("first_key"), *[number(i) for i in range(4)], name.alias("codec")))


def table_index(table: Column, info: Column) -> Column:
    """Array of ``offset, first_key``, one for every block in order; null if it is corrupt."""

    @F.arrow_udf("array<struct<offset:bigint,first_key:binary>>")
    def parse(indexes: pa.Array) -> pa.Array:
        out = []
        for data in indexes.to_pylist():
            if data is None:
                out.append(None)
                continue
            count = int.from_bytes(data[:4], "big")
            at, entries = 4 + count * 10, []
            for i in range(4, at, 10):
                size = int.from_bytes(data[i + 8 : i + 10], "big")
                entries.append({"offset": int.from_bytes(data[i : i + 8], "big"), "first_key": data[at : at + size]})
                at += size
            out.append(entries)
        return pa.array(out, pa.list_(pa.struct([("offset", pa.int64()), ("first_key", pa.binary())])))

    index = F.substring(table, (info["index_offset"] + 1).cast("int"), info["index_len"].cast("int"))
    return parse(F.when(checksum_holds(index), index))


def table_filter(table: Column, info: Column) -> Column:
    """The stored filter of a table, null if it has none."""
    return F.when(info["filter_len"] > 0, F.substring(table, (info["filter_offset"] + 1).cast("int"), info["filter_len"].cast("int")))


def read_blocks(tables: DataFrame, group: list[str], low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """``group, block_no, block``: the blocks of tables (``group, table``) that may hold keys in ``[low, high)``.

    A block is left out by the first keys in the index: its own against ``high``, the next one's against
    ``low``. Tables whose info or index is corrupt give none.
    """
    info = table_info(F.col("table"))
    opened = tables.select(*group, "table", info.alias("info")).select(*group, "table", "info", table_index(F.col("table"), F.col("info")).alias("index")).filter("index is not null")
    end = F.when(F.col("info.filter_len") > 0, F.col("info.filter_offset")).otherwise(F.col("info.index_offset"))
    opened = opened.select(*group, "table", "index", end.alias("end"))
    types = {f.name: f.dataType.simpleString() for f in tables.schema}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                table, index, end = (batch.column(c)[i].as_py() for c in ("table", "index", "end"))
                firsts = [e["first_key"] for e in index]
                ends = [e["offset"] for e in index[1:]] + [end]
                keep = [n for n, k in enumerate(firsts) if (high is None or k < high) and (low is None or n + 1 == len(firsts) or firsts[n + 1] > low)]
                columns = [pa.repeat(batch.column(g)[i], len(keep)) for g in group]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keep, pa.int64()), pa.array([table[index[n]["offset"] : ends[n]] for n in keep], pa.binary())], [*group, "block_no", "block"])

    return opened.mapInArrow(cut, ", ".join(f"`{g}` {types[g]}" for g in group) + ", block_no bigint, block binary")
