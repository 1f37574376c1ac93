import random

import pytest
from keystrata.operators import compaction, entries, layers, merge, prune, read, rowformat
from keystrata.operators.compaction import Manifest
from keystrata.sources.compactor import Compactor
from keystrata.sources.manifest import Fenced, FencedManifest, ManifestStore
from keystrata.sources.objects import AlreadyExists, ObjectFolder
from keystrata.sources.store import KeyedTable
from keystrata.streaming.ingest import Maintenance, ingest
from pyspark.sql import functions as F

CHANGES = "key binary, kind tinyint, value binary, seq bigint"


def log(spark, rows):
    return entries.entries(spark, [(k, t, v, s, w) for k, t, v, s, w in rows])


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


# reads


def test_put_get_delete_and_levels(spark):
    rows = log(spark, [(b"foo", 0, b"bar", 1, 1), (b"foo", 0, b"bla", 2, 2), (b"key2", 0, b"v", 3, 1), (b"key2", 1, None, 4, 2)])
    one = lambda key, level: [bytes(r.value) for r in read.get(rows, key, level, 1).collect()]
    assert one(b"foo", read.COMMITTED) == [b"bar"] and one(b"foo", read.UNCOMMITTED) == [b"bla"]
    assert one(b"key2", read.COMMITTED) == [b"v"] and one(b"key2", read.UNCOMMITTED) == []
    assert one(b"none", read.UNCOMMITTED) == []
    with pytest.raises(ValueError):
        read.at_level(rows, "other")


def test_scan_seek_and_prefix(spark):
    rows = log(spark, [(f"abc{c}".encode(), 0, b"v", i, 1) for i, c in enumerate(["555", "111", "333", "222", "444"])])
    keys = lambda df: [bytes(r.key).decode() for r in df.collect()]
    assert keys(read.scan(rows, b"abc333")) == ["abc333", "abc444", "abc555"]
    assert keys(read.scan(rows, b"abc345")) == ["abc444", "abc555"]
    assert keys(read.scan(rows, b"abc2", b"abc4")) == ["abc222", "abc333"]
    assert keys(read.scan_prefix(rows, b"abc2")) == ["abc222"]
    assert read.prefix_end(b"a\xff\xff") == b"b" and read.prefix_end(b"\xff") is None


def test_invalid_changes_fail(spark):
    good = [(b"k", 0, b"v", 1)]
    for bad in [(b"", 0, b"v", 1), (None, 0, b"v", 1), (b"k", 2, b"v", 1), (b"k", None, b"v", 1), (b"k", 0, b"v", None), (b"k" * 70000, 0, b"v", 1)]:
        with pytest.raises(Exception, match="invalid key"):
            entries.checked(changes(spark, good + [bad])).collect()
    assert entries.checked(changes(spark, good)).count() == 1


# layers, merge, compaction


def test_merge_takes_the_first_source(spark):
    rng = random.Random(5)
    sources = [{f"k{rng.randrange(40):02d}": f"{n}-{i}" for i in range(25)} for n in range(4)]
    want = {}
    for source in reversed(sources):
        want.update(source)
    out = merge.merge([spark.createDataFrame(list(x.items()), "key string, value string") for x in sources])
    assert {r.key: r.value for r in out.collect()} == want
    versions = spark.createDataFrame([("a", 1, 0, 5), ("a", 2, 0, 7), ("a", 3, 1, 9), ("b", 4, 1, 1)], "key string, value int, source int, seq int")
    assert sorted((r.key, r.value) for r in merge.merge_numbered(versions, newest="seq").collect()) == [("a", 2), ("b", 4)]


def test_cut_by_bytes_is_close_to_the_limit_and_in_key_order(spark):
    rng = random.Random(8)
    rows = [(b"p" * 30 + f"{i:05d}".encode(), rng.randrange(1, 40)) for i in rng.sample(range(90000), 3000)]
    out = merge.cut_by_bytes(spark.createDataFrame(rows, "key binary, size int").repartition(7), "size", 500).collect()
    tables = {}
    for r in sorted(out, key=lambda r: bytes(r.key)):
        tables.setdefault(r.table_no, []).append(r.size)
    assert len(out) == 3000 and list(tables) == list(range(len(tables)))
    assert all(sum(t) < 540 for t in tables.values()) and all(sum(t) > 460 for t in list(tables.values())[:-1])
    assert merge.cut_by_bytes(spark.createDataFrame([], "key binary, size int"), "size", 500).count() == 0


def test_roll_ends_a_table_after_the_row_over_the_limit(spark):
    rng = random.Random(1)
    rows = [(g, f"{i:04d}".encode(), b"x" * rng.randrange(0, 50)) for g in (1, 2) for i in range(200)]
    want = {}
    for g in (1, 2):
        n = size = 0
        for _, k, v in sorted(r for r in rows if r[0] == g):
            want[g, k] = n
            size += len(k) + len(v)
            if size > 100:
                n, size = n + 1, 0
    out = merge.roll(spark.createDataFrame(rows, "g int, key binary, value binary"), ["g"], 100)
    assert {(r.g, bytes(r.key)): r.table_no for r in out.collect()} == want


def test_freeze_by_size_counts_net_bytes(spark):
    rows = log(spark, [(b"a", 0, b"12345678", 1, 1), (b"a", 0, b"1", 2, 2), (b"b", 0, b"12345678", 3, 3), (b"c", 1, None, 4, 4)])
    out = [tuple(r) for r in layers.freeze_by_size(rows, 12).orderBy("wal_id").collect()]
    assert out == [(1, 10, False), (2, 3, False), (3, 13, True), (4, 2, False)]
    assert layers.freeze_by_size(rows.limit(0), 12).count() == 0
    rng = random.Random(3)
    many = [(bytes([97 + rng.randrange(6)]), 0, b"x" * rng.randrange(1, 9), i, 1 + i // 3) for i in range(300)]
    want, held = [], {}
    for w in range(1, 101):
        held.update({k: len(k) + 1 + len(v) for k, _, v, _, x in many if x == w})
        total = sum(held.values())
        want.append((w, total, total >= 30))
        if total >= 30:
            held = {}
    assert [tuple(r) for r in layers.freeze_by_size(log(spark, many), 30).orderBy("wal_id").collect()] == want


def test_compaction_state():
    file = lambda n: compaction.TableFile(n, "61", "62", 1, 0, 9)
    tables = lambda names: tuple(file(n) for n in names)
    s = compaction.Manifest(level0=tables("dcba"), next_wal_id=9)
    (job,) = compaction.schedule(s)
    assert job == compaction.Compaction(("d", "c", "b", "a"), (), 0)
    busy = compaction.submit(s, job)
    assert compaction.schedule(s, busy) == []
    with pytest.raises(compaction.CompactionRefused):
        compaction.submit(s, job, busy)
    moved = compaction.Manifest(level0=tables("edcba"), next_wal_id=12, last_compacted_wal_id=11)
    done = compaction.finish(moved, job, (file("r0"),))
    assert done.runs == ((0, (file("r0"),)),) and done.level0 == tables("e") and done.level0_last_compacted == "d" and done.last_compacted_wal_id == 11
    with pytest.raises(compaction.CompactionRefused):
        compaction.finish(done, job, (file("r1"),))  # its sources are gone
    with pytest.raises(compaction.CompactionRefused):
        compaction.submit(done, compaction.Compaction(("e",), (), 0))
    mixed = compaction.finish(done, compaction.Compaction(("e",), (0,), 0), (file("r1"),))
    assert mixed.runs == ((0, (file("r1"),)),) and compaction.in_order(mixed.runs)
    assert compaction.schedule(compaction.Manifest(level0=tables("abc"))) == []
    assert compaction.finish(mixed, compaction.everything(mixed), ()).runs == () and compaction.everything(compaction.Manifest()) is None


# pruning and format


def test_table_lookup(spark):
    tables = spark.createDataFrame([(1, 0, b"c"), (1, 1, b"m"), (1, 2, b"t\x00"), (2, 0, None), (3, 5, b"m")], "g int, t int, first_key binary")
    keys = spark.createDataFrame([(g, k) for g in (1, 2) for k in (b"a", b"c", b"l", b"m", b"t", b"z", b"z")], "g int, key binary")
    at = lambda clamp: [(bytes(r.key), r.t) for r in prune.table_for_key(keys, tables, ["g"], "t", clamp).filter("g = 1").orderBy("key").collect()]
    assert at(False) == [(b"a", None), (b"c", 0), (b"l", 0), (b"m", 1), (b"t", 1), (b"z", 2), (b"z", 2)]
    assert at(True)[0] == (b"a", 0)
    for clamp in (False, True):
        for size in (1 << 20, 0):  # searched in the tasks, and sorted together
            out = prune.table_in_each(keys.filter("g = 1"), tables, "g", "t", clamp, size)
            assert sorted(((r.g, bytes(r.key), r.t) for r in out.collect()), key=repr) == sorted([(1, *x) for x in at(clamp)] + [(3, bytes(r.key), 5 if bytes(r.key) >= b"m" or clamp else None) for r in keys.filter("g = 1").collect()], key=repr)


def test_filters_have_no_wrong_no(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").cast("binary").alias("key"))
    filters = prune.filter_words(df, ["g"])
    assert prune.probe_filters(df, filters, ["g"]).filter("not maybe").count() == 0
    other = df.select("g", F.concat("key", F.lit("x").cast("binary")).alias("key"))
    assert prune.probe_filters(other, filters, ["g"]).filter("maybe").count() < 60
    assert prune.filter_words(df, ["g"], min_keys=5000).count() == 0
    packed = prune.pack_filters(filters, ["g"]).collect()
    import pyarrow as pa
    from keystrata.functions.hashes import fnv1
    for p in packed:
        hashes = fnv1(pa.array([str(i).encode() for i in range(p.g, 3000, 3)], pa.binary()))
        assert p.num_keys == 1000 and len(p.data) * 8 == p.bits and prune.may_include(bytes(p.data), 6, hashes).all()
        assert prune.may_include(bytes(p.data), 6, fnv1(pa.array([b"%dy" % i for i in range(1000)], pa.binary()))).sum() < 30
    assert prune.may_include(b"", 6, hashes).all() and prune.may_include(b"x", 0, hashes).all()


def test_hash_and_probe_vectors(spark):
    from keystrata.functions.hashes import fnv1_hex, probe_bits

    halves = F.struct(F.lit(0xDEADBEEF).cast("bigint").alias("lo"), F.lit(0xDF77EF56).cast("bigint").alias("hi"))
    row = spark.range(1).select(probe_bits(halves, F.lit(1_000_000).cast("bigint"), 7).alias("p"), fnv1_hex(F.lit(b"a")).alias("a"), fnv1_hex(F.lit(b"")).alias("e"), fnv1_hex(F.lit(None).cast("binary")).alias("n")).first()
    assert row.p == [928559, 107781, 287004, 466229, 645457, 824689, 3926]
    assert row.a == "AF63BD4C8601B7BE" and row.e == "CBF29CE484222325" and row.n is None


def test_prefixes_and_blocks(spark):
    pairs = [(b"", b""), (b"a", b"b"), (b"ab", b"abc"), (b"abc", b"abd"), (b"x" * 207, b"x" * 300), ("日本語文".encode(), "日本語分".encode()), (b"q" * 700, b"q" * 607 + b"z"), (None, b"a")]
    df = spark.createDataFrame(pairs, "a binary, b binary")
    for r in df.withColumn("got", rowformat.common_prefix(F.col("a"), F.col("b"))).collect():
        if r.a is None:
            assert r.got is None
            continue
        want = 0
        while want < min(len(r.a), len(r.b)) and r.a[want] == r.b[want]:
            want += 1
        assert r.got == want
    rows = log(spark, [(f"key{i:03d}".encode(), 0, b"v" * (i % 9), i, 1) for i in range(100)])
    blocks = rowformat.cut_blocks(rows.withColumn("t", F.lit(1)), ["t"], 120).collect()
    assert sum(b.num_rows for b in blocks) == 100 and all(b.encoded_bytes <= 124 for b in blocks)
    assert [b.block_no for b in sorted(blocks, key=lambda b: b.first_key)] == list(range(len(blocks)))


def test_blocks_and_rows_round_trip_with_times(spark):
    rows = [(1, f"key{i:03d}".encode(), i % 4 == 0, None if i % 4 == 0 else b"v" * (i % 7), i, None if i % 3 else i - 50, i * 1000 if i % 2 else None) for i in range(1, 90)]
    df = spark.createDataFrame([(t, k, int(dead), v, s, e, c) for t, k, dead, v, s, e, c in rows], "t int, key binary, kind int, value binary, seq bigint, expire_millis bigint, created_millis bigint")
    for codec in ("none", "lz4"):
        blocks = rowformat.encode_blocks(rowformat.place_in_blocks(df, ["t"], 150), ["t"], codec)
        out, warnings = rowformat.decode_blocks(blocks, ["t"], codec)
        assert warnings.count() == 0
        got = sorted((bytes(r.key), bool(r.kind), None if r.value is None else bytes(r.value), r.seq, r.expire_millis, r.created_millis) for r in out.collect())
        assert got == sorted(r[1:] for r in rows)


def test_corrupt_blocks_are_reported_and_give_no_rows(spark):
    df = log(spark, [(b"key1", 0, b"value1", 1, 1), (b"key2", 0, b"value2", 2, 1)]).withColumn("t", F.lit(1))
    good = bytes(rowformat.encode_blocks(rowformat.place_in_blocks(df, ["t"], 4096), ["t"]).first().block)
    import zlib

    sealed = lambda body: body + zlib.crc32(body).to_bytes(4, "big")
    cases = {
        "block is too small": good[:5],
        "checksum mismatch": bytes([good[0] ^ 1]) + good[1:],
        "invalid index offset": sealed(b"\x00\x09\x00\x09"),
        "no offsets": sealed(good[:-10] + b"\x00\x00"),
        "offset exceeds the rows": sealed(good[:-10] + b"\xff\xff" + b"\x00\x01"),
    }
    blocks = spark.createDataFrame([(1, i, b) for i, b in enumerate([good, *cases.values()])], "t int, block_no bigint, block binary")
    rows, warnings = rowformat.decode_blocks(blocks, ["t"])
    assert [r.warning for r in warnings.orderBy("block_no").collect()] == list(cases)
    assert sorted(bytes(r.key) for r in rows.collect()) == [b"key1", b"key2"]
    assert rowformat.merged_warnings(warnings, warnings).count() == len(cases)


def test_codecs(spark):
    from keystrata.functions.codecs import CODECS, UnknownCodec, compress_bytes, decompress_bytes, id_halves, id_millis

    for codec in CODECS:
        for data in (b"", b"a", b"ab" * 100000):
            assert decompress_bytes(compress_bytes(data, codec), codec) == data
    with pytest.raises(UnknownCodec):
        compress_bytes(b"a", "best")
    with pytest.raises(Exception):
        decompress_bytes(b"junk junk junk", "zstd")
    one = spark.createDataFrame([("00000000010000000000000001",), ("7ZZZZZZZZZZZZZZZZZZZZZZZZZ",), (None,)], "i string")
    out = one.select(id_millis(F.col("i")).alias("m"), id_halves(F.col("i")).alias("h")).collect()
    assert out[0].m == 1 and out[0].h.high == "0000000000010000" and out[0].h.low == "0000000000000001"
    assert out[1].m == 2**48 - 1 and out[1].h.high == out[1].h.low == "F" * 16 and out[2].m is None


# store


def test_exclusive_create_and_fencing(spark, tmp_path):
    folder = ObjectFolder(spark, f"file://{tmp_path}/o")
    folder.create("a", "1")
    with pytest.raises(AlreadyExists):
        folder.create("a", "2")
    assert folder.read("a") == "1" and folder.names() == ["a"]
    store = ManifestStore(spark, f"file://{tmp_path}/m")
    first = FencedManifest(store, "writer")
    compactor = FencedManifest(store, "compactor")
    second = FencedManifest(store, "writer")
    with pytest.raises(Fenced):
        first.refresh()
    with pytest.raises(Fenced):
        first.update(lambda m: Manifest())
    compactor.refresh()
    second.refresh()


def test_random_operations_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(11)
    table, root, seq, want, durable = None, f"file://{tmp_path}/t", 0, {}, {}
    table = KeyedTable(spark, root)
    for _ in range(30):
        step = rng.choice(["write", "write", "write", "buffer", "flush_log", "flush", "compact", "reopen", "major"])
        if step in ("write", "buffer"):
            if step == "write" and table._buffer:
                table.flush_log()
                durable = dict(want)
            batch = []
            for _ in range(rng.randrange(0, 6)):
                seq += 1
                key, dead = bytes([97 + rng.randrange(8)]), rng.random() < 0.3
                batch.append((key, int(dead), None if dead else b"v%d" % seq, seq))
                want.pop(key, None) if dead else want.__setitem__(key, b"v%d" % seq)
            getattr(table, step)(changes(spark, batch))
            durable = dict(want) if step == "write" else durable
        elif step == "flush_log":
            table.flush_log()
            durable = dict(want)
        elif step == "flush":
            table.flush_memory()
        elif step == "compact":
            table.compact(limit=2)
        elif step == "major":
            table.major_compact()
        else:
            table.close()
            durable = dict(want)
            table = KeyedTable(spark, root)
    state = lambda level: {bytes(r.key): bytes(r.value) for r in table.scan(level=level).collect()}
    assert state(read.UNCOMMITTED) == want and state(read.COMMITTED) == durable
    assert table.get(b"a") == durable.get(b"a")
    asked = table.multi_get(spark.createDataFrame([(b"a",), (b"zz",)], "key binary")).collect()
    assert {bytes(r.key): r.found for r in asked} == {b"a": b"a" in durable, b"zz": False}
    assert [bytes(r.key) for r in table.scan(b"c", b"f").collect()] == sorted(k for k in durable if b"c" <= k < b"f")


def test_empty_value_is_a_tombstone_once_stored(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t")
    table.write(changes(spark, [(b"k", 0, b"", 1)]))
    assert table.get(b"k") == b""
    table.flush_memory()
    assert table.get(b"k") is None
    assert table.dump().count() == 1


def test_stale_writer_is_fenced_and_versions_stay_readable(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    old = KeyedTable(spark, root)
    old.write(changes(spark, [(b"k", 0, b"1", 1)]))
    version = old.held.version
    new = KeyedTable(spark, root)
    with pytest.raises(Fenced):
        old.write(changes(spark, [(b"k", 0, b"2", 2)]))
    new.write(changes(spark, [(b"k", 0, b"3", 3)]))
    assert [bytes(r.value) for r in new.rows(version=version).collect()] == [b"1"]
    assert new.get(b"k") == b"3"


def test_write_async_is_done_once_durable(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t")
    futures = [table.write_async(changes(spark, [(b"k", 0, b"%d" % i, i)])) for i in range(3)]
    assert [f.result() for f in futures] == [1, 2, 3]
    assert table.get(b"k") == b"2"
    table.close()


def test_stream_writes_each_batch_once(spark, tmp_path):
    source, root = f"file://{tmp_path}/in", f"file://{tmp_path}/t"
    table = KeyedTable(spark, root)
    for n in range(3):
        changes(spark, [(b"k%d" % i, 0, b"v%d" % n, n * 10 + i) for i in range(4)]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
        ingest(stream, table, f"file://{tmp_path}/check").awaitTermination()
    assert {bytes(r.value) for r in table.scan().collect()} == {b"v2"}
    assert table.held.refresh().next_wal_id == 4
    table.write(changes(spark, [(b"k0", 0, b"again", 99)]), "stream", 2)  # delivered again
    assert table.get(b"k0") == b"v2"


# safety of the store


def test_a_fenced_writer_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    old = KeyedTable(spark, root)
    old.write(changes(spark, [(b"k", 0, b"old", 1)]))
    old.held.refresh()
    new = KeyedTable(spark, root)
    assert new.write(changes(spark, [(b"k", 0, b"good", 2)])) == 2
    refresh = old.held.refresh
    old.held.refresh = lambda: new.manifests.latest()[1]  # the old writer looked before the new one came
    with pytest.raises(Fenced):
        old.write(changes(spark, [(b"k", 0, b"bad", 3)]))
    old.held.refresh = refresh
    assert new.get(b"k") == b"good" and KeyedTable(spark, root).get(b"k") == b"good"
    assert len(list((tmp_path / "t" / "wal").iterdir())) == 2  # and its rows are gone


def test_two_threads_write_to_one_table(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    table = KeyedTable(spark, f"file://{tmp_path}/t")
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda i: table.write(changes(spark, [(b"k%d" % i, 0, b"v%d" % i, i)])), range(8)))
    assert sorted(ids) == list(range(1, 9))
    assert {bytes(r.key): bytes(r.value) for r in table.scan().collect()} == {b"k%d" % i: b"v%d" % i for i in range(8)}


def test_torn_manifests_do_not_block_a_table(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    table = KeyedTable(spark, root)
    table.write(changes(spark, [(b"k", 0, b"v", 1)]))
    last = table.held.version
    folder = tmp_path / "t" / "manifest"
    (folder / f"{last + 1:020d}.manifest").write_bytes(b"")
    whole = (folder / f"{last:020d}.manifest").read_bytes()
    (folder / f"{last + 2:020d}.manifest").write_bytes(whole[: len(whole) // 2])
    (folder / ".hidden").write_bytes(b"x")
    again = KeyedTable(spark, root)
    assert again.held.version == last + 3 and again.get(b"k") == b"v"
    again.write(changes(spark, [(b"k", 0, b"w", 2)]))
    assert KeyedTable(spark, root).get(b"k") == b"w"


def test_a_compactor_of_its_own(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    table = KeyedTable(spark, root, table_bytes=60)
    compactor = Compactor(spark, root, limit=2)
    assert compactor.run_once() == []
    for n in range(2):
        table.write(changes(spark, [(b"key%d" % i, 0, b"value%d" % n, n * 10 + i) for i in range(8)] + [(b"gone", n, b"x", n * 10 + 9)]))
        table.flush_memory()
    held = table.held.refresh()
    assert len(held.level0) > 2 and all(f.bytes <= 60 + 14 for f in held.level0)  # flushed tables are cut by bytes
    compactor.tables.table_bytes = 60
    (run,) = compactor.run_once()
    m = table.held.refresh()
    assert m.level0 == () and [r for r, _ in m.runs] == [run] and len(m.runs[0][1]) > 1
    assert [f.first_key for f in m.runs[0][1]] == sorted(f.first_key for f in m.runs[0][1])
    assert {bytes(r.value) for r in table.scan().collect()} == {b"value1"} and table.get(b"gone") is None
    other = Compactor(spark, root)
    with pytest.raises(Fenced):
        compactor.run_once()
    table.write(changes(spark, [(b"key0", 0, b"last", 99)]))
    table.flush_memory()
    other.limit = 1
    other.start(0.2)
    assert other.next_result(60) == run + 1
    other.stop()
    assert other.next_result() is None and table.get(b"key0") == b"last" and table.get(b"key1") == b"value1"


def test_reads_skip_tables_by_range_and_filter(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t")
    for n in range(3):
        table.write(changes(spark, [(b"k%05d" % i, 0, b"v", i) for i in range(n, 900, 3)]))
        table.flush_memory()
    opened = []
    read = table.tables.read
    table.tables.read = lambda ids: opened.append(ids) or read(ids)
    assert table.get(b"k00301") == b"v" and len(opened) < 3
    plan = table.rows(key=b"k00301")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan
    opened.clear()
    assert table.get(b"zzz") is None and opened == []
    asked = spark.createDataFrame([(b"k00300",), (b"a",), (None,)], "key binary")
    assert {r.key if r.key is None else bytes(r.key): r.found for r in table.multi_get(asked).collect()} == {b"k00300": True, b"a": False, None: False}
    assert len(opened) < 3
    table.tables.filter = lambda t: None  # no filter is no answer
    assert table.get(b"k00301") == b"v"


def test_few_keys_make_no_filter(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", min_filter_keys=5)
    table.write(changes(spark, [(b"a", 0, b"v", 1)]))
    (file,) = table.flush_memory()
    assert table.tables.filter(file.table_id) is None and table.get(b"a") == b"v"


def test_maintenance_beside_a_stream(spark, tmp_path):
    source, root = f"file://{tmp_path}/in", f"file://{tmp_path}/t"
    table = KeyedTable(spark, root, level0_bytes=20)
    service = Maintenance(table, 0.3).start()
    for n in range(6):
        changes(spark, [(b"k%d" % i, 0, b"v%d" % n, n * 10 + i) for i in range(4)]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
        ingest(stream, table, f"file://{tmp_path}/check").awaitTermination()
    service.stop(everything=True)
    m = table.held.refresh()
    assert m.wals == () and (m.level0 or m.runs)
    assert {bytes(r.key): bytes(r.value) for r in table.scan().collect()} == {b"k%d" % i: b"v5" for i in range(4)}
    table.close()


def test_table_as_bytes(spark):
    rows = log(spark, [(b"b", 1, None, 2, 1), (b"a", 0, b"v", 1, 1)]).withColumn("t", F.lit(1))
    (r,) = rowformat.table_bytes(rows, ["t"]).collect()
    assert bytes(r.table) == b"\0\0\0\1\0\0\0\2a\0v" + b"\0\0\0\1\0\0\0\1b\1"


def test_tables_as_one_byte_string(spark):
    rows = log(spark, [(b"key%03d" % i, 0, b"v" * (i % 9), i, 1) for i in range(100)]).withColumn("t", F.lit(1)).drop("wal_id")
    blocks = rowformat.encode_blocks(rowformat.place_in_blocks(rows, ["t"], 120), ["t"], "zlib")
    tables = rowformat.encode_tables(blocks, ["t"], codec="zlib")
    want = {r.block_no: bytes(r.block) for r in blocks.collect()}
    tables = spark.createDataFrame(tables.collect(), tables.schema)
    read = lambda **x: {r.block_no: bytes(r.block) for r in rowformat.read_blocks(tables, ["t"], **x).collect()}
    assert read() == want
    firsts = {r.block_no: bytes(r.first_key) for r in blocks.collect()}
    some = read(low=b"key040", high=b"key050")
    assert some == {n: want[n] for n in some} and len(some) < 9
    assert all(n in some for n, k in firsts.items() if b"key040" <= k < b"key050")
    info = tables.select(rowformat.table_info(F.col("table")).alias("i")).first().i
    assert bytes(info.first_key) == b"key000" and info.filter_len == 0 and info.codec == "zlib"
    torn = tables.withColumn("table", F.concat(F.lit(b"x"), F.substring("table", 3, 1 << 20)))
    assert rowformat.read_blocks(torn, ["t"]).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from keystrata.sources import scratch

    class Far:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://far:7077"
            getConf = staticmethod(lambda: Far.conf)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.shared_folder(Far)
    small = spark.createDataFrame([(1, "abc")], "a bigint, b string")
    assert small.agg(F.sum(scratch.row_bytes(small))).first()[0] == 8 * 6 + 8 + 3
