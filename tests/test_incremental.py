import random
from datetime import datetime, timedelta

import pytest
from keystrata.operators.incremental import IncrementalTable, manifest_delta, record_delta, visible_changes
from pyspark.sql import functions as F

FILES = "store_id bigint, id bigint, last_modified timestamp_ntz, checksum bigint, run_id string, wal_id string"
RUNS = "run_id bigint, store_id bigint, started_at timestamp_ntz, status string, next_wal_sst_id bigint, change string"
T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def brute(files, runs):
    files = {f for f in files if None not in f[:3]}
    done = sorted({(s, t, r, n) for r, s, t, st, n in runs if st == "committed" and s is not None and t is not None})
    out, before = set(), {}
    for store, start, run, upto in done:
        seen = {}
        for s, i, m, c in files:
            if s == store and upto is not None and i < upto and m <= start:
                seen[i] = max(seen.get(i, (m, -(2**62))), (m, c if c is not None else -(2**62)))
        old = before.get(store, {})
        out |= {(store, run, i, "added" if i not in old else "replaced") for i, v in seen.items() if i not in old or old[i][1] != v[1]}
        out |= {(store, run, i, "removed") for i in old if i not in seen}
        before[store] = seen
    return out


def run(spark, files, runs):
    f = spark.createDataFrame([(*x, "clash", "clash") for x in files], FILES)
    r = spark.createDataFrame([(*x, "clash") for x in runs], RUNS)
    out = [tuple(x) for x in visible_changes(f, r).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    files = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(300, 340), at(rng.randrange(0, 2000)), rng.choice([1, 2, 3, None])) for _ in range(250)]
    files += files[:40] + [(1, None, at(1), 1), (1, 301, None, 1)]
    runs = [(n, rng.choice([1, 1, 2, 3, None]), rng.choice([at(rng.randrange(0, 2400)), None]), rng.choice(["committed", "committed", "failed", "fenced", None]), rng.choice([None, 0, rng.randrange(290, 345), 10**9])) for n in range(60)]
    assert run(spark, files, runs + runs[:10]) == brute(files, runs)


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [(1, 1, at(0), 1)], []) == set()
    assert run(spark, [], [(1, 1, at(0), "committed", 5)]) == set()


def test_manifest_delta_with_deletion_vectors(spark):
    a = spark.createDataFrame([("f", "1", [1]), ("g", "1", None), ("h", "1", [2, 1]), ("i", None, [])], "name string, version string, deleted_rows array<bigint>")
    b = spark.createDataFrame([("g", "2", None), ("h", "1", [1, 2]), ("i", None, [3]), ("j", "1", None), ("j", "1", None)], a.schema)
    assert {tuple(r) for r in manifest_delta(a, b).collect()} == {("f", "removed"), ("g", "replaced"), ("i", "masked"), ("j", "added")}


def test_runs_survive_failures_without_skipping_or_repeating(spark, tmp_path):
    table = IncrementalTable(spark, f"file://{tmp_path}/t")
    schema = "name string, version string"
    first = spark.createDataFrame([("a", "1"), ("b", "1")], schema)
    take = lambda delta: delta.filter("change in ('added', 'replaced')")
    table.run(first, take, "r1")

    def broken(delta):
        raise RuntimeError("lost")

    second = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1")], schema)
    with pytest.raises(RuntimeError):
        table.run(second, broken, "r2")
    assert len(table.commits()) == 1
    table.run(second, take, "r3")
    assert table.run(second, take, "r4") is None  # nothing is new
    assert table.run(second, take, "r3") is None  # applied already
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", "added"), ("a", "replaced"), ("b", "added"), ("c", "added")]
    again = IncrementalTable(spark, f"file://{tmp_path}/t")
    assert [c["run_id"] for c in again.commits()] == ["r1", "r3"]


def test_commits_are_gathered_now_and_then(spark, tmp_path, monkeypatch):
    from keystrata.operators import incremental

    monkeypatch.setattr(incremental, "CHECKPOINT", 3)
    table = IncrementalTable(spark, f"file://{tmp_path}/t")
    for i in range(7):
        table.run(spark.createDataFrame([("a", str(i))], "name string, version string"), lambda d: d, f"r{i}")
    read = []
    one = table.log.read
    table.log.read = lambda n: read.append(n) or one(n)
    assert [c["run_id"] for c in table.commits()] == [f"r{i}" for i in range(7)] and len(read) == 2
    assert [c["number"] for c in table.commits()] == list(range(1, 8))


CONTENT = {("f", "1"): "ab", ("g", "1"): "abcc", ("g", "2"): "bccd", ("h", "1"): "xyz", ("i", None): "pq", ("j", "1"): "kk"}
MANIFEST = "name string, version string, deleted_rows array<bigint>"


def reader(spark):
    rows = spark.createDataFrame([(n, v, i, x) for (n, v), text in CONTENT.items() for i, x in enumerate(text)], "name string, version string, position bigint, x string")
    return lambda files: rows.withColumnsRenamed({"name": "n", "version": "v"}).join(files, (F.col("n") == files["name"]) & F.col("v").eqNullSafe(files["version"])).select("name", "version", "position", "x")


def test_records_inserted_and_deleted_by_files_and_vectors(spark):
    a = spark.createDataFrame([("f", "1", [1]), ("g", "1", None), ("h", "1", [2]), ("i", None, [])], MANIFEST)
    b = spark.createDataFrame([("g", "2", [1]), ("h", "1", [0]), ("i", None, None), ("j", "1", None), ("j", "1", None)], MANIFEST)
    got = sorted((r.name, r.x, r.position, r.change) for r in record_delta(a, b, reader(spark)).collect())
    assert got == [("f", "a", 0, "deleted"), ("g", "a", 0, "deleted"), ("g", "c", 3, "deleted"), ("g", "d", 3, "inserted"), ("h", "x", 0, "deleted"), ("h", "z", 2, "inserted"), ("j", "k", 0, "inserted"), ("j", "k", 1, "inserted")]


def test_output_of_deleted_records_is_taken_back(spark, tmp_path):
    table = IncrementalTable(spark, f"file://{tmp_path}/t")
    versions = [[("f", "1", [1]), ("g", "1", None), ("h", "1", [2])], [("g", "2", [1]), ("h", "1", [0]), ("j", "1", None)]]
    for i, files in enumerate(versions):
        table.run(spark.createDataFrame(files, MANIFEST), lambda d: d.selectExpr("name", "upper(x) as x", "change"), f"r{i}", reader(spark))
        living = sorted((n, x.upper()) for n, v, gone in files for p, x in enumerate(CONTENT[n, v]) if p not in (gone or []))
        assert sorted(tuple(r) for r in table.read().collect()) == living
