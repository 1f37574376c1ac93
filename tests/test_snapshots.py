import random

from keystrata.operators.snapshots import compare_snapshots, handle_changes

SST = "struct<sst_id:string,first_key:binary,index_offset:bigint,index_len:bigint,filter_offset:bigint,filter_len:bigint,codec:string>"
SNAPSHOT = f"store_id bigint, manifest_id bigint, location string, l0 array<{SST}>, compacted array<struct<id:bigint,ssts:array<{SST}>>>, sst_id string, field string"
MANIFEST = "store_id bigint, id bigint, location string, manifest_id bigint"


def sst(name, codec="none", first=b"a", offset=1):
    return (name, first, offset, 1, 1, 0, codec)


def run(spark, snapshots, manifests):
    s = spark.createDataFrame([(*x, "clash", "clash") for x in snapshots], SNAPSHOT)
    m = spark.createDataFrame([(*x, 99) for x in manifests], MANIFEST)
    out = handle_changes(s, m)
    return {(r.store_id, r.prev_manifest_id, r.manifest_id, r.sst_id): (r.change_kind, r.changed_fields) for r in out.collect()}


def test_added_removed_changed_moved(spark):
    snapshots = [
        (1, 1, "a", [sst("x"), sst("y"), sst("y")], []),
        (1, 2, "b", [sst("y", codec="lz4"), None], [(7, [sst("x"), sst("z")])]),
        (1, 2, "b", [sst("y", codec="lz4")], [(7, [sst("z"), sst("x")])]),  # delivered again, another order
        (1, 3, "ghost", [sst("w")], []),  # no manifest of the store
        (1, 5, "c", None, []),
        (2, 1, "a", [sst("x")], None),
        (None, 1, "a", [sst("x")], []),
        (1, None, "a", [sst("v")], []),
    ]
    manifests = [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, None, "ghost"), (1, 5, "c"), (2, 1, "a"), (2, 3, "ghost")]
    assert run(spark, snapshots, manifests) == {
        (1, 1, 2, "x"): ("changed", ["layer", "run_id"]),
        (1, 1, 2, "y"): ("changed", ["codec"]),
        (1, 1, 2, "z"): ("added", ["codec", "filter_len", "filter_offset", "first_key", "index_len", "index_offset", "layer", "run_id"]),
        (1, 2, 5, "x"): ("removed", ["codec", "filter_len", "filter_offset", "first_key", "index_len", "index_offset", "layer", "run_id"]),
        (1, 2, 5, "y"): ("removed", ["codec", "filter_len", "filter_offset", "first_key", "index_len", "index_offset", "layer", "run_id"]),
        (1, 2, 5, "z"): ("removed", ["codec", "filter_len", "filter_offset", "first_key", "index_len", "index_offset", "layer", "run_id"]),
    }


def test_nulls_are_values_of_their_own(spark):
    snapshots = [(1, 1, "a", [sst("x", first=None), sst("y", codec=None)], []), (1, 2, "b", [sst("x", first=b""), sst("y", codec=None)], [])]
    assert run(spark, snapshots, [(1, 1, "a"), (1, 2, "b")]) == {(1, 1, 2, "x"): ("changed", ["first_key"])}


def test_key_with_several_rows_is_a_set_of_cells(spark):
    versions = spark.createDataFrame([(1, 1), (1, 2)], "g int, v int")
    records = spark.createDataFrame([(1, 1, "k", "a"), (1, 1, "k", "b"), (1, 2, "k", "a"), (1, 1, "j", "a"), (1, 2, "j", "a")], "g int, v int, key string, f string")
    out = compare_snapshots(versions, records, "g", "v", "key").collect()
    assert [(r.key, r.change_kind, r.changed_fields) for r in out] == [("k", "changed", ["f"])]


def test_many_versions_with_gaps_equal_brute_force(spark):
    rng = random.Random(2)
    numbers = {g: sorted(rng.sample(range(1, 400), 150)) for g in (1, 2)}
    state, records, want = {}, [], set()
    for g, versions in numbers.items():
        old, state, last = {}, {}, None
        for v in versions:
            for _ in range(rng.randrange(0, 4)):
                k = f"k{rng.randrange(12)}"
                if rng.random() < 0.3:
                    state.pop(k, None)
                else:
                    state[k] = (rng.randrange(3), rng.choice([b"a", b"", None]))
            records += [(g, v, k, *x) for k, x in state.items()]
            if last is not None:
                for k in old.keys() | state.keys():
                    if old.get(k) != state.get(k):
                        want.add((g, last, v, k, "added" if k not in old else "removed" if k not in state else "changed"))
            old, last = dict(state), v
    rng.shuffle(records)
    df = spark.createDataFrame(records + records[:50], "g int, v bigint, key string, f int, b binary")
    versions = spark.createDataFrame([(g, v) for g, vs in numbers.items() for v in vs], "g int, v bigint")
    out = compare_snapshots(versions, df, "g", "v", "key").collect()
    assert len(out) == len(want) and {(r.g, r.prev_v, r.v, r.key, r.change_kind) for r in out} == want


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, 1, "a", [sst("x")], [])], []) == {}
