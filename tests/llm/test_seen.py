import random

import numpy as np
from keystrata.llm.seen import BlockedFilter, SeenKeys, blocked_rate, error_rate, filter_shape, seen_before

HISTORY, INCOMING = "key binary, note string", "incoming_id bigint, key binary, first_id bigint"


def brute(history, incoming):
    known = {k for k in history if k}
    out = {}
    for i, k in sorted(incoming):
        out[i] = bool(k) and k in known
        if k:
            known.add(k)
    return out


def run(spark, history, incoming):
    h = spark.createDataFrame([(k, "x") for k in history], HISTORY)
    n = spark.createDataFrame([(i, k, None) for i, k in incoming], INCOMING)
    return {r.incoming_id: r for r in seen_before(h, n).collect()}


def test_matches_brute_force_with_hot_keys_nulls_and_repeats(spark):
    rng = random.Random(5)
    keys = [bytes([rng.randrange(256) for _ in range(rng.randrange(1, 6))]) for _ in range(300)] + [b"hot"] * 200
    history = [rng.choice(keys) for _ in range(600)] + [None, b""] * 3
    incoming = [(i, rng.choice(keys + [None, b"", b"hot ", b"new" + bytes([i % 256])])) for i in range(400)]
    got = run(spark, history, incoming)
    want = brute(history, incoming)
    assert {i: r.seen for i, r in got.items()} == want
    assert all(r.maybe_seen or not r.seen for r in got.values())  # no false negative


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert {i: r.seen for i, r in run(spark, [], [(1, b"a"), (2, b"a"), (3, None)]).items()} == {1: False, 2: True, 3: False}
    assert run(spark, [b"a"], []) == {}


def test_kept_filters_decide_batch_after_batch(spark, tmp_path):
    rng = random.Random(9)
    kept, known = SeenKeys(spark, f"file://{tmp_path}/t", shard_keys=100), set()
    for n, size in enumerate((50, 20, 400, 30, 0)):  # the third batch exceeds what the filters were sized for
        batch = [(i, rng.choice([None, b"", b"hot"]) if rng.random() < 0.4 else b"%d" % rng.randrange(900)) for i in range(size)]
        got = {r.incoming_id: r for r in kept.check(spark.createDataFrame([(*x, None) for x in batch], INCOMING)).collect()}
        want = brute(known, batch)
        assert {i: r.seen for i, r in got.items()} == want and all(r.maybe_seen or not r.seen for r in got.values())
        known |= {k for _, k in batch if k}
        assert sorted(bytes(r.key) for r in kept.keys().collect()) == sorted(known)
        assert kept.state()["keys"] == len(known) <= kept.state()["capacity"]
    again = SeenKeys(spark, f"file://{tmp_path}/t", shard_keys=100)
    assert again.check(spark.createDataFrame([(1, b"hot", None), (2, b"no", None)], INCOMING)).orderBy("incoming_id").toPandas().seen.tolist() == [True, False]


def test_measured_rate_is_near_the_target(spark):
    h = spark.range(20000).selectExpr("cast(cast(id as string) as binary) as key")
    n = spark.range(2000).selectExpr("id as incoming_id", "cast(concat('n', id) as binary) as key")
    row = error_rate(h, n, 0.01).first()
    assert row.absent_probes == 22000
    assert row.error_rate < 0.015


def test_filter_shape_reaches_its_rate():
    rng = np.random.default_rng(1)
    for target in (0.02, 0.001):
        bits, probes = filter_shape(target)
        assert blocked_rate(bits, probes) <= target
        f = BlockedFilter(50_000, bits, probes)
        inside, outside = rng.integers(-(2**63), 2**63 - 1, 50_000), rng.integers(-(2**63), 2**63 - 1, 100_000)
        f.add(inside)
        assert f.query(inside).all()
        assert f.query(outside).mean() < 2 * target
