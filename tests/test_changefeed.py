import random

from keystrata.operators.changefeed import apply_changes

FEED = "store_id bigint, key binary, kind tinyint, value binary, seq bigint, rank int, payload string"


def brute(rows):
    best = {}
    for store, key, kind, value, seq, *_ in rows:
        if kind in (0, 1) and key and seq is not None and seq >= best.get((store, key), (-1,))[0]:
            best[store, key] = (seq, kind, value)
    return {(s, k, seq) for (s, k), (seq, kind, value) in best.items() if kind == 0 and value}


def feed(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), rng.choice([b"hot", b"hot", bytes([rng.randrange(5)]), b"", None]), rng.choice([0, 0, 1, 2, -1, None]), rng.choice([b"v", b"", None]), rng.choice([i * 2, None]), 1, "p") for i in range(1, n)]
    rows += rows[: n // 3]
    rng.shuffle(rows)
    return rows


def run(spark, rows, base=None):
    return {(r.store_id, bytes(r.key), r.seq) for r in apply_changes(spark.createDataFrame(rows, FEED), ["store_id"], base).collect()}


def test_matches_brute_force_in_any_order(spark):
    rows = feed(400, 1)
    assert run(spark, rows) == brute(rows)


def test_merges_into_a_base(spark):
    rows = feed(300, 2)
    old = [r for r in rows if r[4] is not None and r[4] <= 300]
    new = [r for r in rows if r not in old]
    base = apply_changes(spark.createDataFrame(old, FEED), ["store_id"])
    assert run(spark, new, base) == brute(rows)


def test_empty_feed_gives_the_base_back(spark):
    base = spark.createDataFrame([(1, b"a", 5)], "store_id bigint, key binary, seq bigint")
    assert run(spark, [], base) == {(1, b"a", 5)}
    assert run(spark, []) == set()


def test_a_put_older_than_a_delete_of_the_base_stays_deleted(spark):
    rows = feed(300, 5)
    half = len(rows) // 2  # in order of arrival, not of seq
    base = apply_changes(spark.createDataFrame([*rows[:half], (1, b"late", 1, None, 900, 1, "p")], FEED), ["store_id"], tombstones=True)
    late = [*rows[half:], (1, b"late", 0, b"v", 800, 1, "p")]
    again = apply_changes(spark.createDataFrame(late, FEED), ["store_id"], base, tombstones=True)
    assert run(spark, [], again) == run(spark, late, base) == brute(rows)


def test_any_split_and_order_of_the_feed_gives_the_same(spark):
    for seed in range(4):
        rng, rows = random.Random(seed), feed(250, seed)
        parts, base = [[] for _ in range(rng.randrange(2, 5))], None
        for r in rows:
            parts[rng.randrange(len(parts))].append(r)
        for part in parts[:-1]:
            base = apply_changes(spark.createDataFrame(part, FEED), ["store_id"], base, tombstones=True)
        assert run(spark, parts[-1], base) == brute(rows)
