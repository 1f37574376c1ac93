import random
from collections import defaultdict

import numpy as np
import pytest
from keystrata.llm import packing
from keystrata.llm.packing import ATTENTION_SHARE, LEAST_ITEMS, TOKENS_PER_ITEM, best_fit, fill_report, pack


def check(rows, sizes, kinds):
    covered, used, items, cost = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        if r.bin_id is None:
            assert r.n_tokens == 0 and not sizes[r.doc_id]
            covered[r.container_id, r.doc_id] = covered[r.container_id, r.doc_id]
            continue
        covered[r.container_id, r.doc_id].append((r.token_start, r.token_start + r.n_tokens))
        used[r.container_id, r.bin_id] += r.n_tokens
        items[r.container_id, r.bin_id] += 1
        cost[r.container_id, r.bin_id] += r.n_tokens**2
    for (k, b), n in used.items():
        assert n <= kinds[k] and items[k, b] <= max(LEAST_ITEMS, kinds[k] // TOKENS_PER_ITEM) and (items[k, b] == 1 or cost[k, b] <= ATTENTION_SHARE * kinds[k] ** 2)
    assert set(covered) == {(k, d) for k in kinds for d in sizes}
    for (k, d), spans in covered.items():
        size = sizes[d] or 0
        spans.sort()
        assert [s[0] for s in spans] == [0, *[s[1] for s in spans[:-1]]][: len(spans)]
        assert (spans[-1][1] if spans else 0) == size
        assert len(spans) == 1 or size > kinds[k] or size == 0  # cut only what exceeds a container


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_token_is_packed_once_under_all_constraints(spark, rule):
    rng = random.Random(3)
    sizes = {i: rng.choice([None, 0, 1, 5, rng.randrange(1, 90), rng.randrange(1, 400)]) for i in range(500)}
    sizes |= {i: 33 for i in range(500, 900)}  # ties
    kinds = {1: 64, 2: 100}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint").selectExpr("*", "7 as bin_id", "0 as block")
    containers = spark.createDataFrame([(1, 64), (2, 100), (2, 100), (3, 0), (4, None)], "container_id int, capacity_tokens bigint")
    packed = pack(df, containers, rule=rule, block_items=200)
    check(packed.collect(), sizes, kinds)
    for r in fill_report(packed).collect():
        assert r.tokens == sum(x or 0 for x in sizes.values()) and r.fullest <= r.capacity_tokens


def test_fill_is_near_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 500, 4000))[::-1].astype(np.int64)
    bins, refused = best_fit(sizes, 1000, 10**6, 10**12)
    assert not refused.any()
    assert bins.max() + 1 <= np.ceil(sizes.sum() / 1000) * 1.01 + 1


def test_item_limit_and_attention_bind():
    ones = np.ones(100, np.int64)
    bins, refused = best_fit(ones, 1000, 10, 10**9)
    assert bins.max() + 1 == 10 and 60 <= (refused & 1).sum() <= 90  # full containers are closed now and then
    bins, refused = best_fit(np.full(8, 10, np.int64), 1000, 100, 200)
    assert bins.max() + 1 == 4 and (refused >> 1).sum() > 0
    bins, refused = best_fit(np.array([99, 1]), 100, 10, 0.95 * 100 * 100)
    assert bins.tolist() == [0, 1] and refused.tolist() == [0, 2]  # alone it may cost more than the limit


def test_limits_are_parameters(spark):
    df = spark.createDataFrame([(i, 10) for i in range(40)], "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([(1, 400)], "container_id int, capacity_tokens bigint")
    bins = lambda **x: pack(df, kinds, **x).select("bin_id").distinct().count()
    assert bins(tokens_per_item=1) == 1 and bins(tokens_per_item=40) == 4 and bins(tokens_per_item=1, attention_share=0.01) == 3


def test_loose_containers_of_all_blocks_are_packed_again(spark):
    rng = random.Random(6)
    sizes = {i: rng.randrange(1, 60) for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([(1, 1000)], "container_id int, capacity_tokens bigint")
    packed = pack(df, kinds, block_items=300, tokens_per_item=1).collect()
    assert len({r.bin_id for r in packed}) <= sum(sizes.values()) / 1000 * 1.03 + 1
    assert sorted(r.doc_id for r in packed) == sorted(sizes)


def test_any_number_of_kinds(spark, monkeypatch):
    monkeypatch.setattr(packing, "KINDS_AT_A_TIME", 2)
    df = spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([(i, 10 + i) for i in range(5)], "container_id int, capacity_tokens bigint")
    assert sorted(r.container_id for r in pack(df, kinds).collect()) == list(range(5))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([(1, 8)], "container_id int, capacity_tokens bigint")
    assert pack(none, kinds).collect() == []
    assert pack(spark.createDataFrame([(1, 5)], none.schema), kinds.limit(0)).collect() == []
