import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from keystrata.operators.ordering import with_last_event, with_next_event, with_previous, with_running_total
from pyspark.sql import functions as F

fast = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(-50, 50)), unique=True, max_size=40)


@fast
@given(data=rows)
def test_previous_crosses_buckets(spark, data):
    df = spark.createDataFrame(data, "k int, t int")
    got = {(r.k, r.t): r.p and r.p.t for r in with_previous(df, ["k"], ["t"], ["t"], F.floor(F.col("t") / 7), "p").collect()}
    for k, t in data:
        before = [x for j, x in data if j == k and x < t]
        assert got[k, t] == (max(before) if before else None)


@fast
@given(data=rows, sizes=st.lists(st.integers(0, 9), min_size=40, max_size=40))
def test_running_total_crosses_buckets(spark, data, sizes):
    full = [(k, t, s) for (k, t), s in zip(data, sizes)]
    df = spark.createDataFrame(full, "k int, t int, s int")
    got = {(r.k, r.t): r.b for r in with_running_total(df, ["k"], "t", "s", F.floor(F.col("t") / 5), "b").collect()}
    for k, t, _ in full:
        assert got[k, t] == sum(s for j, x, s in full if j == k and x < t)


@fast
@given(left=rows, right=rows)
def test_next_event_crosses_buckets(spark, left, right):
    a, b = spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "k int, u int")
    out = with_next_event(a, "t", b, "u", ["k"], ["u"], lambda c: F.floor(c / 6), "n").collect()
    assert sorted((str(r.k), r.t) for r in out) == sorted((str(k), t) for k, t in left)
    for r in out:
        later = [u for k, u in right if k == r.k and u >= r.t]
        assert (r.n and r.n.u) == (min(later) if later else None)


@fast
@given(left=rows, right=rows)
def test_last_event_crosses_buckets(spark, left, right):
    a, b = spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "k int, u int")
    out = with_last_event(a, "t", b, "u", ["k"], ["u"], lambda c: F.floor(c / 6), "n").collect()
    assert len(out) == len(left)
    for r in out:
        earlier = [u for k, u in right if k == r.k and u <= r.t]
        assert (r.n and r.n.u) == (max(earlier) if earlier else None)


def test_hot_key_is_cut_into_buckets(spark):
    rng = random.Random(2)
    data = [(0, t) for t in rng.sample(range(100000), 3000)] + [(1, 5)]
    df = spark.createDataFrame(data, "k int, t int")
    out = with_previous(df, ["k"], ["t"], ["t"], F.floor(F.col("t") / 1000), "p")
    order = sorted(t for k, t in data if k == 0)
    assert {r.t: r.p.t for r in out.filter("k = 0 and p is not null").collect()} == dict(zip(order[1:], order))
