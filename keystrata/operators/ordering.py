"""Order-dependent helpers that stay distributed when one key holds a large share of the rows.

``Window.partitionBy(key).orderBy(t)`` hands every row of a hot key to one task. Each helper here cuts
the order axis of a key into buckets, solves every bucket with an ordinary window, and carries the
boundary from bucket to bucket through a summary of one row per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.functions.keys import common_prefix

_B, _C = "__bucket", "__carry"


def key_stretch(rows: DataFrame, key: str):
    """A function from a byte key to the number of its stretch, for the keys that occur in ``rows``.

    The stretch is the three bytes behind what the least and the greatest key share, so it does not
    decrease along the keys, fits whatever the keys begin with, and there are at most ``2**24`` of them.
    Both ends come from one aggregate inside the plan.
    """
    ends = rows.agg(F.min(key).alias("a"), F.max(key).alias("z")).select(F.coalesce(common_prefix(F.col("a"), F.col("z")), F.lit(0)).cast("int").alias("n"))
    shared = ends.scalar()
    return lambda k: F.conv(F.hex(F.call_function("rpad", F.substring(k, shared + 1, F.lit(3)), F.lit(3), F.lit(b"\x00"))), 16, 10).cast("bigint")


def week(ts: Column) -> Column:
    """Week number of a timestamp, independent of the session's time zone for zone-less timestamps."""
    return F.floor(F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")) / 7)


def with_previous(df: DataFrame, keys: list[str], order: list[str], payload: list[str], bucket: Column, out: str) -> DataFrame:
    """Add struct column ``out`` with ``payload`` of the row before, per ``keys`` in the order of ``order``.

    ``bucket`` must not decrease along ``order``. Rows without a predecessor get null. ``order`` must be
    unique per key for a defined result.
    """
    cols = df.columns
    d = df.withColumn(_B, bucket)
    item = F.struct(*[F.col(c) for c in payload])
    w = Window.partitionBy(*keys, _B).orderBy(*order)
    inner = d.withColumn(out, F.lag(item).over(w))
    ends = d.groupBy(*keys, _B).agg(F.max_by(item, F.struct(*[F.col(c) for c in order])).alias(_C))
    ends = ends.withColumn(_C, F.lag(_C).over(Window.partitionBy(*keys).orderBy(_B)))
    ends = ends.select(*[F.col(c).alias(f"__k_{i}") for i, c in enumerate(keys)], F.col(_B).alias("__b2"), _C)
    on = F.col(_B).eqNullSafe(F.col("__b2"))
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{i}"))
    return inner.join(ends, on, "left").select(*cols, F.coalesce(F.col(out), F.col(_C)).alias(out))


def with_next_event(left: DataFrame, left_time: str, right: DataFrame, right_time: str, keys: list[str], payload: list[str], bucket, out: str) -> DataFrame:
    """Forward as-of join: add struct ``out`` of the first ``right`` row with ``right_time >= left_time`` per key.

    ``bucket`` is a function from a time column to a bucket number that does not decrease with time.
    Ties among right rows go to the smallest payload. Left rows without a later right row get null.
    """
    return _as_of(left, left_time, right, right_time, keys, payload, bucket, out, forward=True)


def with_last_event(left: DataFrame, left_time: str, right: DataFrame, right_time: str, keys: list[str], payload: list[str], bucket, out: str) -> DataFrame:
    """Backward as-of join: add struct ``out`` of the last ``right`` row with ``right_time <= left_time`` per key.

    As ``with_next_event`` with the other direction; ties among right rows go to the greatest payload.
    """
    return _as_of(left, left_time, right, right_time, keys, payload, bucket, out, forward=False)


def _as_of(left: DataFrame, left_time: str, right: DataFrame, right_time: str, keys: list[str], payload: list[str], bucket, out: str, forward: bool) -> DataFrame:
    cols = left.columns
    item = F.struct(*[F.col(c) for c in payload])
    lrow = left.select(*keys, F.col(left_time).alias("__t"), F.lit(0).alias("__right"), F.lit(None).cast(right.select(item.alias("x")).schema["x"].dataType).alias(_C), F.struct(*[F.col(c) for c in cols]).alias("__row"))
    rrow = right.select(*keys, F.col(right_time).alias("__t"), F.lit(1).alias("__right"), item.alias(_C), F.lit(None).cast(lrow.schema["__row"].dataType).alias("__row"))
    both = lrow.unionByName(rrow).withColumn(_B, bucket(F.col("__t")))
    way = (lambda c: c.desc()) if forward else (lambda c: c.asc())
    # walking towards the left row, right rows of its own time come before it and the wanted one comes last
    w = Window.partitionBy(*keys, _B).orderBy(way(F.col("__t")), F.col("__right").desc(), way(F.col(_C))).rowsBetween(Window.unboundedPreceding, 0)
    inner = both.withColumn(out, F.last(_C, ignorenulls=True).over(w)).filter("__right = 0")
    edge = (F.min if forward else F.max)(F.when(F.col("__right") == 1, F.struct("__t", _C)))
    edges = both.groupBy(*keys, _B).agg(edge.alias("__f"))
    beyond = Window.partitionBy(*keys).orderBy(way(F.col(_B))).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("__f", F.last("__f", ignorenulls=True).over(beyond))
    edges = edges.select(*[F.col(c).alias(f"__k_{i}") for i, c in enumerate(keys)], F.col(_B).alias("__b2"), F.col(f"__f.{_C}").alias("__carried"))
    on = F.col(_B).eqNullSafe(F.col("__b2"))
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{i}"))
    return inner.join(edges, on, "left").select("__row.*", F.coalesce(F.col(out), F.col("__carried")).alias(out))


def with_running_total(df: DataFrame, keys: list[str], order: str, size: str, bucket: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows of a key strictly before this one in ``order``.

    ``order`` must be unique per key; ``bucket`` must not decrease along it.
    """
    cols = df.columns
    d = df.withColumn(_B, bucket)
    before = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = d.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)))
    sums = d.groupBy(*keys, _B).agg(F.sum(size).alias(_C))
    sums = sums.withColumn(_C, F.coalesce(F.sum(_C).over(Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"__k_{i}") for i, c in enumerate(keys)], F.col(_B).alias("__b2"), _C)
    on = F.col(_B).eqNullSafe(F.col("__b2"))
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{i}"))
    return inner.join(sums, on).select(*cols, (F.col(out) + F.col(_C)).alias(out))


def with_running_max(df: DataFrame, keys: list[str], order: str, values: list[str], bucket: Column, out: list[str]) -> DataFrame:
    """Add, for each of ``values``, its greatest over the rows of a key up to and with this one in ``order``."""
    cols = df.columns
    d = df.withColumn(_B, bucket)
    upto = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = d.select("*", *[F.max(v).over(upto).alias(o) for v, o in zip(values, out)])
    earlier = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    tops = d.groupBy(*keys, _B).agg(*[F.max(v).alias(f"__m_{i}") for i, v in enumerate(values)])
    tops = tops.select("*", *[F.max(f"__m_{i}").over(earlier).alias(f"__c_{i}") for i in range(len(values))])
    tops = tops.select(*[F.col(c).alias(f"__k_{i}") for i, c in enumerate(keys)], F.col(_B).alias("__b2"), *[f"__c_{i}" for i in range(len(values))])
    on = F.col(_B).eqNullSafe(F.col("__b2"))
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{i}"))
    return inner.join(tops, on, "left").select(*cols, *[F.greatest(o, f"__c_{i}").alias(o) for i, o in enumerate(out)])
