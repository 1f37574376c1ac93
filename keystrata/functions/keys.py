"""Byte keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading bytes two byte strings share, by halving: log2 many comparisons of slices."""
    shorter = F.least(F.octet_length(a), F.octet_length(b))

    grow = F.aggregate(F.array(*[F.lit(1 << i) for i in range(15, -1, -1)]), F.lit(0), lambda n, step: F.when((n + step <= shorter) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step)), n + step).otherwise(n))
    return F.when(a.isNotNull() & b.isNotNull(), grow).cast("bigint")
