"""Hilbert-curve codes of points with several dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert_codes(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of each point; ``axes`` hold integers in ``[0, 2**bits)``.

    Works on whole columns: the curve's rotations are undone bit plane by bit plane from the top, the
    planes are then Gray-decoded and interleaved. ``len(axes) * bits`` must not exceed 63.
    """
    n = len(axes)
    if n * bits > 63:
        raise ValueError("codes would not fit in 63 bits")
    x = [np.asarray(a).astype(np.uint64) for a in axes]
    one = np.uint64(1)
    plane = 1 << (bits - 1)
    while plane > 1:
        below, q = np.uint64(plane - 1), np.uint64(plane)
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        plane >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    fold = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        fold = np.where((x[n - 1] & np.uint64(plane)) != 0, fold ^ np.uint64(plane - 1), fold)
        plane >>= 1
    x = [a ^ fold for a in x]
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            code = (code << one) | ((a >> np.uint64(b)) & one)
    return code.astype(np.int64)


def hilbert_code(axes: list[Column], bits: int, spread: list[list[int]]) -> Column:
    """Column form of ``hilbert_codes`` for integer columns of any distribution; null counts as the least value.

    ``spread`` holds for each axis its quantiles in ascending order: they are put at equal distances on the
    grid and values between two of them in proportion, so that outliers take no room from the others. An
    axis without quantiles, or with one value, lies at 0.
    """
    points = [np.unique(np.asarray(s, np.int64)) if s else np.zeros(1, np.int64) for s in spread]

    @F.pandas_udf("long")
    def code(*cols: pd.Series) -> pd.Series:
        grid = []
        for c, known in zip(cols, points):
            low, top = known[0], (1 << bits) - 1
            # distances from the least value, so that large numbers keep their last digits
            values = (c.fillna(low).astype("int64").to_numpy() - low).astype(np.float64)
            at = np.interp(values, (known - low).astype(np.float64), np.linspace(0, top, len(known)) if len(known) > 1 else [0.0])
            grid.append(np.floor(at).astype(np.int64))
        return pd.Series(hilbert_codes(grid, bits))

    return code(*[a.cast("bigint") for a in axes])
