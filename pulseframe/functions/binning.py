"""Interval and quantile binning as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(col: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> Column:
    """Label by interval: (a, b] when ``right``, else [a, b). Outside → null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        over = F.lit(True) if lo == -math.inf else (col > lo if right else col >= lo)
        under = F.lit(True) if hi == math.inf else (col <= hi if right else col < hi)
        test = col.isNotNull() & over & under
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def count_below(col: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted ``cuts`` are strictly below ``col``, by bisection."""
    cuts = list(cuts)

    def split(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col > F.lit(cuts[mid]), split(mid + 1, hi)).otherwise(split(lo, mid))

    return split(0, len(cuts))


def quantile_label(col: Column, edges: Sequence[float | None]) -> Column:
    """0-based bin between distinct sorted edges; the lowest edge is included.

    Equal values share a bin. Null, or outside the edges → null.
    """
    edges = sorted({e for e in edges if e is not None})
    if len(edges) < 2:
        return F.lit(None).cast("int")
    inside = (col >= F.lit(edges[0])) & (col <= F.lit(edges[-1]))
    return F.when(inside, count_below(col, edges[1:-1])).cast("int")
