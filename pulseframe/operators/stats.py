"""Fused column statistics.

Per-column figures are gathered with as few aggregates as possible and come
back as a plain dict: one row whose width is the number of columns, never a
function of the data size. Operators turn these figures into literals, so the
pass over the rows itself stays a narrow projection.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.session import materialize

# Counts of cells that one round of the quantile search gathers, about.
CELLS = 65_536


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def date_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def fused(df: DataFrame, exprs: Mapping[str, Column]) -> dict:
    """Run every expression in a single aggregate and return its only row."""
    if not exprs:
        return {}
    names = list(exprs)
    row = df.agg(*[exprs[n].alias(f"_{i}") for i, n in enumerate(names)]).first()
    return {n: row[i] for i, n in enumerate(names)}


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """Row count and nulls per column."""
    cols = list(df.columns if cols is None else cols)
    found = fused(df, {"*": F.count(F.lit(1)), **{f"c:{c}": F.count(F.col(c)) for c in cols}})
    n = found["*"]
    return n, {c: n - found[f"c:{c}"] for c in cols}


def adjusted_skewness(col: Column) -> Column:
    """Bias-adjusted sample skewness; null below three values or with no spread."""
    n = F.count(col).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.skewness(col) * factor)


def adjusted_kurtosis(col: Column) -> Column:
    n = F.count(col).cast("double")
    scaled = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(col) + 6)
    return F.when(n >= 4, scaled)


def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value as text) pairs of the non-null cells."""
    floats = (T.DoubleType, T.FloatType)
    same = {c: F.col(c) + 0.0 if isinstance(df.schema[c].dataType, floats) else F.col(c) for c in cols}  # -0.0 is 0.0
    texts = df.select(*[same[c].cast("string").alias(c) for c in cols])
    return texts.unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull())


def distinct_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column with its number of distinct non-null values.

    Values are grouped before they are counted, so no task holds a set of them.
    """
    values = long_values(df, cols).groupBy("column", "value").agg(F.lit(1).alias("one"))
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> dict[str, int]:
    """Distinct non-null values per column, in one job."""
    cols = list(cols)
    if approximate:
        return fused(df, {c: F.approx_count_distinct(F.col(c)) for c in cols})
    if not cols:
        return {}
    found = {r["column"]: r["unique_values"] for r in distinct_table(df, cols).collect()}
    return {c: found.get(c, 0) for c in cols}


def distinct_up_to(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, int]:
    """Distinct values per column, exact where there are at most ``limit``.

    A sketch settles the wide columns without a shuffle; only those it puts
    near the limit are counted exactly.
    """
    rough = distinct_counts(df, cols, approximate=True)
    near = [c for c in cols if rough[c] <= 4 * limit + 20]
    return rough | distinct_counts(df, near)


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column as text; ties go to the smallest.

    Columns are unpivoted and counted, so a value shared by a third of the rows
    is collapsed before the shuffle.
    """
    cols = list(cols)
    if not cols:
        return {}
    counts = long_values(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("b"))
    found = {r["column"]: r["b"]["value"] for r in best.collect()}
    return {c: found.get(c) for c in cols}


def quantiles(df: DataFrame, spec: Mapping[str, Sequence[float]], cells: int = CELLS) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles (linear; nulls and NaN ignored) of several columns.

    The columns are written once, narrow, as (column, value). Each round deals the values of
    every open range into equal cells and counts them, combined before the
    shuffle; a rank then goes on in its cell, whose own smallest and largest value
    bound the next range. A rank at a cell's edge is found. All marks of all columns
    share the rounds, and at most about ``cells`` counts reach the driver in one.
    """
    cols = list(spec)
    if not cols:
        return {}
    wide = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"{i}") for i, c in enumerate(cols)])
    data = wide.unpivot([], [f"{i}" for i in range(len(cols))], "c", "x").where("x IS NOT NULL").select(F.col("c").cast("int").alias("c"), "x")
    data = materialize(data, "values")
    head = {r["c"]: (r["n"], r["lo"], r["hi"]) for r in data.groupBy("c").agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    places = {i: [(head[i][0] - 1) * float(p) for p in spec[c]] for i, c in enumerate(cols) if i in head}
    ranks = {(i, r) for i, at in places.items() for a in at for r in (math.floor(a), math.ceil(a))}
    values = _order_statistics(data, head, ranks, cells)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for at in places.get(i, []):
            lo, hi = values[(i, math.floor(at))], values[(i, math.ceil(at))]
            out[c].append(lo if lo == hi else lo + (hi - lo) * (at - math.floor(at)))
        if i not in head:
            out[c] = [None for _ in spec[c]]
    return out


def _squeeze(x: float) -> float:
    """A monotone map under which ranges of very different sizes have cells of their own."""
    return math.copysign(min(math.log1p(abs(x)), 711.0), x)


def _scale(lo: float, hi: float) -> tuple[bool, float, float]:
    """(squeezed, start, width) by which the values of a range are dealt into cells."""
    a, b = _squeeze(lo), _squeeze(hi)
    return (True, a, b - a) if b - a > 1e-9 * max(1.0, abs(a), abs(b)) else (False, lo, hi - lo)


def _cell(x: Column, squeezed: Column, start: Column, width: Column, cells: int) -> Column:
    """The cell of a value; a range's smallest value is in the first one and its largest in the last."""
    bent = F.signum(x) * F.least(F.log1p(F.abs(x)), F.lit(711.0))
    at = (F.when(squeezed, bent).otherwise(x) - start) / width
    return F.least(F.greatest(F.floor(at * cells), F.lit(0)), F.lit(cells - 1)).cast("int")


def _order_statistics(data: DataFrame, head: Mapping[int, tuple], ranks: set[tuple[int, int]], cells: int) -> dict[tuple[int, int], float]:
    """Values at 0-based ranks of the columns ``c`` of rows (c, x)."""
    found: dict[tuple[int, int], float] = {}
    # Open ranges (column, first cell, smallest, largest value) with the rows below and inside, and the ranks wanted there.
    open_: dict[tuple, tuple[int, int, set[int]]] = {}

    def place(key: tuple, below: int, inside: int, wanted: set[int]) -> None:
        c, _, lo, hi = key
        for r in wanted:
            if lo == hi or r == below:
                found[(c, r)] = lo
            elif r == below + inside - 1:
                found[(c, r)] = hi
            else:
                open_.setdefault(key, (below, inside, set()))[2].add(r)

    for c, (n, lo, hi) in head.items():
        place((c, 0, lo, hi), 0, n, {r for k, r in ranks if k == c})
    if not open_:
        return found
    spark, x = data.sparkSession, F.col("x")
    # The first round's cells find a value's range in the later ones. One row per column, and at most one
    # range per mark, are small enough to be sent along.
    whole = spark.createDataFrame([(c, *_scale(lo, hi)) for c, _, lo, hi in open_], "c int, s boolean, a double, w double")
    first = max(16, cells // len(open_))
    dealt = data.join(F.broadcast(whole), "c").select("c", "x", _cell(x, F.col("s"), F.col("a"), F.col("w"), first).alias("first"))
    counts, keys = dealt.groupBy("c", F.col("first").alias("cell")), {(key[0],): key for key in open_}
    by_key = ["c"]
    while open_:
        got: dict[tuple, list] = {}
        for r in counts.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            got.setdefault(keys[tuple(r[k] for k in by_key)], []).append(r)
        previous, open_ = open_, {}
        for key, (below, _, wanted) in previous.items():
            ascending, at = sorted(wanted), 0
            for r in sorted(got.get(key, []), key=lambda r: r["cell"]):
                past = bisect_left(ascending, below + r["n"], at)
                inside, at = set(ascending[at:past]), past
                if inside:
                    place((key[0], r["cell"] if by_key == ["c"] else key[1], r["lo"], r["hi"]), below, r["n"], inside)
                below += r["n"]
        if not open_:
            break
        rows = [(i, key[0], key[1], key[2], key[3], *_scale(key[2], key[3])) for i, key in enumerate(open_)]
        ranges = spark.createDataFrame(rows, "i int, rc int, rf int, lo double, hi double, s boolean, a double, w double")
        hit = dealt.join(F.broadcast(ranges), (F.col("c") == F.col("rc")) & (F.col("first") == F.col("rf")) & x.between(F.col("lo"), F.col("hi")))
        cell = _cell(x, F.col("s"), F.col("a"), F.col("w"), max(16, cells // len(rows)))
        counts, keys, by_key = hit.groupBy("i", cell.alias("cell")), {(i,): key for i, key in enumerate(open_)}, ["i"]
    return found


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper Tukey fences; columns without values are left out."""
    q = quantiles(df, {c: [0.25, 0.75] for c in cols})
    return {
        c: (lo - k * (hi - lo), hi + k * (hi - lo))
        for c, (lo, hi) in q.items() if lo is not None
    }
