"""Missing values and outliers.

Every operator makes at most two aggregate passes for its statistics and then
one narrow projection. ``known`` lets a caller pass figures it already has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.operators import stats

CONDITION_FLAGS = ("has_hypertension", "has_diabetes", "has_heart_disease")


def drop_sparse_columns(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    n, nulls = stats.null_counts(df)
    return df.drop(*[c for c in df.columns if n and nulls[c] / n > threshold])


def _fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    changes = {}
    for c, v in values.items():
        if v is None:
            continue
        integral = isinstance(df.schema[c].dataType, T.IntegralType)
        col = F.col(c).cast("double") if integral and isinstance(v, float) else F.col(c)
        changes[c] = F.coalesce(col, F.lit(v))
    return df.withColumns(changes)


def impute_median(df: DataFrame, cols: Sequence[str] | None = None, known: Mapping | None = None) -> DataFrame:
    """Exact medians; columns without gaps are left alone."""
    cols = stats.numeric_columns(df) if cols is None else list(cols)
    if known is None:
        _, nulls = stats.null_counts(df, cols)
        gaps = [c for c in cols if nulls[c]]
        known = {c: v[0] for c, v in stats.quantiles(df, {c: [0.5] for c in gaps}).items()}
    return _fill(df, known)


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None, known: Mapping | None = None) -> DataFrame:
    cols = stats.numeric_columns(df) if cols is None else list(cols)
    if known is None:
        found = stats.fused(df, {
            **{f"m:{c}": F.avg(c) for c in cols}, **{f"g:{c}": F.count_if(F.col(c).isNull()) for c in cols}})
        known = {c: found[f"m:{c}"] for c in cols if found[f"g:{c}"]}
    return _fill(df, known)


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None, default: str = "unknown") -> DataFrame:
    """Most frequent text; ties → smallest; a column with no value → ``default``.

    Only columns with gaps are counted: grouping a text column moves its values.
    """
    cols = stats.string_columns(df) if cols is None else list(cols)
    _, nulls = stats.null_counts(df, cols)
    return _fill(df, _mode_values(df, [c for c in cols if nulls[c]], default))


def _mode_values(df: DataFrame, cols: Sequence[str], default: str) -> dict[str, str]:
    found = stats.modes(df, cols)
    return {c: default if found[c] is None else found[c] for c in cols}


def impute_smart(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Numbers: median when skew exceeds 1, else mean. Text: mode."""
    cols = list(df.columns if cols is None else cols)
    numeric = stats.numeric_columns(df.select(*cols))
    found = stats.fused(df, {
        **{("g", c): F.count_if(F.col(c).isNull()) for c in cols},
        **{("m", c): F.avg(c) for c in numeric},
        **{("s", c): stats.adjusted_skewness(F.col(c)) for c in numeric},
    })
    gaps = [c for c in numeric if found[("g", c)]]
    skewed = [c for c in gaps if (found[("s", c)] or 0.0) > 1]
    medians = stats.quantiles(df, {c: [0.5] for c in skewed})
    out = _fill(df, {c: medians[c][0] if c in skewed else found[("m", c)] for c in gaps})
    texts = [c for c in stats.string_columns(df.select(*cols)) if found[("g", c)]]
    return impute_mode(out, texts) if texts else out


def impute_false(df: DataFrame, cols: Sequence[str] = CONDITION_FLAGS) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in cols if c in df.columns})


def impute_constant(df: DataFrame, cols: Sequence[str] | None = None, value: str = "missing") -> DataFrame:
    cols = stats.string_columns(df) if cols is None else list(cols)
    return df.fillna(value, subset=cols)


def handle_missing(df: DataFrame, flags: Sequence[str] = CONDITION_FLAGS) -> DataFrame:
    """Drop columns over 90 % missing, then medians, modes and false flags."""
    n, nulls = stats.null_counts(df)
    df = df.drop(*[c for c in df.columns if n and nulls[c] / n > 0.9])
    gaps = {c for c in df.columns if nulls[c]}
    numeric = [c for c in stats.numeric_columns(df) if c in gaps]
    medians = {c: v[0] for c, v in stats.quantiles(df, {c: [0.5] for c in numeric}).items()}
    texts = [c for c in stats.string_columns(df) if c in gaps]
    return impute_false(_fill(df, {**medians, **_mode_values(df, texts, "unknown")}), flags)


def clip_iqr(
    df: DataFrame, cols: Sequence[str] | None = None, target: str = "Data_Value", known: Mapping | None = None
) -> DataFrame:
    """Clip to the fences; the target is left as it is and nulls stay null."""
    cols = stats.numeric_columns(df, exclude=[target]) if cols is None else list(cols)
    fences = stats.iqr_fences(df, cols) if known is None else known
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c).cast("double"))))
        for c, (lo, hi) in fences.items()
    })


def _outside(c: str, fence: tuple[float, float]):
    return F.coalesce((F.col(c) < F.lit(fence[0])) | (F.col(c) > F.lit(fence[1])), F.lit(False))


def flag_iqr(df: DataFrame, cols: Sequence[str], suffix: str = "_outlier") -> DataFrame:
    fences = stats.iqr_fences(df, cols)
    return df.withColumns({f"{c}{suffix}": _outside(c, f) for c, f in fences.items()})


def count_iqr(df: DataFrame, cols: Sequence[str] | None = None, known: Mapping | None = None) -> dict[str, int]:
    cols = stats.numeric_columns(df) if cols is None else list(cols)
    fences = stats.iqr_fences(df, cols) if known is None else known
    return stats.fused(df, {c: F.count_if(_outside(c, f)) for c, f in fences.items()})


def drop_iqr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the rows that lie inside every fence."""
    keep = F.lit(True)
    for c, f in stats.iqr_fences(df, cols).items():
        keep = keep & ~_outside(c, f)
    return df.where(keep)
