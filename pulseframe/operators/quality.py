"""Validation, profiles and quality scores.

Table-level checks are one wide aggregate each. Report tables have one row per
column or rule; figures that would need unbounded state (distinct values, full
duplicates) are grouped by Spark first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions.risk import holds
from pulseframe.operators import gram
from pulseframe.operators import rules as R
from pulseframe.operators import stats


def _listed(parts: Sequence[Column]) -> Column:
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def _r3(x: float | None) -> float | None:
    return None if x is None else round(x, 3)


def one_row(df: DataFrame, schema: str, *values) -> DataFrame:
    return df.sparkSession.createDataFrame([values], schema)


# -- rows ---------------------------------------------------------------------

def validate_rows(
    df: DataFrame,
    required: Sequence[str] = R.REQUIRED_FOR_SCORING,
    ranges: Mapping[str, tuple] = R.VALUE_RANGES,
    categories: Mapping[str, Sequence[str]] = R.CATEGORIES,
    extra: Sequence[R.Rule] = (),
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Add error and warning lists, validity and a quality score to every row."""
    fields = list(df.columns if fields is None else fields)
    errors: list[Column] = []
    warnings: list[Column] = []
    bad: list[Column] = []
    for c in required:
        missing = F.col(c).isNull() if c in df.columns else F.lit(True)
        errors.append(F.when(missing, f"required: {c}"))
    for c in fields:
        col = F.col(c)
        warnings.append(F.when(col.isNull(), f"{c}: missing"))
        if c in ranges:
            lo, hi = ranges[c]
            if isinstance(df.schema[c].dataType, T.NumericType):
                warnings.append(F.when((col < lo) | (col > hi), f"{c}: outside [{lo}, {hi}]"))
            else:
                errors.append(F.when(col.isNotNull(), f"{c}: not numeric"))
                bad.append(col.isNotNull())
        if c in categories:
            warnings.append(F.when(~F.lower(col.cast("string")).isin(*categories[c]), f"{c}: unexpected category"))
        if c == "age" and isinstance(df.schema[c].dataType, T.NumericType):
            errors.append(F.when(col < 0, "age: negative"))
            warnings.append(F.when(col > 150, "age: unusually high"))
            bad.append(col < 0)
    for r in extra:
        broken = F.when(~F.expr(r.predicate), r.name)
        (errors if r.severity == "error" else warnings).append(broken)
    present = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0)) / F.lit(float(len(fields)))
    valid = F.lit(len(fields)) - sum((holds(b) for b in bad), F.lit(0))
    return df.withColumns({
        "errors": _listed(errors), "warnings": _listed(warnings),
    }).withColumns({
        "is_valid": F.size("errors") == 0,
        "quality_score": F.round(valid / F.lit(float(len(R.EXPECTED_SCHEMA))) * 0.7 + present * 0.3, 3),
    })


def feedback_rules(df: DataFrame) -> DataFrame:
    """Name the field a feedback row of its type lacks."""
    kind = F.col("feedback_type")
    no_score = F.coalesce(F.col("corrected_risk_score"), F.lit(0.0)) == 0
    no_category = F.coalesce(F.col("corrected_risk_category"), F.lit("")) == ""
    return df.withColumn("feedback_error", (
        F.when((kind == "outcome") & F.col("actual_outcome").isNull(), "actual_outcome is required")
        .when((kind == "rating") & F.col("provider_rating").isNull(), "provider_rating is required")
        .when((kind == "correction") & no_score & no_category,
              "corrected_risk_score or corrected_risk_category is required")))


# -- duplicates ---------------------------------------------------------------

def duplicate_count(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of every equal group; copies collapse before the shuffle."""
    groups = df.groupBy(*(df.columns if keys is None else keys)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
                      F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_rows"))


def drop_duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(keys)) if keys else df.distinct()


def keep_latest_duplicate(df: DataFrame, order: str = "yearstart") -> DataFrame:
    """Among rows equal in every other column keep the greatest ``order`` (null last).

    A maximum per group is enough, and it is combined before the shuffle.
    """
    others = [c for c in df.columns if c != order]
    return df.groupBy(*others).agg(F.max(order).alias(order)).select(*df.columns)


# -- columns ------------------------------------------------------------------

def _category_misses(df: DataFrame, categories: Mapping[str, Sequence[str]], show: int) -> DataFrame:
    """Per column: how many unexpected values, and the first ``show`` of them in order."""
    tested = {c: v for c, v in categories.items() if c in df.columns}
    long = df.select(*[
        F.when(~F.lower(F.col(c).cast("string")).isin(*v), F.col(c).cast("string")).alias(c)
        for c, v in tested.items()]).unpivot([], list(tested), "column", "value")
    values = long.where("value is not null").distinct()
    ranked = values.withColumn(
        "_r", F.row_number().over(Window.partitionBy("column").orderBy("value")))
    return ranked.where(F.col("_r") <= show).groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("invalid_categories"))


def validate_columns(
    df: DataFrame,
    ranges: Mapping[str, tuple] = R.VALUE_RANGES,
    categories: Mapping[str, Sequence[str]] = R.CATEGORIES,
    expected: Mapping[str, str] = R.EXPECTED_SCHEMA,
) -> DataFrame:
    """One row per expected column: completeness, distinct values, and findings."""
    cols = [c for c in df.columns if c in expected]
    numeric = set(stats.numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs.append(F.count(c).alias(f"k{i}"))
        if c in ranges and c in numeric:
            lo, hi = ranges[c]
            aggs.append(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"r{i}"))
    rows = [F.struct(
        F.lit(c).alias("column"), F.col("n"), F.col(f"k{i}").alias("present"),
        (F.col(f"r{i}") if c in ranges and c in numeric else F.lit(0).cast("long")).alias("out_of_range"),
    ) for i, c in enumerate(cols)]
    long = df.agg(*aggs).select(F.inline(F.array(*rows)))
    missing = F.lit(1.0) - F.col("present") / F.col("n")
    outside = F.col("out_of_range") / F.col("n")
    misses = _category_misses(df, {c: v for c, v in categories.items() if c in cols}, 5)
    joined = long.join(stats.distinct_table(df, cols), "column", "left").join(misses, "column", "left")
    errors = [F.when(missing > 0.5, "missing_over_50_percent"), F.when(outside > 0.1, "out_of_range_over_10_percent")]
    warnings = [
        F.when((missing > 0.2) & (missing <= 0.5), "missing_over_20_percent"),
        F.when((outside > 0) & (outside <= 0.1), "out_of_range"),
        F.when(F.col("invalid_categories").isNotNull(), "invalid_categories"),
    ]
    return joined.select(
        "column", F.round(F.col("present") / F.col("n"), 6).alias("completeness"),
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"), "out_of_range", "invalid_categories",
        F.array_join(_listed(errors), ", ").alias("errors"),
        F.array_join(_listed(warnings), ", ").alias("warnings"),
    ).withColumn("valid", F.col("errors") == "")


def dataset_quality(df: DataFrame, required: Sequence[str] = R.REQUIRED) -> DataFrame:
    """Cell completeness and row validity, weighted 0.4 and 0.6."""
    complete = F.lit(all(c in df.columns for c in required))
    for c in required:
        if c in df.columns:
            complete = complete & F.col(c).isNotNull()
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    width = len(df.columns)
    base = df.agg(F.count(F.lit(1)).alias("n"), F.sum(filled.cast("long")).alias("filled"),
                  F.count_if(complete).alias("valid_records"))
    cells = F.col("n") * width
    completeness = F.col("filled") / cells
    validity = F.when(F.col("n") > 0, F.col("valid_records") / F.col("n")).otherwise(0.0)
    return base.select(
        F.round(completeness * 0.4 + validity * 0.6, 3).alias("overall_score"),
        F.round(completeness, 3).alias("completeness"), F.round(validity, 3).alias("validity_score"),
        "valid_records", (F.col("n") - F.col("valid_records")).alias("invalid_records"),
        (cells - F.col("filled")).alias("missing_cells"), cells.alias("total_cells"))


REPORT = ("is_valid boolean, quality_score double, error_count int, warning_count int, errors string, "
          "warnings string, total_records long, valid_records long, invalid_records long, recommendations string")


def _report(df: DataFrame, score, errors, warnings, total, valid, advice) -> DataFrame:
    return one_row(df, REPORT, not errors, _r3(score), len(errors), len(warnings), "; ".join(errors),
                   "; ".join(warnings), total, valid, total - valid, "; ".join(advice))


def _structure(df: DataFrame, required: Sequence[str], min_rows: int):
    quality = dataset_quality(df, required).first()
    total = quality["valid_records"] + quality["invalid_records"]
    errors, warnings = [], []
    if total < min_rows:
        errors.append("dataset_size")
    missing = [c for c in required if c not in df.columns]
    if missing:
        errors.append("missing_columns: " + ", ".join(missing))
    for r in sorted(validate_columns(df).collect(), key=lambda r: r["column"]):
        errors += [f"{r['column']}: {e}" for e in r["errors"].split(", ") if e]
        warnings += [f"{r['column']}: {w}" for w in r["warnings"].split(", ") if w]
    copies = duplicate_count(df).first()["duplicate_rows"]
    if copies:
        warnings.append("duplicates")
    return quality, total, errors, warnings, copies


def validate_dataset(df: DataFrame, required: Sequence[str] = R.REQUIRED, min_rows: int = 100) -> DataFrame:
    """Size, required columns, column findings and duplicates in one report row."""
    quality, total, errors, warnings, _ = _structure(df, required, min_rows)
    advice = []
    if errors:
        advice.append("Address critical data errors before using dataset for training")
    if total < 1000:
        advice.append("Consider collecting more data - larger datasets typically improve model performance")
    if total and quality["missing_cells"] / quality["total_cells"] > 0.1:
        advice.append("Consider imputation strategies for missing values")
    if "Data_Value" in df.columns and constant(df, "Data_Value"):
        advice.append("Target variable has no variance - check data collection process")
    if not advice:
        advice.append("Dataset quality is good for cardiovascular disease prediction")
    return _report(df, quality["overall_score"], errors, warnings, total, quality["valid_records"], advice)


def constant(df: DataFrame, col: str) -> bool:
    found = stats.fused(df, {"lo": F.min(col), "hi": F.max(col)})
    return found["lo"] is not None and found["lo"] == found["hi"]


def quick_validate(df: DataFrame, required: Sequence[str] = R.REQUIRED) -> DataFrame:
    """Emptiness, required columns and number types; score is capped by completeness."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    found = stats.fused(df, {"n": F.count(F.lit(1)), "filled": F.sum(filled.cast("long"))})
    n, errors, warnings = found["n"], [], []
    if n == 0:
        errors.append("empty")
    missing = [c for c in required if c not in df.columns]
    if missing:
        errors.append("missing_columns: " + ", ".join(missing))
    numeric = stats.numeric_columns(df)
    warnings += [f"{c}: not numeric" for c in R.QUICK_NUMERIC if c in df.columns and c not in numeric]
    completeness = found["filled"] / (n * len(df.columns)) if n else 0.0
    score = min(0.3 if errors else 0.8, completeness)
    return _report(df, score, errors, warnings, n, 0 if errors else n,
                   ["Run comprehensive validation for detailed analysis"])


def _logical(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "categorical" if isinstance(kind, T.StringType) else kind.simpleString()


def schema_validate(
    df: DataFrame, expected: Mapping[str, str] = R.EXPECTED_SCHEMA, required: Sequence[str] = R.REQUIRED
) -> DataFrame:
    """Expected against actual columns, with the filled values of each and those that are not of the expected type."""
    cast = {"numeric": "double", "boolean": "boolean"}
    here = [c for c in expected if c in df.columns]
    filled = {c: F.count(F.col(f"`{c}`")) for c in df.columns}
    wrong = {c: F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").cast("string").try_cast(cast[expected[c]]).isNull())
             for c in here if expected[c] in cast}
    found = stats.fused(df, {**{("n", c): e for c, e in filled.items()}, **{("bad", c): e for c, e in wrong.items()}})
    rows = []
    for c, kind in expected.items():
        actual = _logical(df.schema[c].dataType) if c in here else None
        rows.append((c, kind, actual, c in here, c in here and actual == kind, c in required and c not in here,
                     found.get(("n", c)), found.get(("bad", c), 0 if c in here else None)))
    rows += [(c, None, _logical(df.schema[c].dataType), True, False, False, found[("n", c)], None)
             for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(
        rows, "column string, expected_type string, actual_type string, present boolean, "
              "type_matches boolean, required_missing boolean, filled_values long, wrong_values long")


def source_validate(df: DataFrame, source: str, as_of_year: int) -> DataFrame:
    """Checks on a landed extract; one row per finding, and one "ok" row when there is none."""
    lower = [c.lower() for c in df.columns]
    aggs = {"n": F.count(F.lit(1)), **{("k", c): F.count(c) for c in df.columns}}
    number = {c: F.col(c).cast("string").try_cast("double") for c in df.columns}
    numeric = [c for c in R.SOURCE_NUMERIC if c in df.columns]
    for c in numeric:
        aggs[("bad", c)] = F.count_if(number[c].isNull())
        if c in R.SOURCE_RANGES:
            lo, hi = R.SOURCE_RANGES[c]
            aggs[("out", c)] = F.count_if((number[c] < lo) | (number[c] > hi))
    dated = [c for c in df.columns if "year" in c.lower() or "date" in c.lower()]
    aggs.update({("latest", c): F.max(number[c]) for c in dated})
    found = stats.fused(df, aggs)
    n = found["n"]
    issues = []
    if n == 0:
        issues.append(("empty", ""))
    else:
        issues += [("missing_required", r) for r in R.SOURCE_REQUIRED if not any(r in c for c in lower)]
        issues += [("non_numeric", c) for c in numeric if found[("bad", c)] > n * 0.5]
        issues += [("out_of_range", c) for c in numeric if found.get(("out", c))]
        issues += [("mostly_missing", c) for c in df.columns if (n - found[("k", c)]) / n * 100 > 70]
        copies = duplicate_count(df).first()["duplicate_rows"]
        if copies > n * 0.1:
            issues.append(("duplicates", ""))
        issues += [("outdated", c) for c in dated
                   if found[("latest", c)] is not None and found[("latest", c)] < as_of_year - 3]
    rows = [(source, kind, col, False) for kind, col in issues] or [(source, "ok", "", True)]
    return df.sparkSession.createDataFrame(rows, "source string, issue string, column_name string, is_valid boolean")


def upload_validate(df: DataFrame) -> DataFrame:
    """Columns and ages a scoring upload needs."""
    errors, warnings = [], []
    missing = [c for c in R.REQUIRED_FOR_SCORING if c not in df.columns]
    if missing:
        errors.append("missing_columns: " + ", ".join(missing))
    numeric = "age" in df.columns and isinstance(df.schema["age"].dataType, T.NumericType)
    if "age" in df.columns and not numeric:
        errors.append("age: not numeric")
    aggs = {"n": F.count(F.lit(1))}
    if numeric:
        aggs["out"] = F.count_if((F.col("age") < 18) | (F.col("age") > 120))
    found = stats.fused(df, aggs)
    if found.get("out"):
        warnings.append(f"age: {found['out']} outside [18, 120]")
    score = 1.0 if not errors else 0.7 if len(errors) < 3 else 0.3
    return _report(df, score, errors, warnings, found["n"], 0 if errors else found["n"],
                   ["Upload validation completed"])


def constraint_check(df: DataFrame, rules: Sequence[R.Rule]) -> DataFrame:
    """Violations per named rule in one aggregate; an unknown result is no violation."""
    usable = list(rules)
    aggs = [F.count_if(~F.expr(r.predicate)).alias(f"v{i}") for i, r in enumerate(usable)]
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
                     F.col(f"v{i}").alias("violations")) for i, r in enumerate(usable)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def unique_check(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Rows that repeat a key; keys with a null part are not compared."""
    whole = df.dropna(subset=list(keys))
    return duplicate_count(whole, keys).select(F.lit(name).alias("rule"), F.lit("error").alias("severity"),
                                               F.col("duplicate_rows").alias("violations"))


def consistency_rules(df: DataFrame) -> DataFrame:
    usable = []
    for r in R.CONSISTENCY_RULES:
        needed = [c for c in df.columns if c in r.predicate.split()]
        if needed and len(needed) == len({w for w in r.predicate.split() if w[0].isalpha()}):
            usable.append(r)
    return constraint_check(df, usable)


def comprehensive_validate(df: DataFrame, required: Sequence[str] = R.REQUIRED, min_rows: int = 100) -> DataFrame:
    """The dataset report with empty and constant columns, outliers, consistency
    and target shape; each error costs 0.1 and each warning 0.02, down to 0."""
    from pulseframe.operators import imputation

    quality, total, errors, warnings, _ = _structure(df, required, min_rows)
    if errors:
        return _report(df, quality["overall_score"], errors, warnings, total, quality["valid_records"], [])
    numeric = stats.numeric_columns(df)
    found = stats.fused(df, {
        **{("k", c): F.count(c) for c in df.columns},
        **{("lo", c): F.min(c) for c in numeric}, **{("hi", c): F.max(c) for c in numeric},
        **({"skew": stats.adjusted_skewness(F.col("Data_Value")), "sd": F.stddev_samp("Data_Value")}
           if "Data_Value" in numeric else {}),
    })
    empty = [c for c in df.columns if not found[("k", c)]]
    if empty:
        warnings.append("null_columns: " + ", ".join(empty))
    flat = [c for c in numeric if found[("lo", c)] == found[("hi", c)]]
    if flat:
        warnings.append("constant_columns: " + ", ".join(flat))
    errors += [f"{c}: not numeric" for c, kind in R.EXPECTED_SCHEMA.items()
               if c in df.columns and kind == "numeric" and c not in numeric]
    outliers = imputation.count_iqr(df, numeric)
    warnings += [f"{c}: outliers" for c in numeric if outliers.get(c, 0) / total > 0.05]
    for r in consistency_rules(df).collect():
        if r["violations"]:
            warnings.append(f"{r['rule']}: {r['violations']}")
    if abs(found.get("skew") or 0.0) > 3:
        warnings.append("Data_Value: skewed")
    if found.get("sd") == 0:
        warnings.append("Data_Value: zero variance")
    score = max(0.0, quality["overall_score"] - 0.1 * len(errors) - 0.02 * len(warnings))
    level = ("poor - significant improvements needed before model training" if score < 0.5 else
             "moderate - some improvements recommended" if score < 0.8 else "good - suitable for model training")
    advice = [f"Data quality is {level}"]
    if quality["completeness"] < 0.9:
        advice.append("Improve data completeness by addressing missing values")
    if errors:
        advice.append("Fix data validation errors to ensure model reliability")
    if len(warnings) > 10:
        advice.append("Review and address data quality warnings")
    if total < 5000:
        advice.append("Consider collecting more data for better model performance")
    return _report(df, score, errors, warnings, total, quality["valid_records"], advice)


# -- reports ------------------------------------------------------------------

def quality_dimensions(
    df: DataFrame, as_of, ranges: Mapping[str, tuple] = R.VALUE_RANGES, keys: Sequence[str] = R.KEY_COLUMNS
) -> DataFrame:
    """Six dimension scores and their mean, one row each."""
    texts = stats.string_columns(df)
    dates = stats.date_columns(df)
    numeric = set(stats.numeric_columns(df))
    bounded = {c: r for c, r in ranges.items() if c in numeric}
    aggs: dict = {"n": F.count(F.lit(1)), **{("k", c): F.count(c) for c in df.columns}}
    lowered = df.select(*texts, *[F.lower(c).alias(f"_lower_{c}") for c in texts])
    distinct = stats.distinct_counts(lowered, lowered.columns)
    pressure = "systolic_bp" in numeric and "diastolic_bp" in numeric
    if pressure:
        aggs["bp"] = F.count_if(F.col("systolic_bp") <= F.col("diastolic_bp"))
    for c, (lo, hi) in bounded.items():
        aggs[("r", c)] = F.count_if((F.col(c) < lo) | (F.col(c) > hi))
    if "age" in numeric:
        aggs["young"] = F.count_if(F.col("age") < 65)
    if dates:
        at = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")
        micros = F.unix_micros(at) - F.unix_micros(F.max(dates[0]).cast("timestamp"))
        aggs["age_days"] = F.floor(micros / F.lit(86_400_000_000))
    found = stats.fused(df, aggs)
    n = found["n"]
    copies = duplicate_count(df).first()["duplicate_rows"]
    key_copies = sum(duplicate_count(df, [c]).first()["duplicate_rows"] for c in keys if c in df.columns)
    filled = sum(found[("k", c)] for c in df.columns)
    mixed = sum(distinct[c] != distinct[f"_lower_{c}"] for c in texts) + bool(pressure and found["bp"])
    outside = sum(bool(found[("r", c)]) for c in bounded)
    invalid = int("age" in numeric and found["young"] > n * 0.1)
    stale = max(0.0, 1 - found["age_days"] / 365) if dates and found["age_days"] is not None else 1.0
    rows = [
        ("completeness", _r3(filled / (n * len(df.columns))), n * len(df.columns) - filled),
        ("consistency", _r3(max(0.0, 1 - mixed / 10)), mixed),
        ("accuracy", _r3(max(0.0, 1 - outside / 20)), outside),
        ("validity", _r3(max(0.0, 1 - invalid / 10)), invalid),
        ("uniqueness", _r3(1 - copies / n), copies + key_copies),
        ("timeliness", _r3(stale), found.get("age_days") or 0),
    ]
    rows.append(("overall", _r3(sum(r[1] for r in rows) / 6), sum(r[2] for r in rows[1:4])))
    return df.sparkSession.createDataFrame(rows, "dimension string, score double, findings long")


def completeness_by_column(df: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(df.columns)]]
    rows = [F.struct(F.lit(c).alias("column"), F.round(F.col(f"k{i}") / F.col("n"), 3).alias("completeness"))
            for i, c in enumerate(df.columns)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def characterise(df: DataFrame, place: str | None = None) -> DataFrame:
    """Size, gaps, duplicates, type counts, date range and number of places."""
    dates, numeric, texts = stats.date_columns(df), stats.numeric_columns(df), stats.string_columns(df)
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(filled.cast("long")).alias("filled")]
    if dates:
        aggs += [F.min(dates[0]).alias("lo"), F.max(dates[0]).alias("hi")]
    if place:
        aggs.append(F.count_distinct(place).alias("places"))
    row = df.agg(*aggs)
    width = len(df.columns)
    copies = duplicate_count(df).first()["duplicate_rows"]
    none = F.lit(None).cast("string")
    return row.select(
        F.col("n").alias("total_rows"), F.lit(width).alias("total_columns"),
        (F.col("n") * width - F.col("filled")).alias("missing_values"),
        F.lit(copies).cast("long").alias("duplicate_rows"),
        F.lit(len(numeric)).alias("numeric_columns"), F.lit(len(texts)).alias("categorical_columns"),
        F.lit(len(dates)).alias("datetime_columns"),
        (F.date_format("lo", "yyyy-MM-dd") if dates else none).alias("start_date"),
        (F.date_format("hi", "yyyy-MM-dd") if dates else none).alias("end_date"),
        (F.col("places") if place else F.lit(0).cast("long")).alias("place_count"))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: gaps, type, and for numbers the fence outliers and adjusted skew."""
    numeric = stats.numeric_columns(df)
    fences = stats.iqr_fences(df, numeric)
    aggs = [F.count(F.lit(1)).alias("n")]
    rows = []
    for i, (c, kind) in enumerate(df.dtypes):
        aggs.append(F.count(c).alias(f"k{i}"))
        outliers, skew = F.lit(None).cast("long"), F.lit(None).cast("double")
        if c in fences:
            lo, hi = fences[c]
            aggs += [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"o{i}"),
                     stats.adjusted_skewness(F.col(c)).alias(f"s{i}")]
            outliers, skew = F.col(f"o{i}"), F.col(f"s{i}")
        gaps = F.col("n") - F.col(f"k{i}")
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(_logical(df.schema[c].dataType)).alias("data_type"),
            gaps.alias("missing_count"), F.round(gaps / F.col("n") * 100, 4).alias("missing_percent"),
            outliers.alias("outliers"), F.round(skew, 4).alias("skewness")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def high_correlations(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Numeric pairs with |r| above the threshold, over rows where both are present."""
    cols = stats.numeric_columns(df) if cols is None else list(cols)
    r = gram.correlations(df, cols)
    found = [(a, b, float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j and abs(r[i, j]) > threshold]
    return df.sparkSession.createDataFrame(found, "feature1 string, feature2 string, correlation double")


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column."""
    cols = stats.numeric_columns(df) if cols is None else list(cols)
    q = stats.quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    aggs, rows = [], []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}")]
        quart = [F.lit(v).cast("double") for v in q[c]]
        rows.append(F.struct(
            F.lit(c).alias("feature"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("std"), F.col(f"a{i}").alias("min"), quart[0].alias("p25"),
            quart[1].alias("p50"), quart[2].alias("p75"), F.col(f"z{i}").alias("max")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count(target).alias("total"), F.count_if(F.col(target) == 1).alias("positives"),
                  F.avg((F.col(target) == 1).cast("double")).alias("positive_rate"))


def dataset_quality_score(df: DataFrame) -> DataFrame:
    """Mean of the parts present: completeness, share not missing, share not duplicate."""
    parts = F.array_compact(F.array(
        F.col("completeness_score"),
        F.when(F.col("total_records") != 0, F.lit(1.0) - F.col("missing_values_count")
               / F.nullif((F.col("total_records") * F.col("total_columns")).cast("double"), F.lit(0.0))),
        F.when(F.col("total_records") != 0,
               F.lit(1.0) - F.col("duplicate_records_count") / F.col("total_records").cast("double"))))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("data_quality_score", F.when(F.size(parts) > 0, total / F.size(parts)).otherwise(0.0))
