"""Projections, filters and row-level cleaning."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions import text as tx
from pulseframe.functions.binning import cut
from pulseframe.operators import stats

# Column lists and synonyms of the extracts.
NUMERIC_COLUMNS = (
    "age", "Data_Value", "Data_Value_Alt", "Low_Confidence_Limit", "High_Confidence_Limit",
    "systolic_bp", "diastolic_bp", "total_cholesterol", "hdl_cholesterol", "bmi",
)
CATEGORICAL_COLUMNS = (
    "gender", "race_ethnicity", "smoking_status", "LocationAbbr", "Break_Out", "Break_Out_Category",
)
YEAR_COLUMNS = ("YearStart",)
SYSTEM_COLUMNS = (
    "RowId", "ClassId", "TopicId", "QuestionId", "Data_Value_TypeID",
    "BreakOutCategoryId", "BreakOutId", "LocationId",
)
NON_NEGATIVE = ("age", "Data_Value", "systolic_bp", "diastolic_bp")
NULL_WORDS = ("NAN", "NULL", "N/A", "NONE", "")
UNKNOWN_WORDS = ("Unknown", "UNKNOWN", "N/A", "")
LOCATION_SYNONYMS = {"UNITED STATES": "NATIONAL", "US": "NATIONAL", "USA": "NATIONAL"}
GENDER_OF_BREAK_OUT = {"Male": "male", "Female": "female", "Unknown": "unknown"}
TARGET_INDICATORS = ("CHD", "MI", "Angina", "Stroke")
TRUE_WORDS = ("true", "yes", "1")
PATIENT_STRINGS = ("gender", "smoking_status", "race_ethnicity")
PATIENT_NUMBERS = ("age", "bmi", "systolic_bp", "diastolic_bp", "total_cholesterol")
PATIENT_FLAGS = (
    "has_hypertension", "has_diabetes", "has_heart_disease",
    "medicare_part_a", "medicare_part_b", "data_sharing_consent",
)
SAFE_FIELDS = ("Sex", "Smoking", "HighBP", "HighChol", "Diabetes", "PhysActivity")


def normalize_column_names(df: DataFrame, lower: bool = False) -> DataFrame:
    """Trim, blanks to underscores; then drop parentheses, or lower the case."""
    names = [c.strip().replace(" ", "_") for c in df.columns]
    names = [n.lower() if lower else re.sub(r"[()]", "", n) for n in names]
    return df.toDF(*names)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    n, nulls = stats.null_counts(df)
    return df.drop(*[c for c in df.columns if nulls[c] == n])


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def coerce_types(
    df: DataFrame,
    numeric: Sequence[str] = NUMERIC_COLUMNS,
    categorical: Sequence[str] = CATEGORICAL_COLUMNS,
    years: Sequence[str] = YEAR_COLUMNS,
) -> DataFrame:
    """Numbers with bad values null, categories as text, years as 1 January."""
    changes: dict[str, Column] = {}
    for c in df.columns:
        if c in numeric:
            changes[c] = F.trim(F.col(c).cast("string")).try_cast("double")
        elif c in categorical:
            changes[c] = F.col(c).cast("string")
        elif c in years:
            year = F.trim(F.col(c).cast("string")).try_cast("int")
            changes[c] = F.when(year.between(1, 9999), F.make_date(year, F.lit(1), F.lit(1)))
    return df.withColumns(changes)


def standardize_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = stats.string_columns(df) if cols is None else cols
    tidy = {c: F.upper(F.trim(F.col(c))) for c in cols}
    return df.withColumns({c: F.when(~e.isin(*NULL_WORDS), e) for c, e in tidy.items()})


def unify_unknown(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = stats.string_columns(df) if cols is None else cols
    tidy = {c: F.trim(F.col(c)) for c in cols}
    return df.withColumns({
        c: F.when(e.isNull() | e.isin(*UNKNOWN_WORDS), "unknown").otherwise(e)
        for c, e in tidy.items()
    })


def null_sigma_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = 3.0) -> DataFrame:
    """Null every value further than ``k`` sample deviations from its column mean."""
    cols = stats.numeric_columns(df) if cols is None else list(cols)
    found = stats.fused(df, {
        **{f"m:{c}": F.avg(c) for c in cols}, **{f"s:{c}": F.stddev_samp(c) for c in cols}})
    changes = {}
    for c in cols:
        mean, sd = found[f"m:{c}"], found[f"s:{c}"]
        if sd:
            changes[c] = F.when(F.abs(F.col(c) - F.lit(mean)) <= F.lit(k * sd), F.col(c))
    return df.withColumns(changes)


def map_values(
    df: DataFrame, col: str, mapping: Mapping[str, str], out: str | None = None, keep_unmapped: bool = True
) -> DataFrame:
    """Replace by lookup; values not listed stay, or become null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), F.col(col))
    return df.withColumn(out or col, F.coalesce(hit, F.col(col)) if keep_unmapped else hit)


def standardize_locations(df: DataFrame, col: str = "locationdesc") -> DataFrame:
    return map_values(df, col, LOCATION_SYNONYMS) if col in df.columns else df


def gender_from_break_out(df: DataFrame, col: str = "Break_Out") -> DataFrame:
    """Add ``gender`` when any break-out value names one."""
    if col not in df.columns:
        return df
    named = F.col(col).isin(*GENDER_OF_BREAK_OUT)
    if df.where(named).isEmpty():
        return df
    return map_values(df, col, GENDER_OF_BREAK_OUT, out="gender", keep_unmapped=False)


def numeric_years(df: DataFrame) -> DataFrame:
    named = [c for c in df.columns if "year" in c.lower() or "date" in c.lower()]
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in named})


def stamp_lineage(df: DataFrame, source: str, as_of: Column | str) -> DataFrame:
    """Add source, time and yyyymmdd version; the time is a parameter, never the clock."""
    at = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp_ntz")
    return df.withColumns({
        "data_source": F.lit(source),
        "ingestion_timestamp": at,
        "data_version": F.date_format(at, "yyyyMMdd"),
    })


def drop_system_columns(df: DataFrame, cols: Sequence[str] = SYSTEM_COLUMNS) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def null_infinite(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    cols = floats if cols is None else cols
    inf = float("inf")
    return df.withColumns({c: F.when(~F.col(c).isin(inf, -inf), F.col(c)) for c in cols})


def null_negative(df: DataFrame, cols: Sequence[str] = NON_NEGATIVE) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols if c in df.columns})


def drop_missing_target(df: DataFrame, target: str = "Data_Value") -> DataFrame:
    return df.dropna(subset=[target]) if target in df.columns else df


def clean_patient_records(df: DataFrame) -> DataFrame:
    """Tidy text, read numbers (bad → null) and flags (text words, null → false)."""
    changes: dict[str, Column] = {}
    for c in PATIENT_STRINGS:
        if c in df.columns:
            changes[c] = F.lower(F.trim(F.col(c)))
    for c in PATIENT_NUMBERS:
        if c in df.columns:
            changes[c] = F.trim(F.col(c).cast("string")).try_cast("double")
    for c in PATIENT_FLAGS:
        if c in df.columns:
            is_text = isinstance(df.schema[c].dataType, T.StringType)
            flag = F.lower(F.col(c)).isin(*TRUE_WORDS) if is_text else F.col(c).cast("boolean")
            changes[c] = F.coalesce(flag, F.lit(False))
    return df.withColumns(changes)


def filter_history(
    df: DataFrame, user_id=None, start=None, end=None, risk_category=None, model_version=None
) -> DataFrame:
    """Conjunction of the conditions given; the others do not restrict."""
    tests = []
    if user_id is not None:
        tests.append(F.col("user_id") == user_id)
    if start is not None:
        tests.append(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        tests.append(F.col("created_at") <= F.lit(end).cast("timestamp_ntz"))
    if risk_category is not None:
        tests.append(F.col("risk_category") == risk_category)
    if model_version is not None:
        tests.append(F.col("model_version") == model_version)
    for t in tests:
        df = df.where(t)
    return df


def derive_target(
    df: DataFrame, target: str = "HeartDisease", indicators: Sequence[str] = TARGET_INDICATORS
) -> DataFrame:
    """Add the target as "any indicator holds" where the table lacks it."""
    if target in df.columns:
        return df
    present = [c for c in indicators if c in df.columns]
    if not present:
        raise ValueError("no indicator column to derive the target from")
    flags = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in present]
    return df.withColumn(target, (sum(flags) > 0).cast("int"))


def redact_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: tx.redact(F.col(c)) for c in cols})


def redact_by_name(df: DataFrame, limit: int = 100) -> DataFrame:
    """Mask columns and map entries whose name is sensitive; shorten other long texts."""
    changes: dict[str, Column] = {}
    for f in df.schema:
        if tx.is_sensitive_name(f.name):
            changes[f.name] = F.lit(tx.MASK)
        elif isinstance(f.dataType, T.StringType):
            changes[f.name] = tx.shorten(F.col(f.name), limit)
        elif (isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, T.StringType)
              and isinstance(f.dataType.valueType, T.StringType)):
            changes[f.name] = tx.mask_map(F.col(f.name), limit=limit)
    return df.withColumns(changes)


def anonymize_patients(df: DataFrame, age: str = "Age", bmi: str = "BMI") -> DataFrame:
    """Bands instead of exact age and body mass; only the safe fields are kept."""
    inf = float("inf")
    out: list[Column] = []
    if age in df.columns:
        bands = ("18-29", "30-39", "40-49", "50-59", "60-69", "70+")
        out.append(cut(F.col(age), [-inf, 30, 40, 50, 60, 70, inf], bands, right=False).alias("age_group"))
    out += [F.col(c) for c in SAFE_FIELDS if c in df.columns]
    if bmi in df.columns:
        bands = ("underweight", "normal", "overweight", "obese")
        out.append(cut(F.col(bmi), [-inf, 18.5, 25, 30, inf], bands, right=False).alias("bmi_category"))
    return df.select(*out)


def pseudonymize(df: DataFrame, col: str, salt: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, tx.pseudonym(F.col(col), salt))


def request_dedup_key(df: DataFrame, cols: Sequence[str], out: str = "request_key") -> DataFrame:
    return df.withColumn(out, tx.stable_key([F.col(c) for c in cols]))


def lookup_by_key(df: DataFrame, key: str, value, owner_col: str | None = None, owner=None) -> DataFrame:
    """One record by id, limited to its owner when one is given."""
    found = df.where(F.col(key) == value)
    return found if owner is None else found.where(F.col(owner_col) == owner)


def delete_by_key(
    df: DataFrame, keys: DataFrame, key: str, as_of: Column | str, event_type: str = "deleted"
) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and one audit row per row that goes."""
    kept = df.join(keys, key, "left_anti")
    at = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp_ntz")
    audit = df.join(keys, key, "left_semi").select(
        F.col(key), F.lit(event_type).alias("event_type"), at.alias("created_at"))
    return kept, audit
