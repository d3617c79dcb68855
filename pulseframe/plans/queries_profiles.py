"""Validation, profiles, quality scores and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import features, quality, rollups, stats
from pulseframe.operators import rules as R
from pulseframe.plans.catalog import query
from pulseframe.plans.frames import Tables
from pulseframe.plans.queries_tables import AS_OF, rounded

_EXPECTED = [c for c in R.EXPECTED_SCHEMA]
_NULLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _EXPECTED)


def _expected(t: Tables):
    return t.patients.select(*_EXPECTED)


def _out(c: str) -> str:
    lo, hi = R.VALUE_RANGES[c]
    return f"({c} < {lo} OR {c} > {hi})"


_WARN = ", ".join(
    [f"CASE WHEN {c} IS NULL THEN '{c}: missing' END" + (
        f", CASE WHEN {_out(c)} THEN '{c}: outside [{R.VALUE_RANGES[c][0]}, {R.VALUE_RANGES[c][1]}]' END"
        if c in R.VALUE_RANGES else "") + (
        f", CASE WHEN LOWER({c}) NOT IN {R.CATEGORIES[c]} THEN '{c}: unexpected category' END" if c in R.CATEGORIES else "")
     + (", CASE WHEN age > 150 THEN 'age: unusually high' END" if c == "age" else "") for c in _EXPECTED])


@query("q1_validate_rows", f"""
SELECT patient_id, ARRAY_TO_STRING(LIST_FILTER([CASE WHEN age IS NULL THEN 'required: age' END, CASE WHEN gender IS NULL THEN 'required: gender' END],
    lambda x: x IS NOT NULL), '; ') AS errors,
  ARRAY_TO_STRING(LIST_FILTER([{_WARN}], lambda x: x IS NOT NULL), '; ') AS warnings,
  age IS NOT NULL AND gender IS NOT NULL AS is_valid,
  ROUND(0.7::DOUBLE + (12 - ({_NULLS})) / 12.0::DOUBLE * 0.3, 3) AS quality_score FROM patients""", ["patients"])
def _(t: Tables):
    out = quality.validate_rows(t.patients, fields=_EXPECTED)
    return out.select("patient_id", F.array_join("errors", "; ").alias("errors"),
                      F.array_join("warnings", "; ").alias("warnings"), "is_valid", "quality_score")


def _column_row(c: str) -> str:
    out = f"SUM(CASE WHEN {_out(c)} THEN 1 ELSE 0 END)::BIGINT" if c in R.VALUE_RANGES else "0::BIGINT"
    cats = R.CATEGORIES.get(c)
    bad = (f"(SELECT STRING_AGG(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM patients WHERE LOWER({c}) NOT IN {cats} "
           f"ORDER BY v LIMIT 5))") if cats else "NULL"
    return (f"SELECT '{c}' AS \"column\", COUNT(*) AS n, COUNT({c}) AS k, COUNT(DISTINCT {c}) AS unique_values, {out} AS out_of_range, "
            f"{bad}::VARCHAR AS invalid_categories FROM patients")


@query("q2_validate_columns", f"""
WITH c AS ({' UNION ALL '.join(_column_row(c) for c in _EXPECTED)}),
m AS (SELECT *, 1 - k / n AS missing, out_of_range / n AS outside FROM c)
SELECT "column", ROUND(k / n, 6) AS completeness, unique_values, out_of_range, invalid_categories,
  CONCAT_WS(', ', CASE WHEN missing > 0.5 THEN 'missing_over_50_percent' END, CASE WHEN outside > 0.1 THEN 'out_of_range_over_10_percent' END) AS errors,
  CONCAT_WS(', ', CASE WHEN missing > 0.2 AND missing <= 0.5 THEN 'missing_over_20_percent' END,
    CASE WHEN outside > 0 AND outside <= 0.1 THEN 'out_of_range' END, CASE WHEN invalid_categories IS NOT NULL THEN 'invalid_categories' END) AS warnings,
  NOT (missing > 0.5 OR outside > 0.1) AS valid FROM m""", ["patients"])
def _(t: Tables):
    return quality.validate_columns(t.patients)


_QUALITY = f"""WITH a AS (SELECT COUNT(*) AS n, SUM({_NULLS})::BIGINT AS gaps,
  SUM(CASE WHEN age IS NOT NULL AND gender IS NOT NULL AND Data_Value IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS ok FROM patients)"""


@query("q3_validate_dataset", f"""{_QUALITY}
SELECT FALSE AS is_valid, ROUND((1 - gaps / (n * 12)) * 0.4 + ok / n * 0.6, 3) AS quality_score, n AS total_records, ok AS valid_records,
  n - ok AS invalid_records FROM a""", ["patients"])
def _(t: Tables):
    out = quality.validate_dataset(_expected(t))
    return out.select("is_valid", "quality_score", "total_records", "valid_records", "invalid_records")


@query("q4_quick_validate", f"""{_QUALITY}
SELECT TRUE AS is_valid, ROUND(LEAST(0.8, 1 - gaps / (n * 12)), 3) AS quality_score, n AS total_records, n AS valid_records,
  0::BIGINT AS invalid_records, '' AS warnings FROM a""", ["patients"])
def _(t: Tables):
    out = quality.quick_validate(_expected(t))
    return out.select("is_valid", "quality_score", "total_records", "valid_records", "invalid_records", "warnings")


_SCHEMA = (
    ("age", "numeric", "numeric", "age"), ("gender", "categorical", "categorical", "gender"), ("Data_Value", "numeric", "numeric", "Data_Value"),
    ("has_hypertension", "boolean", "boolean", "has_hypertension"), ("has_diabetes", "boolean", "categorical", "has_diabetes"),
    ("has_heart_disease", "boolean", None, None), ("systolic_bp", "numeric", "categorical", "systolic_text"),
    ("diastolic_bp", "numeric", "numeric", "diastolic_bp"), ("total_cholesterol", "numeric", "numeric", "total_cholesterol"),
    ("hdl_cholesterol", "numeric", "numeric", "hdl_cholesterol"), ("bmi", "numeric", "numeric", "bmi"),
    ("smoking_status", "categorical", "categorical", "smoking_status"), ("zip_code", None, "categorical", "zip_code"))


def _schema_row(name, expected, actual, source) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    wrong = "SUM(CASE WHEN systolic_text = 'n/a' THEN 1 ELSE 0 END)" if name == "systolic_bp" else "0" if source and expected else "NULL"
    return (f"SELECT '{name}' AS \"column\", {text(expected)} AS expected_type, {text(actual)} AS actual_type, {bool(source)} AS present, "
            f"{bool(source) and expected == actual} AS type_matches, FALSE AS required_missing, "
            f"CAST({f'COUNT({source})' if source else 'NULL'} AS BIGINT) AS filled_values, CAST({wrong} AS BIGINT) AS wrong_values FROM {'p' if source else '(SELECT 1)'}")


@query("q5_schema_validate", "WITH p AS (SELECT *, CASE WHEN patient_id % 7 = 0 THEN 'n/a' ELSE CAST(systolic_bp AS VARCHAR) END AS systolic_text FROM patients)\n"
       + "\nUNION ALL ".join(_schema_row(*r) for r in _SCHEMA), ["patients"])
def _(t: Tables):
    rows = t.patients.select(*[c for c in _EXPECTED if c not in ("has_heart_disease", "has_diabetes", "systolic_bp")],
                             F.when(F.col("patient_id") % 7 == 0, "n/a").otherwise(F.col("systolic_bp").cast("string")).alias("systolic_bp"),
                             F.col("has_diabetes").cast("string").alias("has_diabetes"), "zip_code")
    return quality.schema_validate(rows)


@query("q6_source_validate", """
WITH e AS (SELECT RowId, LocationDesc, Question, Topic AS Response, TRY_CAST(Reading AS DOUBLE) AS v, TRY_CAST(YearStart AS DOUBLE) AS y, Footnote FROM extract)
SELECT 'cdc' AS source, issue, column_name, FALSE AS is_valid FROM (
  SELECT 'non_numeric' AS issue, 'DataValue' AS column_name FROM e HAVING SUM(CASE WHEN v IS NULL THEN 1 ELSE 0 END) > COUNT(*) * 0.5
  UNION ALL SELECT 'out_of_range', 'DataValue' FROM e HAVING SUM(CASE WHEN v < 0 OR v > 100 THEN 1 ELSE 0 END) > 0
  UNION ALL SELECT 'mostly_missing', 'Footnote' FROM e HAVING SUM(CASE WHEN Footnote IS NULL THEN 1 ELSE 0 END) > COUNT(*) * 0.7
  UNION ALL SELECT 'outdated', 'YearStart' FROM e HAVING MAX(y) < 2024 - 3)""", ["extract"])
def _(t: Tables):
    rows = t.extract.select("RowId", "LocationDesc", "Question", F.col("Topic").alias("Response"),
                            F.col("Reading").alias("DataValue"), "YearStart", "Footnote")
    return quality.source_validate(rows, "cdc", 2024)


@query("q7_upload_validate", """
SELECT TRUE AS is_valid, 1.0::DOUBLE AS quality_score, COUNT(*) AS total_records,
  CASE WHEN SUM(CASE WHEN age < 18 OR age > 120 THEN 1 ELSE 0 END) > 0 THEN 'age: ' || SUM(CASE WHEN age < 18 OR age > 120 THEN 1 ELSE 0 END) || ' outside [18, 120]'
    ELSE '' END AS warnings FROM (SELECT age + CASE WHEN patient_id % 10 = 0 THEN 20 ELSE 0 END AS age FROM patients)""", ["patients"])
def _(t: Tables):
    shifted = F.col("age") + F.when(F.col("patient_id") % 10 == 0, 20).otherwise(0)
    out = quality.upload_validate(t.patients.select(shifted.alias("age"), "gender"))
    return out.select("is_valid", "quality_score", "total_records", "warnings")


_CLEAN = ("age", "gender", "Data_Value", "systolic_bp", "diastolic_bp", "bmi")


@query("q8_comprehensive_validate", """
WITH p AS (SELECT CAST(18 + (o_orderkey * 7) % 80 AS INT) AS age, 'male' AS gender, o_totalprice / 100 AS Data_Value,
    CAST(90 + (o_orderkey * 13) % 120 AS INT) AS systolic_bp, CAST(50 + (o_orderkey * 11) % 70 AS INT) AS diastolic_bp, CAST(22 AS INT) AS bmi FROM orders)
SELECT TRUE AS is_valid, 0 AS error_count, COUNT(*) AS total_records, COUNT(*) AS valid_records,
  'constant_columns: bmi; age_medicare: ' || SUM(CASE WHEN age < 65 THEN 1 ELSE 0 END) || '; blood_pressure: '
    || SUM(CASE WHEN systolic_bp <= diastolic_bp THEN 1 ELSE 0 END) AS warnings, ROUND(1 - 0.06, 3)::DOUBLE AS quality_score FROM p""")
def _(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        (18 + k * 7 % 80).cast("int").alias("age"), F.lit("male").alias("gender"),
        (F.col("o_totalprice") / 100).alias("Data_Value"), (90 + k * 13 % 120).cast("int").alias("systolic_bp"),
        (50 + k * 11 % 70).cast("int").alias("diastolic_bp"), F.lit(22).alias("bmi"))
    # Whole copies would only add a warning; the key keeps the rows apart.
    out = quality.comprehensive_validate(rows)
    return out.select("is_valid", "error_count", "total_records", "valid_records", "warnings", "quality_score")


@query("q9_consistency_rules", """
SELECT 'age_medicare' AS rule, 'warning' AS severity, SUM(CASE WHEN age < 65 THEN 1 ELSE 0 END)::BIGINT AS violations FROM patients
UNION ALL SELECT 'blood_pressure', 'warning', SUM(CASE WHEN systolic_bp <= diastolic_bp THEN 1 ELSE 0 END)::BIGINT FROM patients
UNION ALL SELECT 'hospitalizations', 'warning', SUM(CASE WHEN cardiovascular_hospitalizations_last_year > total_hospitalizations_last_year THEN 1 ELSE 0 END)::BIGINT
FROM patients""", ["patients"])
def _(t: Tables):
    return quality.consistency_rules(t.patients)


@query("q10_dataset_quality", f"""{_QUALITY}
SELECT ROUND((1 - gaps / (n * 12)) * 0.4 + ok / n * 0.6, 3) AS overall_score, ROUND(1 - gaps / (n * 12), 3) AS completeness,
  ROUND(ok / n, 3) AS validity_score, ok AS valid_records, n - ok AS invalid_records, gaps AS missing_cells, n * 12 AS total_cells FROM a""", ["patients"])
def _(t: Tables):
    return quality.dataset_quality(_expected(t))


_DIM = ("patient_id", "age", "gender", "systolic_bp", "diastolic_bp", "bmi", "hdl_cholesterol", "record_date")


@query("q11_quality_dimensions", """
WITH p AS (SELECT patient_id, age, CASE WHEN patient_id % 2 = 0 THEN UPPER(gender) ELSE gender END AS gender, systolic_bp, diastolic_bp, bmi,
    hdl_cholesterol, record_date FROM patients),
a AS (SELECT COUNT(*) AS n, SUM(CASE WHEN age IS NULL THEN 1 ELSE 0 END + CASE WHEN gender IS NULL THEN 1 ELSE 0 END
    + CASE WHEN systolic_bp IS NULL THEN 1 ELSE 0 END + CASE WHEN bmi IS NULL THEN 1 ELSE 0 END)::BIGINT AS gaps,
  CASE WHEN COUNT(DISTINCT gender) <> COUNT(DISTINCT LOWER(gender)) THEN 1 ELSE 0 END + CASE WHEN SUM(CASE WHEN systolic_bp <= diastolic_bp THEN 1 ELSE 0 END) > 0
    THEN 1 ELSE 0 END AS mixed,
  CASE WHEN SUM(CASE WHEN age < 18 OR age > 120 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END
    + CASE WHEN SUM(CASE WHEN systolic_bp < 50 OR systolic_bp > 300 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END
    + CASE WHEN SUM(CASE WHEN diastolic_bp < 30 OR diastolic_bp > 200 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END
    + CASE WHEN SUM(CASE WHEN bmi < 10 OR bmi > 100 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END
    + CASE WHEN SUM(CASE WHEN hdl_cholesterol < 10 OR hdl_cholesterol > 150 THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS outside,
  CASE WHEN SUM(CASE WHEN age < 65 THEN 1 ELSE 0 END) > COUNT(*) * 0.1 THEN 1 ELSE 0 END AS invalid,
  DATE_DIFF('day', MAX(record_date), TIMESTAMP '2002-06-01 00:00:00') AS age_days FROM p),
d AS (SELECT 'completeness' AS dimension, ROUND(1 - gaps / (n * 8), 3) AS score, gaps AS findings FROM a
  UNION ALL SELECT 'consistency', ROUND(1 - mixed / 10, 3), mixed FROM a UNION ALL SELECT 'accuracy', ROUND(1 - outside / 20, 3), outside FROM a
  UNION ALL SELECT 'validity', ROUND(1 - invalid / 10, 3), invalid FROM a UNION ALL SELECT 'uniqueness', 1.0, 0 FROM a
  UNION ALL SELECT 'timeliness', ROUND(GREATEST(0, 1 - age_days / 365), 3), age_days FROM a)
SELECT dimension, score, findings::BIGINT AS findings FROM d UNION ALL SELECT 'overall', ROUND(SUM(score) / 6, 3),
  SUM(CASE WHEN dimension IN ('consistency', 'accuracy', 'validity') THEN findings ELSE 0 END)::BIGINT FROM d""", ["patients"])
def _(t: Tables):
    shout = F.when(F.col("patient_id") % 2 == 0, F.upper("gender")).otherwise(F.col("gender"))
    return quality.quality_dimensions(t.patients.select(*_DIM).withColumn("gender", shout), "2002-06-01 00:00:00")


@query("q11_completeness_by_column", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", ROUND(COUNT({c}) / COUNT(*), 3) AS completeness FROM patients" for c in _EXPECTED), ["patients"])
def _(t: Tables):
    return quality.completeness_by_column(_expected(t))


@query("q12_characterise", """
SELECT COUNT(*) AS total_rows, 6 AS total_columns, 0::BIGINT AS missing_values, 0::BIGINT AS duplicate_rows, 3 AS numeric_columns, 2 AS categorical_columns,
  1 AS datetime_columns, STRFTIME(MIN(o_orderdate), '%Y-%m-%d') AS start_date, STRFTIME(MAX(o_orderdate), '%Y-%m-%d') AS end_date,
  COUNT(DISTINCT o_orderpriority) AS place_count FROM orders""")
def _(t: Tables):
    return quality.characterise(t.orders, "o_orderpriority")


_SURVEY_NUM = ("Age", "BMI", "PhysHlth")


def _profile(c: str) -> str:
    f = (f"(SELECT quantile_cont({c}, 0.25) FROM survey_gaps)", f"(SELECT quantile_cont({c}, 0.75) FROM survey_gaps)")
    iqr = f"({f[1]} - {f[0]})"
    return (f"SELECT '{c}' AS \"column\", 'numeric' AS data_type, COUNT(*) - COUNT({c}) AS missing_count, "
            f"ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 4) AS missing_percent, "
            f"SUM(CASE WHEN {c} < {f[0]} - 1.5 * {iqr} OR {c} > {f[1]} + 1.5 * {iqr} THEN 1 ELSE 0 END)::BIGINT AS outliers, "
            f"ROUND(SKEWNESS({c}), 4) AS skewness FROM survey_gaps")


@query("q13_column_profile", " UNION ALL ".join(_profile(c) for c in _SURVEY_NUM) + """
UNION ALL SELECT 'Sex', 'categorical', COUNT(*) - COUNT(Sex), ROUND((COUNT(*) - COUNT(Sex)) / COUNT(*) * 100, 4), NULL, NULL FROM survey_gaps""", ["survey_gaps"])
def _(t: Tables):
    return quality.column_profile(t.survey_gaps.select(*_SURVEY_NUM, "Sex"))


@query("q14_high_correlations", """
WITH x AS (SELECT l_quantity AS a, l_quantity * 2 + l_tax AS b, l_extendedprice AS c, -l_extendedprice + l_quantity AS d FROM lineitem),
p AS (SELECT 'a' AS feature1, 'b' AS feature2, CORR(a, b) AS r FROM x UNION ALL SELECT 'a', 'c', CORR(a, c) FROM x UNION ALL SELECT 'a', 'd', CORR(a, d) FROM x
  UNION ALL SELECT 'b', 'c', CORR(b, c) FROM x UNION ALL SELECT 'b', 'd', CORR(b, d) FROM x UNION ALL SELECT 'c', 'd', CORR(c, d) FROM x)
SELECT feature1, feature2, ROUND(r, 6) AS correlation FROM p WHERE ABS(r) > 0.8""")
def _(t: Tables):
    q, p, x = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    rows = t.lineitem.select(q.alias("a"), (q * 2 + x).alias("b"), p.alias("c"), (q - p).alias("d"))
    return rounded(quality.high_correlations(rows))


def _describe(c: str) -> str:
    return (f"SELECT '{c}' AS feature, COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std, ROUND(MIN({c}), 6)::DOUBLE AS min, "
            f"ROUND(quantile_cont({c}, 0.25), 6)::DOUBLE AS p25, ROUND(quantile_cont({c}, 0.5), 6)::DOUBLE AS p50, ROUND(quantile_cont({c}, 0.75), 6)::DOUBLE AS p75, "
            f"ROUND(MAX({c}), 6)::DOUBLE AS max FROM lineitem")


@query("q15_describe", " UNION ALL ".join(_describe(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")))
def _(t: Tables):
    return rounded(quality.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]))


@query("q15_target_summary", """
SELECT COUNT(HeartDisease) AS total, SUM(HeartDisease)::BIGINT AS positives, ROUND(AVG(HeartDisease), 6) AS positive_rate FROM survey""", ["survey"])
def _(t: Tables):
    return rounded(quality.target_summary(t.survey, "HeartDisease"))


@query("q16_duplicate_count", """
SELECT 'row' AS scope, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM copies)) AS duplicate_rows, COUNT(*) AS total_rows FROM copies
UNION ALL SELECT 'place', COUNT(*) - COUNT(DISTINCT place), COUNT(*) FROM copies""", ["copies"])
def _(t: Tables):
    whole = quality.duplicate_count(t.copies).withColumn("scope", F.lit("row"))
    return whole.unionByName(quality.duplicate_count(t.copies, ["place"]).withColumn("scope", F.lit("place")))


@query("q17_drop_duplicates", "SELECT DISTINCT * FROM copies", ["copies"])
def _(t: Tables):
    return quality.drop_duplicates(t.copies)


@query("q18_keep_latest_duplicate", "SELECT place, topic, reading, MAX(yearstart) AS yearstart FROM copies GROUP BY place, topic, reading", ["copies"])
def _(t: Tables):
    return quality.keep_latest_duplicate(t.copies)


def _violations(rules, table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{r.name}' AS rule, '{r.severity}' AS severity, COALESCE(SUM(CASE WHEN NOT ({r.predicate}) THEN 1 ELSE 0 END), 0)::BIGINT AS violations FROM {table}"
        for r in rules)


@query("q19_constraints_vitals", _violations(R.VITALS_RULES, "vitals"), ["vitals"])
def _(t: Tables):
    return quality.constraint_check(t.vitals, R.VITALS_RULES)


@query("q19_constraints_patients", _violations(
    [r for r in (*R.PATIENT_RULES, *R.HISTORY_RULES) if "data_completeness" not in r.predicate], "patients"), ["patients"])
def _(t: Tables):
    rules = [r for r in (*R.PATIENT_RULES, *R.HISTORY_RULES) if "data_completeness" not in r.predicate]
    return quality.constraint_check(t.patients, rules)


@query("q19_constraints_predictions", _violations(
    [r for r in R.PREDICTION_RULES if "confidence" not in r.predicate], "predictions"), ["predictions"])
def _(t: Tables):
    return quality.constraint_check(t.predictions, [r for r in R.PREDICTION_RULES if "confidence" not in r.predicate])


@query("q19_constraints_feedback", _violations(R.FEEDBACK_RULES, "feedback"), ["feedback"])
def _(t: Tables):
    return quality.constraint_check(t.feedback, R.FEEDBACK_RULES)


@query("q19_constraints_medications", _violations(R.MEDICATION_RULES, "medications"), ["medications"])
def _(t: Tables):
    return quality.constraint_check(t.medications, R.MEDICATION_RULES)


@query("q19_constraints_datasets", _violations(
    [r for r in R.DATASET_RULES if "usage" not in r.predicate and "processing_status" not in r.predicate], "datasets"), ["datasets"])
def _(t: Tables):
    rules = [r for r in R.DATASET_RULES if "usage" not in r.predicate and "processing_status" not in r.predicate]
    return quality.constraint_check(t.datasets, rules)


_RECORD_RULES = {
    "models": R.MODEL_RULES, "outcomes": R.OUTCOME_RULES, "episodes": R.EPISODE_RULES, "risk_factors": R.RISK_FACTOR_RULES,
    "providers": R.PROVIDER_RULES, "relationships": R.RELATIONSHIP_RULES, "sync_jobs": R.SYNC_RULES, "processing_jobs": R.PROCESSING_RULES,
    "batches": R.BATCH_RULES, "performance_history": R.PERFORMANCE_RULES, "training_jobs": R.TRAINING_JOB_RULES,
    "completeness": [r for r in (*R.PATIENT_RULES, *R.PREDICTION_RULES, *R.DATASET_RULES)
                     if r.predicate.split()[0] in ("data_completeness_score", "confidence_score", "usage_count", "processing_status")]}
for _name, _rules in _RECORD_RULES.items():
    query(f"q19_constraints_{_name}", _violations(_rules, "records"), ["records"])(
        lambda t, rules=_rules: quality.constraint_check(t.records, rules))


@query("q19_unique_key", """
SELECT 'uq_patient_day' AS rule, 'error' AS severity, COUNT(*) - COUNT(DISTINCT (patient_id, measurement_date)) AS violations FROM vitals""", ["vitals"])
def _(t: Tables):
    return quality.unique_check(t.vitals, "uq_patient_day", ["patient_id", "measurement_date"])


@query("q20_feedback_rules", """
SELECT feedback_id, CASE WHEN feedback_type = 'outcome' AND actual_outcome IS NULL THEN 'actual_outcome is required'
  WHEN feedback_type = 'rating' AND provider_rating IS NULL THEN 'provider_rating is required'
  WHEN feedback_type = 'correction' AND COALESCE(corrected_risk_score, 0) = 0 AND corrected_risk_category IS NULL
    THEN 'corrected_risk_score or corrected_risk_category is required' END AS feedback_error FROM feedback""", ["feedback"])
def _(t: Tables):
    return quality.feedback_rules(t.feedback).select("feedback_id", "feedback_error")


@query("q21_dataset_statistics", """
SELECT dataset_type, COUNT(*) AS datasets, SUM(total_records)::BIGINT AS records, ROUND(SUM(COALESCE(file_size_bytes, 0) / 1048576.0), 2) AS size_mb,
  SUM(CASE WHEN created_at > TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 30 DAY THEN 1 ELSE 0 END)::BIGINT AS added_last_30_days,
  ROUND(AVG(COALESCE(file_size_bytes, 0) / 1048576.0), 2) AS average_size_mb,
  ROUND(COALESCE(AVG(CASE WHEN completeness_score <> 0 THEN completeness_score END), 0), 4) AS average_completeness,
  SUM(CASE WHEN validation_status = 'passed' THEN 1 ELSE 0 END)::BIGINT AS validated_datasets FROM datasets GROUP BY ROLLUP (dataset_type)""", ["datasets"])
def _(t: Tables):
    return rollups.dataset_statistics(t.datasets, "2001-06-01 00:00:00")


@query("q22_dataset_quality_score", """
WITH s AS (SELECT dataset_id, [completeness_score, CASE WHEN total_records <> 0 THEN 1 - missing_values_count / (total_records * total_columns) END,
  CASE WHEN total_records <> 0 THEN 1 - duplicate_records_count / total_records END] AS parts FROM datasets)
SELECT dataset_id, ROUND(COALESCE(LIST_AVG(LIST_FILTER(parts, lambda x: x IS NOT NULL)), 0), 6) AS data_quality_score FROM s""", ["datasets"])
def _(t: Tables):
    return rounded(quality.dataset_quality_score(t.datasets).select("dataset_id", "data_quality_score"))


# -- summaries ----------------------------------------------------------------

_COUNTS = ", ".join(f"SUM(CASE WHEN risk_category = '{c}' THEN 1 ELSE 0 END)::BIGINT AS {c}_count" for c in ("low", "medium", "high"))
_STATS = """ROUND(AVG(risk_score), 4) AS average_risk_score, ROUND(quantile_cont(risk_score, 0.5), 4) AS median_risk_score,
  ROUND(STDDEV_POP(risk_score), 4) AS std_risk_score, ROUND(MIN(risk_score), 4) AS min_risk_score, ROUND(MAX(risk_score), 4) AS max_risk_score"""


@query("q23_batch_summary", f"""
SELECT COUNT(*) AS total_predictions, COUNT(risk_score) AS successful_predictions, {_COUNTS}, {_STATS},
  ROUND(100.0 * SUM(CASE WHEN risk_category = 'high' THEN 1 ELSE 0 END) / COUNT(*), 1) AS high_risk_percentage FROM predictions""", ["predictions"])
def _(t: Tables):
    return rollups.batch_summary(t.predictions)


@query("q24_batch_analytics", """
SELECT SUM(CASE WHEN risk_score < 0.2 THEN 1 ELSE 0 END)::BIGINT AS very_low, SUM(CASE WHEN risk_score >= 0.2 AND risk_score < 0.4 THEN 1 ELSE 0 END)::BIGINT AS low,
  SUM(CASE WHEN risk_score >= 0.4 AND risk_score < 0.6 THEN 1 ELSE 0 END)::BIGINT AS moderate,
  SUM(CASE WHEN risk_score >= 0.6 AND risk_score < 0.8 THEN 1 ELSE 0 END)::BIGINT AS high, SUM(CASE WHEN risk_score >= 0.8 THEN 1 ELSE 0 END)::BIGINT AS very_high,
  ROUND(AVG(risk_score), 4) AS mean, ROUND(quantile_cont(risk_score, 0.5), 4) AS median, ROUND(STDDEV_POP(risk_score), 4) AS standard_deviation,
  ROUND(MIN(risk_score), 4) AS min, ROUND(MAX(risk_score), 4) AS max,
  CONCAT_WS('; ', CASE WHEN 100.0 * SUM(CASE WHEN risk_score >= 0.7 THEN 1 ELSE 0 END) / COUNT(*) > 30 THEN 'many at high risk' END,
    CASE WHEN AVG(risk_score) > 0.6 THEN 'Overall patient population shows elevated cardiovascular risk' END,
    CASE WHEN STDDEV_POP(risk_score) > 0.3 THEN 'High variability in risk scores suggests diverse patient population' END) AS insights FROM predictions""",
       ["predictions"])
def _(t: Tables):
    out = rollups.batch_analytics(t.predictions)
    short = F.transform("clinical_insights", lambda x: F.when(x.startswith("High percentage"), "many at high risk").otherwise(x))
    return out.withColumn("insights", F.array_join(short, "; ")).drop("clinical_insights")


@query("q25_history_summary", f"""
SELECT COUNT(*) AS total_predictions, {_COUNTS}, ROUND(AVG(risk_score), 4) AS average_risk_score, COUNT(DISTINCT model_version) AS model_versions,
  COUNT(actual_outcome) AS predictions_with_feedback, SUM(CASE WHEN actual_outcome THEN 1 ELSE 0 END)::BIGINT AS positive_outcomes,
  SUM(CASE WHEN NOT actual_outcome THEN 1 ELSE 0 END)::BIGINT AS negative_outcomes, STRFTIME(MIN(created_at), '%Y-%m-%d %H:%M:%S') AS earliest,
  STRFTIME(MAX(created_at), '%Y-%m-%d %H:%M:%S') AS latest FROM predictions""", ["predictions"])
def _(t: Tables):
    return rollups.history_summary(t.predictions)


@query("q25_model_usage", "SELECT model_version, COUNT(*) AS predictions FROM predictions GROUP BY 1", ["predictions"])
def _(t: Tables):
    return rollups.model_usage(t.predictions)


_HOURS = {"1h": 1, "1d": 24, "7d": 168, "30d": 720, "all": 100000}


def _statistics(frame: str) -> str:
    pct = ", ".join(f"ROUND(100.0 * SUM(CASE WHEN risk_category = '{c}' THEN 1 ELSE 0 END) / COUNT(*), 1) AS {c}_percentage" for c in ("low", "medium", "high"))
    return (f"SELECT '{frame}' AS timeframe, COUNT(*) AS total_predictions, {_COUNTS}, {pct}, {_STATS}, COUNT(DISTINCT model_version) AS model_versions "
            f"FROM predictions WHERE created_at >= (SELECT MAX(created_at) FROM predictions) - INTERVAL {_HOURS[frame]} HOUR")


@query("q26_prediction_statistics", " UNION ALL ".join(_statistics(f) for f in _HOURS), ["predictions"])
def _(t: Tables):
    return rollups.prediction_statistics(t.predictions, list(_HOURS))


_DAILY = """COUNT(*) AS total, SUM(CASE WHEN risk_category = 'low' THEN 1 ELSE 0 END)::BIGINT AS low_risk,
  SUM(CASE WHEN risk_category = 'medium' THEN 1 ELSE 0 END)::BIGINT AS medium_risk, SUM(CASE WHEN risk_category = 'high' THEN 1 ELSE 0 END)::BIGINT AS high_risk,
  ROUND(AVG(risk_score), 4) AS avg_risk_score"""


@query("q27_daily_trend", f"""
SELECT CAST(created_at AS DATE) AS day, {_DAILY}, ROUND(100.0 * SUM(CASE WHEN risk_category = 'high' THEN 1 ELSE 0 END) / COUNT(*), 4) AS high_risk_percentage
FROM predictions GROUP BY 1""", ["predictions"])
def _(t: Tables):
    return rollups.daily_trend(t.predictions)


@query("q28_outcome_performance", """
SELECT COUNT(actual_outcome) AS predictions_with_outcomes, ROUND(AVG(CASE WHEN actual_outcome IS NULL THEN NULL WHEN (risk_category = 'high') = actual_outcome THEN 1 ELSE 0 END), 4) AS accuracy,
  ROUND(COUNT(actual_outcome) / COUNT(*), 4) AS feedback_rate, SUM(CASE WHEN actual_outcome THEN 1 ELSE 0 END)::BIGINT AS positive_outcomes,
  SUM(CASE WHEN NOT actual_outcome THEN 1 ELSE 0 END)::BIGINT AS negative_outcomes FROM predictions""", ["predictions"])
def _(t: Tables):
    return rollups.outcome_performance(t.predictions)


@query("q29_statistics_insights", """
SELECT '7d' AS timeframe, CONCAT_WS('; ', CASE WHEN ROUND(100.0 * SUM(CASE WHEN risk_category = 'high' THEN 1 ELSE 0 END) / COUNT(*), 1) > 25 THEN 'High percentage of patients classified as high-risk' END,
  CASE WHEN AVG(risk_score) > 0.6 THEN 'Patient population shows elevated cardiovascular risk' END,
  CASE WHEN COUNT(DISTINCT model_version) > 1 THEN 'Multiple models are being used for predictions' END) AS insights
FROM predictions WHERE created_at >= (SELECT MAX(created_at) FROM predictions) - INTERVAL 168 HOUR""", ["predictions"])
def _(t: Tables):
    out = rollups.statistics_insights(rollups.prediction_statistics(t.predictions, "7d"))
    return out.withColumn("insights", F.array_join("insights", "; "))


@query("q30_peer_percentile", """
SELECT prediction_id, ROUND(AVG(risk_score) OVER (PARTITION BY age_group, gender), 6) AS peer_average,
  ROUND(PERCENT_RANK() OVER (PARTITION BY age_group, gender ORDER BY risk_score), 6) AS percentile FROM predictions""", ["predictions"])
def _(t: Tables):
    return rounded(rollups.peer_percentile(t.predictions).select("prediction_id", "peer_average", "percentile"))


@query("q31_request_metrics", """
SELECT method, endpoint, status_code, COUNT(*) AS requests, SUM(CASE WHEN response_time_ms <= 100 THEN 1 ELSE 0 END)::BIGINT AS latency_le_100,
  SUM(CASE WHEN response_time_ms > 100 AND response_time_ms <= 500 THEN 1 ELSE 0 END)::BIGINT AS latency_le_500,
  SUM(CASE WHEN response_time_ms > 500 AND response_time_ms <= 1000 THEN 1 ELSE 0 END)::BIGINT AS latency_le_1000,
  SUM(CASE WHEN response_time_ms > 1000 AND response_time_ms <= 5000 THEN 1 ELSE 0 END)::BIGINT AS latency_le_5000,
  SUM(CASE WHEN response_time_ms > 5000 THEN 1 ELSE 0 END)::BIGINT AS latency_over, SUM(CASE WHEN response_time_ms > 5000 THEN 1 ELSE 0 END)::BIGINT AS slow_requests,
  ROUND(AVG(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END), 4) AS error_share, ROUND(AVG(response_time_ms), 4) AS avg_response_time_ms
FROM requests GROUP BY 1, 2, 3""", ["requests"])
def _(t: Tables):
    return rollups.request_metrics(t.requests)
