"""Row-level cleaning, missing values, outliers and feature construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions import risk
from pulseframe.functions import text as tx
from pulseframe.operators import cleaning, features, imputation, quality
from pulseframe.plans.catalog import query
from pulseframe.plans.frames import Tables
from pulseframe.plans.queries_tables import AS_OF, rounded

NTZ = "timestamp_ntz"


# -- cleaning -----------------------------------------------------------------

@query("c1_normalize_column_names", "SELECT c_custkey AS Cust_Key, c_name AS Full_Name_legal, c_nationkey AS nation FROM customer")
def _(t: Tables):
    raw = t.customer.select(F.col("c_custkey").alias(" Cust Key "), F.col("c_name").alias("Full Name (legal)"),
                            F.col("c_nationkey").alias("nation  "))
    return cleaning.normalize_column_names(raw)


@query("c1_lower_column_names", "SELECT c_custkey AS cust_key, c_name AS full_name FROM customer")
def _(t: Tables):
    raw = t.customer.select(F.col("c_custkey").alias(" Cust Key "), F.col("c_name").alias("FULL Name"))
    return cleaning.normalize_column_names(raw, lower=True)


@query("c2_drop_all_null_columns", "SELECT RowId, Topic, Break_Out FROM extract", ["extract"])
def _(t: Tables):
    return cleaning.drop_all_null_columns(t.extract.select("RowId", "Topic", "Footnote", "Break_Out"))


@query("c3_drop_all_null_rows", """
SELECT age, gender FROM patients WHERE age IS NOT NULL OR gender IS NOT NULL""", ["patients"])
def _(t: Tables):
    return cleaning.drop_all_null_rows(t.patients.select("age", "gender"))


@query("c4_coerce_types", """
SELECT RowId, TRY_CAST(Reading AS DOUBLE) AS Reading, LocationAbbr,
  CASE WHEN TRY_CAST(YearStart AS INT) IS NOT NULL THEN MAKE_DATE(TRY_CAST(YearStart AS INT), 1, 1) END AS YearStart FROM extract""",
       ["extract"])
def _(t: Tables):
    rows = t.extract.select("RowId", "Reading", "LocationAbbr", "YearStart")
    return cleaning.coerce_types(rows, numeric=["Reading"])


@query("c5_standardize_text", """
SELECT RowId, CASE WHEN UPPER(TRIM(LocationDesc)) NOT IN ('NAN', 'NULL', 'N/A', 'NONE', '') THEN UPPER(TRIM(LocationDesc)) END AS LocationDesc,
  CASE WHEN UPPER(TRIM(LocationAbbr)) NOT IN ('NAN', 'NULL', 'N/A', 'NONE', '') THEN UPPER(TRIM(LocationAbbr)) END AS LocationAbbr,
  UPPER(Question) AS Question FROM extract""", ["extract"])
def _(t: Tables):
    return cleaning.standardize_text(t.extract.select("RowId", "LocationDesc", "LocationAbbr", "Question"))


@query("c6_unify_unknown", """
SELECT RowId, CASE WHEN LocationDesc IS NULL OR TRIM(LocationDesc) IN ('Unknown', 'UNKNOWN', 'N/A', '') THEN 'unknown'
  ELSE TRIM(LocationDesc) END AS LocationDesc FROM extract""", ["extract"])
def _(t: Tables):
    return cleaning.unify_unknown(t.extract.select("RowId", "LocationDesc"))


@query("c7_null_sigma_outliers", """
WITH s AS (SELECT AVG(value) AS m, STDDEV_SAMP(value) AS sd FROM events)
SELECT event_id, CASE WHEN ABS(value - m) <= 3 * sd THEN value END AS value FROM events, s""")
def _(t: Tables):
    return cleaning.null_sigma_outliers(t.events.select("event_id", "value"), ["value"])


@query("c8_map_locations", """
SELECT RowId, CASE WHEN UPPER(TRIM(LocationDesc)) IN ('UNITED STATES', 'US', 'USA') THEN 'NATIONAL' ELSE UPPER(TRIM(LocationDesc)) END AS locationdesc
FROM extract""", ["extract"])
def _(t: Tables):
    rows = t.extract.select("RowId", F.upper(F.trim("LocationDesc")).alias("locationdesc"))
    return cleaning.standardize_locations(rows)


@query("c8_gender_from_break_out", """
SELECT RowId, Break_Out, CASE Break_Out WHEN 'Male' THEN 'male' WHEN 'Female' THEN 'female' WHEN 'Unknown' THEN 'unknown' END AS gender
FROM extract""", ["extract"])
def _(t: Tables):
    return cleaning.gender_from_break_out(t.extract.select("RowId", "Break_Out"))


@query("c9_numeric_years", "SELECT RowId, TRY_CAST(YearStart AS DOUBLE) AS YearStart, Topic FROM extract", ["extract"])
def _(t: Tables):
    return cleaning.numeric_years(t.extract.select("RowId", "YearStart", "Topic"))


@query("c10_stamp_lineage", """
SELECT n_nationkey, n_name, 'cdc' AS data_source, '2024-01-31 00:00:00' AS stamped, '20240131' AS data_version FROM nation""")
def _(t: Tables):
    out = cleaning.stamp_lineage(t.nation.drop("n_regionkey"), "cdc", AS_OF)
    return out.withColumn("stamped", F.date_format("ingestion_timestamp", "yyyy-MM-dd HH:mm:ss")).drop("ingestion_timestamp")


@query("c11_drop_system_columns", "SELECT Topic, Question FROM extract", ["extract"])
def _(t: Tables):
    return cleaning.drop_system_columns(t.extract.select("RowId", "Topic", "Question"))


@query("c12_null_impossible", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS Data_Value,
  CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal / (c_custkey % 10) END AS ratio FROM customer""")
def _(t: Tables):
    inf = F.lit(float("inf"))
    part = F.col("c_custkey") % 10
    ratio = F.when(part == 0, F.when(F.col("c_acctbal") < 0, -inf).otherwise(inf)).otherwise(
        F.col("c_acctbal") / F.nullif(part, F.lit(0)))
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("Data_Value"), ratio.alias("ratio"))
    return cleaning.null_negative(cleaning.null_infinite(rows))


@query("c13_drop_missing_target", "SELECT patient_id, Data_Value FROM patients WHERE Data_Value IS NOT NULL", ["patients"])
def _(t: Tables):
    return cleaning.drop_missing_target(t.patients.select("patient_id", "Data_Value"))


@query("c14_clean_patient_records", """
SELECT patient_id, LOWER(gender) AS gender, LOWER(smoking_status) AS smoking_status,
  CASE WHEN patient_id % 8 = 0 THEN NULL ELSE CAST(age AS DOUBLE) END AS age, COALESCE(has_diabetes, FALSE) AS has_diabetes,
  patient_id % 3 = 0 AS has_hypertension FROM patients""", ["patients"])
def _(t: Tables):
    pid = F.col("patient_id")
    raw = t.patients.select(
        "patient_id", F.concat(F.lit("  "), F.upper("gender"), F.lit(" ")).alias("gender"),
        F.initcap("smoking_status").alias("smoking_status"),
        F.when(pid % 8 == 0, "n/a").otherwise(F.col("age").cast("string")).alias("age"), "has_diabetes",
        F.when(pid % 3 == 0, F.when(pid % 2 == 0, "Yes").otherwise("TRUE")).when(pid % 3 == 1, "no")
        .alias("has_hypertension"))
    return cleaning.clean_patient_records(raw)


@query("c15_filter_history", """
SELECT prediction_id, risk_category FROM predictions WHERE user_id = 7 AND created_at >= TIMESTAMP '2024-01-05 00:00:00'
  AND created_at <= TIMESTAMP '2024-01-25 00:00:00' AND risk_category = 'low' AND model_version = 'v1'""", ["predictions"])
def _(t: Tables):
    return cleaning.filter_history(t.predictions, 7, "2024-01-05 00:00:00", "2024-01-25 00:00:00", "low", "v1").select(
        "prediction_id", "risk_category")


@query("c16_derive_target", """
SELECT sid, CASE WHEN HighBP = 1 OR Diabetes = 1 OR HighChol = 1 THEN 1 ELSE 0 END AS HeartDisease FROM survey""", ["survey"])
def _(t: Tables):
    rows = t.survey.select("sid", F.col("HighBP").alias("CHD"), F.col("Diabetes").alias("MI"), F.col("HighChol").alias("Stroke"))
    return cleaning.derive_target(rows).select("sid", "HeartDisease")


_REDACT = "text"
for _p in tx.SENSITIVE_PATTERNS:
    _REDACT = f"REGEXP_REPLACE({_REDACT}, '{_p}', '[REDACTED]', 'gi')"


@query("c17_redact_text", f"SELECT doc_id, MD5({_REDACT}) AS digest, LENGTH({_REDACT}) AS chars, {_REDACT} <> text AS changed FROM documents")
def _(t: Tables):
    out = cleaning.redact_text(t.documents.select("doc_id", "text", F.col("text").alias("raw")), ["text"])
    return out.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"),
                      (F.col("text") != F.col("raw")).alias("changed"))


@query("c17_redact_turns", f"SELECT conv_id, turn, MD5({_REDACT}) AS digest FROM conversations")
def _(t: Tables):
    return cleaning.redact_text(t.conversations, ["text"]).select("conv_id", "turn", F.md5("text").alias("digest"))


@query("c18_redact_by_name", """
SELECT doc_id, '[REDACTED]' AS api_token, CASE WHEN LENGTH(text) > 100 THEN SUBSTR(text, 1, 97) || '...' ELSE text END AS text,
  '[REDACTED]' AS secret_in_map, lang AS lang_in_map FROM documents""")
def _(t: Tables):
    rows = t.documents.select("doc_id", F.col("source").alias("api_token"), "text", F.create_map(
        F.lit("user_password"), F.col("source"), F.lit("lang"), F.col("lang")).alias("settings"))
    out = cleaning.redact_by_name(rows)
    return out.select("doc_id", "api_token", "text", F.col("settings")["user_password"].alias("secret_in_map"),
                      F.col("settings")["lang"].alias("lang_in_map"))


@query("c19_anonymize_patients", """
SELECT CASE WHEN Age < 30 THEN '18-29' WHEN Age < 40 THEN '30-39' WHEN Age < 50 THEN '40-49' WHEN Age < 60 THEN '50-59'
  WHEN Age < 70 THEN '60-69' ELSE '70+' END AS age_group, Sex, Smoking, HighBP, HighChol, Diabetes, PhysActivity,
  CASE WHEN BMI < 18.5 THEN 'underweight' WHEN BMI < 25 THEN 'normal' WHEN BMI < 30 THEN 'overweight' ELSE 'obese' END AS bmi_category
FROM survey""", ["survey"])
def _(t: Tables):
    return cleaning.anonymize_patients(t.survey)


@query("c20_pseudonymize", "SELECT SHA256(CAST(c_custkey AS VARCHAR) || 'pepper') AS c_custkey, c_nationkey FROM customer")
def _(t: Tables):
    return cleaning.pseudonymize(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", "pepper")


@query("c21_config_fingerprint", """
SELECT s_suppkey, SUBSTR(MD5('{"feature_columns": ["age", "bmi", "n' || s_nationkey || '"], "hyperparameters": [["alpha", '
  || (s_suppkey % 9) || '.5], ["depth", ' || (s_suppkey % 4) || '.0]], "model_type": "' || s_name || '"}'), 1, 16) AS signature FROM supplier""")
def _(t: Tables):
    key = F.col("s_suppkey")
    params = F.create_map(F.lit("depth"), (key % 4).cast("double"), F.lit("alpha"), (key % 9).cast("double") + 0.5)
    names = F.array(F.lit("bmi"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("age"))
    return t.supplier.select("s_suppkey", tx.config_signature(F.col("s_name"), params, names).alias("signature"))


@query("c22_request_dedup_key", """
SELECT patient_id, MD5(COALESCE(CAST(age AS VARCHAR), '<null>') || '|' || COALESCE(gender, '<null>') || '|' ||
  COALESCE(CAST(systolic_bp AS VARCHAR), '<null>')) AS request_key FROM patients""", ["patients"])
def _(t: Tables):
    return cleaning.request_dedup_key(t.patients, ["age", "gender", "systolic_bp"]).select("patient_id", "request_key")


@query("c23_lookup_by_key", "SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders) WHERE o_orderkey = 77")
def _(t: Tables):
    return cleaning.lookup_by_key(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 77)


@query("c24_delete_by_key", """
SELECT prediction_id, 'kept' AS fate FROM predictions WHERE prediction_id NOT IN (SELECT prediction_id FROM feedback WHERE feedback_type = 'correction')
UNION ALL SELECT prediction_id, 'deleted' FROM predictions WHERE prediction_id IN (SELECT prediction_id FROM feedback WHERE feedback_type = 'correction')""",
       ["predictions", "feedback"])
def _(t: Tables):
    keys = t.feedback.where("feedback_type = 'correction'").select("prediction_id").distinct()
    kept, audit = cleaning.delete_by_key(t.predictions.select("prediction_id"), keys, "prediction_id", AS_OF)
    return kept.withColumn("fate", F.lit("kept")).unionByName(audit.select("prediction_id", F.col("event_type").alias("fate")))


# -- missing values and outliers ----------------------------------------------

@query("i1_drop_sparse_columns", "SELECT sid, Age, GenHlth FROM survey_gaps", ["survey_gaps"])
def _(t: Tables):
    return imputation.drop_sparse_columns(t.survey_gaps.select("sid", "Age", "GenHlth", "Education"))


@query("i2_impute_median", """
WITH m AS (SELECT quantile_cont(Age, 0.5) AS a, quantile_cont(BMI, 0.5) AS b, quantile_cont(PhysHlth, 0.5) AS p FROM survey_gaps)
SELECT sid, COALESCE(Age::DOUBLE, a) AS Age, ROUND(COALESCE(BMI, b), 6) AS BMI, COALESCE(PhysHlth::DOUBLE, p) AS PhysHlth FROM survey_gaps, m""",
       ["survey_gaps"])
def _(t: Tables):
    return rounded(imputation.impute_median(t.survey_gaps.select("sid", "Age", "BMI", "PhysHlth")))


@query("i2_impute_mean", """
WITH m AS (SELECT AVG(Age) AS a, AVG(BMI) AS b FROM survey_gaps)
SELECT sid, ROUND(COALESCE(Age, a), 6) AS Age, ROUND(COALESCE(BMI, b), 6) AS BMI, HighBP FROM survey_gaps, m""", ["survey_gaps"])
def _(t: Tables):
    return rounded(imputation.impute_mean(t.survey_gaps.select("sid", "Age", "BMI", "HighBP")))


_MODE = "(SELECT {c} FROM survey_gaps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"


@query("i3_impute_mode", f"""
SELECT HighBP, COALESCE(Sex, {_MODE.format(c='Sex')}) AS Sex, COALESCE(GenHlth, {_MODE.format(c='GenHlth')}) AS GenHlth,
  'unknown' AS Nothing FROM survey_gaps""", ["survey_gaps"])
def _(t: Tables):
    rows = t.survey_gaps.select("HighBP", "Sex", "GenHlth", F.lit(None).cast("string").alias("Nothing"))
    return imputation.impute_mode(rows)


_SKEW = "(SELECT CASE WHEN SKEWNESS({c}) > 1 THEN quantile_cont({c}, 0.5) ELSE AVG({c}) END FROM survey_gaps)"


@query("i4_impute_smart", f"""
SELECT ROUND(COALESCE(Age, {_SKEW.format(c='Age')}), 6) AS Age, ROUND(COALESCE(BMI, {_SKEW.format(c='BMI')}), 6) AS BMI,
  ROUND(COALESCE(PhysHlth, {_SKEW.format(c='PhysHlth')}), 6) AS PhysHlth, COALESCE(Sex, {_MODE.format(c='Sex')}) AS Sex, HighBP
FROM survey_gaps""", ["survey_gaps"])
def _(t: Tables):
    return rounded(imputation.impute_smart(t.survey_gaps.select("Age", "BMI", "PhysHlth", "Sex", "HighBP")))


@query("i5_impute_false", "SELECT patient_id, COALESCE(has_diabetes, FALSE) AS has_diabetes, has_hypertension FROM patients", ["patients"])
def _(t: Tables):
    return imputation.impute_false(t.patients.select("patient_id", "has_diabetes", "has_hypertension"))


@query("i6_impute_constant", """
SELECT patient_id, COALESCE(gender, 'missing') AS gender, COALESCE(smoking_status, 'missing') AS smoking_status FROM patients""", ["patients"])
def _(t: Tables):
    return imputation.impute_constant(t.patients.select("patient_id", "gender", "smoking_status"))


_FENCE = """q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS p1, quantile_cont(l_extendedprice, 0.75) AS p3,
  quantile_cont(v, 0.25) AS v1, quantile_cont(v, 0.75) AS v3 FROM r)"""
_RAW = "r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_extendedprice * l_quantity AS v FROM lineitem)"
_PRICES = ("l_extendedprice", "v")


def _prices(t: Tables):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
                             (F.col("l_extendedprice") * F.col("l_quantity")).alias("v"))


@query("i8_clip_iqr", f"""
WITH {_RAW}, {_FENCE} SELECT l_orderkey, l_partkey, l_linenumber,
  ROUND(GREATEST(p1 - 1.5 * (p3 - p1), LEAST(p3 + 1.5 * (p3 - p1), l_extendedprice)), 4) AS l_extendedprice,
  ROUND(GREATEST(v1 - 1.5 * (v3 - v1), LEAST(v3 + 1.5 * (v3 - v1), v)), 3) AS v FROM r, q""")
def _(t: Tables):
    out = imputation.clip_iqr(_prices(t), _PRICES)
    return out.withColumns({"l_extendedprice": F.round("l_extendedprice", 4), "v": F.round("v", 3)})


@query("i9_flag_iqr", f"""
WITH {_RAW}, {_FENCE} SELECT l_orderkey, l_partkey, l_linenumber,
  l_extendedprice < p1 - 1.5 * (p3 - p1) OR l_extendedprice > p3 + 1.5 * (p3 - p1) AS l_extendedprice_outlier,
  v < v1 - 1.5 * (v3 - v1) OR v > v3 + 1.5 * (v3 - v1) AS v_outlier FROM r, q""")
def _(t: Tables):
    return imputation.flag_iqr(_prices(t), _PRICES).drop(*_PRICES)


@query("i9_count_iqr", f"""
WITH {_RAW}, {_FENCE} SELECT SUM(CASE WHEN l_extendedprice < p1 - 1.5 * (p3 - p1) OR l_extendedprice > p3 + 1.5 * (p3 - p1) THEN 1 ELSE 0 END)::BIGINT AS l_extendedprice,
  SUM(CASE WHEN v < v1 - 1.5 * (v3 - v1) OR v > v3 + 1.5 * (v3 - v1) THEN 1 ELSE 0 END)::BIGINT AS v FROM r, q""")
def _(t: Tables):
    found = imputation.count_iqr(_prices(t), _PRICES)
    return t.spark.createDataFrame([tuple(found[c] for c in _PRICES)], "l_extendedprice long, v long")


@query("i10_drop_iqr", f"""
WITH {_RAW}, {_FENCE} SELECT l_orderkey, l_partkey, l_linenumber FROM r, q
WHERE l_extendedprice BETWEEN p1 - 1.5 * (p3 - p1) AND p3 + 1.5 * (p3 - p1) AND v BETWEEN v1 - 1.5 * (v3 - v1) AND v3 + 1.5 * (v3 - v1)""")
def _(t: Tables):
    return imputation.drop_iqr(_prices(t), _PRICES).drop(*_PRICES)


# -- features -----------------------------------------------------------------

@query("e1_bmi", """
SELECT patient_id, ROUND(weight_kg / POW(height_cm / 100.0, 2), 6) AS bmi, ROUND(weight_kg / POW(height_cm / 100.0, 2), 2) AS calculated_bmi
FROM patients""", ["patients"])
def _(t: Tables):
    rows = features.add_bmi(t.patients, 2, "calculated_bmi")
    return features.add_bmi(rows).select("patient_id", F.round("bmi", 6).alias("bmi"), "calculated_bmi")


_BP = """CASE WHEN systolic_bp IS NULL OR diastolic_bp IS NULL THEN 'unknown' WHEN systolic_bp < 120 AND diastolic_bp < 80 THEN 'normal'
  WHEN systolic_bp < 130 AND diastolic_bp < 80 THEN 'elevated' WHEN systolic_bp BETWEEN 120 AND 129 OR diastolic_bp BETWEEN 80 AND 89
  THEN 'stage1_hypertension' ELSE 'stage2_hypertension' END"""


@query("e2_bp_category", f"SELECT patient_id, {_BP} AS bp_category FROM patients", ["patients"])
def _(t: Tables):
    return features.add_bp_category(t.patients).select("patient_id", "bp_category")


@query("e3_age_group", """
SELECT patient_id, CASE WHEN age > 120 THEN NULL WHEN age > 85 THEN '85_plus' WHEN age > 75 THEN '75_84' WHEN age > 65 THEN '65_74'
  WHEN age > 0 THEN 'under_65' END AS age_group,
  CASE WHEN age >= 85 THEN '85_plus' WHEN age >= 75 THEN '75_84' WHEN age >= 65 THEN '65_74' WHEN age < 65 THEN 'under_65' END AS peer_group
FROM patients""", ["patients"])
def _(t: Tables):
    rows = features.add_age_group(features.add_age_group(t.patients), out="peer_group", right=False)
    return rows.select("patient_id", "age_group", "peer_group")


@query("e4_bmi_category", """
SELECT patient_id, CASE WHEN bmi > 50 THEN NULL WHEN bmi > 30 THEN 'obese' WHEN bmi > 25 THEN 'overweight' WHEN bmi > 18.5 THEN 'normal'
  WHEN bmi > 0 THEN 'underweight' END AS bmi_category,
  CASE WHEN bmi > 39.9 THEN 'Obese_III' WHEN bmi > 34.9 THEN 'Obese_II' WHEN bmi > 29.9 THEN 'Obese_I' WHEN bmi > 24.9 THEN 'Overweight'
  WHEN bmi > 18.5 THEN 'Normal' WHEN bmi > 0 THEN 'Underweight' END AS BMI_Class FROM patients""", ["patients"])
def _(t: Tables):
    rows = features.add_bmi_category(features.add_bmi_category(t.patients), levels=6, out="BMI_Class")
    return rows.select("patient_id", "bmi_category", "BMI_Class")


@query("e5_bp_bin", """
SELECT patient_id, CASE WHEN systolic_bp > 300 THEN NULL WHEN systolic_bp > 140 THEN 'stage2' WHEN systolic_bp > 130 THEN 'stage1'
  WHEN systolic_bp > 120 THEN 'elevated' WHEN systolic_bp > 0 THEN 'normal' END AS bp_bin FROM patients""", ["patients"])
def _(t: Tables):
    return features.add_bp_bin(t.patients).select("patient_id", "bp_bin")


@query("e6_health_day_category", """
SELECT sid, CASE WHEN PhysHlth > 14 THEN 'Poor' WHEN PhysHlth > 7 THEN 'Fair' WHEN PhysHlth > 0 THEN 'Good' ELSE 'Excellent' END AS Physical_Health_Category,
  CASE WHEN MentHlth > 30 THEN NULL WHEN MentHlth > 14 THEN 'Many' WHEN MentHlth > 7 THEN 'Some' WHEN MentHlth > 0 THEN 'Few' ELSE 'None' END AS MentHlth_Binned
FROM survey""", ["survey"])
def _(t: Tables):
    rows = features.add_health_days(t.survey, "PhysHlth", "Physical_Health_Category")
    return features.add_health_days(rows, "MentHlth", "MentHlth_Binned", open_ended=False).select(
        "sid", "Physical_Health_Category", "MentHlth_Binned")


def _marks(q: int) -> str:
    return ", ".join(str(i / q) for i in range(1, q))


@query("e7_quantile_bin", f"""
WITH a AS (SELECT quantile_cont(Age, [{_marks(10)}]) AS e, MIN(Age) AS lo FROM survey),
b AS (SELECT quantile_cont(BMI, [{_marks(5)}]) AS e, MIN(BMI) AS lo FROM survey)
SELECT sid, CAST(LEN(LIST_FILTER(LIST_DISTINCT(a.e), lambda x: x < Age AND x > a.lo)) AS INT) AS Age_Decile,
  CAST(LEN(LIST_FILTER(LIST_DISTINCT(b.e), lambda x: x < BMI AND x > b.lo)) AS INT) AS BMI_Quintile FROM survey, a, b""", ["survey"])
def _(t: Tables):
    return features.add_quantile_bins(t.survey, {"Age_Decile": ("Age", 10), "BMI_Quintile": ("BMI", 5)}).select(
        "sid", "Age_Decile", "BMI_Quintile")


@query("e8_comorbidity_count", """
SELECT patient_id, CAST(has_hypertension AS INT) + COALESCE(CAST(has_diabetes AS INT), 0) + CAST(has_heart_disease AS INT)
  + CAST(has_stroke_history AS INT) + CAST(has_heart_attack_history AS INT) AS comorbidity_count,
  CAST(has_hypertension AS INT) + COALESCE(CAST(has_diabetes AS INT), 0) + CAST(has_heart_disease AS INT)
  + CAST(has_stroke_history AS INT) + CAST(has_heart_attack_history AS INT) + CAST(has_atrial_fibrillation AS INT)
  + CAST(has_heart_failure AS INT) AS cardiovascular_conditions_count FROM patients""", ["patients"])
def _(t: Tables):
    rows = features.add_comorbidity_count(t.patients)
    return features.add_comorbidity_count(rows, features.ENTITY_CONDITIONS, "cardiovascular_conditions_count").select(
        "patient_id", "comorbidity_count", "cardiovascular_conditions_count")


@query("e9_diabetes_hypertension_combo", """
SELECT patient_id, CASE WHEN has_diabetes AND has_hypertension THEN 1 ELSE 0 END AS diabetes_hypertension_combo FROM patients""", ["patients"])
def _(t: Tables):
    return features.add_diabetes_hypertension(t.patients).select("patient_id", "diabetes_hypertension_combo")


@query("e10_cholesterol_ratio", """
SELECT patient_id, ROUND(total_cholesterol / NULLIF(hdl_cholesterol, 0), 6) AS cholesterol_ratio FROM patients""", ["patients"])
def _(t: Tables):
    return rounded(features.add_cholesterol_ratio(t.patients).select("patient_id", "cholesterol_ratio"))


@query("e11_threshold_flags", """
SELECT sid, CAST(COALESCE(BMI >= 30, FALSE) AS INT) AS BMI_High_Risk, CAST(COALESCE(BMI >= 35, FALSE) AS INT) AS BMI_Very_High_Risk,
  CAST(COALESCE(Age >= 65, FALSE) AS INT) AS Age_High_Risk, CAST(COALESCE(Age >= 75, FALSE) AS INT) AS Age_Very_High_Risk,
  CAST(COALESCE(Sex = 'Male' AND Age > 45, FALSE) AS INT) AS Male_Over_45, CAST(COALESCE(Sex = 'Female' AND Age > 55, FALSE) AS INT) AS Female_Over_55,
  CAST(COALESCE(PhysHlth > 14, FALSE) AS INT) AS Poor_Physical_Health, CAST(MentHlth > 14 AS INT) AS Poor_Mental_Health FROM survey_gaps""",
       ["survey_gaps"])
def _(t: Tables):
    rows = t.survey_gaps.select("sid", "BMI", "Age", "Sex", "PhysHlth", "MentHlth")
    return features.add_threshold_flags(rows).drop("BMI", "Age", "Sex", "PhysHlth", "MentHlth")


@query("e12_lifestyle_risk_score", """
SELECT sid, Smoking + (1 - PhysActivity) + HvyAlcoholConsump AS Lifestyle_Risk_Score FROM survey""", ["survey"])
def _(t: Tables):
    return features.add_lifestyle_score(t.survey).select("sid", "Lifestyle_Risk_Score")


@query("e13_medical_risk_score", """
SELECT sid, Diabetes + HighBP + HighChol AS Medical_Risk_Score, CASE WHEN Diabetes + HighBP + HighChol >= 2 THEN 1 ELSE 0 END AS Multiple_Conditions
FROM survey""", ["survey"])
def _(t: Tables):
    return features.add_medical_score(t.survey).select("sid", "Medical_Risk_Score", "Multiple_Conditions")


@query("e14_passthrough_flags", """
SELECT sid, HighBP AS BP_Risk, HighChol AS Cholesterol_Risk, NoDocbcCost AS Healthcare_Access_Risk FROM survey""", ["survey"])
def _(t: Tables):
    return features.add_passthrough_flags(t.survey).select("sid", "BP_Risk", "Cholesterol_Risk", "Healthcare_Access_Risk")


_SEX = "(CASE WHEN Sex = 'Male' THEN 1 ELSE 0 END)"


@query("e15_pair_interactions", f"""
SELECT sid, Smoking * HighBP AS Smoking_X_HighBP, Diabetes * HighChol AS Diabetes_X_HighChol, Smoking * Diabetes AS Smoking_X_Diabetes,
  HighBP * HighChol AS HighBP_X_HighChol, PhysActivity * CAST(TRUNC(BMI) AS INT) AS PhysActivity_X_BMI, Age * {_SEX} AS Age_X_Sex,
  Smoking * PhysActivity AS Smoking_X_PhysActivity, ROUND(Age * BMI, 6) AS Age_X_BMI, Age * HighBP AS Age_X_HighBP,
  Age * HighChol AS Age_X_HighChol, Age * Diabetes AS Age_X_Diabetes, Age * Smoking AS Age_X_Smoking,
  ROUND(BMI * HighBP, 6) AS BMI_X_HighBP, ROUND(BMI * Diabetes, 6) AS BMI_X_Diabetes, ROUND(BMI * PhysActivity, 6) AS BMI_X_PhysActivity
FROM survey""", ["survey"])
def _(t: Tables):
    out = features.pair_interactions(t.survey)
    return rounded(out.select("sid", *[c for c in out.columns if "_X_" in c]))


@query("e16_triple_interactions", f"""
SELECT sid, Age * Smoking * HighBP AS Age_X_Smoking_X_HighBP, ROUND(BMI * Diabetes * HighChol, 6) AS BMI_X_Diabetes_X_HighChol,
  Age * {_SEX} * HighBP AS Age_X_Sex_X_HighBP FROM survey""", ["survey"])
def _(t: Tables):
    out = features.triple_interactions(t.survey)
    return rounded(out.select("sid", *[c for c in out.columns if "_X_" in c]))


@query("e15_patient_interactions", """
SELECT patient_id, age * CAST(has_diabetes AS INT) AS age_diabetes_interaction, age * CAST(has_hypertension AS INT) AS age_hypertension_interaction,
  ROUND(bmi * CAST(has_diabetes AS INT), 6) AS bmi_diabetes_interaction FROM patients""", ["patients"])
def _(t: Tables):
    return rounded(features.patient_interactions(t.patients).select(
        "patient_id", "age_diabetes_interaction", "age_hypertension_interaction", "bmi_diabetes_interaction"))


@query("e17_pressure_terms", """
SELECT patient_id, systolic_bp - diastolic_bp AS pulse_pressure,
  ROUND(diastolic_bp + (systolic_bp - diastolic_bp) / 3, 6) AS mean_arterial_pressure FROM patients""", ["patients"])
def _(t: Tables):
    return rounded(features.add_pressure_terms(t.patients).select("patient_id", "pulse_pressure", "mean_arterial_pressure"))


@query("e18_polynomial", """
SELECT sid, ROUND(POW(Age, 2), 6) AS Age_Poly_2, ROUND(POW(Age, 3), 6) AS Age_Poly_3, ROUND(POW(BMI, 2), 6) AS BMI_Poly_2,
  ROUND(POW(BMI, 3), 4) AS BMI_Poly_3 FROM survey""", ["survey"])
def _(t: Tables):
    rows = t.survey.select("sid", "Age", "BMI", F.col("HighBP").alias("PhysHlth"))
    out = features.polynomial(rows, 3, transforms=False).drop("Age", "BMI", "PhysHlth")
    return rounded(out).withColumn("BMI_Poly_3", F.round("BMI_Poly_3", 4))


@query("e18_squared_terms", """
SELECT patient_id, ROUND(POW(age, 2), 6) AS age_squared, ROUND(POW(bmi, 2), 6) AS bmi_squared, ROUND(POW(systolic_bp, 2), 6) AS systolic_bp_squared,
  ROUND(POW(total_cholesterol, 2), 6) AS total_cholesterol_squared FROM patients""", ["patients"])
def _(t: Tables):
    rows = t.patients.select("patient_id", *features.SQUARED_COLUMNS)
    return rounded(features.squared_terms(rows).drop(*features.SQUARED_COLUMNS))


@query("e19_root_and_log", """
SELECT sid, ROUND(SQRT(Age), 6) AS Age_Sqrt, ROUND(SQRT(BMI), 6) AS BMI_Sqrt, ROUND(SQRT(PhysHlth), 6) AS PhysHlth_Sqrt,
  ROUND(LN(Age), 6) AS Age_Log, ROUND(LN(BMI), 6) AS BMI_Log FROM survey""", ["survey"])
def _(t: Tables):
    out = features.polynomial(t.survey.select("sid", "Age", "BMI", "PhysHlth"), 1)
    return rounded(out.drop("Age", "BMI", "PhysHlth"))


@query("e20_temporal_parts", """
SELECT o_orderkey, YEAR(o_orderdate)::INT AS o_orderdate_year, MONTH(o_orderdate)::INT AS o_orderdate_month,
  QUARTER(o_orderdate)::INT AS o_orderdate_quarter, DAYOFYEAR(o_orderdate)::INT AS o_orderdate_day_of_year FROM orders""")
def _(t: Tables):
    return features.temporal_parts(t.orders.select("o_orderkey", "o_orderdate")).drop("o_orderdate")


_CATEGORY = "CASE WHEN risk_score < 0.3 THEN 'low' WHEN risk_score < 0.7 THEN 'medium' ELSE 'high' END"


@query("e21_risk_category", f"""
SELECT prediction_id, {_CATEGORY} AS computed, {_CATEGORY} = CASE WHEN prediction_id % 13 = 0 THEN 'high' ELSE risk_category END AS category_consistent
FROM predictions""", ["predictions"])
def _(t: Tables):
    claimed = F.when(F.col("prediction_id") % 13 == 0, "high").otherwise(F.col("risk_category"))
    rows = t.predictions.withColumn("risk_category", claimed)
    rows = features.check_risk_category(features.add_risk_category(rows, out="computed"))
    return rows.select("prediction_id", "computed", "category_consistent")


@query("e22_risk_band5", """
SELECT prediction_id, CASE WHEN risk_score < 0.2 THEN 'very_low' WHEN risk_score < 0.4 THEN 'low' WHEN risk_score < 0.6 THEN 'moderate'
    WHEN risk_score < 0.8 THEN 'high' ELSE 'very_high' END AS risk_band,
  CASE WHEN risk_score >= 0.8 THEN 'emergent' WHEN risk_score >= 0.6 THEN 'urgent' WHEN risk_score >= 0.4 THEN 'priority' ELSE 'routine' END AS urgency_level,
  CASE risk_category WHEN 'low' THEN 'Annual assessment recommended' WHEN 'medium' THEN 'Semi-annual assessment recommended'
    ELSE 'Quarterly assessment recommended' END AS monitoring FROM predictions""", ["predictions"])
def _(t: Tables):
    return features.add_risk_band(t.predictions).select("prediction_id", "risk_band", "urgency_level", "monitoring")


@query("e23_clinical_significance", f"""
SELECT prediction_id, CASE WHEN age >= 80 AND risk_score > 0.5 THEN '{risk.SIGNIFICANCE[0]}' WHEN age < 65 AND risk_score > 0.7
  THEN '{risk.SIGNIFICANCE[1]}' WHEN risk_score > 0.8 THEN '{risk.SIGNIFICANCE[2]}' ELSE '{risk.SIGNIFICANCE[3]}' END AS clinical_significance
FROM predictions""", ["predictions"])
def _(t: Tables):
    return features.add_clinical_significance(t.predictions).select("prediction_id", "clinical_significance")


@query("e24_risk_factors", """
SELECT patient_id, ARRAY_TO_STRING(LIST_FILTER([CASE WHEN age >= 75 THEN 'Advanced age (≥75 years)' WHEN age >= 65 THEN 'Age ≥65 years' END,
  CASE WHEN has_hypertension THEN 'Hypertension' END, CASE WHEN has_diabetes THEN 'Diabetes mellitus' END,
  CASE WHEN has_heart_disease THEN 'Existing heart disease' END, CASE WHEN has_stroke_history THEN 'Previous stroke' END,
  CASE WHEN has_heart_attack_history THEN 'Previous myocardial infarction' END, CASE WHEN smoking_status = 'current' THEN 'Current smoking' END,
  CASE WHEN systolic_bp >= 140 THEN 'Elevated blood pressure' END, CASE WHEN total_cholesterol >= 240 THEN 'High cholesterol' END,
  CASE WHEN bmi >= 30 THEN 'Obesity' END], lambda x: x IS NOT NULL), '; ') AS risk_factors FROM patients""", ["patients"])
def _(t: Tables):
    return features.add_risk_factors(t.patients).select("patient_id", F.array_join("risk_factors", "; ").alias("risk_factors"))


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SCORE = "((patient_id * 37) % 100) / 100.0"


@query("e25_recommendations", f"""
SELECT patient_id, ARRAY_TO_STRING((CASE WHEN {_SCORE} >= 0.7 THEN {_quoted(risk.TIER_ADVICE['high'])} WHEN {_SCORE} >= 0.3
    THEN {_quoted(risk.TIER_ADVICE['medium'])} ELSE {_quoted(risk.TIER_ADVICE['low'])} END || LIST_FILTER([
  CASE WHEN has_hypertension THEN '{risk.ADVICE_HYPERTENSION}' END, CASE WHEN has_diabetes THEN '{risk.ADVICE_DIABETES}' END,
  CASE WHEN smoking_status = 'current' THEN '{risk.ADVICE_SMOKING}' END, CASE WHEN bmi >= 30 THEN '{risk.ADVICE_WEIGHT}' END],
  lambda x: x IS NOT NULL))[1:5], '; ') AS recommendations FROM patients""", ["patients"])
def _(t: Tables):
    rows = t.patients.withColumn("risk_score", (F.col("patient_id") * 37 % 100) / 100)
    return features.add_recommendations(rows).select("patient_id", F.array_join("recommendations", "; ").alias("recommendations"))


def _filled(c: str) -> str:
    text = c in ("gender", "race_ethnicity", "state_code", "zip_code", "smoking_status")
    test = f"{c} IS NOT NULL AND {c} <> ''" if text else f"{c} IS NOT NULL"
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


@query("e26_completeness_score", f"""
SELECT patient_id, ROUND(({' + '.join(_filled(c) for c in features.COMPLETENESS_FIELDS)}) / 16.0, 6) AS completeness_score FROM patients""",
       ["patients"])
def _(t: Tables):
    return rounded(features.add_completeness(t.patients).select("patient_id", "completeness_score"))


@query("e27_entity_derivations", """
SELECT entity_id, CASE WHEN baseline_value <> 0 AND current_value <> 0 THEN current_value < baseline_value END AS is_improving,
  DATE_DIFF('day', episode_start_date, CASE WHEN episode_end_date IS NOT NULL THEN episode_end_date WHEN is_ongoing
    THEN TIMESTAMP '2024-01-31 00:00:00' END) AS episode_duration_days,
  CASE WHEN goals_total = 0 THEN 0.0::DOUBLE ELSE ROUND(goals_achieved / goals_total, 6) END AS goals_achievement_rate,
  CASE WHEN records_processed = 0 THEN 0.0::DOUBLE ELSE ROUND((records_inserted + records_updated) / records_processed * 100, 6) END AS success_rate,
  CASE WHEN processing_seconds > 0 THEN ROUND(records_processed / processing_seconds, 6) END AS processing_rate,
  CASE WHEN status = 'running' AND progress <> 0 THEN ROUND(GREATEST(0, e / (progress / 100) - e), 4) END AS eta_minutes
FROM (SELECT *, EPOCH(TIMESTAMP '2024-01-31 00:00:00' - episode_start_date) / 60 AS e FROM entities)""", ["entities"])
def _(t: Tables):
    as_of = F.lit(AS_OF).cast(NTZ)
    c = F.col
    return t.entities.select(
        "entity_id", features.is_improving(c("baseline_value"), c("current_value")).alias("is_improving"),
        features.episode_duration_days(c("episode_start_date"), c("episode_end_date"), c("is_ongoing"), as_of)
        .alias("episode_duration_days"),
        F.round(features.rate(c("goals_achieved"), c("goals_total")), 6).alias("goals_achievement_rate"),
        F.round(features.rate(c("records_inserted") + c("records_updated"), c("records_processed"), 100.0), 6)
        .alias("success_rate"),
        F.round(features.processing_rate(c("records_processed"), c("processing_seconds")), 6).alias("processing_rate"),
        F.round(features.eta_minutes(c("status"), c("episode_start_date"), c("progress"), as_of), 4).alias("eta_minutes"))


@query("e28_names", """
SELECT provider_id, f AS full_name, CASE WHEN credentials <> '' THEN f || ', ' || credentials ELSE f END AS display_name
FROM (SELECT *, CASE WHEN provider_type = 'individual' THEN first_name || ' ' || CASE WHEN middle_name <> '' THEN middle_name || ' ' ELSE '' END
  || last_name ELSE name END AS f FROM providers)""", ["providers"])
def _(t: Tables):
    return features.add_names(t.providers).select("provider_id", "full_name", "display_name")


@query("e29_feature_text", """
WITH f AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'age' WHEN 1 THEN 'has_diabetes' WHEN 2 THEN 'systolic_bp' WHEN 3 THEN 'blood_glucose'
  WHEN 4 THEN 'total_hospitalizations_last_year' WHEN 5 THEN 'zip_code' ELSE 'has_kidney_disease' END AS feature FROM part)
SELECT p_partkey, feature, CASE WHEN feature = 'age' THEN 'demographics' WHEN feature LIKE '%has\\_%' ESCAPE '\\' THEN 'medical_history'
  WHEN feature IN ('systolic_bp', 'blood_glucose') THEN 'clinical_measures' WHEN feature LIKE '%hospitalization%' THEN 'utilization' ELSE 'other' END AS feature_category,
  CASE feature WHEN 'age' THEN 'Patient age in years' WHEN 'has_diabetes' THEN 'History of diabetes' WHEN 'systolic_bp' THEN 'Systolic blood pressure'
  WHEN 'blood_glucose' THEN 'Blood Glucose' WHEN 'total_hospitalizations_last_year' THEN 'Total Hospitalizations Last Year'
  WHEN 'zip_code' THEN 'Zip Code' ELSE 'Has Kidney Disease' END AS feature_description FROM f""")
def _(t: Tables):
    names = ("age", "has_diabetes", "systolic_bp", "blood_glucose", "total_hospitalizations_last_year", "zip_code",
             "has_kidney_disease")
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return features.describe_features(t.part.select("p_partkey", pick.alias("feature")))


@query("e30_confidence_interval", """
WITH c AS (SELECT patient_id, ((patient_id * 37) % 100) / 100.0::DOUBLE AS p, 0.1 + (1 - (CASE WHEN COALESCE(age, 0) <> 0 THEN 1 ELSE 0 END
  + CASE WHEN COALESCE(bmi, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN COALESCE(has_diabetes, FALSE) THEN 1 ELSE 0 END
  + CASE WHEN hdl_cholesterol <> 0 THEN 1 ELSE 0 END) / 4.0::DOUBLE) * 0.2 AS u FROM patients)
SELECT patient_id, ROUND(GREATEST(0, p - u), 6) AS confidence_lower, ROUND(LEAST(1, p + u), 6) AS confidence_upper, ROUND(1 - u, 6) AS confidence_score
FROM c""", ["patients"])
def _(t: Tables):
    rows = t.patients.withColumn("risk_score", (F.col("patient_id") * 37 % 100) / 100)
    out = features.add_confidence(rows, ["age", "bmi", "has_diabetes", "hdl_cholesterol"])
    return rounded(out.select("patient_id", "confidence_lower", "confidence_upper", "confidence_score"))


@query("e31_peer_risk_factors", """
WITH c AS (SELECT patient_id, CAST(has_hypertension AS INT) + COALESCE(CAST(has_diabetes AS INT), 0) + CAST(has_heart_disease AS INT)
  + CASE WHEN smoking_status = 'current' THEN 1 ELSE 0 END AS n, CASE WHEN age >= 85 THEN '85_plus' WHEN age >= 75 THEN '75_84'
  WHEN age >= 65 THEN '65_74' WHEN age < 65 THEN 'under_65' ELSE 'unknown' END AS g FROM patients)
SELECT patient_id, n AS patient_risk_factors, ROUND(AVG(n) OVER (PARTITION BY g), 6) AS peer_average,
  CASE WHEN n > AVG(n) OVER (PARTITION BY g) THEN 'above_average' WHEN n < AVG(n) OVER (PARTITION BY g) THEN 'below_average' ELSE 'average' END AS comparison
FROM c""", ["patients"])
def _(t: Tables):
    out = features.peer_risk_factors(t.patients)
    return rounded(out.select("patient_id", "patient_risk_factors", "peer_average", "comparison"))
