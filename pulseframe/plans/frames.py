"""Domain tables derived from the given tables.

One SQL text per table, in the dialect both engines share, so a query and its
check start from the same rows. ``{name}`` stands for a given or derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")

FRAMES: dict[str, str] = {}

FRAMES["patients"] = """
SELECT o_orderkey AS patient_id,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(18 + (o_orderkey * 7) % 100 AS INT) END AS age,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'male' WHEN o_orderkey % 4 = 1 THEN 'female'
       WHEN o_orderkey % 28 = 2 THEN 'm?' WHEN o_orderkey % 4 = 2 THEN 'other' ELSE 'unknown' END AS gender,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'hispanic' ELSE 'other' END AS race_ethnicity,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'CA' ELSE 'NY' END AS state_code,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(10000 + o_orderkey % 80000 AS STRING) END AS zip_code,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'never' WHEN o_orderkey % 3 = 1 THEN 'former'
       ELSE 'current' END AS smoking_status,
  (o_orderkey % 3 = 0) AS has_hypertension,
  CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE (o_orderkey % 5 = 0) END AS has_diabetes,
  (o_orderkey % 7 = 0) AS has_heart_disease,
  (o_orderkey % 11 = 0) AS has_stroke_history,
  (o_orderkey % 13 = 0) AS has_heart_attack_history,
  (o_orderkey % 17 = 0) AS has_atrial_fibrillation,
  (o_orderkey % 19 = 0) AS has_heart_failure,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(90 + (o_orderkey * 13) % 120 AS INT) END AS systolic_bp,
  CAST(50 + (o_orderkey * 11) % 70 AS INT) AS diastolic_bp,
  CAST(150 + (o_orderkey * 3) % 50 AS INT) AS height_cm,
  CAST(45 + (o_orderkey * 17) % 90 AS INT) AS weight_kg,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE 9 + CAST((o_orderkey * 17) % 450 AS DOUBLE) / 10 END AS bmi,
  CAST(120 + (o_orderkey * 19) % 200 AS DOUBLE) AS total_cholesterol,
  CASE WHEN o_orderkey % 37 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(20 + (o_orderkey * 23) % 80 AS DOUBLE) END AS hdl_cholesterol,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(60 + (o_orderkey * 29) % 200 AS DOUBLE) END AS blood_glucose,
  CASE WHEN o_orderkey % 25 <> 0 THEN NULL ELSE CAST(4 + o_orderkey % 6 AS DOUBLE) END AS hba1c,
  CAST(o_orderkey % 4 AS INT) AS cardiovascular_hospitalizations_last_year,
  CAST(o_orderkey % 6 AS INT) AS total_hospitalizations_last_year,
  CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_totalprice / 40 END AS Data_Value,
  o_orderdate AS record_date
FROM {orders}"""

# Records of the administrative tables: each column takes values inside and outside its limits, and nulls.
_RANGES = {
    "risk_score": 1, "star_rating": 5, "patient_satisfaction_score": 100, "annual_cv_cases": 40, "satisfaction_rating": 5,
    "communication_rating": 5, "total_visits": 30, "progress_percentage": 100, "records_received": 900, "records_processed": 800,
    "input_records_count": 700, "output_records_count": 600, "total_records": 500, "processed_records": 400,
    "successful_predictions": 300, "failed_predictions": 20, "r2_score": 1, "total_predictions": 250, "correct_predictions": 200,
    "mse_score": 3, "mae_score": 2, "training_data_size": 1000, "severity_score": 5, "length_of_stay_days": 14, "data_completeness": 1,
    "total_cost": 9000, "care_coordination_score": 1, "admission_risk_score": 1, "number_of_encounters": 9, "goals_achieved": 6,
    "goals_total": 7, "data_completeness_score": 1, "confidence_score": 1, "usage_count": 50,
}
_KINDS = {
    "risk_level": "low moderate high severe none", "severity": "mild moderate severe fatal", "confidence_level": "definite probable possible sure",
    "provider_type": "individual organization group", "relationship_type": "primary_care specialist consulting emergency family",
    "care_level": "primary secondary tertiary home", "status": "queued running completed failed cancelled training active deprecated",
    "sync_type": "full incremental validation partial", "job_type": "validation cleaning transformation feature_engineering export",
    "job_status": "queued running completed failed cancelled lost", "urgency_level": "routine urgent emergent elective",
    "episode_type": "acute chronic preventive follow_up other", "processing_status": "uploaded processing processed failed unknown",
}


def _spread_values(i: int, top: float) -> str:
    at = f"(o_orderkey * {2 * i + 7} + {i}) % 1000"
    return f"CASE WHEN o_orderkey % {i + 13} = 0 THEN NULL ELSE (CAST({at} AS DOUBLE) - 40) * {top * 1.1 / 960!r} END"


def _spread_kinds(i: int, names: str) -> str:
    kinds = names.split()
    cases = " ".join(f"WHEN (o_orderkey + {i}) % {len(kinds) + 1} = {k} THEN '{n}'" for k, n in enumerate(kinds))
    return f"CASE {cases} END"


FRAMES["records"] = "SELECT o_orderkey AS record_id, " + ",\n  ".join(
    [f"{_spread_values(i, top)} AS {c}" for i, (c, top) in enumerate(_RANGES.items())]
    + [f"{_spread_kinds(i, names)} AS {c}" for i, (c, names) in enumerate(_KINDS.items())]) + "\nFROM {orders}"

FRAMES["survey"] = """
SELECT sid, Age, Sex, BMI, Smoking, HighBP, HighChol, Diabetes, PhysActivity, HvyAlcoholConsump, PhysHlth, MentHlth,
  NoDocbcCost, GenHlth, Education,
  CASE WHEN (CASE WHEN Age > 60 THEN 30 ELSE 0 END) + Smoking * 20 + HighBP * 15 + Diabetes * 10 + noise >= 55
       THEN 1 ELSE 0 END AS HeartDisease
FROM (SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
    || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING) AS sid,
  CAST(18 + (l_partkey * 7 + l_orderkey) % 82 AS INT) AS Age,
  CASE WHEN (l_partkey + l_linenumber) % 2 = 0 THEN 'Male' ELSE 'Female' END AS Sex,
  16 + CAST((l_partkey * 13 + l_linenumber * 7) % 280 AS DOUBLE) / 10 AS BMI,
  CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS Smoking,
  CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS HighBP,
  CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS HighChol,
  CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS Diabetes,
  CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS PhysActivity,
  CASE WHEN l_partkey % 20 = 0 THEN 1 ELSE 0 END AS HvyAlcoholConsump,
  CAST((l_partkey * 3) % 31 AS INT) AS PhysHlth,
  CAST((l_orderkey * 5) % 31 AS INT) AS MentHlth,
  CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS NoDocbcCost,
  CASE l_partkey % 6 WHEN 0 THEN 'Good' WHEN 1 THEN 'Excellent' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Poor'
       WHEN 4 THEN 'Very good' ELSE 'Refused' END AS GenHlth,
  CASE l_suppkey % 3 WHEN 0 THEN 'School' WHEN 1 THEN 'College' ELSE 'Graduate' END AS Education,
  CAST((l_orderkey * 31 + l_partkey * 17) % 40 AS INT) AS noise
FROM {lineitem}) s"""

FRAMES["survey_gaps"] = """
SELECT sid,
  CASE WHEN Age % 17 = 0 THEN NULL ELSE Age END AS Age,
  CASE WHEN MentHlth = 7 THEN NULL ELSE Sex END AS Sex,
  CASE WHEN PhysHlth = 5 THEN NULL WHEN Age = 40 THEN 80.0 ELSE BMI END AS BMI,
  CASE WHEN PhysHlth = 9 THEN NULL ELSE Smoking END AS Smoking,
  HighBP, HighChol, Diabetes, PhysActivity, HvyAlcoholConsump,
  CASE WHEN Age = 33 THEN NULL ELSE PhysHlth * PhysHlth * PhysHlth * PhysHlth END AS PhysHlth,
  MentHlth,
  CASE WHEN MentHlth = 11 THEN NULL ELSE GenHlth END AS GenHlth,
  CASE WHEN Age <> 50 THEN NULL ELSE Education END AS Education,
  HeartDisease
FROM {survey}"""

FRAMES["predictions"] = """
SELECT prediction_id, created_at, user_id, patient_id, model_version, risk_score, age, gender, age_group,
  CASE WHEN risk_score < 0.3 THEN 'low' WHEN risk_score < 0.7 THEN 'medium' ELSE 'high' END AS risk_category,
  CASE WHEN prediction_id % 7 = 0 THEN NULL
       ELSE (CAST((prediction_id * 31) % 100 AS DOUBLE) < risk_score * 80 + 10) END AS actual_outcome,
  CASE WHEN prediction_id % 5 = 0 THEN CAST(prediction_id % 7 AS INT) ELSE NULL END AS feedback_score,
  CASE WHEN prediction_id % 101 = 0 THEN 'other' WHEN prediction_id % 3 = 0 THEN 'single'
       WHEN prediction_id % 3 = 1 THEN 'batch' ELSE 'csv' END AS prediction_type
FROM (SELECT event_id AS prediction_id, ts AS created_at, user_id, user_id AS patient_id,
  'v' || CAST(user_id % 3 AS STRING) AS model_version,
  CASE WHEN value > 150 THEN CAST(1 AS DOUBLE) ELSE value / 150 END AS risk_score,
  CAST(18 + (event_id * 7) % 80 AS INT) AS age,
  CASE WHEN event_id % 9 = 0 THEN 'unknown' WHEN event_id % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
  CASE WHEN (event_id * 7) % 80 < 47 THEN 'under_65' WHEN (event_id * 7) % 80 < 57 THEN '65_74'
       WHEN (event_id * 7) % 80 < 67 THEN '75_84' ELSE '85_plus' END AS age_group
  FROM {events}) e"""

FRAMES["scored"] = """
SELECT prediction_id, created_at, model_version, gender, age_group, risk_score AS score,
  CASE WHEN actual_outcome THEN 1 ELSE 0 END AS label,
  CASE WHEN risk_score >= 0.5 THEN 1 ELSE 0 END AS predicted
FROM {predictions} WHERE actual_outcome IS NOT NULL"""

FRAMES["fitted"] = """
SELECT prediction_id, risk_score AS actual,
  risk_score * 0.8 + CAST((prediction_id * 13) % 100 AS DOUBLE) / 500 AS predicted,
  CAST(1 + prediction_id % 3 AS DOUBLE) AS weight
FROM {predictions}"""

FRAMES["feedback"] = """
SELECT event_id AS feedback_id, event_id - event_id % 3 AS prediction_id, ts AS feedback_date,
  CASE event_id % 4 WHEN 0 THEN 'outcome' WHEN 1 THEN 'rating' WHEN 2 THEN 'correction' ELSE 'note' END AS feedback_type,
  CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 4 = 0 THEN (event_id % 12 = 0) ELSE NULL END AS actual_outcome,
  CASE WHEN event_id % 4 = 0 THEN CAST(ts AS DATE) ELSE NULL END AS outcome_date,
  CASE WHEN event_id % 20 = 1 THEN NULL WHEN event_id % 4 = 1 THEN CAST(event_id % 7 AS INT) ELSE NULL END AS provider_rating,
  CASE WHEN event_id % 8 = 2 THEN value / 400 ELSE NULL END AS corrected_risk_score,
  CASE WHEN event_id % 12 = 6 THEN 'high' ELSE NULL END AS corrected_risk_category
FROM {events}"""

FRAMES["extract"] = """
SELECT c_custkey AS RowId,
  CASE c_custkey % 11 WHEN 0 THEN ' united states ' WHEN 1 THEN 'usa' WHEN 2 THEN 'N/A' WHEN 3 THEN ''
    WHEN 4 THEN NULL WHEN 5 THEN 'UNKNOWN' ELSE '  Nation ' || CAST(c_nationkey AS STRING) || ' ' END AS LocationDesc,
  CASE WHEN c_custkey % 13 = 0 THEN 'none' ELSE 'n' || CAST(c_nationkey AS STRING) END AS LocationAbbr,
  CASE WHEN c_custkey % 19 = 0 THEN 'unk' ELSE CAST(2010 + c_custkey % 9 AS STRING) END AS YearStart,
  c_mktsegment AS Topic,
  CASE WHEN c_custkey % 2 = 0 THEN 'Heart Disease' ELSE 'heart disease' END AS Question,
  CASE WHEN c_custkey % 17 = 0 THEN 'n.a.' ELSE CAST(CAST(FLOOR(c_acctbal) AS INT) AS STRING) END AS Reading,
  CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN 900.5 ELSE c_acctbal / 100 END AS Data_Value,
  CASE c_custkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Unknown' ELSE 'Overall' END AS Break_Out,
  CAST(NULL AS STRING) AS Footnote
FROM {customer}"""

FRAMES["source_a"] = """
SELECT CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE 'NATION ' || CAST(c_nationkey AS STRING) END AS locationdesc,
  CAST(2010 + c_custkey % 9 AS INT) AS yearstart, c_mktsegment AS topic,
  COUNT(*) AS rows_a, ROUND(SUM(c_acctbal), 2) AS datavalue
FROM {customer} GROUP BY 1, 2, 3"""

FRAMES["source_b"] = """
SELECT CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE 'NATION ' || CAST(s_nationkey AS STRING) END AS locationdesc,
  CAST(2010 + s_suppkey % 12 AS INT) AS yearstart,
  CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'DIABETES' END AS topic,
  COUNT(*) AS rows_b, ROUND(SUM(s_acctbal), 2) AS datavalue
FROM {supplier} GROUP BY 1, 2, 3"""

FRAMES["source_c"] = """
SELECT n_name AS state, r_name AS area, n_nationkey AS code FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""

FRAMES["vitals"] = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING)
    || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING) AS vital_id,
  l_orderkey AS patient_id, l_shipdate AS measurement_date,
  CAST(80 + l_partkey % 150 AS INT) AS systolic_bp, CAST(25 + l_suppkey % 100 AS INT) AS diastolic_bp,
  CAST(40 + (l_partkey * 3) % 190 AS INT) AS heart_rate, CAST(60 + l_partkey % 45 AS DOUBLE) AS oxygen_saturation,
  CAST(60 + (l_partkey * 7) % 460 AS DOUBLE) AS total_cholesterol,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice / 150 END AS blood_glucose,
  CAST(2 + l_linenumber * 2 AS DOUBLE) AS hba1c
FROM {lineitem}"""

FRAMES["medications"] = """
SELECT l_orderkey AS patient_id, 'med' || CAST(l_partkey AS STRING) AS medication_name,
  CAST(l_shipdate AS DATE) AS start_date,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) * 10 END AS end_date,
  CAST(l_partkey % 120 AS DOUBLE) AS adherence_percentage, CAST(l_linenumber AS INT) AS effectiveness_rating
FROM {lineitem}"""

FRAMES["admissions"] = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING)
    || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING) AS admission_id,
  l_orderkey AS patient_id, CAST(l_shipdate AS DATE) AS admission_date, l_extendedprice AS total_cost
FROM {lineitem}"""

FRAMES["versions"] = """
SELECT 'm' || CAST(user_id % 4 AS STRING) AS model_name, 'v' || CAST(user_id AS STRING) AS version,
  CASE WHEN user_id % 3 = 0 THEN 'staging' ELSE 'production' END AS environment,
  CASE WHEN user_id % 5 = 0 THEN 'active' ELSE 'inactive' END AS status,
  MAX(ts) AS deployment_date,
  CAST(SUM(event_id) % 1000 AS DOUBLE) / 1000 AS r2_score,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE CAST(SUM(event_id * 7) % 2000000 AS DOUBLE) END AS mse,
  CAST(SUM(event_id * 3) % 500 AS DOUBLE) / 10 AS mae,
  CAST(600 + SUM(event_id * 13) % 400 AS DOUBLE) / 1000 AS accuracy,
  CAST(600 + SUM(event_id * 17) % 400 AS DOUBLE) / 1000 AS precision_score,
  CASE WHEN user_id % 4 = 0
    THEN '{{"validation": {{"r2_score": 0.' || LPAD(CAST(SUM(event_id) % 1000 AS STRING), 3, '0') || ', "mse": '
      || CAST(SUM(event_id * 7) % 900 AS STRING) || '}}}}'
    WHEN user_id % 4 = 1 THEN '{{"training": {{"r2_score": 0.25}}, "mse": 4}}'
    ELSE '{{"r2_score": 0.5, "validation": {{"mae": 2}}}}' END AS performance_metrics
FROM {events} GROUP BY user_id"""

FRAMES["metric_rows"] = """
SELECT 'm' || CAST(user_id % 4 AS STRING) AS model_name, 'v' || CAST(user_id % 8 AS STRING) AS version,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) AS measured_at, 'accuracy' AS metric_name,
  CAST(500 + SUM(event_id * 7) % 500 AS DOUBLE) / 1000 AS metric_value
FROM {events} GROUP BY 1, 2, 3"""

FRAMES["sync_jobs"] = """
SELECT event_id AS job_id, event_type AS source, ts AS completed_at,
  CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS status,
  CAST(event_id % 50 AS INT) AS records_processed, CAST(event_id % 20 AS INT) AS records_inserted,
  CAST(event_id % 11 AS INT) AS records_updated
FROM {events}"""

FRAMES["requests"] = """
SELECT event_id AS request_id, ts,
  CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method,
  '/' || event_type AS endpoint,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 8 = 0 THEN 404 ELSE 200 END AS status_code,
  value * 25 AS response_time_ms
FROM {events}"""

FRAMES["datasets"] = """
SELECT o_orderkey AS dataset_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'training' WHEN 1 THEN 'validation' ELSE 'test' END AS dataset_type,
  CAST(FLOOR(o_totalprice) AS BIGINT) AS total_records, CAST(5 + o_orderkey % 40 AS INT) AS total_columns,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(FLOOR(o_totalprice) AS BIGINT) * 900 END AS file_size_bytes,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS completeness_score,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(FLOOR(o_totalprice) AS BIGINT) % 5000 END AS missing_values_count,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(FLOOR(o_totalprice) AS BIGINT) % 300 END AS duplicate_records_count,
  CASE o_orderkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'pending' END AS validation_status,
  o_orderdate AS created_at
FROM {orders}"""

FRAMES["entities"] = """
SELECT o_orderkey AS entity_id,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS baseline_value,
  CAST((o_orderkey * 7) % 100 AS DOUBLE) AS current_value,
  o_orderdate AS episode_start_date,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + (o_orderkey % 40) * INTERVAL 1 DAY END AS episode_end_date,
  (o_orderkey % 2 = 0) AS is_ongoing,
  CAST(o_orderkey % 5 AS INT) AS goals_total, CAST(o_orderkey % 3 AS INT) AS goals_achieved,
  CAST(o_orderkey % 50 AS INT) AS records_processed, CAST(o_orderkey % 20 AS INT) AS records_inserted,
  CAST(o_orderkey % 11 AS INT) AS records_updated,
  CAST(o_orderkey % 13 AS DOUBLE) AS processing_seconds,
  CASE WHEN o_orderkey % 4 = 0 THEN 'running' ELSE 'completed' END AS status,
  CAST(o_orderkey % 101 AS DOUBLE) AS progress
FROM {orders}"""

FRAMES["providers"] = """
SELECT s_suppkey AS provider_id, CASE WHEN s_suppkey % 3 = 0 THEN 'organization' ELSE 'individual' END AS provider_type,
  s_name AS name, 'First' || CAST(s_suppkey % 7 AS STRING) AS first_name,
  CASE WHEN s_suppkey % 2 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN '' ELSE 'M.' END AS middle_name,
  'Last' || CAST(s_suppkey AS STRING) AS last_name,
  CASE WHEN s_suppkey % 4 = 0 THEN 'MD' WHEN s_suppkey % 4 = 1 THEN '' ELSE NULL END AS credentials
FROM {supplier}"""

FRAMES["copies"] = """
SELECT c_nationkey AS place, c_mktsegment AS topic, CAST(c_custkey % 9 AS INT) AS yearstart,
  CAST(c_custkey % 4 AS INT) AS reading FROM {customer}"""

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def needs(sql: str) -> list[str]:
    """Names of the tables a text reads, in order of first use."""
    return list(dict.fromkeys(_NAME.findall(sql)))


def all_frames(names) -> list[str]:
    """The derived tables needed for ``names``, each after those it reads."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in out:
            return
        for n in needs(FRAMES[name]):
            visit(n)
        out.append(name)

    for n in names:
        visit(n)
    return out


def check_ctes(names) -> str:
    """The derived tables as the head of a WITH clause."""
    parts = [f"{n} AS ({FRAMES[n].format(**{t: t for t in needs(FRAMES[n])})})" for n in all_frames(names)]
    return ",\n".join(parts)


class Tables:
    """Given and derived tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in FRAMES:
            sql = FRAMES[name]
            return self.spark.sql(sql, **{t: getattr(self, t) for t in needs(sql)})
        raise AttributeError(name)
