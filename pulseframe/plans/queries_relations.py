"""Joins, rankings, versions and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import joins, ranking
from pulseframe.plans.catalog import query
from pulseframe.plans.frames import Tables
from pulseframe.plans.queries_tables import AS_OF, rounded


# -- joins --------------------------------------------------------------------

_MATCH = "a.locationdesc IS NOT DISTINCT FROM b.locationdesc AND a.yearstart IS NOT DISTINCT FROM b.yearstart AND a.topic IS NOT DISTINCT FROM b.topic"


@query("j1_merge_sources", f"""
SELECT a.locationdesc, a.yearstart, a.topic, rows_a, rows_b, a.datavalue, b.datavalue AS datavalue_suppliers FROM source_a a LEFT JOIN source_b b ON {_MATCH}
UNION ALL SELECT b.locationdesc, b.yearstart, b.topic, NULL, rows_b, NULL, b.datavalue FROM source_b b WHERE NOT EXISTS (SELECT 1 FROM source_a a WHERE {_MATCH})""",
       ["source_a", "source_b"])
def _(t: Tables):
    return joins.merge_sources({"customers": t.source_a, "suppliers": t.source_b})


@query("j2_stack_without_common_key", """
SELECT locationdesc, rows_a, NULL AS state, NULL AS code FROM source_a UNION ALL SELECT NULL, NULL, state, code FROM source_c""", ["source_a", "source_c"])
def _(t: Tables):
    return joins.merge_sources({"a": t.source_a.select("locationdesc", "rows_a"), "c": t.source_c.select("state", "code")})


@query("j3_entity_joins", """
SELECT p.patient_id, p.age, x.prediction_id, ROUND(x.risk_score, 6) AS risk_score, m.environment FROM patients p
JOIN predictions x ON p.patient_id = x.patient_id LEFT JOIN versions m ON 'v' || x.user_id = m.version""", ["patients", "predictions", "versions"])
def _(t: Tables):
    scored = t.predictions.select("patient_id", "prediction_id", "risk_score",
                                  F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("version"))
    rows = joins.entity_join(t.patients.select("patient_id", "age"), scored, "patient_id", "inner")
    return rounded(joins.entity_join(rows, t.versions.select("version", "environment"), "version").drop("version"))


@query("j3_patients_with_vitals", """
SELECT p.patient_id, COUNT(v.vital_id) AS vitals, ROUND(AVG(v.heart_rate), 4) AS heart_rate FROM patients p LEFT JOIN vitals v ON p.patient_id = v.patient_id GROUP BY 1""",
       ["patients", "vitals"])
def _(t: Tables):
    # Reduce the many side first: the join then carries one row per patient.
    each = t.vitals.groupBy("patient_id").agg(F.count("vital_id").alias("vitals"), F.avg("heart_rate").alias("heart_rate"))
    rows = joins.entity_join(t.patients.select("patient_id"), each, "patient_id")
    return rows.select("patient_id", F.coalesce("vitals", F.lit(0)).alias("vitals"), F.round("heart_rate", 4).alias("heart_rate"))


@query("j4_apply_feedback", """
WITH o AS (SELECT prediction_id, actual_outcome, outcome_date FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY prediction_id ORDER BY feedback_date DESC, feedback_id DESC) AS rn
    FROM feedback WHERE actual_outcome IS NOT NULL) WHERE rn = 1),
s AS (SELECT prediction_id, provider_rating FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY prediction_id ORDER BY feedback_date DESC, feedback_id DESC) AS rn
    FROM feedback WHERE provider_rating <> 0) WHERE rn = 1)
SELECT p.prediction_id, COALESCE(o.actual_outcome, p.actual_outcome) AS actual_outcome, o.outcome_date, COALESCE(s.provider_rating, p.feedback_score) AS feedback_score
FROM predictions p LEFT JOIN o ON p.prediction_id = o.prediction_id LEFT JOIN s ON p.prediction_id = s.prediction_id""", ["predictions", "feedback"])
def _(t: Tables):
    rows = t.predictions.select("prediction_id", "actual_outcome", "feedback_score", F.lit(None).cast("date").alias("outcome_date"))
    return joins.apply_feedback(rows, t.feedback)


@query("j5_attach_predictions", """
SELECT p.patient_id, ROUND(s.risk_score, 6) AS risk_score, CASE WHEN p.age IS NULL THEN 'Missing fields: age' END AS error FROM patients p
LEFT JOIN (SELECT patient_id, age * 0.01::DOUBLE AS risk_score FROM patients WHERE age IS NOT NULL) s ON p.patient_id = s.patient_id""", ["patients"])
def _(t: Tables):
    """Scores stay on their row: no join back, and rows that cannot be scored carry the reason."""
    known = F.col("age").isNotNull()
    return rounded(t.patients.select("patient_id", F.when(known, F.col("age") * 0.01).alias("risk_score"),
                                     F.when(~known, "Missing fields: age").alias("error")))


@query("j6_latest_vitals", """
SELECT p.patient_id, v.systolic_bp, v.heart_rate, STRFTIME(v.measurement_date, '%Y-%m-%d') AS measured FROM patients p LEFT JOIN
(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient_id ORDER BY measurement_date DESC, vital_id DESC) AS rn FROM vitals) WHERE rn = 1) v
ON p.patient_id = v.patient_id""", ["patients", "vitals"])
def _(t: Tables):
    out = joins.latest_vitals(t.patients.select("patient_id"), t.vitals, ["systolic_bp", "heart_rate"])
    return out.select("patient_id", "systolic_bp", "heart_rate", F.date_format("measurement_date", "yyyy-MM-dd").alias("measured"))


@query("j7_referential_check", """
SELECT feedback_id, prediction_id + 5 AS prediction_id FROM feedback WHERE prediction_id + 5 NOT IN (SELECT prediction_id FROM predictions)""",
       ["feedback", "predictions"])
def _(t: Tables):
    child = t.feedback.select("feedback_id", (F.col("prediction_id") + 5).alias("prediction_id"))
    return joins.referential_check(child, t.predictions, "prediction_id", "prediction_id")


@query("j8_has_feedback", """
SELECT prediction_id, actual_outcome IS NOT NULL AS has_feedback FROM predictions
WHERE prediction_id IN (SELECT prediction_id FROM feedback WHERE feedback_type <> 'note')""", ["predictions", "feedback"])
def _(t: Tables):
    told = t.feedback.where("feedback_type <> 'note'")
    return joins.with_feedback_flag(joins.having_feedback(t.predictions, told)).select("prediction_id", "has_feedback")


@query("j9_outcome_readmission", """
SELECT admission_id, COALESCE(DATE_DIFF('day', admission_date, n) <= 30, FALSE) AS readmitted_30d FROM (
  SELECT patient_id, admission_date, LEAD(admission_date) OVER (PARTITION BY patient_id ORDER BY admission_date, admission_id) AS n, admission_id FROM admissions)""",
       ["admissions"])
def _(t: Tables):
    rows = t.admissions.select("admission_id", "patient_id", "admission_date")
    # Equal days are told apart by the admission id, so order by both.
    keyed = rows.withColumn("at", F.struct("admission_date", "admission_id"))
    from pulseframe.operators import ordered
    month = F.trunc("admission_date", "month")
    found = ordered.next_in_group(keyed, ["patient_id"], "at", month, "following")
    gap = F.datediff(F.col("following.admission_date"), F.col("admission_date"))
    return found.select("admission_id", F.coalesce(gap <= 30, F.lit(False)).alias("readmitted_30d"))


@query("j9_readmission_counts", """
SELECT readmitted_30d, COUNT(*) AS admissions FROM (SELECT COALESCE(DATE_DIFF('day', admission_date, LEAD(admission_date) OVER (PARTITION BY patient_id
  ORDER BY admission_date)) <= 30, FALSE) AS readmitted_30d FROM admissions) GROUP BY 1""", ["admissions"])
def _(t: Tables):
    return joins.readmissions(t.admissions).groupBy("readmitted_30d").agg(F.count(F.lit(1)).alias("admissions"))


@query("j10_current_medications", """
SELECT patient_id, medication_name FROM medications WHERE start_date <= DATE '2000-01-01' AND (end_date IS NULL OR end_date >= DATE '2000-01-01')""", ["medications"])
def _(t: Tables):
    return joins.current_medications(t.medications, F.lit("2000-01-01").cast("date")).select("patient_id", "medication_name")


@query("j10_medications_at_visit", """
SELECT a.admission_id, COUNT(m.medication_name) AS active_medications FROM admissions a LEFT JOIN medications m ON a.patient_id = m.patient_id
  AND m.start_date <= a.admission_date AND (m.end_date IS NULL OR m.end_date >= a.admission_date) GROUP BY 1""", ["admissions", "medications"])
def _(t: Tables):
    visits = t.admissions.select("admission_id", "patient_id", F.col("admission_date").alias("visit_date"))
    return joins.medications_at(visits, t.medications).select("admission_id", "active_medications")


# -- rankings and versions ----------------------------------------------------

@query("w1_paged_history", """
SELECT prediction_id, (SELECT COUNT(*) FROM predictions WHERE risk_category = 'high') AS total_count, 120 < (SELECT COUNT(*) FROM predictions WHERE risk_category = 'high') AS has_more
FROM predictions WHERE risk_category = 'high' ORDER BY created_at DESC, prediction_id DESC LIMIT 100 OFFSET 20""", ["predictions"])
def _(t: Tables):
    """A page is the feature: offset and limit apply after the newest-first order."""
    rows = t.predictions.where("risk_category = 'high'").select("prediction_id", "created_at")
    return ranking.paged_history(rows, limit=100, offset=20).drop("created_at")


@query("w2_latest_completed", """
SELECT source, job_id, records_processed FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY completed_at DESC, job_id DESC) AS rn
FROM sync_jobs WHERE status = 'completed') WHERE rn = 1""", ["sync_jobs"])
def _(t: Tables):
    return ranking.latest_completed(t.sync_jobs).select("source", "job_id", "records_processed")


_METRICS = ("r2_score", "mse", "mae", "accuracy")
_LONG = " UNION ALL ".join(f"SELECT version, '{m}' AS metric, {m} AS value FROM versions WHERE {m} IS NOT NULL" for m in _METRICS)


@query("w3_rank_models", f"""
SELECT version, metric, value, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('r2_score', 'accuracy') THEN -value ELSE value END, version) AS rank
FROM ({_LONG})""", ["versions"])
def _(t: Tables):
    return ranking.rank_models(t.versions, _METRICS)


@query("w4_best_by_metric", f"""
SELECT metric, version, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('mse', 'mae') THEN value ELSE -value END, version) AS rn
FROM ({_LONG})) WHERE rn = 1""", ["versions"])
def _(t: Tables):
    return ranking.best_by_metric(t.versions, _METRICS)


@query("w5_nested_metric", """
SELECT version, ROUND(COALESCE(TRY_CAST(json_extract_string(performance_metrics, '$.validation.r2_score') AS DOUBLE), TRY_CAST(json_extract_string(performance_metrics, '$.training.r2_score') AS DOUBLE),
  TRY_CAST(json_extract_string(performance_metrics, '$.r2_score') AS DOUBLE)), 6) AS r2_score,
  COALESCE(TRY_CAST(json_extract_string(performance_metrics, '$.validation.mse') AS DOUBLE), TRY_CAST(json_extract_string(performance_metrics, '$.mse') AS DOUBLE)) AS mse
FROM versions""", ["versions"])
def _(t: Tables):
    j = F.col("performance_metrics")
    return t.versions.select("version", F.round(ranking.nested_metric(j, "r2_score"), 6).alias("r2_score"),
                             ranking.nested_metric(j, "mse").alias("mse"))


@query("w5_event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def _(t: Tables):
    return t.events.select("event_id", ranking.nested_metric(F.col("props"), "k").alias("k"))


@query("w6_comparison_summary", f"""
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('r2_score', 'accuracy') THEN -value ELSE value END, version) AS rank FROM ({_LONG}))
SELECT (SELECT COUNT(*) FROM versions) AS total_models_compared, MAX(CASE WHEN metric = 'r2_score' AND rank = 1 THEN version END) AS best_overall_model,
  STRING_AGG(CASE WHEN rank = 1 THEN metric || '=' || version END, '; ' ORDER BY metric) AS metric_leaders,
  CONCAT_WS('; ', CASE WHEN MAX(CASE WHEN metric = 'r2_score' THEN value END) - MIN(CASE WHEN metric = 'r2_score' THEN value END) > 0.1 THEN 'significant performance variation' END,
    CASE WHEN MAX(CASE WHEN metric = 'r2_score' THEN value END) < 0.7 THEN 'moderate performance - consider feature engineering'
      WHEN MAX(CASE WHEN metric = 'r2_score' THEN value END) > 0.95 THEN 'very high performance - check for overfitting' END) AS insights FROM r""", ["versions"])
def _(t: Tables):
    return ranking.comparison_summary(ranking.rank_models(t.versions, _METRICS), t.versions.count())


@query("w7_top_features", """
WITH w AS (SELECT 'age' AS feature, REGR_SLOPE(Data_Value, age) AS weight FROM patients UNION ALL SELECT 'bmi', REGR_SLOPE(Data_Value, bmi) FROM patients
  UNION ALL SELECT 'systolic_bp', REGR_SLOPE(Data_Value, systolic_bp) FROM patients UNION ALL SELECT 'hdl_cholesterol', REGR_SLOPE(Data_Value, hdl_cholesterol) FROM patients)
SELECT feature, ROUND(ABS(weight) / SUM(ABS(weight)) OVER (), 6) AS importance FROM w ORDER BY importance DESC LIMIT 3""", ["patients"])
def _(t: Tables):
    """Simple slopes as weights; the report shows the strongest three."""
    names = ("age", "bmi", "systolic_bp", "hdl_cholesterol")
    slopes = t.patients.agg(*[F.regr_slope(F.col("Data_Value"), F.col(c).cast("double")).alias(c) for c in names])
    return rounded(ranking.top_features(slopes.unpivot([], list(names), "feature", "weight"), 3, normalise=True))


@query("w8_previous_version", """
WITH a AS (SELECT model_name, environment, MAX(deployment_date) AS at FROM versions WHERE status = 'active' GROUP BY 1, 2),
r AS (SELECT v.model_name, v.environment, v.version, ROW_NUMBER() OVER (PARTITION BY v.model_name, v.environment ORDER BY v.deployment_date DESC, v.version DESC) AS rn
  FROM versions v JOIN a ON v.model_name = a.model_name AND v.environment = a.environment AND v.deployment_date < a.at)
SELECT model_name, environment, version FROM r WHERE rn = 1""", ["versions"])
def _(t: Tables):
    return ranking.previous_version(t.versions).select("model_name", "environment", "version")


@query("w9_retention_overall", """
SELECT version FROM (SELECT version, deployment_date, ROW_NUMBER() OVER (ORDER BY deployment_date DESC, version DESC) AS rn FROM versions)
WHERE rn > 20 OR deployment_date < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY""", ["versions"])
def _(t: Tables):
    return ranking.retention_selection(t.versions, 20, "deployment_date", "version", older_than_days=1,
                                       as_of=F.lit(AS_OF).cast("timestamp_ntz")).select("version")


@query("w9_retention_per_model", """
SELECT model_name, version FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_name ORDER BY deployment_date DESC, version DESC) AS rn FROM versions)
WHERE rn > 5 AND status <> 'active'""", ["versions"])
def _(t: Tables):
    return ranking.retention_selection(t.versions, 5, "deployment_date", "version", ["model_name"], protect_active=True).select(
        "model_name", "version")


@query("w10_recent_degradation", """
SELECT model_name, version, STRFTIME(measured_at, '%Y-%m-%d') AS day, ROUND(recent, 6) AS recent_average, n > 1 AND metric_value < recent * 0.95 AS degraded
FROM (SELECT *, AVG(metric_value) OVER w AS recent, COUNT(*) OVER w AS n FROM metric_rows
  WINDOW w AS (PARTITION BY model_name, version ORDER BY measured_at RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW))""", ["metric_rows"])
def _(t: Tables):
    out = ranking.recent_degradation(t.metric_rows, ts="measured_at")
    return out.select("model_name", "version", F.date_format("measured_at", "yyyy-MM-dd").alias("day"),
                      F.round("recent_average", 6).alias("recent_average"), "degraded")


@query("w11_union_sources", """
SELECT locationdesc, yearstart, rows_a, NULL AS rows_b FROM source_a UNION ALL SELECT locationdesc, yearstart, NULL, rows_b FROM source_b""", ["source_a", "source_b"])
def _(t: Tables):
    return joins.union_sources([t.source_a.drop("topic", "datavalue"), t.source_b.drop("topic", "datavalue")])


@query("w12_common_columns", """
SELECT 'locationdesc' AS column_name, COUNT(DISTINCT locationdesc) AS shared_values FROM source_a WHERE locationdesc IN (SELECT locationdesc FROM source_b)
UNION ALL SELECT 'yearstart', COUNT(DISTINCT yearstart) FROM source_a WHERE yearstart IN (SELECT yearstart FROM source_b)
UNION ALL SELECT 'topic', COUNT(DISTINCT topic) FROM source_a WHERE topic IN (SELECT topic FROM source_b)""", ["source_a", "source_b"])
def _(t: Tables):
    """The shared keys, with the number of values they have in common."""
    keys = joins.common_columns({"a": t.source_a, "b": t.source_b})
    out = None
    for k in keys:
        one = t.source_a.select(k).distinct().join(t.source_b.select(k), k, "left_semi").agg(
            F.lit(k).alias("column_name"), F.count(k).alias("shared_values"))
        out = one if out is None else out.unionByName(one)
    return out


@query("w13_list_versions", """
SELECT model_name, version, status = 'active' AS is_active, CAST(json_extract_string(flat, '$.r2') AS DOUBLE) AS r2
FROM (SELECT *, '{{"r2": ' || '0.' || LPAD(CAST(CAST(ROUND(r2_score * 1000) AS INT) AS VARCHAR), 3, '0') || '}}' AS flat FROM versions) WHERE environment = 'production'"""
       .replace("{{", "{").replace("}}", "}"), ["versions"])
def _(t: Tables):
    flat = F.format_string('{"r2": %.3f}', F.col("r2_score"))
    rows = ranking.list_versions(t.versions.withColumn("performance_metrics", flat), "production")
    return rows.select("model_name", "version", "is_active", F.col("metrics")["r2"].alias("r2"))


@query("w14_model_performance", """
SELECT version, COALESCE(TRY_CAST(json_extract_string(performance_metrics, '$.validation.r2_score') AS DOUBLE), 0) AS r2_score,
  COALESCE(TRY_CAST(json_extract_string(performance_metrics, '$.validation.mse') AS DOUBLE), 0) AS mse_score,
  COALESCE(TRY_CAST(json_extract_string(performance_metrics, '$.validation.mae') AS DOUBLE), 0) AS mae_score,
  ROUND(SQRT(COALESCE(TRY_CAST(json_extract_string(performance_metrics, '$.validation.mse') AS DOUBLE), 0)), 6) AS rmse_score FROM versions""", ["versions"])
def _(t: Tables):
    return rounded(ranking.model_performance_lookup(t.versions))
