"""Sources, sinks and whole-table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import cleaning, quality, stats
from pulseframe.plans import jobs
from pulseframe.plans.catalog import query
from pulseframe.plans.frames import Tables
from pulseframe.session import work_dir
from pulseframe.sources import io

AS_OF = "2024-01-31 00:00:00"


def rounded(df, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float")})


def _folder(t: Tables, name: str) -> str:
    return work_dir(t.spark, name)


@query("s1_read_table", "SELECT c_custkey, c_name, c_nationkey, ROUND(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def _(t: Tables):
    """CSV and JSON copies read by suffix; the halves come from different formats."""
    base = _folder(t, "read")
    rows = t.customer
    rows.where("c_nationkey < 12").write.option("header", True).csv(f"{base}/part.csv")
    rows.where("c_nationkey >= 12").write.json(f"{base}/part.json")
    both = io.read_table(t.spark, f"{base}/part.csv", rows.schema).unionByName(
        io.read_table(t.spark, f"{base}/part.json", rows.schema))
    return rounded(both, 2)


@query("s2_read_extract_csv", """
SELECT RowId, YearStart, Topic, TRY_CAST(Reading AS DOUBLE) AS Reading FROM extract""", ["extract"])
def _(t: Tables):
    base = _folder(t, "extract")
    t.extract.select("RowId", "YearStart", "Topic", "Reading").write.option("header", True).csv(base)
    schema = t.spark.createDataFrame([], "RowId long, YearStart string, Topic string, Reading double").schema
    # Unreadable numbers come back as null and their line is kept in the corrupt-record column.
    return io.read_extract_csv(t.spark, base, schema).select("RowId", "YearStart", "Topic", "Reading")


@query("s3_latest_version", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 365 DAY""")
def _(t: Tables):
    base = _folder(t, "versions")
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    orders.select("o_orderkey", "o_orderstatus").write.parquet(f"{base}/version=20240101")
    top = orders.agg(F.max("o_orderdate")).first()[0]
    recent = orders.where(F.col("o_orderdate") >= F.lit(top) - F.expr("INTERVAL 365 DAY"))
    recent.select("o_orderkey", "o_orderstatus").write.parquet(f"{base}/version=20240201")
    return io.latest_version(t.spark, base)


@query("s4_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def _(t: Tables):
    """The first hundred rows are the feature here."""
    rows, _ = io.preview(t.customer, order=["c_custkey"])
    return rows


@query("s5_write_dual", """
SELECT s_suppkey, s_name, ROUND(s_acctbal, 2) AS s_acctbal, fmt FROM supplier, (VALUES ('csv'), ('parquet')) f(fmt)""")
def _(t: Tables):
    base = _folder(t, "dual")
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    paths = io.write_dual(rows, base, "supplier", "20240131")
    a = io.latest_version(t.spark, paths["parquet"]).withColumn("fmt", F.lit("parquet"))
    b = io.latest_version(t.spark, paths["csv"], "csv").select(
        F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"),
        F.lit("csv").alias("fmt"))
    return rounded(a.unionByName(b), 2)


@query("s6_export_dataset", "SELECT p_partkey, p_brand, p_size FROM part")
def _(t: Tables):
    path = f"{_folder(t, 'export')}/part.json"
    rows = t.part.select("p_partkey", "p_brand", "p_size")
    io.export_dataset(rows, path, "json", {"name": "part", "exported_at": AS_OF})
    return io.read_table(t.spark, path, rows.schema)


@query("s7_save_dataset", """
SELECT COUNT(*) AS total_rows, 27 AS total_columns,
  SUM(CASE WHEN age IS NULL THEN 1 ELSE 0 END + CASE WHEN gender IS NULL THEN 1 ELSE 0 END
    + CASE WHEN race_ethnicity IS NULL THEN 1 ELSE 0 END + CASE WHEN state_code IS NULL THEN 1 ELSE 0 END
    + CASE WHEN smoking_status IS NULL THEN 1 ELSE 0 END + CASE WHEN has_diabetes IS NULL THEN 1 ELSE 0 END
    + CASE WHEN systolic_bp IS NULL THEN 1 ELSE 0 END + CASE WHEN bmi IS NULL THEN 1 ELSE 0 END
    + CASE WHEN blood_glucose IS NULL THEN 1 ELSE 0 END + CASE WHEN hba1c IS NULL THEN 1 ELSE 0 END
    + CASE WHEN Data_Value IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_values,
  0::BIGINT AS duplicate_rows, strftime(MIN(record_date), '%Y-%m-%d') AS start_date,
  strftime(MAX(record_date), '%Y-%m-%d') AS end_date, 'training' AS dataset_type
FROM patients""", ["patients"])
def _(t: Tables):
    row = io.save_dataset(t.patients, _folder(t, "datasets"), "patients", "1", "training", AS_OF)
    return row.select("total_rows", "total_columns", "missing_values", "duplicate_rows", "start_date", "end_date",
                      "dataset_type")


@query("s8_store_predictions", """
SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS stored, ROUND(SUM(risk_score), 4) AS score_sum
FROM predictions GROUP BY 1""", ["predictions"])
def _(t: Tables):
    base = _folder(t, "store")
    rows = t.predictions.select("prediction_id", "created_at", "risk_score", "risk_category", "model_version")
    io.store_predictions(rows, base, "batch-1", AS_OF)
    return t.spark.read.parquet(f"{base}/predictions").groupBy("date").agg(
        F.count(F.lit(1)).alias("stored"), F.round(F.sum("risk_score"), 4).alias("score_sum"))


@query("s9_source_freshness", """
WITH s AS (SELECT user_id AS source_id, CASE user_id % 6 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly'
    WHEN 3 THEN 'quarterly' WHEN 4 THEN 'yearly' ELSE 'sometimes' END AS frequency,
  CASE WHEN user_id % 10 = 9 THEN NULL ELSE MIN(ts) END AS last_updated FROM events GROUP BY user_id)
SELECT source_id, frequency, last_updated IS NULL OR TIMESTAMP '2024-01-31 00:00:00' - last_updated >
  (CASE frequency WHEN 'daily' THEN 1 WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 90
   WHEN 'yearly' THEN 365 ELSE 30 END) * INTERVAL 1 DAY AS due FROM s""")
def _(t: Tables):
    names = ("daily", "weekly", "monthly", "quarterly", "yearly", "sometimes")
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % 6 + 1).cast("int"))
    sources = t.events.groupBy("user_id").agg(F.min("ts").alias("m")).select(
        F.col("user_id").alias("source_id"), pick.alias("frequency"),
        F.when(F.col("user_id") % 10 != 9, F.col("m")).alias("last_updated"))
    return io.source_freshness(sources, F.lit(AS_OF).cast("timestamp_ntz")).select("source_id", "frequency", "due")


@query("s10_content_fingerprint", """
WITH h AS (SELECT CAST('0x' || SUBSTR(MD5(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority), 1, 15) AS BIGINT) AS h
  FROM orders)
SELECT COUNT(*) AS rows, BIT_XOR(h) AS xor_hash, SUM(h % 1000003)::BIGINT AS sum_hash FROM h""")
def _(t: Tables):
    return io.content_checksum(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("s10_content_fingerprint_fast")
def _(t: Tables):
    """The form used in jobs: Spark's own 64-bit hash, one aggregate."""
    return io.content_fingerprint(t.lineitem)


@query("s11_version_retention", """
SELECT model_name AS name, version FROM (SELECT model_name, version, ROW_NUMBER() OVER (PARTITION BY model_name
  ORDER BY deployment_date DESC, version DESC) AS rn FROM versions) WHERE rn > 5""", ["versions"])
def _(t: Tables):
    stored = t.versions.select(F.col("model_name").alias("name"), "version", F.col("deployment_date").alias("stored_at"))
    return io.version_retention(stored).select("name", "version")


@query("s12_ingest_job")
def _(t: Tables):
    """Clean, merge and store three extracts; one summary row per source."""
    sources = {"customers": t.source_a, "suppliers": t.source_b, "survey_extract": t.extract}
    _, summary = jobs.ingest_job(sources, _folder(t, "ingest"), AS_OF)
    return summary


@query("s13_sync_window", """
SELECT prediction_id FROM predictions WHERE created_at >= TIMESTAMP '2024-01-21 00:00:00'
  AND created_at <= TIMESTAMP '2024-01-31 00:00:00' AND created_at > TIMESTAMP '2024-01-25 12:00:00'""", ["predictions"])
def _(t: Tables):
    after = F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")
    return io.sync_window(t.predictions, "created_at", F.lit(AS_OF), 10, after).select("prediction_id")


# -- whole-table cleaning and processing --------------------------------------

@query("c25_process_dataset", """
WITH d AS (SELECT DISTINCT patient_id, age, gender, has_diabetes, has_hypertension, systolic_bp, diastolic_bp,
    total_cholesterol, hdl_cholesterol, Data_Value FROM patients),
g AS (SELECT gender AS mode_gender FROM d WHERE gender IS NOT NULL GROUP BY gender ORDER BY COUNT(*) DESC, gender LIMIT 1),
m AS (SELECT quantile_cont(age, 0.5) AS a, quantile_cont(systolic_bp, 0.5) AS s, quantile_cont(Data_Value, 0.5) AS v FROM d),
f AS (SELECT patient_id, COALESCE(age::DOUBLE, a) AS age, COALESCE(gender, mode_gender) AS gender,
    COALESCE(has_diabetes, FALSE) AS has_diabetes, has_hypertension, COALESCE(systolic_bp::DOUBLE, s) AS systolic_bp,
    diastolic_bp, total_cholesterol, hdl_cholesterol, COALESCE(Data_Value, v) AS Data_Value FROM d, m, g),
q AS (SELECT quantile_cont(age, 0.25) AS a1, quantile_cont(age, 0.75) AS a3, quantile_cont(systolic_bp, 0.25) AS s1,
    quantile_cont(systolic_bp, 0.75) AS s3, quantile_cont(diastolic_bp, 0.25) AS d1, quantile_cont(diastolic_bp, 0.75) AS d3,
    quantile_cont(total_cholesterol, 0.25) AS t1, quantile_cont(total_cholesterol, 0.75) AS t3,
    quantile_cont(hdl_cholesterol, 0.25) AS h1, quantile_cont(hdl_cholesterol, 0.75) AS h3,
    quantile_cont(patient_id, 0.25) AS p1, quantile_cont(patient_id, 0.75) AS p3 FROM f),
k AS (SELECT LEAST(GREATEST(patient_id, p1 - 1.5 * (p3 - p1)), p3 + 1.5 * (p3 - p1)) AS patient_id,
    LEAST(GREATEST(age, a1 - 1.5 * (a3 - a1)), a3 + 1.5 * (a3 - a1)) AS age, gender, has_diabetes, has_hypertension,
    LEAST(GREATEST(systolic_bp, s1 - 1.5 * (s3 - s1)), s3 + 1.5 * (s3 - s1)) AS systolic_bp,
    LEAST(GREATEST(diastolic_bp, d1 - 1.5 * (d3 - d1)), d3 + 1.5 * (d3 - d1)) AS diastolic_bp,
    LEAST(GREATEST(total_cholesterol, t1 - 1.5 * (t3 - t1)), t3 + 1.5 * (t3 - t1)) AS tc,
    LEAST(GREATEST(hdl_cholesterol, h1 - 1.5 * (h3 - h1)), h3 + 1.5 * (h3 - h1)) AS hdl, Data_Value FROM f, q)
SELECT CAST(patient_id AS BIGINT) AS patient_id, ROUND(age, 4) AS age, gender,
  ROUND(Data_Value, 6) AS Data_Value,
  CASE WHEN systolic_bp < 120 AND diastolic_bp < 80 THEN 'normal' WHEN systolic_bp < 130 AND diastolic_bp < 80 THEN 'elevated'
    WHEN systolic_bp BETWEEN 120 AND 129 OR diastolic_bp BETWEEN 80 AND 89 THEN 'stage1_hypertension'
    WHEN systolic_bp >= 130 OR diastolic_bp >= 90 THEN 'stage2_hypertension' ELSE 'unknown' END AS bp_category,
  CASE WHEN age > 0 AND age <= 65 THEN 'under_65' WHEN age <= 75 THEN '65_74' WHEN age <= 85 THEN '75_84'
    WHEN age <= 120 THEN '85_plus' END AS age_group,
  CAST(has_diabetes AS INT) + CAST(has_hypertension AS INT) AS comorbidity_count,
  CAST(has_diabetes AND has_hypertension AS INT) AS diabetes_hypertension_combo,
  ROUND(tc / NULLIF(hdl, 0), 4) AS cholesterol_ratio FROM k""", ["patients"])
def _(t: Tables):
    cols = ("patient_id", "age", "gender", "has_diabetes", "has_hypertension", "systolic_bp", "diastolic_bp",
            "total_cholesterol", "hdl_cholesterol", "Data_Value")
    rows = t.patients.select(*cols)
    out = jobs.process_dataset(rows.unionByName(rows))
    return out.select(
        F.col("patient_id").cast("long").alias("patient_id"), F.round("age", 4).alias("age"), "gender",
        F.round("Data_Value", 6).alias("Data_Value"), "bp_category", "age_group", "comorbidity_count",
        "diabetes_hypertension_combo", F.round("cholesterol_ratio", 4).alias("cholesterol_ratio"))


@query("c26_process_extract", """
WITH e AS (SELECT RowId, LocationAbbr, TRY_CAST(YearStart AS INT) AS y, Topic, Question, Data_Value, Break_Out FROM extract),
m AS (SELECT quantile_cont(Data_Value, 0.5) AS v FROM e)
SELECT RowId, LocationAbbr, CASE WHEN y IS NOT NULL THEN MAKE_DATE(y, 1, 1) END AS YearStart, Topic, Question,
  ROUND(COALESCE(Data_Value, v), 6) AS Data_Value, Break_Out FROM e, m""", ["extract"])
def _(t: Tables):
    rows = t.extract.select("RowId", "LocationAbbr", "YearStart", "Topic", "Question", "Data_Value", "Break_Out", "Footnote")
    named = rows.unionByName(rows).withColumnsRenamed({"Data_Value": " Data Value", "Question": "(Question) "})
    return jobs.process_extract(named).withColumn("Data_Value", F.round("Data_Value", 6))


@query("c27_clean_extract", """
WITH e AS (SELECT LocationDesc, LocationAbbr, YearStart, Topic, Question, Reading, Break_Out, Footnote, Data_Value FROM extract)
SELECT CASE WHEN LocationDesc IS NULL OR TRIM(LocationDesc) IN ('Unknown', 'UNKNOWN', 'N/A', '') THEN 'unknown'
    ELSE TRIM(LocationDesc) END AS LocationDesc, LocationAbbr, YearStart, Topic, Question, Reading,
  CASE WHEN Break_Out = 'Unknown' THEN 'unknown' ELSE Break_Out END AS Break_Out, 'unknown' AS Footnote,
  ROUND(Data_Value, 6) AS Data_Value,
  CASE Break_Out WHEN 'Male' THEN 'male' WHEN 'Female' THEN 'female' END AS gender
FROM e WHERE Data_Value >= 0""", ["extract"])
def _(t: Tables):
    return jobs.clean_extract(t.extract).withColumn("Data_Value", F.round("Data_Value", 6))


@query("c27_standardize_extract", """
WITH e AS (SELECT RowId AS rowid_, UPPER(TRIM(LocationDesc)) AS loc, UPPER(TRIM(LocationAbbr)) AS ab, YearStart, UPPER(TRIM(Topic)) AS topic,
    UPPER(TRIM(Question)) AS question, Data_Value FROM extract),
s AS (SELECT AVG(Data_Value) AS m, STDDEV_SAMP(Data_Value) AS sd, AVG(rowid_) AS rm, STDDEV_SAMP(rowid_) AS rsd FROM e)
SELECT CASE WHEN ABS(rowid_ - rm) <= 3 * rsd THEN rowid_ END AS rowid,
  CASE WHEN loc IN ('UNITED STATES', 'US', 'USA') THEN 'NATIONAL' WHEN loc IN ('NAN', 'NULL', 'N/A', 'NONE', '') THEN NULL ELSE loc END AS locationdesc,
  CASE WHEN ab IN ('NAN', 'NULL', 'N/A', 'NONE', '') THEN NULL ELSE ab END AS locationabbr,
  TRY_CAST(YearStart AS DOUBLE) AS yearstart, topic, question,
  ROUND(CASE WHEN ABS(Data_Value - m) <= 3 * sd THEN Data_Value END, 6) AS data_value,
  'cdc' AS data_source, '20240131' AS data_version FROM e, s""", ["extract"])
def _(t: Tables):
    rows = t.extract.select("RowId", "LocationDesc", "LocationAbbr", "YearStart", "Topic", "Question", "Data_Value", "Footnote")
    out = jobs.standardize_extract(rows, "cdc", AS_OF).drop("ingestion_timestamp")
    return out.withColumn("data_value", F.round("data_value", 6))


@query("c28_prepare_training_table", """
WITH a AS (SELECT quantile_cont(Age, 0.5) AS ma, quantile_cont(BMI, 0.5) AS mb FROM survey_gaps),
x AS (SELECT Sex AS ms FROM survey_gaps WHERE Sex IS NOT NULL GROUP BY Sex ORDER BY COUNT(*) DESC, Sex LIMIT 1),
g AS (SELECT GenHlth AS mg FROM survey_gaps WHERE GenHlth IS NOT NULL GROUP BY GenHlth ORDER BY COUNT(*) DESC, GenHlth LIMIT 1),
r AS (SELECT sid, COALESCE(Age::DOUBLE, ma) AS Age, COALESCE(BMI, mb) AS BMI, COALESCE(Sex, ms) AS Sex, COALESCE(GenHlth, mg) AS GenHlth,
  HighBP, Diabetes FROM survey_gaps, a, x, g)
SELECT Age, ROUND(BMI, 4) AS BMI, (DENSE_RANK() OVER (ORDER BY Sex) - 1)::BIGINT AS Sex,
  (DENSE_RANK() OVER (ORDER BY GenHlth) - 1)::BIGINT AS GenHlth, HighBP,
  CASE WHEN HighBP + Diabetes > 0 THEN 1 ELSE 0 END AS HeartDisease, CAST(sid AS VARCHAR) AS row_key FROM r""", ["survey_gaps"])
def _(t: Tables):
    rows = t.survey_gaps.select("sid", "Age", "Sex", "BMI", "GenHlth", "HighBP", F.col("HighBP").alias("CHD"),
                                F.col("Diabetes").alias("Stroke"))
    # The key rides along as a struct so that it is neither imputed nor encoded.
    keyed = rows.withColumn("k", F.struct("sid")).drop("sid")
    out, _ = jobs.prepare_training_table(keyed)
    return out.select("Age", F.round("BMI", 4).alias("BMI"), "Sex", "GenHlth", "HighBP", "HeartDisease",
                      F.col("k.sid").alias("row_key"))
