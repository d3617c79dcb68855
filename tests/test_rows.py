"""Hand-worked frames for branch order, edges and nulls."""

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import risk
from pulseframe.functions import text as tx
from pulseframe.operators import cleaning, encoding, features, imputation, quality, scaling, training


def column(df, c):
    return [r[c] for r in df.collect()]


@pytest.fixture(scope="module")
def survey(spark):
    rows = [(65.0, "Male", 28.5, True, 5.0, 2, 1), (45.0, "Female", None, False, 0.0, 1, 0), (70.0, None, 30.2, None, 15.0, 10, 1),
            (55.0, "Female", 26.1, False, 2.0, 0, 0), (None, "Male", 24.8, True, None, 3, 1)]
    return spark.createDataFrame(rows, "Age double, Sex string, BMI double, Smoking boolean, PhysHlth double, MentHlth int, HeartDisease int")


def test_blood_pressure_branch_order(spark):
    df = spark.createDataFrame([(110, 70), (125, 70), (150, 85), (150, 95), (125, 95), (None, 80), (119, 92)], "s int, d int")
    got = [r[0] for r in df.select(risk.blood_pressure_category(F.col("s"), F.col("d"))).collect()]
    assert got == ["normal", "elevated", "stage1_hypertension", "stage2_hypertension", "stage1_hypertension", "unknown",
                   "stage2_hypertension"]


def test_risk_category_bounds(spark):
    df = spark.createDataFrame([(0.0,), (0.29999,), (0.3,), (0.69999,), (0.7,), (1.0,), (None,)], "s double")
    assert [r[0] for r in df.select(risk.risk_category(F.col("s"))).collect()] == [
        "low", "low", "medium", "medium", "high", "high", None]


def test_impute_fills_every_gap(spark, survey):
    for out in (imputation.impute_smart(survey.drop("Smoking")), imputation.impute_mode(imputation.impute_median(survey.drop("Smoking")))):
        assert out.where(" or ".join(f"{c} is null" for c in out.columns)).count() == 0
        assert out.count() == 5
    assert column(imputation.impute_median(survey), "Age")[4] == 60.0
    assert column(imputation.impute_mode(survey, ["Sex"]), "Sex")[2] == "Female"


def test_clip_keeps_nulls_and_stays_inside_fences(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in (1, 2, 3, 4, 5, 6, 7, 200)] + [(None, 1.0)], "x double, Data_Value double")
    out = imputation.clip_iqr(df)
    got = column(out, "x")
    assert got == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 11.5, None]
    assert imputation.count_iqr(df, ["x"]) == {"x": 1}
    assert imputation.drop_iqr(df, ["x"]).count() == 8
    assert column(imputation.flag_iqr(df, ["x"]), "x_outlier") == [False] * 7 + [True, False]


def test_comparisons_with_missing_are_false(spark, survey):
    out = features.add_threshold_flags(survey)
    assert column(out, "BMI_High_Risk") == [0, 0, 1, 0, 0]
    assert column(out, "Male_Over_45") == [1, 0, 0, 0, 0]


def test_interactions_with_text_sex(spark, survey):
    out = features.pair_interactions(survey)
    assert column(out, "Age_X_Sex") == [65, 0, None, 0, None]


def test_polynomial_needs_more_than_ten_values(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(12)], "Age double, BMI double")
    assert features.polynomial(df).columns == ["Age", "BMI", "Age_Poly_2", "Age_Sqrt"]
    assert "Age_Log" in features.polynomial(df.withColumn("Age", F.col("Age") + 1)).columns


def test_one_hot_rows_sum_to_at_most_one(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    full = encoding.one_hot(df, drop_first=False)
    assert full.columns == ["k_a", "k_b", "k_c"]
    assert [sum(r) for r in full.collect()] == [1, 1, 1, 0]
    assert encoding.one_hot(df).columns == ["k_b", "k_c"]
    assert encoding.one_hot(df, max_levels=2).columns == ["k"]


def test_auto_encode_by_distinct_values(spark):
    rows = [("x", "p", c) for c in "aabbbccdef"] + [("y", "q", "a"), ("y", "r", "b")]
    out = encoding.auto_encode(spark.createDataFrame(rows, "two string, few string, many string"))
    assert set(out.columns) == {"two", "few_p", "few_q", "few_r", "many"}
    assert sorted({r["many"] for r in out.collect()}) == pytest.approx([0.0, 1 / 3, 2 / 3, 1.0])


def test_scalers_on_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "x double, c double")
    std = scaling.standard_scale(df)
    assert column(std, "c") == [0.0] * 4
    assert column(std, "x")[3] == pytest.approx(3 / 1.870828693)
    assert column(scaling.minmax_scale(df), "c") == [0.0] * 4
    assert column(scaling.robust_scale(df), "c") == [0.0] * 4


def test_quantile_normal_is_symmetric(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    got = column(scaling.quantile_normal(df), "x")
    assert got[50] == pytest.approx(0.0, abs=1e-9)
    assert got[75] == pytest.approx(0.6744897501960817)
    assert got[0] == pytest.approx(-got[100]) and got[100] == pytest.approx(5.199337582, abs=1e-6)


def test_redaction(spark):
    texts = ["login password: hunter2, ok", 'api_key="abc123" next', "Bearer abc.def", "card 4111-1111-1111-1111.", "ssn 123-45-6789",
             "TOKEN = zz9", "nothing here"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.redact(F.col("t"))).collect()] == [
        "login [REDACTED], ok", '[REDACTED]" next', "[REDACTED].def", "card [REDACTED].", "ssn [REDACTED]", "[REDACTED]", "nothing here"]


def test_names_and_maps_are_masked(spark):
    df = spark.createDataFrame([("s3cret", "x" * 101, {"my_token": "t", "city": "y" * 120})], "password string, note string, m map<string,string>")
    r = cleaning.redact_by_name(df).first()
    assert r["password"] == tx.MASK and r["note"] == "x" * 97 + "..." and r["m"]["my_token"] == tx.MASK
    assert r["m"]["city"] == "y" * 97 + "..."


def test_config_signature_does_not_depend_on_order(spark):
    df = spark.createDataFrame([("ridge", {"a": 1.0, "b": 0.5}, ["y", "x"]), ("ridge", {"b": 0.5, "a": 1.0}, ["x", "y"])],
                               "m string, h map<string,double>, f array<string>")
    got = [r[0] for r in df.select(tx.config_signature(F.col("m"), F.col("h"), F.col("f"))).collect()]
    assert got[0] == got[1] and len(got[0]) == 16


def test_clean_patient_records(spark):
    df = spark.createDataFrame([(" Male ", "abc", "Yes", None), ("FEMALE", " 71 ", "no", True)],
                               "gender string, age string, has_diabetes string, has_hypertension boolean")
    got = [tuple(r) for r in cleaning.clean_patient_records(df).collect()]
    assert got == [("male", None, True, False), ("female", 71.0, False, True)]


def test_validate_rows(spark):
    df = spark.createDataFrame([(-3, "male"), (200, "martian"), (None, "male"), (40, "Female")], "age int, gender string")
    out = quality.validate_rows(df).collect()
    assert out[0]["errors"] == ["age: negative"] and not out[0]["is_valid"]
    assert out[1]["warnings"] == ["age: outside [18, 120]", "age: unusually high", "gender: unexpected category"]
    assert out[2]["errors"] == ["required: age"]
    assert out[3]["is_valid"] and out[3]["warnings"] == []


def test_dirty_survey_counts(spark):
    df = spark.createDataFrame([(25, 22.0), (150, 80.0), (-5, 15.0), (65, None), (None, 28.0)], "age int, bmi double")
    from pulseframe.operators import rules as R
    got = {r["rule"]: r["violations"] for r in quality.constraint_check(df, R.PATIENT_RULES[:2]).collect()}
    assert got == {"check_age_range": 1, "check_bmi_range": 0}


def test_stratified_split_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "id int, y int")
    out = training.stratified_split(df, ["id"], "y")
    counts = {r["y"]: (r["n"], r["t"]) for r in out.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert counts == {0: (1800, 360), 1: (200, 40)}
    again = training.stratified_split(df.repartition(7), ["id"], "y")
    assert out.where("is_test").select("id").exceptAll(again.where("is_test").select("id")).count() == 0


def test_empty_frames(spark):
    df = spark.createDataFrame([], "age int, gender string, Data_Value double")
    assert quality.quick_validate(df).first()["errors"] == "empty"
    assert quality.duplicate_count(df).first()["duplicate_rows"] == 0
    assert imputation.impute_median(df).count() == 0
    assert imputation.clip_iqr(df).count() == 0


def test_feature_wording(spark):
    df = spark.createDataFrame([("hba1c_level",), ("zip_code",), ("age",), ("has_kidney_disease",)], "feature string")
    got = [tuple(r)[1:] for r in features.describe_features(df).collect()]
    assert got == [("other", "Hba1C Level"), ("other", "Zip Code"), ("demographics", "Patient age in years"),
                   ("medical_history", "Has Kidney Disease")]
