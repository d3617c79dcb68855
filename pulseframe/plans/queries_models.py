"""Encodings, scalers, selection, model fits, evaluation and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions import text as tx
from pulseframe.operators import encoding, evaluation, features, imputation, monitoring, scaling, selection, stats, training
from pulseframe.plans import jobs
from pulseframe.plans.catalog import query
from pulseframe.plans.frames import Tables
from pulseframe.plans.queries_tables import AS_OF, rounded
from pulseframe.session import materialize, work_dir

SURVEY_FEATURES = ("Age", "BMI", "Smoking", "HighBP", "HighChol", "Diabetes", "PhysActivity", "PhysHlth", "MentHlth")


# -- encodings and scalers ----------------------------------------------------

@query("x1_label_encode", """
SELECT sid, CASE WHEN GenHlth IS NOT NULL THEN (SELECT COUNT(DISTINCT g.GenHlth) FROM survey_gaps g WHERE g.GenHlth < s.GenHlth) END AS GenHlth FROM survey_gaps s""",
       ["survey_gaps"])
def _(t: Tables):
    return encoding.label_encode(t.survey_gaps.select("sid", "GenHlth"), "GenHlth")


@query("x2_one_hot", """
SELECT patient_id, CASE WHEN gender = 'male' THEN 1 ELSE 0 END AS gender_male, CASE WHEN gender = 'm?' THEN 1 ELSE 0 END AS "gender_m?",
  CASE WHEN gender = 'other' THEN 1 ELSE 0 END AS gender_other, CASE WHEN gender = 'unknown' THEN 1 ELSE 0 END AS gender_unknown,
  CASE WHEN smoking_status = 'former' THEN 1 ELSE 0 END AS smoking_status_former, CASE WHEN smoking_status = 'never' THEN 1 ELSE 0 END AS smoking_status_never,
  zip_code FROM patients""", ["patients"])
def _(t: Tables):
    """The postal code has more than fifty values and stays as it is."""
    return encoding.one_hot(t.patients.select("patient_id", "gender", "smoking_status", "zip_code"))


@query("x3_frequency_encode", """
WITH c AS (SELECT GenHlth, COUNT(*) AS n FROM survey_gaps WHERE GenHlth IS NOT NULL GROUP BY 1)
SELECT sid, ROUND((n - (SELECT MIN(n) FROM c)) / ((SELECT MAX(n) FROM c) - (SELECT MIN(n) FROM c)), 6) AS GenHlth
FROM survey_gaps s LEFT JOIN c ON s.GenHlth = c.GenHlth""", ["survey_gaps"])
def _(t: Tables):
    return rounded(encoding.frequency_encode(t.survey_gaps.select("sid", "GenHlth"), "GenHlth"))


@query("x4_auto_encode", """
WITH c AS (SELECT GenHlth, COUNT(*) AS n FROM survey GROUP BY 1)
SELECT Age, CASE Sex WHEN 'Female' THEN 0 ELSE 1 END AS Sex, ROUND((n - (SELECT MIN(n) FROM c)) / GREATEST((SELECT MAX(n) FROM c) - (SELECT MIN(n) FROM c), 1), 6) AS GenHlth,
  CASE WHEN Education = 'College' THEN 1 ELSE 0 END AS Education_College, CASE WHEN Education = 'Graduate' THEN 1 ELSE 0 END AS Education_Graduate,
  CASE WHEN Education = 'School' THEN 1 ELSE 0 END AS Education_School FROM survey s JOIN c ON s.GenHlth = c.GenHlth""", ["survey"])
def _(t: Tables):
    return rounded(encoding.auto_encode(t.survey.select("Age", "Sex", "GenHlth", "Education")))


_LI = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_LIK = ", ".join(_LI)


@query("x5_standard_scale", f"""
WITH s AS (SELECT AVG(l_quantity) AS m, STDDEV_POP(l_quantity) AS d, AVG(l_extendedprice) AS pm, STDDEV_POP(l_extendedprice) AS pd FROM lineitem)
SELECT {_LIK}, ROUND((l_quantity - m) / d, 6) AS l_quantity, ROUND((l_extendedprice - pm) / pd, 6) AS l_extendedprice, 0.0::DOUBLE AS flat FROM lineitem, s""")
def _(t: Tables):
    rows = t.lineitem.select(*_LI, "l_quantity", "l_extendedprice", F.lit(7.0).alias("flat"))
    return rounded(scaling.standard_scale(rows, ["l_quantity", "l_extendedprice", "flat"]))


@query("x6_minmax_scale", f"""
WITH s AS (SELECT MIN(l_quantity) AS a, MAX(l_quantity) AS b FROM lineitem)
SELECT {_LIK}, ROUND((l_quantity - a) / (b - a), 6) AS l_quantity, 0.0::DOUBLE AS flat FROM lineitem, s""")
def _(t: Tables):
    rows = t.lineitem.select(*_LI, "l_quantity", F.lit(7.0).alias("flat"))
    return rounded(scaling.minmax_scale(rows, ["l_quantity", "flat"]))


@query("x7_robust_scale", f"""
WITH s AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT {_LIK}, ROUND((l_extendedprice - m) / (b - a), 6) AS l_extendedprice FROM lineitem, s""")
def _(t: Tables):
    return rounded(scaling.robust_scale(t.lineitem.select(*_LI, "l_extendedprice"), ["l_extendedprice"]))


def _poly(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


_MARKS = ", ".join(repr(i / 999) for i in range(1000))
_OUTER = (f"CASE WHEN s <= 5 THEN {_poly(scaling._MIDDLE[0], '(s - 1.6::DOUBLE)')} / {_poly(scaling._MIDDLE[1], '(s - 1.6::DOUBLE)')} "
          f"ELSE {_poly(scaling._TAIL[0], '(s - 5.0::DOUBLE)')} / {_poly(scaling._TAIL[1], '(s - 5.0::DOUBLE)')} END")


@query("x8_quantile_normal", f"""
WITH u AS (SELECT UNNEST(e) AS e, UNNEST(RANGE(1000)) AS k FROM (SELECT quantile_cont(l_extendedprice, [{_MARKS}]) AS e FROM lineitem)),
d AS (SELECT e, MIN(k) / 999.0::DOUBLE AS f, MAX(k) / 999.0::DOUBLE AS l FROM u GROUP BY e),
n AS (SELECT e, f, l, LEAD(e) OVER (ORDER BY e) AS e1, LEAD(f) OVER (ORDER BY e) AS f1, MIN(e) OVER () AS a, MAX(e) OVER () AS z FROM d),
r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN x <= a THEN 1e-300::DOUBLE WHEN x >= z THEN 1 - 1e-16::DOUBLE WHEN x = e THEN (f + l) / 2 ELSE l + (x - e) * (f1 - l) / (e1 - e) END AS p
  FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem) ASOF JOIN n ON x >= e),
s AS (SELECT *, SQRT(-LN(LEAST(p, 1 - p))) AS s, 0.180625::DOUBLE - (p - 0.5) * (p - 0.5) AS t FROM r)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ROUND(LEAST(5.199337582290661::DOUBLE, GREATEST(-5.199337582290661::DOUBLE, CASE WHEN ABS(p - 0.5) <= 0.425 THEN (p - 0.5) * {_poly(scaling._CENTRAL[0], 't')} / {_poly(scaling._CENTRAL[1], 't')}
  ELSE SIGN(p - 0.5) * ({_OUTER}) END)), 6) AS l_extendedprice FROM s""")
def _(t: Tables):
    return rounded(scaling.quantile_normal(t.lineitem.select(*_LI, "l_extendedprice"), ["l_extendedprice"]))


# -- selection ----------------------------------------------------------------

_UNI = ("Age", "BMI", "Smoking", "HighBP", "PhysHlth")


def _anova(c: str) -> str:
    return (f"SELECT '{c}' AS feature, ROUND((SUM(n * POW(m - g, 2)) / (COUNT(*) - 1)) / (SUM(n * v) / (SUM(n) - COUNT(*))), 4) AS score FROM "
            f"(SELECT HeartDisease, COUNT(*) AS n, AVG({c}) AS m, VAR_POP({c}) AS v, (SELECT AVG({c}) FROM survey) AS g FROM survey GROUP BY 1)")


@query("x9_f_scores_class", " UNION ALL ".join(map(_anova, _UNI)), ["survey"])
def _(t: Tables):
    return rounded(selection.f_scores_class(t.survey, _UNI, "HeartDisease"), 4)


@query("x9_select_k_best", "SELECT feature, score FROM (" + " UNION ALL ".join(map(_anova, _UNI)) + ") ORDER BY score DESC LIMIT 3", ["survey"])
def _(t: Tables):
    """The k best features are the feature here."""
    return rounded(selection.k_best(selection.f_scores_class(t.survey, _UNI, "HeartDisease"), 3), 4)


def _f_regression(c: str) -> str:
    return (f"SELECT '{c}' AS feature, ROUND(POW(CORR({c}, BMI), 2) * (COUNT(*) - 2) / (1 - POW(CORR({c}, BMI), 2)), 4) AS score FROM survey")


@query("x10_f_scores_numeric", " UNION ALL ".join(map(_f_regression, ("Age", "Smoking", "HighChol", "PhysHlth"))), ["survey"])
def _(t: Tables):
    return rounded(selection.f_scores_numeric(t.survey, ("Age", "Smoking", "HighChol", "PhysHlth"), "BMI"), 4)


def _mi(c: str) -> str:
    marks = ", ".join(str(i / 10) for i in range(1, 10))
    return f"""SELECT '{c}' AS feature, ROUND(SUM(n / t * LN(n * t / (nb * ny))), 6) AS score FROM (
  SELECT n, SUM(n) OVER () AS t, SUM(n) OVER (PARTITION BY b) AS nb, SUM(n) OVER (PARTITION BY y) AS ny FROM (
  SELECT LEN(LIST_FILTER(LIST_DISTINCT(e), lambda x: x < {c} AND x > lo)) AS b, HeartDisease AS y, COUNT(*) AS n FROM survey,
    (SELECT quantile_cont({c}, [{marks}]) AS e, MIN({c}) AS lo FROM survey) GROUP BY 1, 2))"""


@query("x11_mutual_information", " UNION ALL ".join(map(_mi, ("Age", "BMI", "MentHlth"))), ["survey"])
def _(t: Tables):
    return rounded(selection.mutual_information(t.survey, ("Age", "BMI", "MentHlth"), "HeartDisease", target_bins=None))


_PSI = "(LN({0} + 10) - 0.5::DOUBLE / ({0} + 10) - 1 / (12::DOUBLE * POW({0} + 10, 2)) + 1 / (120::DOUBLE * POW({0} + 10, 4)) - 1 / (252::DOUBLE * POW({0} + 10, 6)) - " + \
    " - ".join(f"1::DOUBLE / ({{0}} + {j})" for j in range(10)) + ")"


def _near(c: str) -> str:
    side = lambda f, j: f"{{'d': ABS({f}(x, {j}) OVER w - x), 'n': {f}(n, {j}) OVER w}}"
    sides = ", ".join(side(f, j) for f in ("LAG", "LEAD") for j in (1, 2, 3))
    return f"""SELECT '{c}' AS feature, ROUND(GREATEST(0, {_PSI.format('SUM(n)')} + SUM(n * ({_PSI.format('3')} - {_PSI.format('c')} - {_PSI.format('m')})) / SUM(n)), 6) AS score FROM (
  SELECT g.n, g.c, (SELECT SUM(o.n) FROM (SELECT {c}::DOUBLE AS x, COUNT(*) AS n FROM survey GROUP BY 1) o WHERE CASE WHEN g.r = 0 THEN o.x = g.x ELSE o.x > g.x - g.r AND o.x < g.x + g.r END) AS m FROM (
  SELECT x, n, c, LIST_MIN(LIST_TRANSFORM(LIST_FILTER(s, lambda v: LIST_SUM(LIST_TRANSFORM(LIST_FILTER(s, lambda u: u.d <= v.d), lambda u: u.n)) >= 3), lambda v: v.d)) AS r FROM (
  SELECT x, n, SUM(n) OVER (PARTITION BY y) AS c, LIST_FILTER([{{'d': 0::DOUBLE, 'n': n - 1}}, {sides}], lambda v: v.n IS NOT NULL) AS s
  FROM (SELECT {c}::DOUBLE AS x, HeartDisease AS y, COUNT(*) AS n FROM survey GROUP BY 1, 2) WINDOW w AS (PARTITION BY y ORDER BY x))) g)"""


@query("x11_mutual_information_neighbours", " UNION ALL ".join(map(_near, ("Age", "BMI", "MentHlth"))), ["survey"])
def _(t: Tables):
    return rounded(selection.mutual_information_neighbours(t.survey, ("Age", "BMI", "MentHlth"), "HeartDisease"))


@query("x12_recursive_elimination")
def _(t: Tables):
    kept = selection.recursive_elimination(t.survey, SURVEY_FEATURES[:6], "HeartDisease", 4)
    return t.spark.createDataFrame([(c,) for c in kept], "feature string")


@query("x13_model_based_selection")
def _(t: Tables):
    kept = selection.model_based(t.survey, SURVEY_FEATURES, "HeartDisease")
    return t.spark.createDataFrame([(c,) for c in kept], "feature string")


@query("x14_voting_selection")
def _(t: Tables):
    kept = selection.combined_selection(t.survey, SURVEY_FEATURES[:6], "HeartDisease", 4)
    return t.spark.createDataFrame(kept, "feature string, votes int")


@query("x15_constant_columns", """
SELECT l_quantity, l_tax FROM lineitem""")
def _(t: Tables):
    rows = t.lineitem.select("l_quantity", F.lit(3).alias("flat"), "l_tax", F.lit(1.5).alias("level"))
    rows = rows.drop(*selection.constant_columns(rows.drop("level")))
    return selection.variance_filter(rows)


@query("x16_feature_stages")
def _(t: Tables):
    rows = t.survey_gaps.select("sid", F.struct("sid").alias("key"), "Age", "BMI", "Sex", "GenHlth", "HighBP", "HeartDisease").drop("sid")
    out = jobs.feature_estimator(rows, "HeartDisease").fit(rows).transform(rows)
    from pyspark.ml.functions import vector_to_array
    return out.select("key.sid", vector_to_array("selected").alias("selected"))


@query("x17_feature_job")
def _(t: Tables):
    _, report = jobs.feature_job(t.survey_gaps.drop("sid", "Education"), path=work_dir(t.spark, "features"))
    return report


@query("x18_server_feature_job")
def _(t: Tables):
    rows = t.patients.select("age", "bmi", "has_diabetes", "has_hypertension", "systolic_bp", "diastolic_bp", "total_cholesterol",
                             "gender", "smoking_status", "record_date", "Data_Value").where("Data_Value is not null")
    out, _ = jobs.server_feature_job(rows)
    return out


# -- splits and fits ----------------------------------------------------------

_H60 = "CAST('0x' || SUBSTR(MD5(CAST({k} AS VARCHAR)), 1, 15) AS BIGINT)"


@query("m3_random_split", f"SELECT sid, {_H60.format(k='sid')} % 10000 < 2000 AS is_test FROM survey", ["survey"])
def _(t: Tables):
    return training.random_split(t.survey, ["sid"]).select("sid", "is_test")


@query("m3_stratified_split", f"""
SELECT sid, HeartDisease, ROW_NUMBER() OVER (PARTITION BY HeartDisease ORDER BY {_H60.format(k='sid')}) <= ROUND_EVEN(0.2 * COUNT(*) OVER (PARTITION BY HeartDisease), 0) AS is_test
FROM survey""", ["survey"])
def _(t: Tables):
    return training.stratified_split(t.survey, ["sid"], "HeartDisease").select("sid", "HeartDisease", "is_test")


_OLS = """
WITH a AS (SELECT AVG(Age) AS mx, AVG(BMI) AS my, AVG(PhysHlth) AS mz FROM survey),
s AS (SELECT SUM((Age - mx) * (Age - mx)) AS sxx, SUM((PhysHlth - mz) * (PhysHlth - mz)) AS szz, SUM((Age - mx) * (PhysHlth - mz)) AS sxz,
  SUM((Age - mx) * (BMI - my)) AS sxy, SUM((PhysHlth - mz) * (BMI - my)) AS szy FROM survey, a),
b AS (SELECT (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2 FROM s)"""


@query("m1_linear_regression", _OLS + """
SELECT sid, ROUND(my + b1 * (Age - mx) + b2 * (PhysHlth - mz), 4) AS prediction FROM survey, a, b""", ["survey"])
def _(t: Tables):
    model = training.fit(t.survey, ["Age", "PhysHlth"], "BMI", "linear_regression")
    return rounded(training.predict(model, t.survey, ["Age", "PhysHlth"], ["sid"]), 4)


def _fit_quality(t: Tables, kind: str, **params):
    model = training.fit(t.survey, ["Age", "PhysHlth", "Smoking", "HighBP"], "HeartDisease", kind, **params)
    return rounded(training.evaluate_regression(model, t.survey, ["Age", "PhysHlth", "Smoking", "HighBP"], "HeartDisease").select(
        F.lit(kind).alias("model"), "r2_score", "mse", "mae"))


@query("m1_penalised_regressions")
def _(t: Tables):
    out = _fit_quality(t, "ridge").unionByName(_fit_quality(t, "lasso", alpha=0.01))
    return out.unionByName(_fit_quality(t, "elastic_net", alpha=0.01))


@query("m1_tree_regressions")
def _(t: Tables):
    return _fit_quality(t, "random_forest").unionByName(_fit_quality(t, "gradient_boosting"))


@query("m2_classifiers")
def _(t: Tables):
    """Every family on the training side, judged on the test side."""
    split = materialize(training.stratified_split(t.survey, ["sid"], "HeartDisease"), "split")
    train, test = split.where("not is_test"), split.where("is_test")
    out = None
    for kind in ("logistic_regression", "linear_svm", "random_forest", "gradient_boosting"):
        scored = training.held_out_scores(train, test, SURVEY_FEATURES, "HeartDisease", kind)
        one = evaluation.roc_auc(scored, "HeartDisease", "score").select(F.lit(kind).alias("model"), F.round("roc_auc", 6).alias("roc_auc"))
        out = one if out is None else out.unionByName(one)
    return out


@query("m4_grid_search")
def _(t: Tables):
    found = training.search(t.survey, SURVEY_FEATURES[:6], "HeartDisease", "logistic_regression", ["sid"])
    return rounded(training.search_table(found, t.spark), 4)


@query("m5_random_search")
def _(t: Tables):
    found = training.search(t.survey, [c for c in SURVEY_FEATURES if c != "BMI"], "BMI", "lasso", ["sid"], task="regression", n_iter=50)
    return rounded(training.search_table(found, t.spark), 4)


@query("m6_cross_validate")
def _(t: Tables):
    return rounded(training.fold_summary(training.cross_validate(t.survey, SURVEY_FEATURES[:6], "HeartDisease", "ridge", ["sid"])))


_PAIR = f"""
WITH z AS (SELECT sid, BMI AS y, {_H60.format(k='sid')} % 5 AS fold, {_H60.format(k="sid || '|curve'")} % 10000 AS slot, (Age - AVG(Age) OVER ()) / STDDEV_POP(Age) OVER () AS u,
  (PhysHlth - AVG(PhysHlth) OVER ()) / STDDEV_POP(PhysHlth) OVER () AS v FROM survey),
t AS (SELECT UNNEST(RANGE(5)) AS f), h AS (SELECT UNNEST({{shares}}) AS share),
a AS (SELECT f, share, COUNT(*) AS n, AVG(u) AS mu, AVG(v) AS mv, AVG(y) AS my, VAR_POP(u) * COUNT(*) + 1 AS uu, VAR_POP(v) * COUNT(*) + 1 AS vv, COVAR_POP(u, v) * COUNT(*) AS uv,
  COVAR_POP(u, y) * COUNT(*) AS uy, COVAR_POP(v, y) * COUNT(*) AS vy FROM t, h JOIN z ON fold <> f AND slot < ROUND(share * 10000) GROUP BY f, share),
b AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS p, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS q FROM a)"""


@query("m6_cross_validate_pair", _PAIR.format(shares="[1.0::DOUBLE]") + """,
s AS (SELECT f, 1 - SUM(POW(e, 2)) / (VAR_POP(y) * COUNT(*)) AS r2, -AVG(e * e) AS neg_mse, -AVG(ABS(e)) AS neg_mae FROM (
  SELECT f, y, y - (my + p * (u - mu) + q * (v - mv)) AS e FROM b JOIN z ON fold = f) GROUP BY f)
SELECT metric, ROUND(AVG(x), 6) AS mean, ROUND(STDDEV_POP(x), 6) AS std, ROUND(MIN(x), 6) AS min, ROUND(MAX(x), 6) AS max
FROM (UNPIVOT s ON r2, neg_mse, neg_mae INTO NAME metric VALUE x) GROUP BY metric""", ["survey"])
def _(t: Tables):
    return rounded(training.fold_summary(training.cross_validate(t.survey, ["Age", "PhysHlth"], "BMI", "ridge", ["sid"])))


@query("m7_learning_curve_pair", _PAIR.format(shares="[0.1::DOUBLE, 0.4, 0.7, 1.0]") + """,
s AS (SELECT f, share, n, side, 1 - SUM(POW(y - (my + p * (u - mu) + q * (v - mv)), 2)) / (VAR_POP(y) * COUNT(*)) AS r2 FROM (
  SELECT b.*, y, u, v, CASE WHEN fold = f THEN 'validation' ELSE 'train' END AS side FROM b JOIN z ON fold = f OR slot < ROUND(share * 10000)) GROUP BY f, share, n, side)
SELECT ROUND(share, 6) AS share, side, ROUND(AVG(n), 6) AS mean_rows, ROUND(AVG(r2), 6) AS score_mean, ROUND(STDDEV_POP(r2), 6) AS score_std FROM s GROUP BY share, side""", ["survey"])
def _(t: Tables):
    return rounded(training.learning_curve(t.survey, ["Age", "PhysHlth"], "BMI", "ridge", ["sid"], sizes=4))


@query("m1_ridge_pair", _PAIR.format(shares="[1.0::DOUBLE]").replace("fold <> f AND ", "").replace("RANGE(5)", "RANGE(1)") + """
SELECT sid, ROUND(my + p * (u - mu) + q * (v - mv), 4) AS prediction FROM z, b""", ["survey"])
def _(t: Tables):
    model = training.fit(t.survey, ["Age", "PhysHlth"], "BMI", "ridge")
    return rounded(training.predict(model, t.survey, ["Age", "PhysHlth"], ["sid"]), 4)


@query("m7_learning_curve")
def _(t: Tables):
    return rounded(training.learning_curve(t.survey, SURVEY_FEATURES[:4], "HeartDisease", "ridge", ["sid"]))


@query("m8_bootstrap_stability")
def _(t: Tables):
    return rounded(training.bootstrap_stability(t.survey, SURVEY_FEATURES[:6], "HeartDisease", "ridge", 10, keys=["sid"]))


@query("m9_prepare_features", """
SELECT patient_id, COALESCE(age, 0)::DOUBLE AS age, COALESCE(bmi, 0)::DOUBLE AS bmi, COALESCE(CAST(has_diabetes AS INT), 0)::DOUBLE AS has_diabetes,
  0.0::DOUBLE AS smoking_status, 0.0::DOUBLE AS not_there FROM patients""", ["patients"])
def _(t: Tables):
    return training.prepare_features(t.patients, ["age", "bmi", "has_diabetes", "smoking_status", "not_there"], ["patient_id"])


@query("m10_score_batch", _OLS + """, p AS (SELECT sid, my + b1 * (Age - mx) + b2 * (PhysHlth - mz) AS p,
  0.1 + (1 - (CASE WHEN Age <> 0 THEN 1 ELSE 0 END + CASE WHEN PhysHlth <> 0 THEN 1 ELSE 0 END) / 2) * 0.2 AS u FROM survey, a, b)
SELECT sid, ROUND(p, 4) AS risk_score, CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.7 THEN 'medium' ELSE 'high' END AS risk_category, 'v1' AS model_version,
  MD5(sid || '|v1') AS prediction_id, ROUND(1 - u, 6) AS confidence_score FROM p""", ["survey"])
def _(t: Tables):
    model = training.fit(t.survey, ["Age", "PhysHlth"], "BMI", "linear_regression")
    out = training.score_batch(model, t.survey, ["Age", "PhysHlth"], [], "sid", "v1")
    return out.select("sid", F.round("risk_score", 4).alias("risk_score"), "risk_category", "model_version", "prediction_id",
                      F.round("confidence_score", 6).alias("confidence_score"))


# -- evaluation ---------------------------------------------------------------

_E = "(actual - predicted)"
_REG = f"""ROUND(1 - SUM({{w}} * {_E} * {_E}) / SUM({{w}} * POW(actual - m, 2)), 6) AS r2_score, ROUND(SUM({{w}} * {_E} * {_E}) / SUM({{w}}), 6) AS mse,
  ROUND(SUM({{w}} * ABS{_E}) / SUM({{w}}), 6) AS mae, ROUND(SQRT(SUM({{w}} * {_E} * {_E}) / SUM({{w}})), 6) AS rmse,
  ROUND(1 - SUM({{w}} * POW({_E} - me, 2)) / SUM({{w}} * POW(actual - m, 2)), 6) AS explained_variance"""


@query("m11_regression_metrics", f"""
WITH a AS (SELECT AVG(actual) AS m, AVG{_E} AS me, STDDEV_POP{_E} AS sd FROM fitted)
SELECT {_REG.format(w='1.0')}, ROUND(AVG(ABS{_E} / GREATEST(ABS(actual), 2.220446049250313e-16)), 4) AS mape, ROUND(MAX(me), 6) AS mean_residual, ROUND(MAX(sd), 6) AS std_residual,
  ROUND(AVG(POW(({_E} - me) / sd, 3)), 4) AS residual_skewness, ROUND(AVG(POW(({_E} - me) / sd, 4)) - 3, 4) AS residual_kurtosis,
  ROUND(AVG(predicted), 6) AS mean_prediction, ROUND(STDDEV_POP(predicted), 6) AS std_prediction, ROUND(MIN(predicted), 6) AS min_prediction,
  ROUND(MAX(predicted), 6) AS max_prediction, ROUND(MAX(predicted) - MIN(predicted), 6) AS prediction_range,
  ROUND(quantile_cont(ABS{_E}, 0.5), 6) AS median_absolute_error, ROUND(quantile_cont(ABS{_E}, 0.75), 6) AS q75_absolute_error,
  ROUND(quantile_cont(ABS{_E}, 0.95), 6) AS q95_absolute_error, ROUND(MAX(ABS{_E}), 6) AS max_absolute_error FROM fitted, a""", ["fitted"])
def _(t: Tables):
    out = evaluation.regression_metrics(t.fitted, "actual", "predicted")
    return rounded(rounded(out).withColumns({c: F.round(c, 4) for c in ("mape", "residual_skewness", "residual_kurtosis")}))


@query("m11_weighted_regression_metrics", f"""
WITH a AS (SELECT SUM(weight * actual) / SUM(weight) AS m, SUM(weight * {_E}) / SUM(weight) AS me FROM fitted)
SELECT {_REG.format(w='weight')} FROM fitted, a""", ["fitted"])
def _(t: Tables):
    out = evaluation.regression_metrics(t.fitted, "actual", "predicted", "weight")
    return rounded(out.select("r2_score", "mse", "mae", "rmse", "explained_variance"))


_CAT = "CASE WHEN {c} < 0.3 THEN 'low' WHEN {c} < 0.7 THEN 'medium' ELSE 'high' END"
_CATS = f"c AS (SELECT {_CAT.format(c='actual')} AS a, {_CAT.format(c='predicted')} AS p FROM fitted)"


def _prf(c: str) -> str:
    tp = f"SUM(CASE WHEN a = '{c}' AND p = '{c}' THEN 1 ELSE 0 END)"
    return (f"{tp} AS tp_{c}, SUM(CASE WHEN a = '{c}' THEN 1 ELSE 0 END)::BIGINT AS ac_{c}, SUM(CASE WHEN p = '{c}' THEN 1 ELSE 0 END) AS pc_{c}")


_P = {c: f"COALESCE(tp_{c} / NULLIF(pc_{c}, 0), 0)" for c in evaluation.CLASSES}
_RC = {c: f"COALESCE(tp_{c} / NULLIF(ac_{c}, 0), 0)" for c in evaluation.CLASSES}
_F = {c: f"COALESCE(2 * {_P[c]} * {_RC[c]} / NULLIF({_P[c]} + {_RC[c]}, 0), 0)" for c in evaluation.CLASSES}


@query("m12_category_metrics", f"""
WITH {_CATS}, k AS (SELECT COUNT(*) AS n, {', '.join(map(_prf, evaluation.CLASSES))} FROM c)
SELECT ROUND((tp_low + tp_medium + tp_high) / n, 6) AS accuracy, """ + ", ".join(
    f"ROUND({_P[c]}, 6) AS {c}_precision, ROUND({_RC[c]}, 6) AS {c}_recall, ROUND({_F[c]}, 6) AS {c}_f1, ac_{c} AS {c}_support" for c in evaluation.CLASSES)
       + ", " + ", ".join(f"ROUND(({' + '.join(m.values())}) / 3, 6) AS macro_{n}, ROUND(({' + '.join(f'{m[c]} * ac_{c}' for c in m)}) / n, 6) AS weighted_{n}"
                          for n, m in (("precision", _P), ("recall", _RC), ("f1", _F))) + " FROM k", ["fitted"])
def _(t: Tables):
    return rounded(evaluation.category_metrics(t.fitted, "actual", "predicted"))


@query("m13_risk_category_accuracy", f"""
WITH {_CATS} SELECT a AS actual_category, SUM(CASE WHEN p = 'low' THEN 1 ELSE 0 END)::BIGINT AS predicted_low, SUM(CASE WHEN p = 'medium' THEN 1 ELSE 0 END)::BIGINT AS predicted_medium,
  SUM(CASE WHEN p = 'high' THEN 1 ELSE 0 END)::BIGINT AS predicted_high, ROUND(AVG(CASE WHEN a = p THEN 1 ELSE 0 END), 6) AS category_accuracy FROM c GROUP BY a""", ["fitted"])
def _(t: Tables):
    return rounded(evaluation.risk_category_accuracy(t.fitted, "actual", "predicted"))


_CM = """SUM(CASE WHEN label = 1 AND predicted = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, SUM(CASE WHEN label = 0 AND predicted = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
  SUM(CASE WHEN label = 0 AND predicted = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, SUM(CASE WHEN label = 1 AND predicted = 0 THEN 1 ELSE 0 END)::BIGINT AS fn"""


@query("m14_binary_metrics", f"""
WITH c AS (SELECT {_CM} FROM scored), r AS (SELECT *, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp + fn AS pos, tn + fp AS neg FROM c)
SELECT ROUND((tp + tn) / (pos + neg), 6) AS accuracy, ROUND((p1 * pos + p0 * neg) / (pos + neg), 6) AS precision, ROUND((r1 * pos + r0 * neg) / (pos + neg), 6) AS recall,
  ROUND((2 * p1 * r1 / (p1 + r1) * pos + 2 * p0 * r0 / (p0 + r0) * neg) / (pos + neg), 6) AS f1_score, ROUND(r1, 6) AS sensitivity, ROUND(r0, 6) AS specificity,
  ROUND(p0, 6) AS npv, tp, fp, tn, fn FROM r""", ["scored"])
def _(t: Tables):
    return rounded(evaluation.binary_metrics(t.scored, "label", "predicted"))


_CELLS = "c AS (SELECT score, SUM(label)::BIGINT AS pos, SUM(1 - label)::BIGINT AS neg FROM scored GROUP BY score)"


@query("m15_roc_auc", f"""
WITH {_CELLS}, r AS (SELECT *, SUM(neg) OVER (ORDER BY score) - neg AS below FROM c)
SELECT ROUND(SUM(pos * (below + neg / 2)) / (SUM(pos) * SUM(neg)), 6) AS roc_auc, SUM(pos)::BIGINT AS positives, SUM(neg)::BIGINT AS negatives FROM r""", ["scored"])
def _(t: Tables):
    return rounded(evaluation.roc_auc(t.scored, "label", "score"))


_DESC = f"{_CELLS}, r AS (SELECT score, pos, SUM(pos) OVER (ORDER BY score DESC) AS tp, SUM(neg) OVER (ORDER BY score DESC) AS fp, SUM(pos) OVER () AS p, SUM(neg) OVER () AS n FROM c)"


@query("m15_roc_curve", f"""
WITH {_DESC} SELECT score AS threshold, ROUND(fp / n, 6) AS fpr, ROUND(tp / p, 6) AS tpr FROM r
UNION ALL SELECT MAX(score) + 1, 0.0::DOUBLE, 0.0::DOUBLE FROM r""", ["scored"])
def _(t: Tables):
    return evaluation.roc_curve(t.scored, "label", "score").select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("m16_average_precision", f"WITH {_DESC} SELECT ROUND(SUM(pos / p * (tp / (tp + fp))), 6) AS average_precision FROM r", ["scored"])
def _(t: Tables):
    return rounded(evaluation.average_precision(t.scored, "label", "score"))


@query("m16_pr_curve", f"WITH {_DESC} SELECT score AS threshold, ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / p, 6) AS recall FROM r", ["scored"])
def _(t: Tables):
    return evaluation.pr_curve(t.scored, "label", "score").select(
        "threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("m17_confusion_matrix", """
SELECT label AS actual, SUM(CASE WHEN predicted = 0 THEN 1 ELSE 0 END)::BIGINT AS predicted_0, SUM(predicted)::BIGINT AS predicted_1 FROM scored GROUP BY 1""", ["scored"])
def _(t: Tables):
    return evaluation.confusion_matrix(t.scored, "label", "predicted", [0, 1])


@query("m17_classification_report", f"""
WITH {_CATS}, l AS (SELECT DISTINCT a AS label FROM c UNION SELECT DISTINCT p FROM c), k AS (SELECT label, (SELECT COUNT(*) FROM c WHERE a = label AND p = label) AS tp,
  (SELECT COUNT(*) FROM c WHERE p = label) AS pc, (SELECT COUNT(*) FROM c WHERE a = label) AS support FROM l)
SELECT label, ROUND(COALESCE(tp / NULLIF(pc, 0), 0), 6) AS precision, ROUND(COALESCE(tp / NULLIF(support, 0), 0), 6) AS recall, ROUND(2 * tp / (pc + support), 6) AS f1_score, support FROM k""",
       ["fitted"])
def _(t: Tables):
    from pulseframe.functions import risk
    rows = t.fitted.select(risk.risk_category(F.col("actual")).alias("a"), risk.risk_category(F.col("predicted")).alias("p"))
    return rounded(evaluation.classification_report(rows, "a", "p"))


@query("m18_calibration", f"""
WITH e AS (SELECT quantile_cont(score, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e FROM scored)
SELECT CAST(LEN(LIST_FILTER(e, lambda x: x < score)) AS INT) AS bin, COUNT(*) AS rows, ROUND(AVG(score), 6) AS mean_predicted_value, ROUND(AVG(label), 6) AS fraction_of_positives
FROM scored, e GROUP BY 1""", ["scored"])
def _(t: Tables):
    return rounded(evaluation.calibration(t.scored, "label", "score"))


@query("m18_brier", "SELECT ROUND(AVG(POW(score - label, 2)), 6) AS brier_score FROM scored", ["scored"])
def _(t: Tables):
    return rounded(evaluation.brier(t.scored, "label", "score"))


@query("m19_traffic_assignment", f"""
SELECT prediction_id, CASE WHEN {_H60.format(k='prediction_id')} % 100 < 30 THEN 'candidate' ELSE 'current' END AS assigned FROM predictions""", ["predictions"])
def _(t: Tables):
    share = tx.hash_bucket([F.col("prediction_id")], 100) < 30
    return t.predictions.select("prediction_id", F.when(share, "candidate").otherwise("current").alias("assigned"))


def _fair(col: str) -> str:
    return f"""SELECT '{col}' AS feature, v AS value, n AS sample_size, (tp + tn) / n AS accuracy, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS precision,
  COALESCE(tp / NULLIF(tp + fn, 0), 0) AS recall, COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1_score,
  COALESCE((SELECT SUM(pos * (below + neg / 2)) / (SUM(pos) * SUM(neg)) FROM (SELECT pos, neg, SUM(neg) OVER (ORDER BY score) - neg AS below FROM
    (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored s WHERE s.{col} = g.v GROUP BY score))), 0) AS roc_auc
  FROM (SELECT {col} AS v, COUNT(*) AS n, {_CM} FROM scored GROUP BY 1) g"""


@query("m20_fairness", f"""
SELECT feature, value, sample_size, ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1_score, 6) AS f1_score,
  ROUND(roc_auc, 6) AS roc_auc FROM ({_fair('gender')} UNION ALL {_fair('age_group')})""", ["scored"])
def _(t: Tables):
    return rounded(evaluation.fairness(t.scored, "label", "predicted", "score", ["gender", "age_group"]))


_SWEEP = "t AS (SELECT 0.1::DOUBLE + 0.05::DOUBLE * i AS threshold FROM RANGE(18) r(i))"
_SWEPT = f"""WITH {_SWEEP}, k AS (SELECT threshold, SUM(CASE WHEN label = 1 AND score >= threshold THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN label = 0 AND score >= threshold THEN 1 ELSE 0 END) AS fp,
  SUM(CASE WHEN label = 0 AND score < threshold THEN 1 ELSE 0 END) AS tn, SUM(CASE WHEN label = 1 AND score < threshold THEN 1 ELSE 0 END) AS fn FROM scored, t GROUP BY 1),
s AS (SELECT ROUND(threshold, 2) AS threshold, ROUND((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS precision,
  ROUND(tp / (tp + fn), 6) AS recall, ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1_score, ROUND(tn / (tn + fp), 6) AS specificity FROM k)"""


@query("m21_threshold_sweep", _SWEPT + " SELECT * FROM s", ["scored"])
def _(t: Tables):
    return rounded(evaluation.threshold_sweep(t.scored, "label", "score").withColumn("threshold", F.round("threshold", 2)))


@query("m21_best_threshold", _SWEPT + " SELECT threshold AS optimal_threshold, f1_score FROM s ORDER BY f1_score DESC, threshold LIMIT 1", ["scored"])
def _(t: Tables):
    return rounded(evaluation.best_threshold(evaluation.threshold_sweep(t.scored, "label", "score")))


@query("m22_feature_importance")
def _(t: Tables):
    model = training.fit(t.survey, SURVEY_FEATURES, "HeartDisease", "random_forest", "classification")
    from pulseframe.operators import ranking
    table = training.importance_table(model, SURVEY_FEATURES, t.spark)
    return features.describe_features(rounded(ranking.top_features(table, None)))


@query("m23_evaluation_job")
def _(t: Tables):
    return rounded(jobs.evaluation_job(t.scored, "label", "predicted", "score", ["gender"]))


_GATES = " UNION ALL ".join(
    f"SELECT version, '{m}' AS metric, {c} AS value, {v}::DOUBLE AS threshold, {c} >= {v} AS passed FROM g"
    for m, v, c in (("accuracy", 0.75, "accuracy"), ("precision", 0.70, "precision_score"), ("recall", 0.70, "0.0::DOUBLE"),
                    ("f1_score", 0.70, "0.0::DOUBLE"), ("roc_auc", 0.80, "0.0::DOUBLE")))


@query("m24_gate_model", f"WITH g AS (SELECT version, accuracy, precision_score FROM versions) {_GATES}", ["versions"])
def _(t: Tables):
    return evaluation.gate_model(t.versions.withColumnRenamed("precision_score", "precision"))


@query("m24_grade_models", """
SELECT version, f = '' AS meets_requirements, f AS failed_checks, CASE WHEN f = '' THEN 'A' ELSE 'F' END AS performance_grade
FROM (SELECT version, CONCAT_WS(', ', CASE WHEN r2_score < 0.7 THEN 'r2_score' END, CASE WHEN mse > 1000000 THEN 'mse' END) AS f FROM versions)""", ["versions"])
def _(t: Tables):
    return evaluation.grade_models(t.versions)


# -- monitoring ---------------------------------------------------------------

@query("m25_monitor_predictions", """
SELECT COUNT(*) AS total_predictions, ROUND(COUNT(*) / 30, 6) AS daily_average, STRFTIME(MIN(created_at), '%Y-%m-%d %H:%M:%S') AS range_start,
  STRFTIME(MAX(created_at), '%Y-%m-%d %H:%M:%S') AS range_end, ROUND(AVG(risk_score), 6) AS mean_risk_score, ROUND(STDDEV_POP(risk_score), 6) AS std_risk_score,
  ROUND(MIN(risk_score), 6) AS min_risk_score, ROUND(MAX(risk_score), 6) AS max_risk_score, ROUND(quantile_cont(risk_score, 0.25), 6) AS p25,
  ROUND(quantile_cont(risk_score, 0.5), 6) AS p50, ROUND(quantile_cont(risk_score, 0.75), 6) AS p75, ROUND(quantile_cont(risk_score, 0.95), 6) AS p95 FROM predictions""", ["predictions"])
def _(t: Tables):
    return rounded(monitoring.monitor_predictions(t.predictions))


_CUT = "TIMESTAMP '2024-01-16 00:00:00'"


def _cutoff():
    return F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")


@query("m26_drift_mean_shift", f"""
WITH d AS (SELECT SUM(CASE WHEN created_at < {_CUT} THEN 1 ELSE 0 END)::BIGINT AS reference_count, SUM(CASE WHEN created_at >= {_CUT} THEN 1 ELSE 0 END)::BIGINT AS current_count,
  AVG(CASE WHEN created_at < {_CUT} THEN risk_score END) AS a, AVG(CASE WHEN created_at >= {_CUT} THEN risk_score END) AS b FROM predictions)
SELECT reference_count, current_count, ROUND(a, 6) AS reference_mean, ROUND(b, 6) AS current_mean, ROUND(ABS(b - a) / a, 6) AS relative_change, 'ok' AS status,
  ABS(b - a) / a > 0.1 AS significant FROM d""", ["predictions"])
def _(t: Tables):
    return rounded(monitoring.drift_mean_shift(t.predictions, _cutoff()))


@query("m27_drift_ks", f"""
WITH c AS (SELECT risk_score, SUM(CASE WHEN created_at < {_CUT} THEN 1 ELSE 0 END) AS a, SUM(CASE WHEN created_at >= {_CUT} THEN 1 ELSE 0 END) AS b FROM predictions GROUP BY 1),
r AS (SELECT SUM(a) OVER (ORDER BY risk_score) / SUM(a) OVER () AS fa, SUM(b) OVER (ORDER BY risk_score) / SUM(b) OVER () AS fb FROM c),
d AS (SELECT MAX(ABS(fa - fb)) AS d, (SELECT SUM(a)::BIGINT FROM c) AS n1, (SELECT SUM(b)::BIGINT FROM c) AS n2 FROM r),
p AS (SELECT *, LEAST(1, GREATEST(0, 2 * (SELECT SUM(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * EXP(-2.0::DOUBLE * k * k * d * d * n1 * n2 / (n1 + n2))) FROM RANGE(1, 101) q(k)))) AS pv FROM d)
SELECT n1 AS reference_count, n2 AS current_count, ROUND(d, 6) AS ks_statistic, ROUND(pv, 6) AS p_value, pv < 0.05 AS significant FROM p""", ["predictions"])
def _(t: Tables):
    return rounded(monitoring.drift_ks(t.predictions, _cutoff(), exact_rows=0))


@query("m27_drift_ks_exact")
def _(t: Tables):
    """Exact while both sides are small enough; no SQL twin, the tests enumerate orders."""
    return rounded(monitoring.drift_ks(t.predictions, _cutoff()))


@query("m28_performance_alerts", """
SELECT COUNT(*) AS total_predictions, CONCAT_WS('; ', CASE WHEN COUNT(*) / 30 < 10 THEN 'info: low prediction volume' WHEN COUNT(*) / 30 > 1000 THEN 'warning: high prediction volume' END,
  CASE WHEN AVG(risk_score) > 0.7 THEN 'warning: high average risk score' END, 'critical: prediction drift') AS alerts,
  CAST(CASE WHEN COUNT(*) / 30 < 10 OR COUNT(*) / 30 > 1000 THEN 1 ELSE 0 END + CASE WHEN AVG(risk_score) > 0.7 THEN 1 ELSE 0 END + 1 AS INT) AS alert_count FROM predictions""",
       ["predictions"])
def _(t: Tables):
    return monitoring.performance_alerts(monitoring.monitor_predictions(t.predictions), True)


@query("m29_metric_history", """
SELECT version, deployment_date::VARCHAR AS batch_id, 'accuracy' AS metric_name, accuracy AS metric_value FROM versions
UNION ALL SELECT version, deployment_date::VARCHAR, 'precision_score', precision_score FROM versions""", ["versions"])
def _(t: Tables):
    rows = t.versions.withColumn("batch_id", F.col("deployment_date").cast("string"))
    return monitoring.metric_history(rows, ["accuracy", "precision_score"], ["version", "batch_id"])


@query("m30_training_sample_summary", "SELECT HeartDisease AS target_value, COUNT(*) AS rows, 2 AS feature_count FROM survey GROUP BY 1", ["survey"])
def _(t: Tables):
    return monitoring.training_sample_summary(t.survey.select("Age", "BMI", "HeartDisease"), "HeartDisease")


@query("m31_persist_model")
def _(t: Tables):
    """Store two versions, list them newest first, and score with the reloaded one."""
    path = work_dir(t.spark, "models")
    for i, version in enumerate(("v1", "v2")):
        model = training.fit(t.survey, ["Age", "PhysHlth"], "BMI", "ridge", alpha=1.0 + i)
        training.save_model(model, path, version, "ridge", '{"validation": {"r2_score": 0.1}}', ["Age", "PhysHlth"], {"alpha": 1.0 + i},
                            f"2024-01-0{i + 1}", False, t.spark)
    scored = training.predict(training.load_model(path, "v2"), t.survey, ["Age", "PhysHlth"], ["sid"])
    mean = scored.agg(F.round(F.avg("prediction"), 4)).first()[0]
    return training.list_models(path, t.spark).select(
        "version", "model_type", "created_at", F.lit(mean).alias("mean_prediction"))


@query("m32_training_job")
def _(t: Tables):
    grids = {"logistic_regression": {"regParam": [1.0, 0.1]}, "random_forest": {"numTrees": [20], "maxDepth": [5]}}
    out = jobs.training_job(t.survey, ["sid"], SURVEY_FEATURES, "HeartDisease", work_dir(t.spark, "training"), "2024-01-31 00:00:00", grids, k=3)
    return rounded(out, 4)


@query("m33_evaluate_model_on_table")
def _(t: Tables):
    path = work_dir(t.spark, "models")
    model = training.fit(t.survey, SURVEY_FEATURES[:6], "HeartDisease", "linear_regression")
    training.save_model(model, path, "v1", "linear_regression", "{}", SURVEY_FEATURES[:6], {}, "2024-01-01", False, t.spark)
    out = jobs.evaluate_model_on_table(path, "v1", t.survey, SURVEY_FEATURES[:6], "HeartDisease")
    return rounded(out["regression"], 4)


@query("m34_robustness_job")
def _(t: Tables):
    return rounded(jobs.robustness_job(t.survey, SURVEY_FEATURES[:4], "HeartDisease", "ridge", ["sid"]))


@query("i7_impute_knn")
def _(t: Tables):
    """No SQL twin: a nearest-neighbour search over whole tables; tested against brute force."""
    from pulseframe.operators import knn
    rows = t.patients.select("patient_id", "age", "systolic_bp", "diastolic_bp", "total_cholesterol")
    return rounded(knn.impute_knn(rows, ["age", "systolic_bp", "diastolic_bp", "total_cholesterol"]))
