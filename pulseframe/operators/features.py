"""Feature construction: scalar arithmetic, conditions and bins.

Everything here is a projection. Only eligibility checks (distinct counts,
minima, quantile edges) need an aggregate first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions import risk
from pulseframe.functions.binning import cut, quantile_label
from pulseframe.operators import stats

INF = float("inf")

# Condition lists, interaction lists and bin edges.
COMORBIDITIES = (
    "has_hypertension", "has_diabetes", "has_heart_disease",
    "has_stroke_history", "has_heart_attack_history",
)
ENTITY_CONDITIONS = (*COMORBIDITIES, "has_atrial_fibrillation", "has_heart_failure")
PAIRS = (
    ("Smoking", "HighBP"), ("Diabetes", "HighChol"), ("Smoking", "Diabetes"), ("HighBP", "HighChol"),
    ("PhysActivity", "BMI"), ("Age", "Sex"), ("Smoking", "PhysActivity"),
)
AGE_PARTNERS = ("BMI", "HighBP", "HighChol", "Diabetes", "Smoking")
BMI_PARTNERS = ("HighBP", "Diabetes", "PhysActivity")
TRIPLES = (("Age", "Smoking", "HighBP"), ("BMI", "Diabetes", "HighChol"), ("Age", "Sex", "HighBP"))
BMI_EDGES_4 = (0, 18.5, 25, 30, 50)
BMI_LABELS_4 = ("underweight", "normal", "overweight", "obese")
BMI_EDGES_6 = (0, 18.5, 24.9, 29.9, 34.9, 39.9, INF)
BMI_LABELS_6 = ("Underweight", "Normal", "Overweight", "Obese_I", "Obese_II", "Obese_III")
AGE_EDGES_4 = (0, 39, 64, 79, INF)
AGE_LABELS_4 = ("Young_Adult", "Middle_Aged", "Senior", "Elderly")
BP_EDGES = (0, 120, 130, 140, 300)
BP_LABELS = ("normal", "elevated", "stage1", "stage2")
POLYNOMIAL_COLUMNS = ("Age", "BMI", "PhysHlth", "MentHlth")
SQUARED_COLUMNS = ("age", "bmi", "systolic_bp", "total_cholesterol")
COMPLETENESS_FIELDS = (
    "age", "gender", "race_ethnicity", "state_code", "zip_code",
    "has_hypertension", "has_diabetes", "has_heart_disease",
    "systolic_bp", "diastolic_bp", "total_cholesterol", "hdl_cholesterol",
    "bmi", "smoking_status", "blood_glucose", "hba1c",
)
PEER_FACTORS = ("has_hypertension", "has_diabetes", "has_heart_disease")


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def add_bmi(df: DataFrame, digits: int | None = None, out: str = "bmi") -> DataFrame:
    """kg / m²; the entity form rounds to two decimals and wants both measures non-zero."""
    value = F.col("weight_kg") / F.nullif(F.pow(F.col("height_cm") / 100, F.lit(2)), F.lit(0.0))
    if digits is not None:
        value = F.when(F.col("weight_kg") != 0, F.round(value, digits))
    return df.withColumn(out, value)


def add_bp_category(df: DataFrame) -> DataFrame:
    return df.withColumn("bp_category", risk.blood_pressure_category(F.col("systolic_bp"), F.col("diastolic_bp")))


def add_age_group(df: DataFrame, age: str = "age", out: str = "age_group", right: bool = True) -> DataFrame:
    return df.withColumn(out, risk.age_group(F.col(age), right))


def add_bmi_category(df: DataFrame, bmi: str = "bmi", levels: int = 4, out: str = "bmi_category") -> DataFrame:
    edges, labels = (BMI_EDGES_4, BMI_LABELS_4) if levels == 4 else (BMI_EDGES_6, BMI_LABELS_6)
    return df.withColumn(out, cut(F.col(bmi), edges, labels))


def add_bp_bin(df: DataFrame, out: str = "bp_bin") -> DataFrame:
    return df.withColumn(out, cut(F.col("systolic_bp"), BP_EDGES, BP_LABELS))


def add_health_days(df: DataFrame, col: str, out: str, open_ended: bool = True) -> DataFrame:
    labels = ("Excellent", "Good", "Fair", "Poor") if open_ended else ("None", "Few", "Some", "Many")
    return df.withColumn(out, cut(F.col(col), (-1, 0, 7, 14, INF if open_ended else 30), labels))


def add_quantile_bins(df: DataFrame, spec: Mapping[str, tuple[str, int]]) -> DataFrame:
    """``spec``: new name → (column, number of bins). All edges come from one pass."""
    probs: dict[str, set[float]] = {}
    for col, q in spec.values():
        probs.setdefault(col, set()).update(i / q for i in range(q + 1))
    ordered = {c: sorted(p) for c, p in probs.items()}
    found = stats.quantiles(df, ordered)
    edges = {c: dict(zip(ordered[c], found[c])) for c in ordered}
    return df.withColumns({
        name: quantile_label(F.col(col), [edges[col][i / q] for i in range(q + 1)])
        for name, (col, q) in spec.items()
    })


def add_comorbidity_count(
    df: DataFrame, conditions: Sequence[str] = COMORBIDITIES, out: str = "comorbidity_count"
) -> DataFrame:
    present = [c for c in conditions if c in df.columns]
    return df.withColumn(out, sum((risk.truth(F.col(c)).cast("int") for c in present), F.lit(0)))


def add_diabetes_hypertension(df: DataFrame) -> DataFrame:
    both = risk.truth(F.col("has_diabetes")) & risk.truth(F.col("has_hypertension"))
    return df.withColumn("diabetes_hypertension_combo", both.cast("int"))


def add_cholesterol_ratio(df: DataFrame, digits: int | None = None) -> DataFrame:
    ratio = F.col("total_cholesterol").cast("double") / F.nullif(F.col("hdl_cholesterol").cast("double"), F.lit(0.0))
    if digits is not None:
        positive = (F.col("total_cholesterol") != 0) & (F.col("hdl_cholesterol") > 0)
        ratio = F.when(positive, F.round(ratio, digits))
    return df.withColumn("cholesterol_ratio", ratio)


def add_derived(df: DataFrame) -> DataFrame:
    """The derived columns whose inputs the table has."""
    if _has(df, "height_cm", "weight_kg"):
        df = add_bmi(df)
    if _has(df, "systolic_bp", "diastolic_bp"):
        df = add_bp_category(df)
    if _has(df, "age"):
        df = add_age_group(df)
    if any(c in df.columns for c in COMORBIDITIES):
        df = add_comorbidity_count(df)
    if _has(df, "has_diabetes", "has_hypertension"):
        df = add_diabetes_hypertension(df)
    if _has(df, "total_cholesterol", "hdl_cholesterol"):
        df = add_cholesterol_ratio(df)
    return df


def _is_male(df: DataFrame, sex: str) -> Column:
    return F.col(sex) == "Male" if isinstance(df.schema[sex].dataType, T.StringType) else F.col(sex) == 1


def _is_female(df: DataFrame, sex: str) -> Column:
    return F.col(sex) == "Female" if isinstance(df.schema[sex].dataType, T.StringType) else F.col(sex) == 0


def add_threshold_flags(df: DataFrame) -> DataFrame:
    new: dict[str, Column] = {}
    if _has(df, "BMI"):
        new["BMI_High_Risk"] = risk.holds(F.col("BMI") >= 30)
        new["BMI_Very_High_Risk"] = risk.holds(F.col("BMI") >= 35)
    if _has(df, "Age"):
        new["Age_High_Risk"] = risk.holds(F.col("Age") >= 65)
        new["Age_Very_High_Risk"] = risk.holds(F.col("Age") >= 75)
    if _has(df, "Sex", "Age"):
        new["Male_Over_45"] = risk.holds(_is_male(df, "Sex") & (F.col("Age") > 45))
        new["Female_Over_55"] = risk.holds(_is_female(df, "Sex") & (F.col("Age") > 55))
    if _has(df, "PhysHlth"):
        new["Poor_Physical_Health"] = risk.holds(F.col("PhysHlth") > 14)
    if _has(df, "MentHlth"):
        new["Poor_Mental_Health"] = risk.holds(F.col("MentHlth") > 14)
    return df.withColumns(new)


def add_lifestyle_score(df: DataFrame) -> DataFrame:
    terms = []
    if _has(df, "Smoking"):
        terms.append(F.col("Smoking").cast("int"))
    if _has(df, "PhysActivity"):
        terms.append(1 - F.col("PhysActivity").cast("int"))
    if _has(df, "HvyAlcoholConsump"):
        terms.append(F.col("HvyAlcoholConsump").cast("int"))
    return df.withColumn("Lifestyle_Risk_Score", sum(terms[1:], terms[0])) if terms else df


def add_medical_score(df: DataFrame) -> DataFrame:
    present = [c for c in ("Diabetes", "Stroke", "HighBP", "HighChol") if c in df.columns]
    if not present:
        return df
    terms = [F.col(c).cast("int") for c in present]
    score = sum(terms[1:], terms[0])
    return df.withColumns({"Medical_Risk_Score": score, "Multiple_Conditions": risk.holds(score >= 2)})


def add_passthrough_flags(df: DataFrame) -> DataFrame:
    names = {"HighBP": "BP_Risk", "HighChol": "Cholesterol_Risk", "NoDocbcCost": "Healthcare_Access_Risk"}
    return df.withColumns({out: F.col(c).cast("int") for c, out in names.items() if c in df.columns})


def basic_features(df: DataFrame) -> DataFrame:
    """Categories, thresholds, squares and scores of the survey table."""
    if _has(df, "BMI"):
        df = add_bmi_category(df, "BMI", 6, "BMI_Category").withColumn("BMI_Squared", F.pow("BMI", F.lit(2)))
    if _has(df, "Age"):
        df = df.withColumns({
            "Age_Group": cut(F.col("Age"), AGE_EDGES_4, AGE_LABELS_4),
            "Age_Squared": F.pow(F.col("Age"), F.lit(2)),
        })
    df = add_medical_score(add_lifestyle_score(add_passthrough_flags(add_threshold_flags(df))))
    if _has(df, "PhysHlth"):
        df = add_health_days(df, "PhysHlth", "Physical_Health_Category")
    if _has(df, "MentHlth"):
        df = add_health_days(df, "MentHlth", "Mental_Health_Category")
    return df


def encode_sex(df: DataFrame, col: str = "Sex") -> DataFrame:
    """Male → 1, Female → 0, so that products with sex are defined."""
    if col in df.columns and isinstance(df.schema[col].dataType, T.StringType):
        return df.withColumn(col, F.when(F.col(col) == "Male", 1).when(F.col(col) == "Female", 0))
    return df


def _whole(c: str) -> Column:
    return F.col(c).cast("int")


def pair_interactions(df: DataFrame) -> DataFrame:
    """Products of two factors; every factor of a listed pair is cut to a whole number."""
    df = encode_sex(df)
    new: dict[str, Column] = {}
    for a, b in PAIRS:
        if _has(df, a, b):
            new[f"{a}_X_{b}"] = _whole(a) * _whole(b)
    for p in AGE_PARTNERS:
        if _has(df, "Age", p):
            new[f"Age_X_{p}"] = F.col("Age") * (F.col(p) if p == "BMI" else _whole(p))
    for p in BMI_PARTNERS:
        if _has(df, "BMI", p):
            new[f"BMI_X_{p}"] = F.col("BMI") * _whole(p)
    return df.withColumns(new)


def triple_interactions(df: DataFrame) -> DataFrame:
    df = encode_sex(df)
    return df.withColumns({
        f"{a}_X_{b}_X_{c}": (F.col(a) if a in ("Age", "BMI") else _whole(a)) * _whole(b) * _whole(c)
        for a, b, c in TRIPLES if _has(df, a, b, c)
    })


def patient_interactions(df: DataFrame) -> DataFrame:
    new: dict[str, Column] = {}
    for col, flag, name in (("age", "has_diabetes", "age_diabetes_interaction"),
                            ("age", "has_hypertension", "age_hypertension_interaction"),
                            ("bmi", "has_diabetes", "bmi_diabetes_interaction")):
        if _has(df, col, flag):
            new[name] = F.col(col) * F.col(flag).cast("int")
    df = df.withColumns(new)
    return add_pressure_terms(df) if _has(df, "systolic_bp", "diastolic_bp") else df


def add_pressure_terms(df: DataFrame) -> DataFrame:
    pulse = F.col("systolic_bp") - F.col("diastolic_bp")
    return df.withColumns({
        "pulse_pressure": pulse, "mean_arterial_pressure": F.col("diastolic_bp") + pulse / 3})


def polynomial(
    df: DataFrame, degree: int = 2, names: Sequence[str] = POLYNOMIAL_COLUMNS, min_distinct: int = 11,
    transforms: bool = True,
) -> DataFrame:
    """Powers 2..degree of the listed numeric columns with more than ten distinct
    values, with square root and log where every value allows it."""
    numeric = set(stats.numeric_columns(df))
    cols = [c for c in names if c in numeric]
    distinct = stats.distinct_up_to(df, cols, min_distinct)
    found = stats.fused(df, {
        **{("lo", c): F.min(c) for c in cols},
        **{("gap", c): F.count_if(F.col(c).isNull()) for c in cols},
    })
    new: dict[str, Column] = {}
    chosen = [c for c in cols if distinct[c] >= min_distinct]
    for c in chosen:
        for k in range(2, degree + 1):
            new[f"{c}_Poly_{k}"] = F.pow(F.col(c), F.lit(k))
    if transforms:
        whole = [c for c in chosen if not found[("gap", c)]]
        new.update({f"{c}_Sqrt": F.sqrt(c) for c in whole if found[("lo", c)] >= 0})
        new.update({f"{c}_Log": F.ln(F.col(c)) for c in whole if found[("lo", c)] > 0})
    return df.withColumns(new)


def squared_terms(df: DataFrame, cols: Sequence[str] = SQUARED_COLUMNS) -> DataFrame:
    return df.withColumns({f"{c}_squared": F.pow(F.col(c), F.lit(2)) for c in cols if c in df.columns})


def binning_features(df: DataFrame) -> DataFrame:
    spec = {}
    for c in ("Age", "BMI"):
        if c in df.columns:
            spec[f"{c}_Decile"] = (c, 10)
            spec[f"{c}_Quintile"] = (c, 5)
    df = add_quantile_bins(df, spec)
    for c in ("PhysHlth", "MentHlth"):
        if c in df.columns:
            df = add_health_days(df, c, f"{c}_Binned", open_ended=False)
    return df


def server_bins(df: DataFrame) -> DataFrame:
    if _has(df, "age"):
        df = add_age_group(df, out="age_bin")
    if _has(df, "bmi"):
        df = add_bmi_category(df)
    return add_bp_bin(df) if _has(df, "systolic_bp") else df


def temporal_parts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = stats.date_columns(df) if cols is None else cols
    new: dict[str, Column] = {}
    for c in cols:
        new[f"{c}_year"] = F.year(c)
        new[f"{c}_month"] = F.month(c)
        new[f"{c}_quarter"] = F.quarter(c)
        new[f"{c}_day_of_year"] = F.dayofyear(c)
    return df.withColumns(new)


def add_risk_category(df: DataFrame, score: str = "risk_score", out: str = "risk_category") -> DataFrame:
    return df.withColumn(out, risk.risk_category(F.col(score)))


def check_risk_category(df: DataFrame, score: str = "risk_score", category: str = "risk_category") -> DataFrame:
    agrees = F.col(category).eqNullSafe(risk.risk_category(F.col(score)))
    return df.withColumn("category_consistent", agrees)


def add_risk_band(df: DataFrame, score: str = "risk_score", category: str = "risk_category") -> DataFrame:
    s = F.col(score)
    return df.withColumns({
        "risk_band": risk.risk_band(s), "interpretation": risk.risk_interpretation(s),
        "urgency_level": risk.urgency_level(s), "monitoring": risk.monitoring_frequency(F.col(category)),
    })


def add_clinical_significance(df: DataFrame, age: str = "age", score: str = "risk_score") -> DataFrame:
    return df.withColumn("clinical_significance", risk.clinical_significance(F.col(age), F.col(score)))


def add_risk_factors(df: DataFrame, out: str = "risk_factors") -> DataFrame:
    return df.withColumn(out, risk.risk_factors(df.columns))


def add_recommendations(df: DataFrame, score: str = "risk_score", out: str = "recommendations") -> DataFrame:
    return df.withColumn(out, risk.recommendations(F.col(score), df.columns))


def add_completeness(
    df: DataFrame, fields: Sequence[str] | None = COMPLETENESS_FIELDS, out: str = "completeness_score"
) -> DataFrame:
    """Share of the fields present (a missing column counts as absent); ``None``: all columns.
    Empty text counts as absent."""
    names = list(df.columns if fields is None else fields)
    filled = []
    for c in names:
        if c in df.columns:
            there = F.col(c).isNotNull()
            if isinstance(df.schema[c].dataType, T.StringType):
                there = there & (F.col(c) != "")
            filled.append(F.coalesce(there, F.lit(False)).cast("int"))
    return df.withColumn(out, sum(filled, F.lit(0)) / F.lit(float(len(names))))


def add_names(df: DataFrame) -> DataFrame:
    """Full name of a person from its non-empty parts, else the organisation's name."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("first_name", "middle_name", "last_name")]
    full = F.when(F.col("provider_type") == "individual", F.concat_ws(" ", *parts)).otherwise(F.col("name"))
    titled = F.nullif(F.col("credentials"), F.lit("")).isNotNull()
    return df.withColumns({
        "full_name": full,
        "display_name": F.when(titled, F.concat(full, F.lit(", "), F.col("credentials"))).otherwise(full),
    })


def add_confidence(df: DataFrame, features: Sequence[str], score: str = "risk_score") -> DataFrame:
    return df.withColumns(risk.confidence_interval(F.col(score), [F.col(c) for c in features]))


def describe_features(df: DataFrame, col: str = "feature") -> DataFrame:
    return df.withColumns({
        "feature_category": risk.feature_category(F.col(col)),
        "feature_description": risk.feature_description(F.col(col)),
    })


def peer_risk_factors(df: DataFrame, age: str = "age") -> DataFrame:
    """Each row's factor count against the mean of its age group.

    The means are one row per age group, so they are joined rather than
    computed in a window that would move every row to a handful of tasks.
    """
    flags = [risk.truth(F.col(c)).cast("int") for c in PEER_FACTORS]
    smoker = risk.holds(F.col("smoking_status") == "current")
    counted = df.withColumns({
        "patient_risk_factors": sum(flags, smoker),
        "peer_group": F.coalesce(risk.age_group(F.col(age), right=False), F.lit("unknown")),
    })
    means = counted.groupBy("peer_group").agg(F.avg("patient_risk_factors").alias("peer_average"))
    mine, peers = F.col("patient_risk_factors"), F.col("peer_average")
    return counted.join(F.broadcast(means), "peer_group").withColumn(
        "comparison",
        F.when(mine > peers, "above_average").when(mine < peers, "below_average").otherwise("average"))


# -- entity derivations -------------------------------------------------------

def is_improving(baseline: Column, current: Column) -> Column:
    known = (baseline != 0) & (current != 0)
    return F.when(known, current < baseline)


def episode_duration_days(start: Column, end: Column, ongoing: Column, as_of: Column) -> Column:
    """Whole days between the two times, up to ``as_of`` for an open episode."""
    stop = F.when(end.isNotNull(), end).when(ongoing, as_of)
    return F.floor((F.unix_micros(stop.cast("timestamp")) - F.unix_micros(start.cast("timestamp")))
                   / F.lit(86_400_000_000)).cast("long")


def rate(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """Part of a whole; nothing done yet → 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * scale)


def processing_rate(records: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, records / seconds)


def eta_minutes(status: Column, started: Column, progress: Column, as_of: Column) -> Column:
    """Minutes left for a running job at its pace so far."""
    elapsed = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 60e6
    left = elapsed / (progress / 100) - elapsed
    running = (status == "running") & started.isNotNull() & (progress != 0)
    return F.when(running, F.greatest(F.lit(0.0), left))
