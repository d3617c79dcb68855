"""Risk scores, categories and clinical wording as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.functions.binning import cut

INF = float("inf")

# Category thresholds and texts that results must carry as they are.
LOW_BELOW, HIGH_FROM = 0.3, 0.7
BAND_EDGES = (0.2, 0.4, 0.6, 0.8)
BANDS = ("very_low", "low", "moderate", "high", "very_high")
BAND_TEXT = (
    "Very low risk - routine preventive care recommended",
    "Low risk - continue current preventive measures",
    "Moderate risk - enhanced monitoring and lifestyle modifications recommended",
    "High risk - active medical management and close monitoring required",
    "Very high risk - immediate medical attention and intensive management required",
)
MONITORING = {
    "low": "Annual assessment recommended",
    "medium": "Semi-annual assessment recommended",
    "high": "Quarterly assessment recommended",
}
MONITORING_DEFAULT = "Follow clinical guidelines for monitoring frequency"
SIGNIFICANCE = (
    "High clinical significance due to advanced age and elevated risk",
    "High clinical significance due to unusually high risk for age group",
    "Very high clinical significance - immediate intervention warranted",
    "Standard clinical significance for age and risk profile",
)
TIER_ADVICE = {
    "high": (
        "Immediate cardiovascular evaluation recommended",
        "Consider cardiology referral",
        "Intensive risk factor modification",
        "Close monitoring and follow-up",
    ),
    "medium": (
        "Regular cardiovascular monitoring",
        "Lifestyle modification counseling",
        "Risk factor optimization",
    ),
    "low": (
        "Continue current preventive care",
        "Annual cardiovascular risk assessment",
    ),
}
ADVICE_HYPERTENSION = "Blood pressure management and monitoring"
ADVICE_DIABETES = "Diabetes management and glucose control"
ADVICE_SMOKING = "Smoking cessation counseling and support"
ADVICE_WEIGHT = "Weight management and nutritional counseling"
FACTOR_AGE_75 = "Advanced age (≥75 years)"
FACTOR_AGE_65 = "Age ≥65 years"
CONDITION_FACTORS = {
    "has_hypertension": "Hypertension",
    "has_diabetes": "Diabetes mellitus",
    "has_heart_disease": "Existing heart disease",
    "has_stroke_history": "Previous stroke",
    "has_heart_attack_history": "Previous myocardial infarction",
}
AGE_GROUPS = ("under_65", "65_74", "75_84", "85_plus")


def truth(col: Column) -> Column:
    """A flag with missing read as false."""
    return F.coalesce(col.cast("boolean"), F.lit(False))


def holds(test: Column) -> Column:
    """A comparison with a missing side read as false, as 0/1."""
    return F.coalesce(test, F.lit(False)).cast("int")


def risk_category(score: Column, low: float = LOW_BELOW, high: float = HIGH_FROM) -> Column:
    return F.when(score < low, "low").when(score < high, "medium").when(score.isNotNull(), "high")


def risk_band(score: Column) -> Column:
    return cut(score, [-INF, *BAND_EDGES, INF], BANDS, right=False)


def risk_interpretation(score: Column) -> Column:
    return cut(score, [-INF, *BAND_EDGES, INF], BAND_TEXT, right=False)


def urgency_level(score: Column) -> Column:
    return cut(score, [-INF, 0.4, 0.6, 0.8, INF], ("routine", "priority", "urgent", "emergent"), right=False)


def monitoring_frequency(category: Column) -> Column:
    out = None
    for name, text in MONITORING.items():
        out = F.when(category == name, text) if out is None else out.when(category == name, text)
    return out.otherwise(MONITORING_DEFAULT)


def clinical_significance(age: Column, score: Column) -> Column:
    return (F.when((age >= 80) & (score > 0.5), SIGNIFICANCE[0])
            .when((age < 65) & (score > 0.7), SIGNIFICANCE[1])
            .when(score > 0.8, SIGNIFICANCE[2])
            .otherwise(SIGNIFICANCE[3]))


def age_group(age: Column, right: bool = True) -> Column:
    """Right-closed bands up to 120, or the left-closed open-ended form."""
    if right:
        return cut(age, [0, 65, 75, 85, 120], AGE_GROUPS)
    return cut(age, [-INF, 65, 75, 85, INF], AGE_GROUPS, right=False)


def blood_pressure_category(systolic: Column, diastolic: Column) -> Column:
    """The order of the tests matters: 150/85 is stage 1."""
    return (F.when(systolic.isNull() | diastolic.isNull(), "unknown")
            .when((systolic < 120) & (diastolic < 80), "normal")
            .when((systolic < 130) & (diastolic < 80), "elevated")
            .when(systolic.between(120, 129) | diastolic.between(80, 89), "stage1_hypertension")
            .when((systolic >= 130) | (diastolic >= 90), "stage2_hypertension")
            .otherwise("unknown"))


def risk_factors(cols: Mapping[str, Column] | Sequence[str]) -> Column:
    """Ordered list of the factors that apply; columns not given are skipped."""
    c = cols if isinstance(cols, Mapping) else {n: F.col(n) for n in cols}
    parts = []
    if "age" in c:
        parts.append(F.when(c["age"] >= 75, FACTOR_AGE_75).when(c["age"] >= 65, FACTOR_AGE_65))
    for flag, label in CONDITION_FACTORS.items():
        if flag in c:
            parts.append(F.when(truth(c[flag]), label))
    if "smoking_status" in c:
        parts.append(F.when(c["smoking_status"] == "current", "Current smoking"))
    if "systolic_bp" in c:
        parts.append(F.when(c["systolic_bp"] >= 140, "Elevated blood pressure"))
    if "total_cholesterol" in c:
        parts.append(F.when(c["total_cholesterol"] >= 240, "High cholesterol"))
    if "bmi" in c:
        parts.append(F.when(c["bmi"] >= 30, "Obesity"))
    return F.array_compact(F.array(*parts))


def recommendations(score: Column, cols: Mapping[str, Column] | Sequence[str], keep: int = 5) -> Column:
    """Advice for the score tier, then for conditions; the report shows the first five."""
    c = cols if isinstance(cols, Mapping) else {n: F.col(n) for n in cols}
    tier = F.when(score >= HIGH_FROM, F.array(*map(F.lit, TIER_ADVICE["high"])))
    tier = tier.when(score >= LOW_BELOW, F.array(*map(F.lit, TIER_ADVICE["medium"])))
    tier = tier.otherwise(F.array(*map(F.lit, TIER_ADVICE["low"])))
    parts = []
    if "has_hypertension" in c:
        parts.append(F.when(truth(c["has_hypertension"]), ADVICE_HYPERTENSION))
    if "has_diabetes" in c:
        parts.append(F.when(truth(c["has_diabetes"]), ADVICE_DIABETES))
    if "smoking_status" in c:
        parts.append(F.when(c["smoking_status"] == "current", ADVICE_SMOKING))
    if "bmi" in c:
        parts.append(F.when(c["bmi"] >= 30, ADVICE_WEIGHT))
    extra = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    return F.slice(F.concat(tier, extra), 1, keep)


def confidence_interval(score: Column, features: Sequence[Column]) -> dict[str, Column]:
    """Interval and confidence from the share of non-zero features."""
    filled = sum((F.coalesce(f.cast("double"), F.lit(0.0)) != 0).cast("int") for f in features)
    share = filled / F.lit(float(len(features)))
    u = F.lit(0.1) + (F.lit(1.0) - share) * 0.2
    known = score.isNotNull()
    return {
        "confidence_lower": F.when(known, F.greatest(F.lit(0.0), score - u)),
        "confidence_upper": F.when(known, F.least(F.lit(1.0), score + u)),
        "confidence_score": F.when(known, F.lit(1.0) - u),
        "confidence_level": F.when(known, F.lit(0.95)),
    }


# Wording of the model features.
FEATURE_TEXT = {
    "age": "Patient age in years",
    "gender_male": "Male gender indicator",
    "has_hypertension": "History of hypertension",
    "has_diabetes": "History of diabetes",
    "has_heart_disease": "History of heart disease",
    "systolic_bp": "Systolic blood pressure",
    "diastolic_bp": "Diastolic blood pressure",
    "total_cholesterol": "Total cholesterol level",
    "hdl_cholesterol": "HDL cholesterol level",
    "bmi": "Body Mass Index",
    "cardiovascular_hospitalizations_last_year": "CV hospitalizations in past year",
}


def feature_category(name: Column) -> Column:
    return (F.when(name.isin("age", "gender_male"), "demographics")
            .when(name.contains("has_"), "medical_history")
            .when(name.rlike("bp|cholesterol|glucose|bmi"), "clinical_measures")
            .when(name.contains("hospitalization"), "utilization")
            .otherwise("other"))


def feature_description(name: Column) -> Column:
    out = None
    for key, text in FEATURE_TEXT.items():
        out = F.when(name == key, text) if out is None else out.when(name == key, text)
    return out.otherwise(title_case(F.replace(name, F.lit("_"), F.lit(" "))))


def title_case(col: Column) -> Column:
    """Capital at the start of every run of letters, also after a digit."""
    runs = F.split(col, r"(?<=\P{L})(?=\p{L})|(?<=\p{L})(?=\P{L})")
    return F.array_join(F.transform(runs, F.initcap), "")
