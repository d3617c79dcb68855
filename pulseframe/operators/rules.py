"""Rule tables: expected schema, domains and constraints.

A rule is a name, a SQL predicate that must hold, and a severity. Users extend
the checks by passing their own rules; predicates are evaluated by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str
    severity: str = "error"


# Expected columns, required columns, ranges and categories.
REQUIRED = ("age", "gender", "Data_Value")
REQUIRED_FOR_SCORING = ("age", "gender")
EXPECTED_SCHEMA = {
    "age": "numeric",
    "gender": "categorical",
    "Data_Value": "numeric",
    "has_hypertension": "boolean",
    "has_diabetes": "boolean",
    "has_heart_disease": "boolean",
    "systolic_bp": "numeric",
    "diastolic_bp": "numeric",
    "total_cholesterol": "numeric",
    "hdl_cholesterol": "numeric",
    "bmi": "numeric",
    "smoking_status": "categorical",
}
VALUE_RANGES = {
    "age": (18, 120),
    "systolic_bp": (50, 300),
    "diastolic_bp": (30, 200),
    "total_cholesterol": (50, 500),
    "hdl_cholesterol": (10, 150),
    "bmi": (10, 100),
    "Data_Value": (0, 10000),
}
CATEGORIES = {
    "gender": ("male", "female", "other", "unknown"),
    "smoking_status": ("never", "former", "current", "unknown"),
    "race_ethnicity": (
        "white_non_hispanic", "black_non_hispanic", "hispanic", "asian_non_hispanic", "other", "unknown"),
}
QUICK_NUMERIC = ("age", "Data_Value", "systolic_bp", "diastolic_bp")
SOURCE_REQUIRED = ("locationdesc", "datavalue", "question", "response")
SOURCE_NUMERIC = ("DataValue", "LowConfidenceLimit", "HighConfidenceLimit")
SOURCE_RANGES = {"DataValue": (0, 100), "YearStart": (2000, 2030), "YearEnd": (2000, 2030)}
KEY_COLUMNS = ("external_id", "medicare_id")

# Table constraints. A predicate that is null counts as met.
PATIENT_RULES = (
    Rule("check_age_range", "age >= 0 AND age <= 150"),
    Rule("check_bmi_range", "bmi >= 10 AND bmi <= 100"),
    Rule("check_completeness_range", "data_completeness_score >= 0 AND data_completeness_score <= 1"),
    Rule("check_height_range", "height_cm >= 50 AND height_cm <= 300"),
    Rule("check_weight_range", "weight_kg >= 20 AND weight_kg <= 500"),
)
HISTORY_RULES = (
    Rule("check_cv_hospitalizations", "cardiovascular_hospitalizations_last_year >= 0"),
    Rule("check_total_hospitalizations", "total_hospitalizations_last_year >= 0"),
    Rule("check_cv_vs_total_hospitalizations",
         "cardiovascular_hospitalizations_last_year <= total_hospitalizations_last_year"),
)
VITALS_RULES = (
    Rule("check_systolic_bp_range", "systolic_bp >= 50 AND systolic_bp <= 300"),
    Rule("check_diastolic_bp_range", "diastolic_bp >= 30 AND diastolic_bp <= 200"),
    Rule("check_heart_rate_range", "heart_rate >= 30 AND heart_rate <= 220"),
    Rule("check_oxygen_sat_range", "oxygen_saturation >= 50 AND oxygen_saturation <= 100"),
    Rule("check_cholesterol_range", "total_cholesterol >= 50 AND total_cholesterol <= 500"),
    Rule("check_glucose_range", "blood_glucose >= 30 AND blood_glucose <= 600"),
    Rule("check_hba1c_range", "hba1c >= 3 AND hba1c <= 20"),
)
MEDICATION_RULES = (
    Rule("check_adherence_range", "adherence_percentage >= 0 AND adherence_percentage <= 100"),
    Rule("check_effectiveness_range", "effectiveness_rating >= 1 AND effectiveness_rating <= 5"),
)
PREDICTION_RULES = (
    Rule("check_risk_score_range", "risk_score >= 0 AND risk_score <= 1"),
    Rule("check_confidence_range", "confidence_score >= 0 AND confidence_score <= 1"),
    Rule("check_confidence_level", "confidence_level > 0 AND confidence_level < 1"),
    Rule("check_feedback_score_range", "feedback_score >= 1 AND feedback_score <= 5"),
    Rule("check_risk_category", "risk_category IN ('low', 'medium', 'high')"),
    Rule("check_prediction_type", "prediction_type IN ('single', 'batch', 'csv')"),
)
MODEL_RULES = (
    Rule("check_r2_score_range", "r2_score >= 0 AND r2_score <= 1"),
    Rule("check_mse_positive", "mse_score >= 0"),
    Rule("check_mae_positive", "mae_score >= 0"),
    Rule("check_training_data_size", "training_data_size > 0"),
    Rule("check_status_values", "status IN ('training', 'active', 'deprecated', 'failed')"),
)
OUTCOME_RULES = (
    Rule("check_severity_score", "severity_score >= 1 AND severity_score <= 5"),
    Rule("check_los_non_negative", "length_of_stay_days >= 0"),
    Rule("check_completeness_range", "data_completeness >= 0 AND data_completeness <= 1"),
    Rule("check_total_cost_non_negative", "total_cost >= 0"),
    Rule("check_urgency_level", "urgency_level IN ('routine', 'urgent', 'emergent')"),
)
EPISODE_RULES = (
    Rule("check_care_coordination_range", "care_coordination_score >= 0 AND care_coordination_score <= 1"),
    Rule("check_admission_risk_range", "admission_risk_score >= 0 AND admission_risk_score <= 1"),
    Rule("check_encounters_non_negative", "number_of_encounters >= 0"),
    Rule("check_goals_consistency", "goals_achieved <= goals_total"),
    Rule("check_episode_type", "episode_type IN ('acute', 'chronic', 'preventive', 'follow_up')"),
)
RISK_FACTOR_RULES = (
    Rule("check_risk_level", "risk_level IN ('low', 'moderate', 'high', 'severe')"),
    Rule("check_severity", "severity IN ('mild', 'moderate', 'severe')"),
    Rule("check_confidence", "confidence_level IN ('definite', 'probable', 'possible')"),
    Rule("check_risk_score_range", "risk_score >= 0 AND risk_score <= 1"),
)
PROVIDER_RULES = (
    Rule("check_star_rating_range", "star_rating >= 1 AND star_rating <= 5"),
    Rule("check_satisfaction_range", "patient_satisfaction_score >= 0 AND patient_satisfaction_score <= 100"),
    Rule("check_cv_cases_non_negative", "annual_cv_cases >= 0"),
    Rule("check_provider_type", "provider_type IN ('individual', 'organization')"),
)
RELATIONSHIP_RULES = (
    Rule("check_satisfaction_rating", "satisfaction_rating >= 1 AND satisfaction_rating <= 5"),
    Rule("check_communication_rating", "communication_rating >= 1 AND communication_rating <= 5"),
    Rule("check_total_visits_non_negative", "total_visits >= 0"),
    Rule("check_relationship_type", "relationship_type IN ('primary_care', 'specialist', 'consulting', 'emergency')"),
    Rule("check_care_level", "care_level IN ('primary', 'secondary', 'tertiary')"),
)
SYNC_RULES = (
    Rule("check_progress_range", "progress_percentage >= 0 AND progress_percentage <= 100"),
    Rule("check_records_received_non_negative", "records_received >= 0"),
    Rule("check_records_processed_non_negative", "records_processed >= 0"),
    Rule("check_sync_status", "status IN ('queued', 'running', 'completed', 'failed', 'cancelled')"),
    Rule("check_sync_type", "sync_type IN ('full', 'incremental', 'validation')"),
)
PROCESSING_RULES = (
    Rule("check_processing_progress_range", "progress_percentage >= 0 AND progress_percentage <= 100"),
    Rule("check_input_records_positive", "input_records_count > 0"),
    Rule("check_output_records_non_negative", "output_records_count >= 0"),
    Rule("check_job_type", "job_type IN ('validation', 'cleaning', 'transformation', 'feature_engineering')"),
    Rule("check_processing_status", "status IN ('queued', 'running', 'completed', 'failed', 'cancelled')"),
)
BATCH_RULES = (
    Rule("check_total_records_positive", "total_records > 0"),
    Rule("check_processed_records_non_negative", "processed_records >= 0"),
    Rule("check_successful_predictions_non_negative", "successful_predictions >= 0"),
    Rule("check_failed_predictions_non_negative", "failed_predictions >= 0"),
    Rule("check_job_status", "job_status IN ('queued', 'running', 'completed', 'failed', 'cancelled')"),
)
PERFORMANCE_RULES = (
    Rule("check_r2_score_range", "r2_score >= 0 AND r2_score <= 1"),
    Rule("check_total_predictions_non_negative", "total_predictions >= 0"),
    Rule("check_correct_predictions_non_negative", "correct_predictions >= 0"),
)
TRAINING_JOB_RULES = (
    Rule("check_progress_range", "progress_percentage >= 0 AND progress_percentage <= 100"),
    Rule("check_job_status", "status IN ('queued', 'running', 'completed', 'failed', 'cancelled')"),
)
FEEDBACK_RULES = (
    Rule("check_provider_rating_range", "provider_rating >= 1 AND provider_rating <= 5"),
    Rule("check_corrected_risk_range", "corrected_risk_score >= 0 AND corrected_risk_score <= 1"),
    Rule("check_feedback_type", "feedback_type IN ('outcome', 'rating', 'correction', 'note')"),
    Rule("check_corrected_category", "corrected_risk_category IN ('low', 'medium', 'high')"),
)
DATASET_RULES = (
    Rule("check_total_records_positive", "total_records > 0"),
    Rule("check_total_columns_positive", "total_columns > 0"),
    Rule("check_completeness_range", "completeness_score >= 0 AND completeness_score <= 1"),
    Rule("check_missing_values_non_negative", "missing_values_count >= 0"),
    Rule("check_usage_count_non_negative", "usage_count >= 0"),
    Rule("check_dataset_type", "dataset_type IN ('training', 'validation', 'test')"),
    Rule("check_processing_status", "processing_status IN ('uploaded', 'processing', 'processed', 'failed')"),
    Rule("check_validation_status", "validation_status IN ('pending', 'passed', 'failed')"),
)
CONSISTENCY_RULES = (
    Rule("age_medicare", "age >= 65", "warning"),
    Rule("blood_pressure", "systolic_bp > diastolic_bp", "warning"),
    Rule("hospitalizations",
         "cardiovascular_hospitalizations_last_year <= total_hospitalizations_last_year", "warning"),
)
