"""Joins between sources and entities.

Equi-joins are left to Spark: it broadcasts a side only after looking at its
size, and splits skewed partitions otherwise. "Latest per key" is an aggregate
(``max_by``), so one busy key is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import ordered
from pulseframe.session import materialize

MERGE_KEYS = ("locationdesc", "locationabbr", "yearstart", "topic", "question")


def common_columns(frames: Mapping[str, DataFrame], candidates: Sequence[str] = MERGE_KEYS) -> list[str]:
    """Candidate keys that every source has, in candidate order."""
    shared = set.intersection(*[set(f.columns) for f in frames.values()])
    return [k for k in candidates if k in shared]


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all sources; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_sources(frames: Mapping[str, DataFrame], keys: Sequence[str] | None = None) -> DataFrame:
    """Full outer join from left to right on the shared keys.

    Null keys match each other; a clashing column of a later source gets the
    source name as suffix. Without a shared key the sources are stacked. Each
    join is a left join and the later source's rows without a match: a key
    that holds much of a source can be split in both, but not in Spark's full outer join.
    """
    if not frames:
        raise ValueError("no sources to merge")
    keys = common_columns(frames) if keys is None else list(keys)
    if not keys:
        return union_sources(list(frames.values()))
    names = list(frames)
    out = frames[names[0]]
    for step, name in enumerate(names[1:]):
        if step:
            out = materialize(out, "merged")  # read twice below
        right = frames[name]
        taken = set(out.columns)
        renamed = right.select(*[
            F.col(c).alias(f"_k_{c}" if c in keys else f"{c}_{name}" if c in taken else c) for c in right.columns])
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        added = [c for c in renamed.columns if not c.startswith("_k_")]
        met = out.join(renamed, match, "left").select(*out.columns, *added)
        seen = out.select(*keys).distinct()
        alone = renamed.join(seen, match, "left_anti").select(*[F.col(f"_k_{k}").alias(k) for k in keys], *added)
        out = met.unionByName(alone, allowMissingColumns=True)
    return out


def entity_join(parent: DataFrame, child: DataFrame, key: str, how: str = "left") -> DataFrame:
    return parent.join(child, key, how)


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str, cols: Sequence[str]) -> DataFrame:
    """The newest row of every key; equal times go to the greatest ``tie``."""
    newest = F.max_by(F.struct(*[F.col(c) for c in (ts, *cols)]), F.struct(ts, tie)).alias("_v")
    return df.groupBy(key).agg(newest).select(key, "_v.*")


def latest_vitals(patients: DataFrame, vitals: DataFrame, cols: Sequence[str], key: str = "patient_id",
                  ts: str = "measurement_date", tie: str = "vital_id") -> DataFrame:
    return patients.join(latest_per_key(vitals, key, ts, tie, cols), key, "left")


def apply_feedback(predictions: DataFrame, feedback: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Bring the last feedback onto its prediction; each field is taken from the
    newest feedback row that sets it, otherwise the prediction keeps its value."""
    when = F.struct("feedback_date", "feedback_id")
    has_outcome = F.col("actual_outcome").isNotNull()
    has_rating = F.coalesce(F.col("provider_rating"), F.lit(0)) != 0
    newest = feedback.groupBy(F.col(key).alias("_key")).agg(
        F.max_by(F.when(has_outcome, F.struct("actual_outcome", "outcome_date")),
                 F.when(has_outcome, when)).alias("_o"),
        F.max_by(F.when(has_rating, F.col("provider_rating")), F.when(has_rating, when)).alias("_s"))
    told = F.col("_o").isNotNull()
    return (predictions.join(newest, F.col(key) == F.col("_key"), "left")
            .withColumn("outcome_date", F.when(told, F.col("_o.outcome_date")).otherwise(F.col("outcome_date")))
            .withColumn("actual_outcome", F.when(told, F.col("_o.actual_outcome")).otherwise(F.col("actual_outcome")))
            .withColumn("feedback_score", F.coalesce("_s", "feedback_score"))
            .drop("_key", "_o", "_s"))


def referential_check(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key names no parent; a null key is allowed."""
    keys = parent.select(F.col(parent_key).alias("_p"))
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_p"), "left_anti")


def with_feedback_flag(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("has_feedback", F.col("actual_outcome").isNotNull())


def having_feedback(predictions: DataFrame, feedback: DataFrame, key: str = "prediction_id") -> DataFrame:
    return predictions.join(feedback.select(key), key, "left_semi")


def readmissions(
    admissions: DataFrame, patient: str = "patient_id", admitted: str = "admission_date", days: int = 30
) -> DataFrame:
    """Flag admissions followed by another of the same patient within ``days``.

    The search runs per patient and month, so a patient with very many
    admissions is spread over tasks.
    """
    month = F.trunc(F.col(admitted).cast("date"), "month")
    found = ordered.next_in_group(admissions, [patient], admitted, month, "next_admission")
    gap = F.datediff(F.col("next_admission"), F.col(admitted))
    return found.withColumn("readmitted_30d", F.coalesce(gap <= days, F.lit(False)))


def current_medications(medications: DataFrame, as_of: Column) -> DataFrame:
    """Medications whose interval holds the date; an open end means still taken."""
    return medications.where((F.col("start_date") <= as_of)
                             & (F.col("end_date").isNull() | (F.col("end_date") >= as_of)))


def medications_at(visits: DataFrame, medications: DataFrame, key: str = "patient_id",
                   at: str = "visit_date") -> DataFrame:
    """Number of medications in force at each visit of the patient.

    Starts and ends become +1/-1 steps per (patient, day); the visit reads the
    running sum, so no visit × medication pairs are formed.
    """
    starts = medications.select(key, F.col("start_date").alias("_d"), F.lit(1).alias("_step"))
    ends = medications.where(F.col("end_date").isNotNull()).select(
        key, F.date_add("end_date", 1).alias("_d"), F.lit(-1).alias("_step"))
    steps = starts.unionByName(ends).groupBy(key, "_d").agg(F.sum("_step").alias("_step"))
    marks = visits.select(key, F.col(at).alias("_d")).distinct().withColumn("_step", F.lit(0).cast("long"))
    days = steps.unionByName(marks).groupBy(key, "_d").agg(F.sum("_step").alias("_step"))
    ran = ordered.running_totals(days, "_d", {"active_medications": "_step"}, by=[key])
    level = ran.select(F.col(key).alias("_k"), "_d", F.col("active_medications"))
    return visits.join(level, (F.col(key) == F.col("_k")) & (F.col(at) == F.col("_d")), "left").drop("_k", "_d")
