"""Paging, rankings, version selection and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators import ordered

# Metrics ranked from high to low, and name parts that tell the direction.
RANK_DESCENDING = ("r2_score", "accuracy", "precision", "recall", "f1_score")
BETTER_HIGH = ("r2_score", "accuracy", "precision", "recall", "f1_score", "auc")
BETTER_LOW = ("mse", "mae", "rmse", "training_time")
METRIC_PATHS = ("validation", "training", "cross_validation")


def paged_history(
    df: DataFrame, ts: str = "created_at", tie: str = "prediction_id", limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page, newest first, with the total count and whether more rows follow."""
    total = df.count()
    page = df.orderBy(F.col(ts).desc(), F.col(tie).desc()).offset(offset).limit(limit)
    return page.withColumns({
        "total_count": F.lit(total).cast("long"), "has_more": F.lit(offset + limit < total)})


def latest_completed(jobs: DataFrame, source: str | None = None) -> DataFrame:
    """Newest completed job per source (or of one source)."""
    done = jobs.where(F.col("status") == "completed")
    if source is not None:
        done = done.where(F.col("source") == source)
    newest = F.max_by(F.struct(*[c for c in jobs.columns if c != "source"]), F.struct("completed_at", "job_id"))
    return done.groupBy("source").agg(newest.alias("_v")).select("source", "_v.*")


def rank_models(metrics: DataFrame, names: Sequence[str], key: str = "version") -> DataFrame:
    """Rank per metric; quality metrics from high to low, all others from low to high."""
    long = metrics.select(key, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [key], list(names), "metric", "value").where("value is not null")
    signed = F.when(F.col("metric").isin(*RANK_DESCENDING), -F.col("value")).otherwise(F.col("value"))
    ranked = ordered.row_numbers(
        long.withColumn("signed", signed), ["metric"], [F.col("signed"), F.col(key)], "rank")
    return ranked.drop("signed")


def higher_is_better(metric: Column) -> Column:
    name = F.lower(metric)
    low = name.rlike("|".join(BETTER_LOW)) & ~name.rlike("|".join(BETTER_HIGH))
    return ~low


def best_by_metric(metrics: DataFrame, names: Sequence[str], key: str = "version") -> DataFrame:
    """Best version per metric; equal values keep the first version by name."""
    long = metrics.select(key, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [key], list(names), "metric", "value").where("value is not null")
    cost = F.when(higher_is_better(F.col("metric")), -F.col("value")).otherwise(F.col("value"))
    best = F.min(F.struct(cost.alias("cost"), F.col(key), F.col("value"))).alias("_b")
    return long.groupBy("metric").agg(best).select(
        "metric", F.col(f"_b.{key}").alias(key), F.col("_b.value").alias("value"))


def nested_metric(json_col: Column, name: str) -> Column:
    """First number found under validation, training, cross-validation, then the root."""
    paths = [f"$.{p}.{name}" for p in METRIC_PATHS] + [f"$.{name}"]
    return F.coalesce(*[F.get_json_object(json_col, p).try_cast("double") for p in paths])


def comparison_summary(ranked: DataFrame, models: int, main: str = "r2_score", key: str = "version") -> DataFrame:
    """Leaders per metric, overall best by the main metric, and insight lines."""
    first = F.col("rank") == 1
    leaders = F.array_sort(F.collect_list(F.when(first, F.concat_ws("=", "metric", key))))
    is_main = F.col("metric") == main
    row = ranked.groupBy("metric").agg(
        F.min(F.when(first, F.col(key))).alias(key), F.min("rank").alias("rank"),
        F.max("value").alias("hi"), F.min("value").alias("lo"))
    base = row.agg(
        F.array_join(leaders, "; ").alias("metric_leaders"),
        F.max(F.when(is_main, F.col(key))).alias("best_overall_model"),
        F.max(F.when(is_main, F.col("hi"))).alias("hi"), F.max(F.when(is_main, F.col("lo"))).alias("lo"))
    several = F.lit(models > 1)
    insights = F.array_compact(F.array(
        F.when(several & (F.col("hi") - F.col("lo") > 0.1), "significant performance variation"),
        F.when(several & (F.col("hi") < 0.7), "moderate performance - consider feature engineering")
        .when(several & (F.col("hi") > 0.95), "very high performance - check for overfitting")))
    return base.select(F.lit(models).cast("long").alias("total_models_compared"), "best_overall_model",
                       "metric_leaders", F.array_join(insights, "; ").alias("insights"))


def top_features(importances: DataFrame, k: int | None = 10, normalise: bool = False) -> DataFrame:
    """Features by absolute weight (one row per feature); optionally scaled to sum to 1."""
    size = F.abs("weight")
    if normalise:
        size = size / F.sum(size).over(Window.partitionBy(F.lit(0)))
    out = importances.select("feature", size.alias("importance")).orderBy(F.col("importance").desc(), "feature")
    return out if k is None else out.limit(k)


def previous_version(deployments: DataFrame) -> DataFrame:
    """The deployment just before the active one, per model and environment."""
    active = deployments.where(F.col("status") == "active").groupBy("model_name", "environment").agg(
        F.max("deployment_date").alias("_at"))
    before = deployments.join(active, ["model_name", "environment"]).where(F.col("deployment_date") < F.col("_at"))
    newest = F.max_by(F.struct("version", "deployment_date"), F.struct("deployment_date", "version"))
    return before.groupBy("model_name", "environment").agg(newest.alias("_v")).select(
        "model_name", "environment", "_v.*")


def numbered_newest(df: DataFrame, by: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Position of each version within its name, newest first."""
    w = Window.partitionBy(*by).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_pos", F.row_number().over(w))


def retention_selection(
    df: DataFrame, keep: int, ts: str, tie: str, by: Sequence[str] = (), older_than_days: int | None = None,
    as_of: Column | None = None, protect_active: bool = False,
) -> DataFrame:
    """Versions to archive: beyond the newest ``keep`` of their name, or too old.

    The newest ``keep`` are found with a ranking limit that Spark applies in
    every task before the shuffle; the rest is everything not among them.
    """
    group = list(by) or ["_all"]
    data = df if by else df.withColumn("_all", F.lit(1))
    newest = numbered_newest(data, group, ts, tie).where(F.col("_pos") <= keep).select(*group, ts, tie)
    flagged = data.join(newest.withColumn("_keep", F.lit(True)), [*group, ts, tie], "left")
    test = F.col("_keep").isNull()
    if older_than_days is not None:
        test = test | (F.col(ts) < as_of - F.make_dt_interval(days=F.lit(older_than_days)))
    if protect_active:
        test = test & (F.col("status") != "active")
    return flagged.where(test).select(*df.columns)


def recent_degradation(
    history: DataFrame, days: int = 7, ratio: float = 0.95, by: Sequence[str] = ("model_name", "version"),
    ts: str = "timestamp", value: str = "metric_value", metric: str = "accuracy",
) -> DataFrame:
    """Rows whose accuracy fell below ``ratio`` of the mean over the days up to them.

    Every row also visits the following ``days``-wide block as context, so the
    range window runs per (model, block) and no model is one task's work.
    """
    rows = history.where(F.col("metric_name") == metric)
    width = days * 86_400
    block = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / width)
    spread = rows.withColumn("_own", block).withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = (Window.partitionBy(*by, "_block").orderBy(F.unix_micros(F.col(ts).cast("timestamp")))
         .rangeBetween(1 - width * 1_000_000, 0))
    out = spread.withColumns({"recent_average": F.avg(value).over(w), "recent_count": F.count(value).over(w)})
    out = out.where(F.col("_own") == F.col("_block")).drop("_own", "_block")
    return out.withColumn(
        "degraded", (F.col("recent_count") > 1) & (F.col(value) < F.col("recent_average") * ratio))


def list_versions(df: DataFrame, environment: str | None = None, ts: str = "deployment_date") -> DataFrame:
    """Newest first, with the metrics parsed and an active flag."""
    rows = df if environment is None else df.where(F.col("environment") == environment)
    parsed = F.from_json("performance_metrics", "map<string,double>")
    return rows.withColumns({
        "metrics": parsed, "is_active": F.col("status") == "active"}).orderBy(F.col(ts).desc(), "version")


def model_performance_lookup(df: DataFrame, version=None, json_col: str = "performance_metrics") -> DataFrame:
    """Validation r2, mse, mae and root mse; a missing figure reads as 0."""
    rows = df if version is None else df.where(F.col("version") == version)

    def figure(name: str) -> Column:
        return F.coalesce(F.get_json_object(json_col, f"$.validation.{name}").try_cast("double"), F.lit(0.0))

    return rows.select(
        "version", figure("r2_score").alias("r2_score"), figure("mse").alias("mse_score"),
        figure("mae").alias("mae_score"), F.sqrt(figure("mse")).alias("rmse_score"))
