"""Summaries of predictions, datasets and requests.

All are partial/final aggregates over the rows where they lie. Medians and
other quantiles are found exactly beforehand and enter as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import risk
from pulseframe.operators import ordered, stats

TIMEFRAME_HOURS = {"1h": 1, "1d": 24, "7d": 168, "30d": 720, "90d": 2160, "1y": 8760}
LATENCY_EDGES_MS = (100, 500, 1000, 5000)
SLOW_MS = 5000


def r(col: Column, digits: int = 4) -> Column:
    return F.round(col, digits)


def _share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part * 100.0 / whole, digits)


def category_counts(category: Column) -> list[Column]:
    return [F.count_if(category == c).alias(f"{c}_count") for c in ("low", "medium", "high")]


def _median(df: DataFrame, col: str) -> Column:
    return F.lit(stats.quantiles(df, {col: [0.5]})[col][0]).cast("double")


def score_stats(score: str, median: Column) -> list[Column]:
    s = F.col(score)
    return [r(F.avg(s)).alias("average_risk_score"), r(F.max(median)).alias("median_risk_score"),
            r(F.stddev_pop(s)).alias("std_risk_score"), r(F.min(s)).alias("min_risk_score"),
            r(F.max(s)).alias("max_risk_score")]


def batch_summary(df: DataFrame, score: str = "risk_score", category: str = "risk_category") -> DataFrame:
    """Counts per category, score statistics and high share of the scored rows."""
    done = df.where(F.col(score).isNotNull())
    total = df.count()
    high = F.count_if(F.col(category) == "high")
    return done.agg(
        F.lit(total).cast("long").alias("total_predictions"),
        F.count(F.lit(1)).alias("successful_predictions"), *category_counts(F.col(category)),
        *score_stats(score, _median(done, score)),
        _share(high, F.count(F.lit(1))).alias("high_risk_percentage"))


def batch_analytics(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """Five-band counts, score statistics and insight lines."""
    done = df.where(F.col(score).isNotNull())
    s = F.col(score)
    band = risk.risk_band(s)
    high = F.count_if(s >= 0.7) * 100.0 / F.count(F.lit(1))
    base = done.agg(
        *[F.count_if(band == b).alias(b) for b in risk.BANDS], F.avg(s).alias("m"),
        F.stddev_pop(s).alias("sd"), F.min(s).alias("lo"), F.max(s).alias("hi"), high.alias("high_share"))
    shown = F.concat(F.lit("High percentage ("), F.format_number("high_share", 1),
                     F.lit("%) of patients are at high cardiovascular risk"))
    insights = F.array_compact(F.array(
        F.when(F.col("high_share") > 30, shown),
        F.when(F.col("m") > 0.6, "Overall patient population shows elevated cardiovascular risk"),
        F.when(F.col("sd") > 0.3, "High variability in risk scores suggests diverse patient population")))
    return base.select(*risk.BANDS, r(F.col("m")).alias("mean"), r(_median(done, score)).alias("median"),
                       r(F.col("sd")).alias("standard_deviation"), r(F.col("lo")).alias("min"),
                       r(F.col("hi")).alias("max"), insights.alias("clinical_insights"))


def history_summary(df: DataFrame) -> DataFrame:
    """Totals, feedback counts and time range; use per model version as a map column."""
    per_version = df.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("n"), *category_counts(F.col("risk_category")),
        F.sum("risk_score").alias("s"), F.count("risk_score").alias("k"),
        F.count("actual_outcome").alias("fb"), F.count_if("actual_outcome").alias("pos"),
        F.count_if(~F.col("actual_outcome")).alias("neg"),
        F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    return per_version.agg(
        F.sum("n").alias("total_predictions"),
        *[F.sum(f"{c}_count").alias(f"{c}_count") for c in ("low", "medium", "high")],
        r(F.sum("s") / F.sum("k")).alias("average_risk_score"),
        F.count(F.lit(1)).alias("model_versions"),
        F.sum("fb").alias("predictions_with_feedback"), F.sum("pos").alias("positive_outcomes"),
        F.sum("neg").alias("negative_outcomes"),
        F.date_format(F.min("lo"), "yyyy-MM-dd HH:mm:ss").alias("earliest"),
        F.date_format(F.max("hi"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


def model_usage(df: DataFrame) -> DataFrame:
    return df.groupBy("model_version").agg(F.count(F.lit(1)).alias("predictions"))


def in_timeframe(df: DataFrame, timeframe: str, as_of: str, ts: str = "created_at") -> DataFrame:
    """Rows of the last hour, day, … before ``as_of``; ``all`` keeps everything."""
    if timeframe == "all":
        return df
    if timeframe not in TIMEFRAME_HOURS:
        raise ValueError(f"unknown timeframe {timeframe}")
    at = F.lit(as_of).cast("timestamp_ntz")
    return df.where(F.col(ts) >= at - F.make_dt_interval(hours=F.lit(TIMEFRAME_HOURS[timeframe])))


def latest_time(df: DataFrame, ts: str = "created_at") -> str | None:
    row = df.agg(F.max(ts).cast("string")).first()
    return row[0]


def prediction_statistics(
    df: DataFrame, timeframe: str | Sequence[str] = "30d", as_of: str | None = None, user_id=None, ts: str = "created_at"
) -> DataFrame:
    """Totals, distribution, score statistics and model count of one or several timeframes.

    All timeframes come from one pass over the rows of the widest and one quantile
    search over a masked column each. A timeframe without rows has zero counts.
    """
    frames = [timeframe] if isinstance(timeframe, str) else list(timeframe)
    as_of = as_of or latest_time(df, ts)
    unknown = [f for f in frames if f != "all" and f not in TIMEFRAME_HOURS]
    if unknown:
        raise ValueError(f"unknown timeframe {unknown[0]}")
    widest = "all" if "all" in frames else max(frames, key=TIMEFRAME_HOURS.get)
    rows = in_timeframe(df, widest, as_of, ts)
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    at = F.lit(as_of).cast("timestamp_ntz")
    inside = {f: F.lit(True) if f == "all" else F.col(ts) >= at - F.make_dt_interval(hours=F.lit(TIMEFRAME_HOURS[f])) for f in frames}
    found = stats.quantiles(rows.select(*[F.when(i, F.col("risk_score")).alias(f) for f, i in inside.items()]), {f: [0.5] for f in frames})
    n, cat = F.count(F.lit(1)), F.col("risk_category")
    fits = F.array_compact(F.array(*[F.when(i, F.lit(f)) for f, i in inside.items()]))
    got = rows.select(F.explode(fits).alias("timeframe"), "risk_category", "risk_score", "model_version").groupBy("timeframe").agg(
        n.alias("total_predictions"), *category_counts(cat),
        *[_share(F.count_if(cat == c), n).alias(f"{c}_percentage") for c in ("low", "medium", "high")],
        *[c for c in score_stats("risk_score", F.lit(None).cast("double"))],
        F.count_distinct("model_version").alias("model_versions")).drop("median_risk_score")
    asked = df.sparkSession.createDataFrame([(f, found[f][0]) for f in frames], "timeframe string, median double")
    out = asked.join(got, "timeframe", "left")
    zero = [c for c in got.columns if c.endswith("_count") or c in ("total_predictions", "model_versions")]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero}).withColumn(
        "median_risk_score", r(F.col("median"))).drop("median")


def daily_trend(df: DataFrame, ts: str = "created_at") -> DataFrame:
    n = F.count(F.lit(1))
    cat = F.col("risk_category")
    return df.groupBy(F.to_date(ts).alias("day")).agg(
        n.alias("total"),
        *[F.count_if(cat == c).alias(f"{c}_risk") for c in ("low", "medium", "high")],
        r(F.avg("risk_score")).alias("avg_risk_score"),
        F.round(F.count_if(cat == "high") * 100.0 / n, 4).alias("high_risk_percentage"))


def outcome_performance(df: DataFrame) -> DataFrame:
    """Accuracy of "high" as a forecast of the outcome, over rows that have one."""
    known = F.col("actual_outcome").isNotNull()
    hit = known & ((F.col("risk_category") == "high") == F.col("actual_outcome"))
    return df.agg(
        F.count_if(known).alias("predictions_with_outcomes"),
        r(F.count_if(hit) / F.nullif(F.count_if(known).cast("double"), F.lit(0.0))).alias("accuracy"),
        r(F.count_if(known) / F.count(F.lit(1))).alias("feedback_rate"),
        F.count_if("actual_outcome").alias("positive_outcomes"),
        F.count_if(~F.col("actual_outcome")).alias("negative_outcomes"))


def statistics_insights(statistics: DataFrame) -> DataFrame:
    """Insight lines of a statistics row."""
    lines = F.array_compact(F.array(
        F.when(F.col("high_percentage") > 25, "High percentage of patients classified as high-risk"),
        F.when(F.col("average_risk_score") > 0.6, "Patient population shows elevated cardiovascular risk"),
        F.when(F.col("model_versions") > 1, "Multiple models are being used for predictions")))
    return statistics.select("timeframe", lines.alias("insights"))


def dataset_statistics(df: DataFrame, as_of: str) -> DataFrame:
    """Per dataset type and overall (type null): counts, records, size, recency, quality."""
    recent = F.col("created_at") > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(30))
    mb = F.coalesce(F.col("file_size_bytes"), F.lit(0)) / F.lit(1048576.0)
    return df.rollup("dataset_type").agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("total_records").alias("records"),
        F.round(F.sum(mb), 2).alias("size_mb"), F.count_if(recent).alias("added_last_30_days"),
        F.round(F.sum(mb) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("average_size_mb"),
        r(F.coalesce(F.avg(F.when(F.col("completeness_score") != 0, F.col("completeness_score"))), F.lit(0.0)))
        .alias("average_completeness"),
        F.count_if(F.col("validation_status") == "passed").alias("validated_datasets"))


def peer_percentile(
    df: DataFrame, cell: Sequence[str] = ("age_group", "gender"), score: str = "risk_score",
    chunk_rows: int = ordered.CHUNK_ROWS,
) -> DataFrame:
    """Mean score of each row's cell and the share of the cell below the row.

    A cell can hold a third of the table, so ranks come from counts of distinct
    scores rather than from a window over the cell's rows. Rows without a
    score keep null.
    """
    cell = list(cell)
    ranks = ordered.percent_ranks(df, score, by=cell, chunk_rows=chunk_rows)
    means = df.groupBy(*cell).agg(F.avg(score).alias("peer_average"))
    right = ranks.select(*[F.col(c).alias(f"_r_{c}") for c in (*cell, score)],
                         F.col("percent_rank").alias("percentile"))
    match = F.col(score) == F.col(f"_r_{score}")
    same = None
    for c in cell:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = F.col(c).eqNullSafe(F.col(f"_m_{c}"))
        same = cond if same is None else same & cond
    means = means.select(*[F.col(c).alias(f"_m_{c}") for c in cell], "peer_average")
    out = df.join(right, match, "left").join(means, same, "left")
    return out.drop(*[f"_r_{c}" for c in (*cell, score)], *[f"_m_{c}" for c in cell])


def request_metrics(
    df: DataFrame, keys: Sequence[str] = ("method", "endpoint", "status_code"), latency: str = "response_time_ms"
) -> DataFrame:
    """Requests per key with a latency histogram, slow count and error share."""
    t = F.col(latency)
    n = F.count(F.lit(1))
    lows = (float("-inf"), *LATENCY_EDGES_MS)
    highs = (*LATENCY_EDGES_MS, float("inf"))
    names = [f"le_{e}" for e in LATENCY_EDGES_MS] + ["over"]
    hist = [F.count_if((t > lo) & (t <= hi)).alias(f"latency_{name}") for lo, hi, name in zip(lows, highs, names)]
    return df.groupBy(*keys).agg(
        n.alias("requests"), *hist, F.count_if(t > SLOW_MS).alias("slow_requests"),
        r(F.count_if(F.col("status_code") >= 400) / n).alias("error_share"),
        r(F.avg(t)).alias("avg_response_time_ms"))
