"""Streaming rollups: batch twins, and replays of the given tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions import risk
from pulseframe.operators import training
from pulseframe.plans.catalog import query
from pulseframe.plans.frames import Tables
from pulseframe.plans.queries_tables import rounded
from pulseframe.session import work_dir
from pulseframe.streaming import streams


def event_stream(t: Tables):
    return streams.file_stream(t.spark, t.folder, t.events.schema, "events.parquet")


def scored_events(events):
    """The columns of a prediction, straight from arriving events."""
    score = F.least(F.col("value") / 150, F.lit(1.0))
    return events.select(F.col("event_id").alias("prediction_id"), F.col("ts").alias("created_at"), "user_id",
                         score.alias("risk_score")).withColumn("risk_category", risk.risk_category(F.col("risk_score")))


_LIVE = """
WITH k AS (SELECT TO_TIMESTAMP(CAST(FLOOR(EPOCH(created_at) / 30) AS BIGINT) * 30)::TIMESTAMP AS tick, COUNT(*) AS n, SUM(risk_score) AS s,
    SUM(CASE WHEN risk_category = 'low' THEN 1 ELSE 0 END) AS lo, SUM(CASE WHEN risk_category = 'medium' THEN 1 ELSE 0 END) AS me,
    SUM(CASE WHEN risk_category = 'high' THEN 1 ELSE 0 END) AS hi FROM predictions GROUP BY 1),
w AS (SELECT tick - i * INTERVAL 30 SECOND AS w, n, s, lo, me, hi FROM k, RANGE(120) r(i))
SELECT STRFTIME(w, '%Y-%m-%d %H:%M:%S') AS window_start, STRFTIME(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, SUM(n)::BIGINT AS total_predictions,
  SUM(lo)::BIGINT AS low_count, SUM(me)::BIGINT AS medium_count, SUM(hi)::BIGINT AS high_count, ROUND(SUM(s) / SUM(n), 8) AS average_risk_score FROM w GROUP BY w"""


@query("t1_live_statistics", _LIVE, ["predictions"])
def _(t: Tables):
    return streams.live_statistics(scored_events(t.events))


@query("t1_live_statistics_stream", _LIVE + """
HAVING w + INTERVAL 1 HOUR <= (SELECT MAX(created_at) FROM predictions) - INTERVAL 5 MINUTE""", ["predictions"])
def _(t: Tables):
    return streams.run_to_table(streams.live_statistics(scored_events(event_stream(t))), "live")


_FIXED = """
SELECT STRFTIME(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, COUNT(*) AS requests, COUNT(*) > 1 AS over_limit
FROM (SELECT TO_TIMESTAMP(CAST(FLOOR(EPOCH(ts) / 60) AS BIGINT) * 60)::TIMESTAMP AS w, event_type FROM events) GROUP BY w, event_type"""


@query("t2_fixed_window_counts", _FIXED)
def _(t: Tables):
    return streams.fixed_window_counts(t.events, "event_type", limit=1)


@query("t2_fixed_window_counts_stream", _FIXED + """
HAVING w + INTERVAL 60 SECOND <= (SELECT MAX(ts) FROM events) - INTERVAL 2 MINUTE""")
def _(t: Tables):
    return streams.run_to_table(streams.fixed_window_counts(event_stream(t), "event_type", limit=1), "windows")


_PARTS = ("2024-01-11", "2024-01-21", "2024-02-01")


@query("t3_incremental_ingest", """
WITH e AS (SELECT user_id, event_id, value, CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 1 ELSE 2 END AS b FROM events),
n AS (SELECT b, COUNT(*) AS processed, COUNT(DISTINCT user_id) AS keys FROM e GROUP BY b),
f AS (SELECT b, COUNT(*) AS inserted FROM (SELECT user_id, MIN(b) AS b FROM e GROUP BY user_id) GROUP BY b)
SELECT n.b AS run_number, processed AS records_processed, COALESCE(inserted, 0) AS inserted, keys - COALESCE(inserted, 0) AS updated, processed - keys AS skipped
FROM n LEFT JOIN f ON n.b = f.b""")
def _(t: Tables):
    """Three scheduled runs, each over the files landed since the one before."""
    base = work_dir(t.spark, "ingest")
    rows = t.events.select("user_id", "event_id", "ts", "value")
    start, counts = "2000-01-01", None
    for end in _PARTS:
        landed = rows.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        landed.write.mode("append").parquet(f"{base}/landing")
        stream = streams.file_stream(t.spark, f"{base}/landing", rows.schema)
        counts = streams.incremental_ingest(stream, f"{base}/state", ["user_id"], "event_id")
        start = end
    return counts


@query("t3_upserted_table", """
SELECT user_id, MAX(event_id) AS event_id, ROUND(MAX_BY(value, event_id), 6) AS value FROM events GROUP BY 1""")
def _(t: Tables):
    base = work_dir(t.spark, "upsert")
    rows = t.events.select("user_id", "event_id", "value")
    # Each part holds ids below and above those of the other.
    for part in ("event_type not in ('view', 'click')", "event_type in ('view', 'click')"):
        t.events.where(part).select(*rows.columns).write.mode("append").parquet(f"{base}/landing")
        stream = streams.file_stream(t.spark, f"{base}/landing", rows.schema)
        streams.incremental_ingest(stream, f"{base}/state", ["user_id"], "event_id")
    return rounded(streams.current_state(t.spark, f"{base}/state", ["user_id"], rows.schema))


@query("t4_stream_score", """
WITH a AS (SELECT AVG(event_id) AS mx, AVG(value) AS my FROM events),
b AS (SELECT SUM((event_id - mx) * (value - my)) / SUM((event_id - mx) * (event_id - mx)) AS b1 FROM events, a)
SELECT event_id, ROUND(my + b1 * (event_id - mx), 4) AS prediction FROM events, a, b""")
def _(t: Tables):
    """A model fitted on the table scores the rows as they arrive."""
    model = training.fit(t.events, ["event_id"], "value", "linear_regression")
    keyed = event_stream(t).select(F.col("event_id").alias("row"), "event_id")
    scored = streams.stream_score(keyed, lambda rows: training.predict(model, rows, ["event_id"], ["row"]))
    out = streams.run_to_table(scored, "scores")
    return out.select(F.col("row").alias("event_id"), F.round("prediction", 4).alias("prediction"))


_TTL = """
WITH RECURSIVE k AS (
  SELECT user_id, event_type, MIN({'ts': ts, 'id': event_id}) AS v FROM events GROUP BY user_id, event_type
  UNION ALL
  SELECT k.user_id, k.event_type, MIN({'ts': e.ts, 'id': e.event_id}) AS v FROM k JOIN events e
    ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.v.ts + INTERVAL 30 MINUTE GROUP BY k.user_id, k.event_type)
SELECT v.id AS event_id FROM k"""


@query("t5_dedup_ttl", _TTL)
def _(t: Tables):
    return streams.dedup_ttl_batch(t.events, ["user_id", "event_type"], tie="event_id").select("event_id")


@query("t5_dedup_ttl_stream", _TTL)
def _(t: Tables):
    """Three runs, each over the files landed since the one before."""
    base, out = work_dir(t.spark, "ttl"), None
    rows = t.events.select("event_id", "ts", "user_id", "event_type")
    for start, end in zip(("2000-01-01", *_PARTS), _PARTS):
        landed = rows.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        landed.write.mode("append").parquet(f"{base}/landing")
        stream = streams.file_stream(t.spark, f"{base}/landing", rows.schema)
        out = streams.run_to_table(streams.dedup_ttl(stream, ["user_id", "event_type"], tie="event_id"), "ttl", path=base)
    return out.select("event_id")


@query("t6_alert_stream", "SELECT prediction_id, 'high_risk' AS reason FROM predictions WHERE risk_score >= 0.7", ["predictions"])
def _(t: Tables):
    path = work_dir(t.spark, "alerts")
    streams.alert_stream(scored_events(event_stream(t)), path)
    return t.spark.read.parquet(f"{path}/rows").select("prediction_id", "reason")


_DAYS = """
SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS total, SUM(CASE WHEN risk_category = 'low' THEN 1 ELSE 0 END)::BIGINT AS low_risk,
  SUM(CASE WHEN risk_category = 'medium' THEN 1 ELSE 0 END)::BIGINT AS medium_risk, SUM(CASE WHEN risk_category = 'high' THEN 1 ELSE 0 END)::BIGINT AS high_risk,
  ROUND(AVG(risk_score), 4) AS avg_risk_score FROM predictions GROUP BY 1"""


@query("t7_daily_trend", _DAYS, ["predictions"])
def _(t: Tables):
    return streams.daily_trend_stream(scored_events(t.events))


@query("t7_daily_trend_stream", _DAYS + """
HAVING CAST(created_at AS DATE) + INTERVAL 1 DAY <= (SELECT MAX(created_at) FROM predictions) - INTERVAL 1 DAY""", ["predictions"])
def _(t: Tables):
    return streams.run_to_table(streams.daily_trend_stream(scored_events(event_stream(t))), "days")
