"""Sources, joins, rankings, jobs and streams on small fixtures."""

import datetime as dt
import random
import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import joins, ranking
from pulseframe.plans import jobs
from pulseframe.session import work_dir
from pulseframe.sources import io
from pulseframe.streaming import streams


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_read_table_refuses_other_suffixes(spark):
    with pytest.raises(ValueError):
        io.read_table(spark, "/nowhere/data.xlsx")


def _session(master, folder):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_work_dir_uses_the_cluster_folder():
    assert work_dir(_session("yarn", "hdfs://shared/run"), "x").startswith("hdfs://shared/run/x-")
    with pytest.raises(RuntimeError):
        work_dir(_session("yarn", None), "x")


def test_versions_and_latest(spark, tmp_path):
    for v, n in (("1", 3), ("2", 5)):
        io.write_dual(spark.range(n), str(tmp_path), "t", v)
    assert io.versions(spark, f"{tmp_path}/t_parquet") == ["1", "2"]
    assert io.latest_version(spark, f"{tmp_path}/t_parquet").count() == 5
    assert io.latest_version(spark, f"{tmp_path}/none") is None


def test_corrupt_lines_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2.5\n2,oops\n")
    schema = spark.createDataFrame([], "id int, v double").schema
    rows = {r["id"]: r for r in io.read_extract_csv(spark, str(tmp_path), schema).collect()}
    assert rows[1]["v"] == 2.5 and rows[1][io.CORRUPT] is None
    assert rows[2]["v"] is None and rows[2][io.CORRUPT] == "2,oops"


def test_fingerprint_ignores_row_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 3)
    a = io.content_fingerprint(df).first()
    assert a == io.content_fingerprint(df.repartition(5, "v").orderBy(F.desc("id"))).first()
    assert a != io.content_fingerprint(df.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v")))).first()


def test_merge_matches_null_keys_and_adds_suffixes(spark):
    a = spark.createDataFrame([("AL", 2020, 1.0), (None, 2020, 2.0)], "locationdesc string, yearstart int, datavalue double")
    b = spark.createDataFrame([("AL", 2020, 9.0), (None, 2020, 8.0), ("AK", 2021, 7.0)], "locationdesc string, yearstart int, datavalue double")
    out = joins.merge_sources({"a": a, "b": b})
    assert out.columns == ["locationdesc", "yearstart", "datavalue", "datavalue_b"]
    assert {tuple(r) for r in out.collect()} == {("AL", 2020, 1.0, 9.0), (None, 2020, 2.0, 8.0), ("AK", 2021, None, 7.0)}


def test_apply_feedback_takes_the_last_of_each_field(spark):
    p = spark.createDataFrame([(1, None, None, None), (2, True, None, 3)],
                              "prediction_id int, actual_outcome boolean, outcome_date date, feedback_score int")
    f = spark.createDataFrame([
        (1, 1, ts("2024-01-01"), True, dt.date(2024, 1, 1), None), (2, 1, ts("2024-01-03"), None, None, 4),
        (3, 1, ts("2024-01-02"), False, dt.date(2024, 1, 2), 5)],
        "feedback_id int, prediction_id int, feedback_date timestamp, actual_outcome boolean, outcome_date date, provider_rating int")
    got = {r["prediction_id"]: tuple(r)[1:] for r in joins.apply_feedback(p, f).select(*p.columns).collect()}
    assert got == {1: (False, dt.date(2024, 1, 2), 4), 2: (True, None, 3)}


def test_medications_at_visits(spark):
    d = dt.date
    meds = spark.createDataFrame([(1, d(2020, 1, 1), d(2020, 1, 10)), (1, d(2020, 1, 5), None), (2, d(2021, 1, 1), None)],
                                 "patient_id int, start_date date, end_date date")
    visits = spark.createDataFrame([(1, d(2020, 1, 1)), (1, d(2020, 1, 10)), (1, d(2020, 1, 11)), (1, d(2019, 1, 1)), (3, d(2020, 1, 1))],
                                   "patient_id int, visit_date date")
    got = {(r["patient_id"], r["visit_date"]): r["active_medications"] for r in joins.medications_at(visits, meds).collect()}
    assert list(got.values()) and got == {(1, d(2020, 1, 1)): 1, (1, d(2020, 1, 10)): 2, (1, d(2020, 1, 11)): 1,
                                          (1, d(2019, 1, 1)): 0, (3, d(2020, 1, 1)): 0}


def test_recent_degradation_window(spark):
    rows = [("m", "v", ts("2024-01-01"), "accuracy", 0.9), ("m", "v", ts("2024-01-05"), "accuracy", 0.8),
            ("m", "v", ts("2024-01-08"), "accuracy", 0.79), ("m", "v", ts("2024-02-01"), "accuracy", 0.1)]
    df = spark.createDataFrame(rows, "model_name string, version string, timestamp timestamp, metric_name string, metric_value double")
    got = [(round(r["recent_average"], 4), r["degraded"]) for r in ranking.recent_degradation(df).orderBy("timestamp").collect()]
    assert got == [(0.9, False), (0.85, True), (0.795, False), (0.1, False)]


def test_retention_never_takes_the_active_version(spark):
    rows = [("m", str(i), "active" if i == 1 else "inactive", ts(f"2024-01-0{i}")) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "model_name string, version string, status string, at timestamp")
    out = ranking.retention_selection(df, 3, "at", "version", ["model_name"], protect_active=True)
    assert sorted(r["version"] for r in out.collect()) == ["2", "3", "4"]


def test_ingest_job_reports_a_failing_source(spark, tmp_path):
    good = spark.createDataFrame([("alabama", 2020, 1.5), ("alaska", 2020, 2.5)], "LocationDesc string, YearStart int, DataValue double")
    bad = spark.createDataFrame([("x", 1)], "LocationDesc string, Amount int").withColumn(
        "Amount", F.raise_error(F.lit("broken")).cast("int"))
    merged, summary = jobs.ingest_job({"good": good, "bad": bad}, str(tmp_path), "2024-01-31 00:00:00")
    got = {r["source"]: (r["rows_kept"], r["failure"] is None) for r in summary.collect()}
    assert got == {"good": (2, True), "bad": (None, False)}
    assert {r["locationdesc"] for r in merged.collect()} == {"ALABAMA", "ALASKA"}


EVENTS = "user_id int, ts timestamp_ntz, value int"


def _land(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_ingest_is_scheduled_and_counts(spark, tmp_path):
    schema = spark.createDataFrame([], EVENTS).schema
    land, state = f"{tmp_path}/land", f"{tmp_path}/state"
    first = [(1, ts("2024-01-01"), 5), (1, ts("2024-01-02"), 6), (2, ts("2024-01-01"), 7)]
    later = [(2, ts("2024-01-01"), 7), (1, ts("2024-01-03"), 9), (3, ts("2024-01-03"), 1)]
    for rows in (first, later):
        _land(spark, land, rows)
        counts = streams.incremental_ingest(streams.file_stream(spark, land, schema), state, ["user_id"], "ts")
    got = {r["run_number"]: (r["records_processed"], r["inserted"], r["updated"], r["skipped"]) for r in counts.collect()}
    assert got == {0: (3, 2, 0, 1), 1: (3, 1, 1, 1)}
    now = {r["user_id"]: r["value"] for r in streams.current_state(spark, state, ["user_id"], schema).collect()}
    assert now == {1: 9, 2: 7, 3: 1}


def test_late_rows_are_dropped_and_closed_days_emitted(spark, tmp_path):
    schema = "created_at timestamp_ntz, risk_score double, risk_category string"
    typed = spark.createDataFrame([], schema).schema
    land = f"{tmp_path}/land"
    # A row is late against the watermark the batch before it started with.
    batches = [[("2024-01-01 10:00:00", 0.2, "low"), ("2024-01-04 09:00:00", 0.8, "high")], [("2024-01-04 09:30:00", 0.1, "low")],
               [("2024-01-01 11:00:00", 0.9, "high"), ("2024-01-04 10:00:00", 0.6, "medium"), ("2024-01-09 00:00:00", 0.1, "low")]]
    for b in batches:
        spark.createDataFrame([(ts(a), s, c) for a, s, c in b], schema).coalesce(1).write.mode("append").parquet(land)
    stream = streams.file_stream(spark, land, typed, files_per_trigger=1)
    out = streams.run_to_table(streams.daily_trend_stream(stream), "days")
    got = {str(r["day"]): (r["total"], r["high_risk"]) for r in out.collect()}
    assert got == {"2024-01-01": (1, 0), "2024-01-04": (3, 1)}


def test_dedup_within_ttl_is_one_rule_in_batch_and_stream(spark, tmp_path):
    at = ["2024-01-01 00:00:00", "2024-01-01 00:20:00", "2024-01-01 00:30:00", "2024-01-01 00:55:00", "2024-01-01 01:05:00",
          "2024-01-01 05:00:00", "2024-01-03 00:00:00"]
    rows = [(1, ts(x), k) for k, x in enumerate(at)] + [(2, ts("2024-01-01 00:10:00"), 7), (2, ts("2024-01-01 00:10:00"), 8)]
    df = spark.createDataFrame(rows, EVENTS)
    want = [0, 2, 4, 5, 6, 7]
    assert sorted(r["value"] for r in streams.dedup_ttl_batch(df, ["user_id"], tie="value").collect()) == want
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    for name, parts in (("one", [ordered]), ("each", [[r] for r in ordered]), ("some", [ordered[:3], ordered[3:5], ordered[5:]])):
        for part in parts:
            _land(spark, f"{tmp_path}/{name}/land", part)
            stream = streams.file_stream(spark, f"{tmp_path}/{name}/land", df.schema)
            out = streams.run_to_table(streams.dedup_ttl(stream, ["user_id"], tie="value"), "ttl", path=f"{tmp_path}/{name}")
        assert sorted(r["value"] for r in out.collect()) == want, name


def _brute_ttl(rows, seconds):
    last, out = {}, []
    for k, at, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or at >= last[k] + dt.timedelta(seconds=seconds):
            last[k] = at
            out.append(v)
    return sorted(out)


@pytest.mark.parametrize("seconds", [1800, 100_000])
def test_dedup_within_ttl_cuts_a_key_without_gaps_into_tasks(spark, seconds):
    draw = random.Random(seconds)
    rows = [(k, ts("1969-12-28") + dt.timedelta(seconds=draw.randrange(8 * 86_400)), v) for v, k in enumerate([1] * 3_000 + [2] * 40 + [None] * 300)]
    df = spark.createDataFrame(rows, EVENTS)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = streams.dedup_ttl_batch(df, ["user_id"], tie="value", seconds=seconds).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(r["value"] for r in got) == _brute_ttl(rows, seconds)
    assert len({r["task"] for r in got if r["user_id"] == 1}) > 1


def test_rows_without_a_time_go_through(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "HELD_BYTES", 10)
    rows = [(1, ts("2024-01-01"), 0), (1, None, 1), (1, ts("2024-01-01 00:10:00"), 2), (1, None, 3), (2, None, 4), (1, ts("2024-01-01 00:30:00"), 5)]
    df = spark.createDataFrame(rows, EVENTS)
    assert sorted(r["value"] for r in streams.dedup_ttl_batch(df, ["user_id"], tie="value").collect()) == [0, 1, 3, 4, 5]
    for part in (rows[:4], rows[4:], [(1, None, 6), (1, ts("2024-01-01 00:59:00"), 7)]):
        _land(spark, f"{tmp_path}/land", part)
        stream = streams.file_stream(spark, f"{tmp_path}/land", df.schema)
        out = streams.run_to_table(streams.dedup_ttl(stream, ["user_id"], tie="value"), "ttl", path=f"{tmp_path}")
    assert sorted(r["value"] for r in out.collect()) == [0, 1, 3, 4, 5, 6]


def test_keys_of_a_group_share_a_state_and_keep_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "TTL_GROUPS", 2)
    draw = random.Random(4)
    rows = sorted([(draw.choice([None, *range(12)]), ts("2024-01-01") + dt.timedelta(seconds=draw.randrange(7_200)), v) for v in range(400)], key=lambda r: (r[1], r[2]))
    schema = spark.createDataFrame([], EVENTS).schema
    for part in (rows[:150], rows[150:300], rows[300:]):
        _land(spark, f"{tmp_path}/land", part)
        stream = streams.file_stream(spark, f"{tmp_path}/land", schema)
        out = streams.run_to_table(streams.dedup_ttl(stream, ["user_id"], tie="value"), "ttl", path=f"{tmp_path}")
    assert sorted(r["value"] for r in out.collect()) == _brute_ttl(rows, 1800)
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() <= 2  # not one for each of 13 keys


def test_a_key_is_told_from_one_that_is_nearly_equal(spark):
    df = spark.createDataFrame([(0.0, dt.datetime(2024, 1, 1, 0, 0, 0, 1)), (-0.0, dt.datetime(2024, 1, 1, 0, 0, 0, 1)), (0.0, dt.datetime(2024, 1, 1, 0, 0, 0, 2)), (None, None)], "a double, b timestamp")
    keys = [r[0] for r in df.select(streams._ttl_key(df, ["a", "b"])).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3 and None not in keys


def test_an_older_version_never_replaces_a_newer_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT_EVERY", 2)
    schema = spark.createDataFrame([], EVENTS).schema
    land, state = f"{tmp_path}/land", f"{tmp_path}/state"
    days = [10, 5, 11, 3, 12, 12, 1]
    for k, day in enumerate(days):
        _land(spark, land, [(1, ts(f"2024-01-{day:02d}"), day), (100 + k, ts("2024-01-01"), k)])
        counts = streams.incremental_ingest(streams.file_stream(spark, land, schema), state, ["user_id"], "ts")
    got = {r["run_number"]: (r["inserted"], r["updated"], r["skipped"]) for r in counts.collect()}
    assert got == {0: (2, 0, 0), 1: (1, 0, 1), 2: (1, 1, 0), 3: (1, 0, 1), 4: (1, 1, 0), 5: (1, 0, 1), 6: (1, 0, 1)}
    now = {r["user_id"]: r["value"] for r in streams.current_state(spark, state, ["user_id"], schema).collect()}
    assert now == {1: 12} | {100 + k: k for k in range(7)}


def test_the_table_is_its_compaction_and_the_batches_since(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT_EVERY", 3)
    schema = spark.createDataFrame([], EVENTS).schema
    land, state = f"{tmp_path}/land", f"{tmp_path}/state"
    want = {}
    for k in range(8):
        rows = [(u, ts(f"2024-01-{k + 1:02d}"), 10 * k + u) for u in range(k, k + 4)]
        want |= {u: v for u, _, v in rows}
        _land(spark, land, rows)
        streams.incremental_ingest(streams.file_stream(spark, land, schema), state, ["user_id"], "ts")
        for folder in streams.superseded(spark, state):
            shutil.rmtree(folder, ignore_errors=True)  # nothing reads them
        now = streams.current_state(spark, state, ["user_id"], schema)
        assert {r["user_id"]: r["value"] for r in now.collect()} == want
    assert streams._manifest(spark, state) == (6, 7)
    read = {f.split("key_bucket")[0].rstrip("/").split("/")[-1] for f in now.inputFiles()}
    assert read == {"upto=6", "batch=6", "batch=7"}
    # A batch that was begun and not committed is no part of the table; a repeated one may come after its folders went.
    streams._write_bucketed(spark.createDataFrame([(99, None, 1)], schema), ["user_id"], f"{state}/table/batch=8")
    assert streams.current_state(spark, state, ["user_id"], schema).where("user_id = 99").isEmpty()
    assert streams._compacted(spark, state, 6, ["user_id"], "ts", schema) == 6
    assert {r["user_id"]: r["value"] for r in streams.current_state(spark, state, ["user_id"], schema).collect()} == want


def test_a_merge_reads_the_buckets_of_the_arriving_keys(spark, tmp_path):
    schema = spark.createDataFrame([], EVENTS).schema
    rows = spark.createDataFrame([(u, ts("2024-01-01"), u) for u in range(500)], schema)
    streams._write_bucketed(rows, ["user_id"], f"{tmp_path}/table/batch=0")
    stored = streams._rows_of(spark, str(tmp_path), 0, 1, schema)
    bucket = rows.where("user_id = 7").select(streams._bucket(["user_id"])).first()[0]
    pruned = stored.where(F.col("key_bucket").isin([bucket]))
    assert "PartitionFilters: [isnotnull(key_bucket" in pruned._jdf.queryExecution().toString()
    assert pruned.where("user_id = 7").count() == 1 and 0 < pruned.count() < 50 and stored.count() == 500
