"""Structured Streaming forms of the rollups.

Each transformation takes a streaming or a plain DataFrame, so the batch twin
runs the very same code. Event-time state is bounded by a watermark.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions import risk
from pulseframe.session import work_dir


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
                files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process everything available into a file table and read it back; with ``path``, go on where the last run ended."""
    spark = stream.sparkSession
    out, state = (f"{path}/rows", f"{path}/state") if path else (work_dir(spark, name), work_dir(spark, f"{name}-state"))
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state)
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Process what has arrived since the last run that used the folder ``state``."""
    query = (stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _marked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarked event time; the watermark needs a zoned timestamp."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def live_statistics(df: DataFrame, ts: str = "created_at", span: str = "1 hour", slide: str = "30 seconds",
                    delay: str = "5 minutes") -> DataFrame:
    """Counts and mean score of the last hour, renewed every half minute.

    Rows are first reduced to one partial per half minute; the hour windows are
    then built from those partials, so a row is not copied into every window.
    """
    cat = F.col("risk_category")
    tick = _marked(df, ts, delay).groupBy(F.window(ts, slide).alias("tick")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("s"),
        *[F.count_if(cat == c).alias(c) for c in ("low", "medium", "high")])
    hours = tick.groupBy(F.window(F.window_time("tick"), span, slide).alias("w")).agg(
        F.sum("n").alias("total_predictions"), F.sum("s").alias("score_sum"),
        *[F.sum(c).alias(f"{c}_count") for c in ("low", "medium", "high")])
    return hours.select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "total_predictions",
        "low_count", "medium_count", "high_count",
        F.round(F.col("score_sum") / F.col("total_predictions"), 8).alias("average_risk_score"))


def fixed_window_counts(df: DataFrame, key: str, ts: str = "ts", span: str = "60 seconds", limit: int = 100,
                        delay: str = "2 minutes") -> DataFrame:
    counts = _marked(df, ts, delay).groupBy(F.window(ts, span).alias("w"), key).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), key, "requests",
                         (F.col("requests") > limit).alias("over_limit"))


def stream_score(df: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score arriving rows; a fitted model's ``transform`` works on both kinds."""
    return scorer(df)


#: A time so early that any row may follow it, and the bytes of a group's rows that a stream worker holds in memory.
_NEVER, HELD_BYTES = -(2 ** 62), 16_000_000
#: Groups that a stream's keys are dealt into by hash: each has one state, which holds the keys that are live.
TTL_GROUPS = 1_024


def _ttl_filter(at: np.ndarray, last: int | None, ttl: int) -> tuple[np.ndarray, int | None]:
    """Which of the ascending times are let through, and the last one that was."""
    kept = np.zeros(len(at), bool)
    i = 0 if last is None else int(np.searchsorted(at, last + ttl))
    while i < len(at):
        kept[i], last = True, int(at[i])
        i = int(np.searchsorted(at, last + ttl))
    return kept, last


def _ttl_key(df: DataFrame, keys: list[str]):
    """The key columns as one string: equal for the rows that a grouping by them puts together."""
    floating = (T.FloatType, T.DoubleType)
    cols = [(F.col(k) + F.lit(0).cast(df.schema[k].dataType)).alias(k) if isinstance(df.schema[k].dataType, floating) else F.col(k) for k in keys]  # -0.0 is 0.0
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.to_json(F.struct(*cols), exact)


def dedup_ttl(df: DataFrame, keys: list[str], ts: str = "ts", tie: str | None = None, seconds: int = 1800,
              delay: str = "30 minutes") -> DataFrame:
    """A row goes through when none of its key did in the ``seconds`` before it.

    The time to live runs from the row that went through, so repeats do not
    extend it. The state of a key is one time stamp, and goes when the watermark has passed
    its end. Rows of one micro-batch are taken in order of time and ``tie``. A row without a
    time repeats none and goes through.

    Keys are dealt into groups by hash, as a call of a worker costs some milliseconds: a call takes a group's keys
    together. Of a group's rows in a micro-batch the distinct keys and times and the rows let through are in
    memory; the rows wait in a temporary file of the worker when they are many.
    """
    ttl = seconds * 1_000_000
    order = ["_code", "_at", tie] if tie else ["_code", "_at"]
    rows = _marked(df, ts, delay).withColumns({"_at": F.unix_micros(ts), "_key": _ttl_key(df, keys)})
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(TTL_GROUPS)).cast("int"))
    added = ["_at", "_key", "_group"]

    def run(_, batches, state):
        last = dict(zip(*state.get)) if state.exists else {}
        if not state.hasTimedOut:
            with tempfile.SpooledTemporaryFile(HELD_BYTES) as waiting:
                codes, spots = {}, []
                for rows in batches:
                    at, names = pd.factorize(rows["_key"])
                    rows["_code"] = np.array([codes.setdefault(k, len(codes)) for k in names], np.int64)[at]
                    timed = rows["_at"].notna()
                    if not timed.all():
                        yield rows[~timed].drop(columns=[*added, "_code"])
                    rows = rows[timed].astype({"_at": "int64"}).drop(columns=["_key", "_group"])
                    pickle.dump(rows, waiting, pickle.HIGHEST_PROTOCOL)
                    spots.append(rows[["_code", "_at"]].drop_duplicates())
                spot = pd.concat(spots).drop_duplicates().sort_values(["_code", "_at"])
                code, at = spot["_code"].to_numpy(), spot["_at"].to_numpy()
                names, kept = list(codes), np.zeros(len(at), bool)
                first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(code)]):
                    key = names[code[a]]
                    kept[a:b], last[key] = _ttl_filter(at[a:b], last.get(key), ttl)
                spot, through = spot[kept], []
                waiting.seek(0)
                for _ in spots:
                    through.append(pickle.load(waiting).merge(spot, on=["_code", "_at"]))
                    through = [pd.concat(through).sort_values(order, kind="stable").drop_duplicates(["_code", "_at"])]
                if through and len(through[0]):
                    yield through[0].drop(columns=["_code", "_at"])
        mark = state.getCurrentWatermarkMs()
        live = {k: t for k, t in last.items() if (t + ttl) // 1000 > mark}
        if live:
            state.update((list(live), list(live.values())))
            state.setTimeoutTimestamp((min(live.values()) + ttl) // 1000)
        elif state.exists:
            state.remove()

    out = T.StructType([f for f in rows.schema if f.name not in added])
    return rows.groupBy("_group").applyInPandasWithState(run, out, "keys array<string>, last array<long>", "append", "EventTimeTimeout")


def _ttl_steps(at: np.ndarray, since: int, ttl: int) -> tuple[list[int], list[int]]:
    """(enter, leave): what a chunk of times from ``since`` on makes of the last time let through before it.

    If no row may go through before the time t, the chunk leaves the ``leave`` of the first ``enter``
    at or after t as the last one, and without one what came in. Both ascend.
    """
    at = np.unique(at)
    ahead, leave = np.searchsorted(at, at + ttl).tolist(), at.tolist()
    for i in range(len(at) - 1, -1, -1):
        if ahead[i] < len(leave):
            leave[i] = leave[ahead[i]]
    reached = int(np.searchsorted(at, since + ttl)) + 1  # what came in is before the chunk
    at, leave = at[:reached], np.array(leave[:reached])
    turn = np.flatnonzero(np.append(leave[1:] != leave[:-1], True))
    return at[turn].tolist(), leave[turn].tolist()


def _step_rows(rows: list[tuple]):
    if rows:
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["_key", "_chunk", "enter", "leave"])


def _ttl_runs(batch: pa.RecordBatch):
    """(key, chunk, first, end) of the runs of a batch sorted by key and chunk."""
    keys, chunks = batch.column("_key").to_numpy(zero_copy_only=False), batch.column("_chunk").to_numpy()
    if len(keys):
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1]))))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
            yield keys[a], int(chunks[a]), a, b


def dedup_ttl_batch(df: DataFrame, keys: list[str], ts: str = "ts", tie: str | None = None, seconds: int = 1800) -> DataFrame:
    """Batch form of the same rule; a key's rows are cut into chunks of a day, which are separate groups.

    What a chunk needs of those before it is one time stamp. A first pass over the times finds what each chunk
    would make of any such time stamp, a second one over a row per chunk passes it on along the key, and in the third
    the chunks, each behind the time stamp it gets, go through by themselves. Rows without a time all go through.
    """
    ttl = seconds * 1_000_000
    width, names = max(ttl, 86_400_000_000), df.columns
    spot = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.where(spot.isNotNull()).withColumn("_at", spot).withColumn("_key", F.to_json(F.struct(*keys)))
    rows = rows.withColumn("_chunk", F.expr(f"(_at - pmod(_at, {width}L)) div {width}L"))

    def steps(batches):
        name, held = None, []
        for batch in batches:
            at, out = batch.column("_at").to_numpy(), []
            for key, chunk, a, b in _ttl_runs(batch):
                if (key, chunk) != name:
                    if held:
                        out.append((*name, *_ttl_steps(np.concatenate(held), name[1] * width, ttl)))
                    name, held = (key, chunk), []
                held.append(np.unique(at[a:b]))
            yield from _step_rows(out)
        if held:
            yield from _step_rows([(*name, *_ttl_steps(np.concatenate(held), name[1] * width, ttl))])

    def passed_on(batches):
        key, last = None, _NEVER
        for batch in batches:
            given = []
            for name, enter, leave in zip(*(batch.column(c).to_pylist() for c in ("_key", "enter", "leave"))):
                if name != key:
                    key, last = name, _NEVER
                given.append(last)
                j = int(np.searchsorted(enter, last + ttl))
                last = leave[j] if j < len(enter) else last
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_chunk"), pa.array(given, pa.int64())], names=["_key", "_chunk", "_at"])

    def run(batches):
        last = _NEVER
        for batch in batches:
            at, data = batch.column("_at").to_numpy(), batch.column("_data").to_numpy(zero_copy_only=False).astype(bool)
            kept = np.zeros(len(at), bool)
            for _, _, a, b in _ttl_runs(batch):
                if not data[a]:
                    a, last = a + 1, int(at[a])
                kept[a:b], last = _ttl_filter(at[a:b], last, ttl)
            yield batch.filter(pa.array(kept)).select(names)

    times = rows.select("_key", "_chunk", "_at").repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk")
    table = times.mapInArrow(steps, "_key string, _chunk long, enter array<long>, leave array<long>")
    marks = table.repartition("_key").sortWithinPartitions("_key", "_chunk").mapInArrow(passed_on, "_key string, _chunk long, _at long")
    marks = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema], "_at", "_key", "_chunk", F.lit(False).alias("_data"))
    dealt = rows.withColumn("_data", F.lit(True)).unionByName(marks).repartition("_key", "_chunk")
    dealt = dealt.sortWithinPartitions("_key", "_chunk", "_data", "_at", *([tie] if tie else []))
    return dealt.mapInArrow(run, df.schema).unionByName(df.where(spot.isNull()))


def alert_rows(df: DataFrame, score: str = "risk_score", threshold: float = risk.HIGH_FROM) -> DataFrame:
    """High-risk rows and rows that break the score rule."""
    s = F.col(score)
    reason = F.when(s.isNull() | (s < 0) | (s > 1), "invalid_score").when(s >= threshold, "high_risk")
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def alert_stream(stream: DataFrame, path: str) -> None:
    """Append the alerts of every micro-batch to a file table, marked with its number.

    The batch number is the folder name: a batch repeated after a failure
    replaces its own output.
    """
    def write(batch: DataFrame, number: int) -> None:
        alert_rows(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    run_batches(stream, write, f"{path}/state")


def daily_trend_stream(df: DataFrame, ts: str = "created_at", delay: str = "1 day") -> DataFrame:
    cat = F.col("risk_category")
    n = F.count(F.lit(1))
    days = _marked(df, ts, delay).groupBy(F.window(ts, "1 day").alias("w")).agg(
        n.alias("total"), *[F.count_if(cat == c).alias(f"{c}_risk") for c in ("low", "medium", "high")],
        F.avg("risk_score").alias("m"))
    return days.select(F.to_date("w.start").alias("day"), "total", "low_risk", "medium_risk", "high_risk",
                       F.round("m", 4).alias("avg_risk_score"))


def newest_arrivals(arriving: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key of a batch: the one of greatest version, and how many arrived."""
    values = [c for c in arriving.columns if c not in keys]
    return arriving.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(F.col(version), F.struct(*values))).alias("_new"), F.count(F.lit(1)).alias("_rows"))


def upsert_delta(stored: DataFrame | None, arriving: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The arriving keys with ``_state`` inserted, updated, equal or older, and the rows that arrived.

    ``stored`` holds rows of earlier batches; a key's greatest version counts, and
    an arriving version below it is older, whatever order they come in. Only the
    keys that arrive are looked up, so the table is not shuffled when the
    batch is small enough for Spark to broadcast.
    """
    values = [c for c in arriving.columns if c not in keys]
    fresh = newest_arrivals(arriving, keys, version)
    if stored is None:
        marked = fresh.withColumn("_state", F.lit("inserted"))
    else:
        old = stored.join(fresh.select(*keys), keys, "left_semi").groupBy(*keys).agg(
            F.max_by(F.struct(*values), F.struct(F.col(version), "batch")).alias("_old"))
        state = (F.when(F.col("_old").isNull(), "inserted")
                 .when(F.col("_old").eqNullSafe(F.col("_new")), "equal")
                 .when(F.col(f"_new.{version}") < F.col(f"_old.{version}"), "older").otherwise("updated"))
        marked = fresh.join(old, keys, "left").withColumn("_state", state)
    return marked.select(*keys, "_new.*", "_state", "_rows")


#: Batches after which the table is written anew with one row per key, and the folders that a table's rows are dealt into by key.
COMPACT_EVERY, KEY_BUCKETS = 10, 64


def _bucket(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int").alias("key_bucket")


def _write_bucketed(rows: DataFrame, keys: list[str], to: str) -> None:
    """Write with a folder per key bucket; Spark merges the small ones of a batch into few tasks and splits the large ones."""
    rows.withColumn("key_bucket", _bucket(keys)).hint("rebalance", F.col("key_bucket")).write.mode("overwrite").partitionBy("key_bucket").parquet(to)


def _manifest(spark: SparkSession, path: str) -> tuple[int, int]:
    """(compaction, last batch) of the table as last committed; (0, -1) before the first batch."""
    slots = spark.read.schema("batch int, compaction int").parquet(f"{path}/manifest")
    last = slots.agg(F.max(F.struct("batch", "compaction")).alias("m")).first().m  # at most COMPACT_EVERY + 1 rows
    return (last.compaction, last.batch) if last else (0, -1)


def _commit(spark: SparkSession, path: str, number: int, compaction: int) -> None:
    """Make a batch part of the table. Slots are used in turn, so that the entry before stays readable meanwhile."""
    entry = spark.createDataFrame([(number, compaction)], "batch int, compaction int").coalesce(1)
    entry.write.mode("overwrite").parquet(f"{path}/manifest/slot={number % COMPACT_EVERY}")


def _rows_of(spark: SparkSession, path: str, compaction: int, end: int, schema: T.StructType) -> DataFrame | None:
    """Rows of a compaction and of the batches from it up to ``end`` (not included), with ``batch`` and ``key_bucket``."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("key_bucket", T.IntegerType())])
    parts = []
    if compaction:
        parts.append(spark.read.schema(full).parquet(f"{path}/compact/upto={compaction}"))
    if end > compaction:
        folders = [f"{path}/table/batch={k}" for k in range(compaction, end)]
        parts.append(spark.read.schema(full).option("basePath", f"{path}/table").parquet(*folders))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _newest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*by)).alias("_v")).select(*keys, "_v.*")


def _compacted(spark: SparkSession, path: str, number: int, keys: list[str], version: str, schema: T.StructType) -> int:
    """The compaction that batch ``number`` starts from; the batch that starts a new ten writes it.

    A batch that is repeated after a failure writes it again from the same folders, unless the batch was
    committed already: then the folders may be gone, and the compaction stands.
    """
    start = number - number % COMPACT_EVERY
    if number == start and number and _manifest(spark, path)[1] < number:
        rows = _rows_of(spark, path, start - COMPACT_EVERY, number, schema)
        _write_bucketed(_newest(rows, keys, [version, "batch"]), keys, f"{path}/compact/upto={start}")
    return start


def current_state(spark: SparkSession, path: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """Newest stored row per key, from the last compaction and the batches committed since.

    Reads no folder before the compaction, and none of a batch that is still being written.
    """
    compaction, last = _manifest(spark, path)
    rows = _rows_of(spark, path, compaction, last + 1, schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    return _newest(rows, keys, ["batch"]).select(*schema.names)


def superseded(spark: SparkSession, path: str) -> list[str]:
    """Folders of the last ten batches before the compaction, and the compaction before it, that nothing reads any more."""
    compaction, _ = _manifest(spark, path)
    before = max(0, compaction - COMPACT_EVERY)
    old = [f"{path}/{kind}/batch={k}" for kind in ("table", "arrived") for k in range(before, compaction)]
    return old + ([f"{path}/compact/upto={before}"] if before else [])


def incremental_ingest(stream: DataFrame, path: str, keys: list[str], version: str) -> DataFrame:
    """Merge the files landed since the last run into a keyed table.

    A batch appends only its new and changed rows, in a folder of its own
    number; a repeated batch rewrites that folder. Every tenth batch starts
    from a compaction, and rows lie in folders by key bucket, so that a run reads neither the whole history nor
    the buckets that no arriving key is in. The last step of a batch is its entry in the manifest. A version older than
    the stored one is skipped. Returns the counts per batch.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        compaction = _compacted(spark, path, number, keys, version, batch.schema)
        stored = _rows_of(spark, path, compaction, number, batch.schema)
        if stored is not None:
            touched = [r.key_bucket for r in batch.select(_bucket(keys)).distinct().collect()]  # at most KEY_BUCKETS numbers
            stored = stored.where(F.col("key_bucket").isin(touched)).drop("key_bucket")
        # Written once: the rows of the table and the counts both come from it.
        upsert_delta(stored, batch, keys, version).write.mode("overwrite").parquet(f"{path}/arrived/batch={number}")
        marked, state = spark.read.parquet(f"{path}/arrived/batch={number}"), F.col("_state")
        _write_bucketed(marked.where(state.isin("inserted", "updated")).drop("_rows", "_state"), keys, f"{path}/table/batch={number}")
        counts = marked.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("records_processed"),
                            F.count_if(state == "inserted").alias("inserted"), F.count_if(state == "updated").alias("updated"))
        counts.select(F.lit(number).alias("run_number"), "records_processed", "inserted", "updated",
                      (F.col("records_processed") - F.col("inserted") - F.col("updated")).alias("skipped")) \
            .write.mode("overwrite").parquet(f"{path}/counts/run={number}")
        _commit(spark, path, number, compaction)

    run_batches(stream, merge, f"{path}/state")
    return spark.read.option("basePath", f"{path}/counts").parquet(f"{path}/counts").drop("run")
