"""Readers, writers and version bookkeeping.

Every stored table is a folder of versions, ``<root>/<name>/version=<v>/``.
The newest version is found from the folder listing, so a read touches one
partition; nothing is copied to mark it as the latest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions import text as tx
from pulseframe.operators import quality, ranking

FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet"}
CADENCE_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 90, "yearly": 365}
DEFAULT_CADENCE = 30
EXTRACTS = (
    "heart_disease_mortality", "behavioral_risk_factors", "heart_disease_hospitalization",
    "chronic_disease_indicators",
)
CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV, JSON or Parquet by suffix; anything else is refused."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file format: {path}")
    reader = spark.read.format(FORMATS[suffix])
    if suffix == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_extract_csv(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """A landed extract. With a schema, unreadable lines are kept in a column of their own."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return reader.csv(folder)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return reader.option("columnNameOfCorruptRecord", CORRUPT).schema(full).csv(folder)


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Version names present in a table folder, oldest first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("version="))


def latest_version(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame | None:
    """The newest stored version, or ``None``; only its files are listed and read."""
    found = versions(spark, folder)
    if not found:
        return None
    reader = spark.read.option("basePath", folder)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(f"{folder}/version={found[-1]}").drop("version")


def newest_rows(df: DataFrame, version: str = "version") -> DataFrame:
    """Rows of the greatest version of a versioned table (prunes when partitioned by it)."""
    top = df.agg(F.max(version)).first()[0]
    return df.where(F.col(version) == F.lit(top))


def preview(df: DataFrame, rows: int = 100, order: Sequence[str] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The first rows (the feature is a preview) by ``order``, or by all columns, and the column types."""
    return df.orderBy(*(order or df.columns)).limit(rows), df.dtypes


def write_dual(df: DataFrame, root: str, name: str, version: str) -> dict[str, str]:
    """Write one version as Parquet and CSV."""
    paths = {fmt: f"{root}/{name}_{fmt}" for fmt in ("parquet", "csv")}
    df.write.mode("overwrite").parquet(f"{paths['parquet']}/version={version}")
    df.write.mode("overwrite").option("header", True).csv(f"{paths['csv']}/version={version}")
    return paths


def export_dataset(df: DataFrame, path: str, fmt: str = "csv", metadata: Mapping[str, str] | None = None) -> None:
    """Export with an optional side record that describes it."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format: {fmt}")
    writer = df.write.mode("overwrite").format(FORMATS[fmt])
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    if metadata is not None:
        spark = df.sparkSession
        side = {**metadata, "format": fmt, "columns": ",".join(df.columns)}
        spark.createDataFrame([tuple(side.values())], ", ".join(f"{k} string" for k in side)).coalesce(1) \
            .write.mode("overwrite").json(f"{path}_metadata")


def save_dataset(df: DataFrame, root: str, name: str, version: str, dataset_type: str, created_at: str) -> DataFrame:
    """Write a dataset and register its characteristics."""
    path = f"{root}/{name}/version={version}"
    df.write.mode("overwrite").parquet(path)
    # Characterise what was written, not the upstream plan.
    traits = quality.characterise(df.sparkSession.read.parquet(path))
    cells = F.col("total_rows") * F.col("total_columns")
    row = traits.withColumns({
        "name": F.lit(name), "version": F.lit(version), "dataset_type": F.lit(dataset_type),
        "created_at": F.lit(created_at), "path": F.lit(path),
        "completeness_score": F.lit(1.0) - F.col("missing_values") / F.nullif(cells.cast("double"), F.lit(0.0)),
    })
    row.write.mode("append").parquet(f"{root}/_datasets")
    return row


def store_predictions(df: DataFrame, root: str, batch_id: str, created_at: str, ts: str = "created_at") -> DataFrame:
    """Append prediction rows by day, one batch row and one audit row; returns the batch row."""
    spark = df.sparkSession
    dated = df.withColumns({"batch_id": F.lit(batch_id), "date": F.to_date(ts)})
    # Counted while they are written: no later batch has to read the history.
    seen = Observation()
    counted = dated.observe(seen, F.count(F.lit(1)).alias("total"), F.count("risk_score").alias("done"))
    # Rebalancing gathers small days into few files and splits a day that is too large for one task.
    counted.hint("rebalance", F.col("date")).write.mode("append").partitionBy("date").parquet(f"{root}/predictions")
    total, done = seen.get["total"], seen.get["done"]
    batch = spark.createDataFrame(
        [(batch_id, created_at, "completed", total, done, total - done)],
        "batch_id string, created_at string, job_status string, total_records long, successful_predictions long, failed_predictions long")
    batch.write.mode("append").parquet(f"{root}/batches")
    spark.createDataFrame([("batch_stored", batch_id, created_at)],
                          "event_type string, correlation_id string, created_at string") \
        .write.mode("append").parquet(f"{root}/audit")
    return batch


def source_freshness(sources: DataFrame, as_of: Column) -> DataFrame:
    """Add ``due``: never loaded, or last load longer ago than the cadence allows."""
    pairs = [F.lit(x) for kv in CADENCE_DAYS.items() for x in kv]
    allowed = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("frequency")), F.lit(DEFAULT_CADENCE))
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_updated").cast("timestamp"))
    over = age > allowed.cast("long") * F.lit(86_400_000_000)
    return sources.withColumns({"allowed_days": allowed, "due": F.col("last_updated").isNull() | over})


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of the whole table from one aggregate."""
    h = F.xxhash64(*df.columns)
    low = F.pmod(h, F.lit(1 << 31))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"),
                  F.sum(low).alias("sum_hash"))


def content_checksum(df: DataFrame) -> DataFrame:
    """Fingerprint from md5 digits, for comparison with other systems."""
    h = tx.hash60([F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"),
                  F.sum(F.pmod(h, F.lit(1_000_003))).alias("sum_hash"))


def version_retention(stored: DataFrame, keep: int = 5, by: Sequence[str] = ("name",), ts: str = "stored_at",
                      tie: str = "version") -> DataFrame:
    """Stored versions beyond the newest ``keep`` of their name."""
    return ranking.retention_selection(stored, keep, ts, tie, by)


def sync_window(df: DataFrame, ts: str, as_of: Column, days: int = 730, after: Column | None = None) -> DataFrame:
    """Rows of the default range; an incremental sync takes only those after the last one."""
    at = as_of.cast("timestamp_ntz")
    rows = df.where((F.col(ts) >= at - F.make_dt_interval(days=F.lit(days))) & (F.col(ts) <= at))
    return rows if after is None else rows.where(F.col(ts) > after)
