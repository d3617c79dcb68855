"""Session set-up and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def get_spark(app: str = "pulseframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be present: a machine-local folder is not
    visible to the other executors. Only a ``local`` master, as in tests, gets
    a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        app_id = spark.sparkContext.applicationId
        if app_id not in _LOCAL_DIRS:
            _LOCAL_DIRS[app_id] = tempfile.mkdtemp(prefix="pulseframe-")
        base = _LOCAL_DIRS[app_id]
    return f"{base.rstrip('/')}/{name or 'run'}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: fixed rows, short lineage.

    Used where two passes must see identical rows or partition numbers; the
    written table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows_per_part: int = 100_000, by: Sequence[str] | None = None) -> DataFrame:
    """Rows dealt by their hash into a number of partitions that only their count decides, sorted in each.

    Iterative fits draw samples by partition and position, so the same table gives
    the same model on any cluster and from any layout of files. With ``by`` only those columns are
    hashed: computed numbers can differ in their last digit from layout to layout.
    """
    parts = max(8, -(-df.count() // rows_per_part))
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in by or df.columns])
    return df.repartition(parts, mark).sortWithinPartitions(mark)
