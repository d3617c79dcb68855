"""Ranks and running totals over a whole table without a one-task window.

Input rows are grouped first, so a value shared by a third of the table is one
row. Small groupings use one window; large ones are range-partitioned, written
once so the partition number is fixed, and each partition adds the total of the
partitions before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.session import materialize

CHUNK_ROWS = 500_000


def chunked(df: DataFrame, order: Sequence[Column | str], chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, int]:
    """Add ``_chunk``: rows of a chunk sort entirely before those of the next.

    Groups come first in ``order``, so most lie in one chunk, and one group may fill several.
    """
    # Counted, sampled for range boundaries and read: computed once.
    stored = materialize(df, "grouped")
    n = stored.count()
    # Not more chunks than a few rounds of the cluster's tasks; larger ones sort on disk.
    most = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-n // chunk_rows), most))
    if parts == 1:
        return stored.withColumn("_chunk", F.lit(0)), 1
    ranged = stored.repartitionByRange(parts, *order).withColumn("_chunk", F.spark_partition_id())
    return materialize(ranged, "chunks"), parts


def running_totals(
    df: DataFrame,
    key: str,
    totals: Mapping[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Inclusive running sums of ``totals`` (new name → column) in order of ``key``.

    ``df`` must hold one row per (by, key), as a grouping yields.
    """
    order = F.col(key).desc() if descending else F.col(key).asc()
    data, parts = chunked(df, [*[F.col(b) for b in by], order], chunk_rows)
    inside = (Window.partitionBy(*by, "_chunk").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = data
    for name, col in totals.items():
        out = out.withColumn(name, F.sum(col).over(inside))
    if parts > 1:
        before = (Window.partitionBy(*by).orderBy("_chunk")
                  .rowsBetween(Window.unboundedPreceding, -1))
        sums = data.groupBy(*by, "_chunk").agg(
            *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
        offsets = sums.select(
            *[F.col(b).alias(f"_b_{b}") for b in by], F.col("_chunk").alias("_at"),
            *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in totals],
            F.count(F.lit(1)).over(before).alias("_earlier"))
        offsets = offsets.where("_earlier > 0").drop("_earlier")  # only groups that cross a boundary
        match = F.col("_chunk") == F.col("_at")
        for b in by:
            match = match & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
        out = out.join(offsets, match, "left")
        for name in totals:
            out = out.withColumn(name, F.col(name) + F.coalesce(F.col(f"_o_{name}"), F.lit(0)))
        out = out.drop("_at", *[f"_b_{b}" for b in by], *[f"_o_{n}" for n in totals])
    return out.drop("_chunk")


def row_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "row_number",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Position of every row in its group; a large group spans several chunks."""
    data, parts = chunked(df, [*[F.col(b) for b in by], *order], chunk_rows)
    out = data.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(*order)).cast("long"))
    if parts > 1:
        before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        sizes = data.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        offsets = sizes.select(
            *[F.col(b).alias(f"_b_{b}") for b in by], F.col("_chunk").alias("_at"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
        match = F.col("_chunk") == F.col("_at")
        for b in by:
            match = match & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
        out = out.join(offsets, match, "left").withColumn(name, F.col(name) + F.col("_o"))
        out = out.drop("_at", "_o", *[f"_b_{b}" for b in by])
    return out.drop("_chunk")


def index_values(df: DataFrame, col: str, name: str = "code", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """0-based position of every distinct non-null value in sorted order."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_one", F.lit(1))
    ranked = running_totals(values, col, {"_upto": "_one"}, chunk_rows=chunk_rows)
    return ranked.select(col, (F.col("_upto") - 1).cast("long").alias(name))


def percent_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row per (by, value): rows below it, group size and (rank-1)/(n-1)."""
    keys = [*by, value]
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    ran = running_totals(cells, value, {"_upto": "_k"}, by=by, chunk_rows=chunk_rows)
    sizes = cells.groupBy(*by).agg(F.sum("_k").alias("group_size")) if by else \
        cells.agg(F.sum("_k").alias("group_size"))
    if by:
        match = None
        renamed = sizes.select(*[F.col(b).alias(f"_b_{b}") for b in by], "group_size")
        for b in by:
            cond = F.col(b).eqNullSafe(F.col(f"_b_{b}"))
            match = cond if match is None else match & cond
        ran = ran.join(renamed, match, "left").drop(*[f"_b_{b}" for b in by])
    else:
        ran = ran.withColumn("group_size", F.lit(sizes.first()[0]).cast("long"))
    below = F.col("_upto") - F.col("_k")
    return ran.select(
        *keys, below.cast("long").alias("rows_below"), "group_size",
        F.when(F.col("group_size") > 1, below / (F.col("group_size") - 1))
        .otherwise(0.0).alias("percent_rank"))


def next_in_group(
    df: DataFrame, group: Sequence[str], order: str, chunk: Column, out: str = "next_value",
    hot_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``lead(order)`` per group; groups too large for one task are split.

    The group sizes decide: when every group fits a task one window does. Else
    ``chunk``, which must not decrease with ``order`` (for example a month),
    splits the groups: a window finds the next row inside a chunk, and the last
    row of a chunk takes the earliest value of the group's next chunk.
    """
    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0]
    ascending = F.col(order).asc_nulls_last()  # rows without a value come last and have no successor
    if (largest or 0) <= hot_rows:
        return df.withColumn(out, F.lead(order).over(Window.partitionBy(*group).orderBy(ascending)))
    data = df.withColumn("_c", chunk)
    inside = Window.partitionBy(*group, "_c").orderBy(ascending)
    data = data.withColumn("_n", F.lead(order).over(inside))
    firsts = df.withColumn("_c", chunk).groupBy(*group, "_c").agg(F.min(order).alias("_first"))
    across = Window.partitionBy(*group).orderBy(F.col("_c").asc_nulls_last())
    nexts = firsts.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_c").alias("_gc"),
        F.lead("_first").over(across).alias("_follow"))
    match = F.col("_c").eqNullSafe(F.col("_gc"))
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = data.join(nexts, match, "left")
    follow = F.when(F.col(order).isNotNull(), F.coalesce("_n", "_follow"))
    return (joined.withColumn(out, follow)
            .drop("_c", "_n", "_gc", "_follow", *[f"_g_{g}" for g in group]))
