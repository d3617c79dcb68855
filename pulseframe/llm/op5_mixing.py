"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken ``target / source size`` times on
average. The whole part is taken for certain. The fractions are rounded in
pairs: words move from one document's expected share to the other's until one
of the two is whole, which way being drawn so that each fraction keeps its
mean. Expected words never change, so that all of a source's words stay near its
target; one document per chunk is left with a fraction. Chunks round in
parallel, and what is left of them is rounded together in a tree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pulseframe.llm.common import materialize, put_back, set_aside, text_of, unit

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Documents rounded by one task, and fan-in of the tree above.
CHUNK_ROWS, FAN_IN = 2_000, 1_000


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size, rows).

    Targets are ``min(most * size, level * weight)`` with the one level at which
    they add up to ``share`` of all sizes: what is left of a capped source goes
    to the others by weight. The windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full", F.col("cap") / F.col("w"))
    order = Window.orderBy("full", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    by = by.withColumn("level", (
        F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # The first source, by fullness, that the level does not fill fixes the level.
    level = F.min_by(F.when(F.col("level") <= F.col("full"), F.col("level")), F.when(F.col("level") <= F.col("full"), F.col("full"))).over(everything)
    return by.select("source", "source_size", "n", F.coalesce(F.least("cap", level * F.col("w")), F.col("cap")).alias("target"))


def _pivot(pdf: pd.DataFrame) -> pd.DataFrame:
    """Round the fractions ``p`` of one group; at most one row keeps a fraction."""
    pdf = pdf.sort_values(["mass", "doc_id", "size"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    p, mass, draw = pdf["p"].tolist(), pdf["mass"].tolist(), pdf["u"].tolist()
    held = -1
    for j in range(len(p)):
        if not 1e-12 < p[j] < 1 - 1e-12:
            p[j] = float(round(p[j]))
            continue
        if mass[j] <= 0:  # no words to keep even
            p[j] = float(draw[j] < p[j])
            continue
        if held < 0:
            held = j
            continue
        i, ratio = held, mass[j] / mass[held]
        up, down = min(1 - p[i], p[j] * ratio), min(p[i], (1 - p[j]) * ratio)
        step = up if draw[j] * (up + down) < down else -down
        p[i], p[j] = p[i] + step, p[j] - step / ratio
        held = -1
        for k in (i, j):
            if p[k] < 1e-12 or p[k] > 1 - 1e-12:
                p[k] = float(round(p[k]))
            else:
                held = k
    pdf["p"] = p
    return pdf


def plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, units): one row per document, and one row per decision.

    ``rows`` has doc_id, source, size; ``units`` has those, source_size, target
    and copies. Repeated rows (one doc_id, source and size) are one unit and are
    taken equally often; its words count once per row. Null texts have no words,
    null sources are one source, the last. Without any words targets are 0.
    """
    rows = materialize(docs.select(
        docs["doc_id"], docs["source"], F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size")), "mix_rows")
    units = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    targets = materialize(source_targets(units, share, most, weights), "mix_targets")
    chunks = targets.withColumn("chunks", F.ceil(F.col("n") / CHUNK_ROWS))
    joined = units.join(chunks.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("times") + 1e-12)
    start = joined.withColumn("times", times).select(
        "doc_id", "source", "size", (F.col("size") * F.col("rows")).alias("mass"), "source_size", "target",
        whole.cast("int").alias("base"), F.greatest(F.col("times") - whole, F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("chunks")).alias("chunk"))
    schema = start.withColumn("u", F.lit(0.0)).schema
    left, level, done = start, 0, None
    groups = chunks.agg(F.max("chunks")).first()[0] or 1
    while True:
        last = groups <= 1
        drawn = left.withColumn("u", unit("doc_id", "source", "size", F.lit(f"{seed}/{level}")))
        rounded = materialize(drawn.groupBy("source", "chunk").applyInPandas(_pivot, schema), "mix_rounded")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        if last:  # one document of a source may be left: its own draw decides
            rounded = rounded.withColumn("p", F.when(open_, (unit("doc_id", "size", F.lit(f"{seed}/end")) < F.col("p")).cast("double")).otherwise(F.col("p")))
            done = rounded if done is None else done.unionByName(rounded)
            break
        settled = rounded.where(~open_)
        done = settled if done is None else done.unionByName(settled)
        left = rounded.where(open_).drop("u").withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
        groups, level = -(-groups // FAN_IN), level + 1
    decided = done.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("p").cast("int")).alias("copies"))
    return rows, decided


def _match(rows: DataFrame, units: DataFrame) -> DataFrame:
    units = units.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "source", "size")})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "source", "size")]
    return rows.join(units, on[0] & on[1] & on[2]).drop("_doc_id", "_source", "_size")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken words of every document."""
    rows, units = plan(docs, **options)
    return _match(rows, units).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    _, units = plan(docs, **options)
    own = set_aside(docs, "doc_id", "text", "source")
    sized = own.withColumn("size", F.regexp_count(text_of(own), F.lit(WORD)).cast("long"))
    taken = _match(sized, units).where("copies > 0")
    taken = taken.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return put_back(taken, docs, "doc_id", "text", "source")
