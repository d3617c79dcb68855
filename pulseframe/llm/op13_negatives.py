"""Hard-negative mining by threshold joins of anchors and rows, in the manner of L2AP.

Vectors are integers, their components ordered by weight. Rows and anchors come in packs, and every
pack of anchors meets every pack of rows in a task. For a threshold, a row's component
needs no index entry if the row's norm from there on, times the largest norm of the anchors
from there on, stays below the threshold: no pair can reach the threshold by what is left out. The rows of a pack
are sorted by the components they keep, so a component's postings are a slice, and one
product adds its share to all pairs. A pair whose partial score plus the product of the remaining
norms stays below the anchor's threshold is pruned; the others get their remaining components,
again with the bound after each chunk, until their score is exact.

An anchor looks for the first ``k`` rows in each of its windows of scores. Its thresholds start high, where a
sample of rows says that a few times ``k`` rows will be, and are lowered for the windows
that are not full, at last to the window's own bottom; so the result is exact whatever the sample holds. Within a
task the k-th score found so far raises the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseframe.llm.common import best_rows, materialize

#: Bytes of components of a pack of rows and of anchors (8 each).
PACK_BYTES, ANCHOR_BYTES = 1_000_000, 250_000
#: Rows of the sample that sets the first thresholds; the result does not depend on it.
SAMPLE = 2_048
#: Components added at a time, anchors that share one index, and the share of live pairs below which pairs go one by one.
CHUNK, GROUP, SPARSE = 8, 128, 0.02
#: Rows wanted above the first threshold, in multiples of k, and how much further the next one goes.
AIM, LOWER = 4, 8
FAR = 2 ** 62
_WINDOWS = "array<struct<tag:int,bottom:long,high:long,low:long>>"
_STATE = f"anchor_id long, label string, v array<long>, windows {_WINDOWS}"


def _norms(v: np.ndarray) -> np.ndarray:
    """Norms of the rows from each chunk on, and 0 after the last; a little too large rather than too small."""
    chunks = np.add.reduceat(v.astype(np.float64) ** 2, np.arange(0, v.shape[1], CHUNK), axis=1)
    left = np.sqrt(np.cumsum(chunks[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)
    return np.concatenate([left, np.zeros((len(v), 1))], axis=1)


def _matrix(lists: list, order: np.ndarray) -> np.ndarray:
    """Rows of integers in the order of weight; short vectors count as ended by zeros."""
    out = np.zeros((len(lists), max(len(order), 1)), np.int64)
    for k, v in enumerate(lists):
        out[k, :len(v)] = v
    return out[:, order] if len(order) else out


def reach(q: np.ndarray, q_norms: np.ndarray, low: np.ndarray, y: np.ndarray, y_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with ``q[anchor] @ y[row] >= low[anchor]``."""
    least, top, chunks = low.min(), q_norms.max(axis=0), y_norms.shape[1] - 1
    # Chunks that a row must have in the index.
    kept = np.full(len(y), chunks)
    if least > 0:
        kept = (y_norms[:, :chunks] * top[:chunks] >= least).sum(axis=1)
    rows = np.argsort(-kept, kind="stable")
    rows = rows[:np.count_nonzero(kept)]
    y, y_norms, kept = y[rows], y_norms[rows], kept[rows]
    partial = np.zeros((len(q), len(rows)), y.dtype)
    for c in range(chunks):
        postings = int(np.searchsorted(-kept, -c, "left"))  # rows with more than c chunks
        if not postings:
            break
        at = slice(c * CHUNK, (c + 1) * CHUNK)
        partial[:, :postings] += q[:, at] @ y[:postings, at].T
    done = kept.copy()  # chunks that a row's partial scores hold
    while True:
        live = partial + q_norms[:, done] * y_norms[np.arange(len(done)), done] >= low[:, None]
        some = live.any(axis=0)
        if not some.all():
            rows, y, y_norms, done, partial, live = rows[some], y[some], y_norms[some], done[some], partial[:, some], live[:, some]
        if not len(rows) or (done == chunks).all() or live.mean() < SPARSE:
            break
        step = done < chunks
        c = int(done[step].min())
        step = done == c
        at = slice(c * CHUNK, (c + 1) * CHUNK)
        partial[:, step] += q[:, at] @ y[step, at].T
        done[step] = c + 1
    a, r = np.nonzero(live)
    score, done = partial[a, r], done[r]
    for c in range(chunks):  # what is left, pair by pair
        step = np.flatnonzero(done == c)
        if len(step):
            at = slice(c * CHUNK, (c + 1) * CHUNK)
            score[step] += (q[a[step], at] * y[r[step], at]).sum(axis=1)
            done[step] = c + 1
            alive = score + q_norms[a, done] * y_norms[r, done] >= low[a]
            a, r, score, done = a[alive], r[alive], score[alive], done[alive]
    return a, rows[r], score.astype(np.int64)


class _Search:
    """The windows of a pack of anchors and the best rows found for them."""

    def __init__(self, row: dict, k: int, same: bool, width: int, dtype):
        self.k, self.same = k, same
        self.ids, self.labels = np.array(row["ids"], np.int64), np.array(row["labels"], str)
        self.q = np.frombuffer(row["v"], np.int64).reshape(len(self.ids), width).astype(dtype)
        self.norms = _norms(self.q)
        self.owner, self.tag, self.low, self.high = (np.array(row[c], np.int64) for c in ("owner", "tag", "low", "high"))
        self.first = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        self.best = [np.empty(0, np.int64)] * 4  # window, score, id is null, id

    def meet(self, ids: np.ndarray, missing: np.ndarray, labels: np.ndarray, y: np.ndarray, y_norms: np.ndarray) -> None:
        low = np.full(len(self.ids), FAR)
        np.minimum.at(low, self.owner, self.low)
        near = np.isin(self.labels, np.unique(labels)) if self.same else np.ones(len(low), bool)
        anchors = np.flatnonzero(near & (low < FAR))
        # Anchors of like thresholds share an index.
        anchors = anchors[np.argsort(low[anchors] / np.maximum(self.norms[anchors, 0], 1e-9), kind="stable")]
        for g in range(0, len(anchors), GROUP):
            who = anchors[g:g + GROUP]
            a, r, score = reach(self.q[who], self.norms[who], low[who], y, y_norms)
            a = who[a]
            fits = ((self.labels[a] == labels[r]) == self.same) & ((self.ids[a] != ids[r]) | missing[r])
            self._take(a[fits], score[fits], missing[r[fits]].astype(np.int64), ids[r[fits]])

    def _take(self, a, score, missing, ids) -> None:
        count = np.diff(self.first)[a]
        pair = np.repeat(np.arange(len(a)), count)
        window = np.repeat(self.first[a] - (np.cumsum(count) - count), count) + np.arange(len(pair))
        fits = (score[pair] >= self.low[window]) & (score[pair] <= self.high[window])
        pair, window = pair[fits], window[fits]
        if len(pair):
            rows = [np.concatenate(x) for x in zip(self.best, (window, score[pair], missing[pair], ids[pair]))]
            order, rank = best_rows(*rows, self.k)
            self.best = [x[order] for x in rows]
            full = rank == self.k - 1
            np.maximum.at(self.low, self.best[0][full], self.best[1][full])


# -- tables ----------------------------------------------------------------------

def _statistics(rows: DataFrame) -> tuple[int, np.ndarray, np.dtype]:
    """Number of rows, components by falling weight, and a number type that holds all scores exactly."""
    parts = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum(F.pow(F.col("x").cast("double"), F.lit(2))).alias("w")).collect()
    weight = {r["at"]: r["w"] for r in parts}  # one row per component
    order = np.array(sorted(range(max(weight, default=-1) + 1), key=lambda k: (-weight.get(k, 0.0), k)), np.int64)
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    found = rows.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    return found["n"], order, np.dtype(np.float64 if (found["norm"] or 0) < 2.0 ** 52 else np.int64)


def _row_packs(rows: DataFrame, order: np.ndarray) -> DataFrame:
    each = max(64, PACK_BYTES // (8 * max(len(order), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, each):
                part = batch.slice(first, each).to_pydict()
                yield pa.RecordBatch.from_arrays([
                    pa.array([part["vec_id"]], pa.list_(pa.int64())), pa.array([part["label"]], pa.list_(pa.string())),
                    pa.array([_matrix(part["v"], order).tobytes()], pa.binary())], names=["row_ids", "row_labels", "row_v"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, "row_ids array<long>, row_labels array<string>, row_v binary")


def _lowered(state: DataFrame, sample: list, order: np.ndarray, rank: int | None, same: bool) -> DataFrame:
    """``state`` with the windows' thresholds: the score of that rank among the sample's in the window, or the bottom."""
    shared = state.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s_ids = np.array([-1 if r[0] is None else r[0] for r in shared.value], np.int64)
        s_none = np.array([r[0] is None for r in shared.value], bool)
        s_labels, s = np.array([r[1] for r in shared.value], str), _matrix([r[2] for r in shared.value], order).astype(np.float64)
        for batch in batches:
            rows = batch.to_pylist()
            for first in range(0, len(rows), 256):
                part = rows[first:first + 256]
                scores = _matrix([r["v"] for r in part], order).astype(np.float64) @ s.T
                for r, line in zip(part, scores):
                    fits = ((s_labels == r["label"]) == same) & ((s_ids != r["anchor_id"]) | s_none)
                    line = np.sort(line[fits])
                    for w in r["windows"]:
                        at = np.searchsorted(line, w["high"], "right") - rank
                        w["low"] = max(w["bottom"], math.floor(line[at])) if at >= 0 else w["bottom"]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    if rank is None or not sample:
        return state.withColumn("windows", F.transform("windows", lambda w: w.withField("low", w["bottom"])))
    return state.mapInArrow(run, _STATE)


def _anchor_packs(state: DataFrame, order: np.ndarray) -> DataFrame:
    each = max(16, ANCHOR_BYTES // (8 * max(len(order), 1)))
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, each):
                part = batch.slice(first, each).to_pylist()
                flat = [(k, w["tag"], w["low"], w["high"]) for k, r in enumerate(part) for w in r["windows"]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([(task << 32) + serial], pa.int64()), pa.array([[r["anchor_id"] for r in part]], longs),
                    pa.array([[r["label"] for r in part]], pa.list_(pa.string())),
                    pa.array([_matrix([r["v"] for r in part], order).tobytes()], pa.binary()),
                    *[pa.array([[f[c] for f in flat]], longs) for c in range(4)]],
                    names=["pack", "ids", "labels", "v", "owner", "tag", "low", "high"])
                serial += 1

    return state.mapInArrow(run, "pack long, ids array<long>, labels array<string>, v binary, owner array<long>, "
                                 "tag array<long>, low array<long>, high array<long>")


def _scan(anchors: DataFrame, rows: DataFrame, width: int, dtype, k: int, same: bool) -> DataFrame:
    """(anchor_id, tag, rank, id, score): the first ``k`` rows of every window at or above its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Search] = {}
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {n: batch.column(i)[k_row].as_py() for i, n in enumerate(batch.schema.names)}
                if row["pack"] not in held:
                    held[row["pack"]] = _Search(row, k, same, width, dtype)
                ids = row["row_ids"]
                y = np.frombuffer(row["row_v"], np.int64).reshape(len(ids), width).astype(dtype)
                held[row["pack"]].meet(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool),
                                       np.array(row["row_labels"], str), y, _norms(y))
        part = TaskContext.get().partitionId() // 256
        for s in held.values():
            window, score, no_id, ids = s.best
            if len(window):
                yield pa.RecordBatch.from_arrays([
                    pa.array(s.ids[s.owner[window]]), pa.array(s.tag[window].astype(np.int32)), pa.array(ids, mask=no_id > 0),
                    pa.array(score), pa.array(np.full(len(ids), part))], names=["anchor_id", "tag", "id", "score", "part"])

    # A stated query set against all rows, in blocks: one row per pair of packs.
    found = anchors.crossJoin(rows).mapInArrow(run, "anchor_id long, tag int, id long, score long, part long")
    for keys in (["anchor_id", "tag", "part"], ["anchor_id", "tag"]):
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("anchor_id", "tag", "rank", "id", "score")


def _fill(state: DataFrame, packs: DataFrame, sample: list, n: int, order: np.ndarray, dtype, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows of every window of ``state``; thresholds go down until the windows are full."""
    first = max(1, -(-AIM * k * len(sample) // max(n, 1)))
    out = None
    for rank in (first, first * LOWER, None):
        state = materialize(_lowered(state, sample, order, rank, same), "thresholds")
        found = materialize(_scan(_anchor_packs(state, order), packs, max(len(order), 1), dtype, k, same), "reached")
        count = found.groupBy("anchor_id", "tag").agg(F.count("*").alias("n"))
        windows = state.select("anchor_id", F.explode("windows").alias("w")).select("anchor_id", F.col("w.tag").alias("tag"), "w")
        left = windows.join(count, ["anchor_id", "tag"], "left").where((F.coalesce("n", F.lit(0)) < k) & (F.col("w.low") > F.col("w.bottom")))
        left = materialize(left.select("anchor_id", "tag", "w"), "open")
        full = found.join(left, ["anchor_id", "tag"], "left_anti")
        out = full if out is None else out.unionByName(full)
        if left.isEmpty():
            break
        state = state.drop("windows").join(left.groupBy("anchor_id").agg(F.collect_list("w").alias("windows")), "anchor_id")  # a few per anchor
        state = state.select("anchor_id", "label", "v", "windows")
    return out


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: float = 256.0, sample_rows: int = SAMPLE) -> DataFrame:
    """Hard negatives of ``vectors(vec_id, embedding, label)``, for the rows where ``is_anchor`` holds.

    Components become ``floor(scale * x)``, a score is the inner product. An anchor's positives are its
    first rows of the same label; for each of them come the first rows of other labels with a score between
    ``low`` and ``high`` per cent of the positive's. Equal scores are ranked by vec_id, a null one last.

    Rows with a null label or vector, or a component that is null or not finite, take no part. Shorter vectors
    count as ended by zeros. An anchor needs a vec_id, and rows with its vec_id are no partners of it;
    of anchors with one vec_id the row with the smallest label and vector counts. Other columns are not read,
    except by ``is_anchor``. An empty table, or one without anchors, gives an empty one. Scores are
    exact to 2^63.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding",
        (F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull()).alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        "vec_id", "label", "anchor", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    # Rows of one label together, so that packs of another label can be passed over.
    rows = materialize(rows.repartitionByRange("label", F.xxhash64("vec_id", "v")).sortWithinPartitions("label"), "vectors")
    n, order, dtype = _statistics(rows)
    packs = materialize(_row_packs(rows, order), "packs")
    sample = [tuple(r) for r in rows.orderBy(F.xxhash64("vec_id", "v")).limit(sample_rows).select("vec_id", "label", "v").collect()]

    whole = F.expr(f"array(named_struct('tag', 0, 'bottom', {-FAR}L, 'high', {FAR}L, 'low', {-FAR}L))")
    state = rows.where("anchor").groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("x"))
    state = materialize(state.select("anchor_id", "x.label", "x.v", whole.alias("windows")), "anchors")
    near = materialize(_fill(state, packs, sample, n, order, dtype, positives, True), "positives").select(
        "anchor_id", F.col("rank").alias("tag"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    score = F.col("positive_score")
    bounds = F.struct("tag", F.expr(f"({low} * positive_score + 99) div 100").alias("bottom"),
                      F.expr(f"{high} * positive_score div 100").alias("high"))
    windows = near.where(score >= 0).select("anchor_id", bounds.alias("w")).where("w.bottom <= w.high").select(
        "anchor_id", F.col("w").withField("low", F.col("w.bottom")).alias("w"))
    windows = windows.groupBy("anchor_id").agg(F.collect_list("w").alias("windows"))  # one per positive
    state = state.drop("windows").join(windows, "anchor_id").select("anchor_id", "label", "v", "windows")
    far = _fill(state, packs, sample, n, order, dtype, negatives, False)
    return far.join(near, ["anchor_id", "tag"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
