"""Sums of products of columns, and the models that need nothing else.

One scan gathers, per group of rows, the count, the sums and the products of all pairs of
columns. Every linear fit of every fold, training share, setting or bootstrap draw follows from
them without a look at the rows. Logistic fits share their scans: a round of
Newton steps reads the rows once for all models. Sums are taken in the tasks, matrix by matrix,
and added up by Spark in blocks; what comes back has the size of the models.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a block of sums, and rows that a logistic round takes at once.
BLOCK, SLICE = 65_536, 1_024
#: Distribution function of a Poisson number of mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def add_up(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterable[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sums over all rows of the vectors that ``kernel`` gives per batch and group."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, values in kernel(batch) if batch.num_rows else ():
                sums[group] = sums[group] + values if group in sums else values.astype(np.float64)
        for group, values in sums.items():
            for k in range(0, len(values), BLOCK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group], pa.int32()), pa.array([k // BLOCK], pa.int32()), pa.array([values[k:k + BLOCK].tobytes()], pa.binary())],
                    names=["group", "block", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in table.column("sums"))
        return pa.table({"group": table.column("group")[:1], "block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "group int, block int, sums binary"
    found = df.mapInArrow(partial, kind).groupBy("group", "block").applyInArrow(merge, kind).collect()
    out: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["group"], r["block"])):
        out.setdefault(r["group"], []).append(np.frombuffer(r["sums"]))
    return {g: np.concatenate(v) for g, v in out.items()}


def columns_of(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Columns as a matrix of doubles; nulls become NaN."""
    return np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.float64) for n in names])


# -- linear models --------------------------------------------------------------

@dataclass
class Moments:
    """Count, sums and products of columns; the label is the last. Values are taken from ``shift`` on."""

    n: float
    sums: np.ndarray
    products: np.ndarray
    shift: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products, self.shift)

    def centred(self) -> np.ndarray:
        return self.products - np.outer(self.sums, self.sums) / max(self.n, 1.0)

    def squared_errors(self, model: Linear) -> float:
        """Sum of squared errors of the model over these rows."""
        v = np.append(-model.weights, 1.0)
        bias = model.bias + float(self.shift[:-1] @ model.weights) - self.shift[-1]
        return float(v @ self.products @ v - 2 * bias * (v @ self.sums) + self.n * bias * bias)

    def r2(self, model: Linear) -> float | None:
        total = float(self.centred()[-1, -1])
        return 1 - self.squared_errors(model) / total if total > 0 else None


@dataclass
class Linear:
    weights: np.ndarray
    bias: float


def _matrices(x: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    scaled = x if weight is None else x * weight[:, None]
    n = len(x) if weight is None else weight.sum()
    return np.concatenate([[n], scaled.sum(axis=0), (scaled.T @ x).ravel()])


def _moments(flat: np.ndarray, shift: np.ndarray) -> Moments:
    p = len(shift)
    return Moments(flat[0], flat[1:p + 1], flat[p + 1:].reshape(p, p), shift)


def _shift(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Means, from which values are taken, so that squares of large values do not cancel."""
    row = df.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).first()
    return np.array([v or 0.0 for v in row], np.float64)


def moments(df: DataFrame, cols: Sequence[str], group: Column) -> dict[int, Moments]:
    """Moments of the columns per integer group; the columns hold no nulls."""
    cols, shift = list(cols), _shift(df, cols)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)], group.cast("int").alias("g"))
    names = rows.columns[:-1]

    def kernel(batch: pa.RecordBatch):
        x, g = columns_of(batch, names) - shift, batch.column(len(names)).to_numpy(zero_copy_only=False)
        for k in np.unique(g):
            yield int(k), _matrices(x[g == k])

    return {g: _moments(v, shift) for g, v in add_up(rows, kernel).items()}


def poisson_weights(key: np.ndarray, draw: int) -> np.ndarray:
    """Poisson weights of mean 1 from 64-bit keys: the same for a key in any partition."""
    h = key.astype(np.uint64) ^ np.uint64((draw * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2 ** 64)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    h ^= h >> np.uint64(33)
    return np.searchsorted(POISSON, (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53, "right").astype(np.float64)


def drawn_moments(df: DataFrame, cols: Sequence[str], key: Column, draws: int, seed: int) -> dict[int, Moments]:
    """Moments of bootstrap draws: every draw weighs each row by a Poisson number from its key."""
    cols, shift = list(cols), _shift(df, cols)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)], key.alias("key"))
    names = rows.columns[:-1]

    def kernel(batch: pa.RecordBatch):
        x, h = columns_of(batch, names) - shift, batch.column(len(names)).to_numpy(zero_copy_only=False)
        for k in range(draws):
            yield k, _matrices(x, poisson_weights(h, seed + k))

    return {g: _moments(v, shift) for g, v in add_up(rows, kernel).items()}


def linear(m: Moments, strength: float = 0.0, mix: float = 0.0, rounds: int = 10_000) -> Linear:
    """Least squares with the penalty ``strength * (mix * |w| + (1 - mix) / 2 * w²)`` per row; the bias is free."""
    n, c = max(m.n, 1.0), m.centred()
    a, b = c[:-1, :-1] / n, c[:-1, -1] / n
    if strength == 0.0 or mix == 0.0:
        w = np.linalg.lstsq(a + strength * np.eye(len(b)), b, rcond=None)[0]
    else:
        w = _descend(a, b, np.zeros(len(b)), strength * mix, strength * (1 - mix), np.ones(len(b), bool), rounds)
    mean = m.sums / n + m.shift
    return Linear(w, float(mean[-1] - mean[:-1] @ w))


def _descend(a: np.ndarray, b: np.ndarray, w: np.ndarray, l1: float, l2: float, penalised: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """Coordinate descent on ``w'aw/2 - b'w`` with the penalties on the penalised coordinates."""
    w = w.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            one, two = (l1, l2) if penalised[j] else (0.0, 0.0)
            r = b[j] - a[j] @ w + a[j, j] * w[j]
            curve = a[j, j] + two
            new = 0.0 if curve <= 0 else math.copysign(max(abs(r) - one, 0.0), r) / curve
            moved = max(moved, abs(new - w[j]) * math.sqrt(max(a[j, j], 0.0)))
            w[j] = new
        if moved < 1e-12:
            break
    return w


# -- logistic models ---------------------------------------------------------------

@dataclass
class Task:
    """A logistic fit: the fold held out (or None) and its penalty."""

    held: int | None
    strength: float
    mix: float


def logistic(rows: DataFrame, features: Sequence[str], label: str, fold: str | None, tasks: Sequence[Task],
             rounds: int = 40, tolerance: float = 1e-9) -> list[Linear]:
    """Fits of all tasks; each round of Newton steps is one scan of the rows for all of them.

    A step that raises a task's loss is halved. The penalty has the form of ``linear``; the bias is free.
    """
    d = len(features)
    narrow = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)],
                         F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("g"))
    names = narrow.columns[:d]

    one, two = np.triu_indices(d + 1)

    def scan(weights: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        held = np.array([-1 if tasks[k].held is None else tasks[k].held for k in weights])  # folds are from 0 on
        models = np.column_stack(list(weights.values()))

        def kernel(batch: pa.RecordBatch):
            x = np.column_stack([columns_of(batch, names), np.ones(batch.num_rows)])
            y, g = (batch.column(k).to_numpy(zero_copy_only=False) for k in (d, d + 1))
            total = 0.0
            for a in range(0, len(x), SLICE):  # all models side by side, in slices that stay in the cache
                u, v, in_ = x[a:a + SLICE], y[a:a + SLICE, None], (g[a:a + SLICE, None] != held).astype(np.float64)
                z = u @ models
                e = np.exp(-np.abs(z))
                p = np.where(z >= 0, 1.0, e) / (1 + e)
                loss = ((np.log1p(e) + np.maximum(z, 0) - v * z) * in_).sum(axis=0)
                total = total + np.vstack([in_.sum(axis=0), loss, u.T @ ((p - v) * in_), (u[:, one] * u[:, two]).T @ (p * (1 - p) * in_)])
            for k, flat in zip(weights, total.T):
                curve = np.empty((d + 1, d + 1))
                curve[one, two] = curve[two, one] = flat[d + 3:]
                yield k, np.concatenate([flat[:d + 3], curve.ravel()])
        return add_up(narrow, kernel)

    penalised = np.arange(d + 1) < d
    now = {k: np.zeros(d + 1) for k in range(len(tasks))}
    best: dict[int, tuple[float, np.ndarray, np.ndarray, np.ndarray]] = {}  # loss, weights, gradient, curvature
    ready: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        if not now:
            break
        following = {}
        for k, flat in scan(now).items():
            t, n, w = tasks[k], max(flat[0], 1.0), now[k]
            loss = flat[1] / n + t.strength * (t.mix * np.abs(w[:d]).sum() + (1 - t.mix) / 2 * (w[:d] ** 2).sum())
            if k in best and not loss <= best[k][0] + 1e-13:
                following[k] = (w + best[k][1]) / 2
            else:
                better = best[k][0] - loss if k in best else math.inf
                best[k] = loss, w, flat[2:d + 3] / n, flat[d + 3:].reshape(d + 1, d + 1) / n
                if better > tolerance * max(abs(loss), 1e-3):
                    _, _, slope, curve = best[k]
                    curve = curve + 1e-12 * np.eye(d + 1)
                    following[k] = _descend(curve, curve @ w - slope, w, t.strength * t.mix, t.strength * (1 - t.mix), penalised, 2_000)
            if k in following and np.abs(following[k] - best[k][1]).max() < 1e-10:
                del following[k]
        now = following
    for k in range(len(tasks)):
        ready[k] = best[k][1] if k in best else np.zeros(d + 1)
    return [Linear(w[:d], float(w[d])) for w in ready.values()]


# -- correlations --------------------------------------------------------------------

def correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Correlation of each pair of columns over the rows that have both; NaN where there is none.

    Four products per pair of columns, with zeros for missing values: rows with both, sums and squares of the one where
    the other is there, and products. Works for many columns, as plans and code do not grow with pairs.
    """
    cols = list(cols)
    number = [F.col(f"`{c}`").cast("double") for c in cols]
    rows = df.select(*[F.when(F.abs(x) < float("inf"), x).alias(f"c{i}") for i, x in enumerate(number)])  # NaN is above all
    rows_names, p = rows.columns, len(cols)
    shift = _shift(rows, rows_names)

    def kernel(batch: pa.RecordBatch):
        x = columns_of(batch, rows_names) - shift
        there = ~np.isnan(x)
        x, m = np.where(there, x, 0.0), there.astype(np.float64)
        yield 0, np.concatenate([(m.T @ m).ravel(), (x.T @ m).ravel(), ((x * x).T @ m).ravel(), (x.T @ x).ravel()])

    flat = add_up(rows, kernel).get(0, np.zeros(4 * p * p))
    n, s, q, xy = flat.reshape(4, p, p)
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = xy - s * s.T / n
        spread = np.maximum(q - s * s / n, 0.0)
        spread = np.where(spread > 1e-14 * np.maximum(q, 1e-300), spread, 0.0)
        r = cov / np.sqrt(spread * spread.T)
    return np.where(np.isfinite(r), np.clip(r, -1.0, 1.0), np.nan)
