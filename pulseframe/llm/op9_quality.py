"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words and runs of marks are hashed to ``BUCKETS`` buckets. Each bucket has a fixed
sparse random index vector, and a bucket's word vector is the mean of the index
vectors that occur near it anywhere in the corpus. A document is the mean and
spread of its word vectors. A network of two layers is fitted in numpy on at most
``SAMPLE`` labelled documents, and a temperature fitted on a part kept back
turns its outputs into probabilities. What is shipped to tasks, the vectors and
the network, has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulseframe.llm.common import add_up, as_blocks, byte_table, cut_words, drop_columns, fold, labelled_sample, put_back, set_aside, slices

BUCKETS, WIDTH, NONZERO, REACH = 1 << 14, 48, 4, 2
#: Labelled rows the network is fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.3
_KEEP = byte_table(lambda b: b > 32 and b != 127, lower=False)
#: Letters and digits, and marks: a word ends where one follows the other.
_KINDS = bytes(0 if b <= 32 else 1 if chr(b).isalnum() and b < 128 or b >= 128 else 2 for b in range(256))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of the ``NONZERO`` entries of every bucket's index vector."""
    rng = np.random.default_rng(9)
    columns = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    return columns, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, _, bounds = cut_words(texts, _KEEP, _KINDS)
    return (h >> np.uint64(50)).astype(np.int64), bounds


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, WIDTH) from all of ``docs``: each task sends one sum per block of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, signs = index_vectors()
        total = np.zeros(BUCKETS * (WIDTH + 1))
        sums, counts = total[:BUCKETS * WIDTH], total[BUCKETS * WIDTH:]
        for batch in batches:
            for _, texts in slices(batch):
                token, bounds = _tokens(texts)
                counts += np.bincount(token, minlength=BUCKETS)
                owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
                for step in range(1, REACH + 1):
                    near = owner[step:] == owner[:-step]
                    left, right = token[:-step][near], token[step:][near]
                    for word, context in ((left, right), (right, left)):
                        at = word[:, None] * WIDTH + columns[context]
                        sums += np.bincount(at.ravel(), signs[context].ravel(), BUCKETS * WIDTH)
        yield as_blocks(total)

    total = add_up(docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "block int, values binary"), BUCKETS * (WIDTH + 1))
    counts = total[BUCKETS * WIDTH:]
    return (total[:BUCKETS * WIDTH].reshape(BUCKETS, WIDTH) / np.maximum(counts, 1)[:, None]).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, step: int = 65_536) -> np.ndarray:
    """Mean and spread of each text's word vectors, how far they move from word to word, and the log of its length.

    Empty texts give zeros.
    """
    token, bounds = _tokens(texts)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n)
    sums = np.zeros((2, len(texts), WIDTH))
    for a in range(0, len(token), step):
        part, whose = vectors[token[a:a + step]], owner[a:a + step]
        first = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
        sums[0][whose[first]] += np.add.reduceat(part, first, axis=0)
        sums[1][whose[first]] += np.add.reduceat(part * part, first, axis=0)
    mean, square = sums / np.maximum(n, 1)[:, None]
    spread = np.maximum(square - mean * mean, 0)
    stay = np.bincount(owner[1:][(token[1:] == token[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts)) / np.maximum(n - 1, 1)
    moves = np.zeros(len(texts))
    for a in range(1, len(token), step):
        part = vectors[token[a - 1:a + step]]
        same, whose = owner[a:a + step] == owner[a - 1:a - 1 + len(part) - 1], owner[a:a + step]
        moves += np.bincount(whose, np.square(part[1:] - part[:-1]).sum(axis=1) * same, len(texts))
    moves = moves / np.maximum(n - 1, 1) / np.maximum(2 * spread.sum(axis=1), 1e-9) * (n > 1)
    return np.hstack((mean, np.sqrt(spread), np.stack((stay, np.minimum(moves, 4), np.log1p(n)), 1)))


class Network(NamedTuple):
    """Standardising shift and scale, two layers, and the temperature."""
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, batch: int = 128, seed: int = 9) -> Network:
    """Adam on the log loss; a fifth of the rows only fits the temperature.

    Without rows of both labels the network is constant: the share of label 1 (0.5 without rows).
    """
    d = x.shape[1]
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back = order[: len(y) // 5] if len(y) >= 50 else order
    fit = order[len(y) // 5:] if len(y) >= 50 else order
    shift, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z = (x - shift) / scale
    p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            rows = fit[at:at + batch]
            h = np.tanh(z[rows] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40)))
            e = (out - y[rows]) / len(rows)
            back_h = np.outer(e, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back_h + 1e-4 * p[0], back_h.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logit, truth = net.logit(x[back]), y[back]
    grid = np.exp(np.linspace(np.log(0.5), np.log(8), 81))
    loss = [np.mean(np.logaddexp(0, np.where(truth > 0, -1, 1) * logit / g)) for g in grid]
    return net._replace(temperature=float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network of a bounded sample of labelled ones outside the held-out fold."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = labelled_sample(labels, "quality", sample, fold(F.col("doc_id"), modulus) != held)
    sent = spark.sparkContext.broadcast((vectors, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, known = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [k for k, i in enumerate(ids) if i in known]
            if not rows:
                continue
            batch = batch.take(pa.array(rows))
            x = np.concatenate([pooled(texts, vectors) for _, texts in slices(batch)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([known[ids[k]] for k in rows], pa.int32()), pa.array(list(x), pa.list_(pa.float64()))],
                names=["doc_id", "y", "x"])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = narrow.mapInArrow(run, "doc_id long, y int, x array<double>").orderBy("doc_id", "x").limit(2 * sample).collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), 2 * WIDTH + 3)
    return vectors, train(x, np.array([r.y for r in rows], float))


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """``docs`` with score, the probability of label 1. Null and empty texts get one too."""
    docs = drop_columns(docs, {"score"})
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for batch in batches:
            scores = [network.score(pooled(texts, vectors)) for _, texts in slices(batch)]
            done = pa.array(np.concatenate(scores) if scores else np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, done], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Ids may be null or repeat; without usable labels every score is the same.
    """
    narrow = docs.select(docs["doc_id"], docs["text"])
    scored = score(narrow, *fit(docs, labels, modulus, held))
    return scored.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored below the threshold, in their own columns."""
    kept = score(set_aside(docs, "doc_id", "text"), *fit(docs, labels)).where(F.col("score") >= threshold)
    return put_back(kept, docs, "doc_id", "text")
