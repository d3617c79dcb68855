"""Toxic passages: maximum-scoring segments of token log-odds with extreme-value statistics.

A token is a word or the start of one. Its score is its log-odds between toxic and
other labelled documents under an informative Dirichlet prior, whose weights are
the token's counts in the whole corpus, less a constant; a document counts a token once. A word scores as
the surest of its tokens. A document's maximal segments are found in one
scan over its scores. The best segment of a harmless text of ``n`` tokens follows
an extreme-value law, fitted to labelled texts that are not toxic; the expected number of as
good segments says which passages are significant. Their evidence adds up, and a
logistic curve turns it into a probability. Law and curve are fitted on labelled
rows scored by the other folds' counts. Tokens are hashed to ``BUCKETS`` buckets, so what is shipped to tasks has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulseframe.llm.common import add_up, as_blocks, byte_table, cut_words, drop_columns, fold, labelled_sample, materialize, slices

BUCKETS = 1 << 18
#: Labelled rows that are learned from, at most, and the folds they are scored in for the calibration.
SAMPLE, FOLDS = 40_000, 4
THRESHOLD = 0.7
#: Bytes of a word's starts that are tokens of their own, so that inflected words count together.
HEADS = (4, 6)
#: Pseudo-documents of the prior in each class: shared out by the corpus, and for every token.
PRIOR, FLOOR = 200.0, 0.5
#: Standard errors a score is drawn to 0 by, and what every word's score is lowered by.
SURE, DRIFT = 1.0, 1.0
_WORDS = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
PASSAGES = T.ArrayType(T.StructType([
    T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


class Model(NamedTuple):
    """Token scores, the law's decay and log size, and the logistic weights."""
    odds: np.ndarray
    decay: float
    log_k: float
    weights: np.ndarray


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of tokens (words, and their starts), and the bounds of each text's words."""
    h, _, bounds = cut_words(texts, _WORDS, heads=HEADS)
    return (h >> np.uint64(46)).astype(np.int64), bounds


def _word_scores(token: np.ndarray, odds: np.ndarray) -> np.ndarray:
    each = odds[token]
    return np.take_along_axis(each, np.abs(each).argmax(axis=0)[None], axis=0)[0] - np.float32(DRIFT)


def log_odds(corpus: np.ndarray, toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, sure: float = SURE) -> np.ndarray:
    """Log-odds of a document of each class to have each token, with the corpus as prior, drawn to 0 by ``sure`` standard errors."""
    prior = PRIOR * corpus / max(1.0, corpus.sum()) + FLOOR
    delta = np.log((toxic + prior) / (n_toxic + 2 * prior)) - np.log((other + prior) / (n_other + 2 * prior))
    error = np.sqrt(1 / (toxic + prior) + 1 / (other + prior))
    return np.sign(delta) * np.maximum(np.abs(delta) - sure * error, 0)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past, score) in one scan.

    Every segment is the best one in the room that better ones leave it. Runs
    of one sign are taken together, as no maximal segment cuts one.
    """
    if not len(scores) or scores.max() <= 0:
        return []
    sign = scores > 0
    first = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1])))
    past = np.append(first[1:], len(scores))
    sums = np.add.reduceat(scores, first)
    stack: list[list] = []  # first, past, total before, total after, place of the nearest earlier one with less before
    total = 0.0
    for a, b, s in zip(first.tolist(), past.tolist(), sums.tolist()):
        if s <= 0:
            total += s
            continue
        now = [a, b, total, total + s, -1]
        total += s
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= now[2]:
                k = stack[k][4]
            now[4] = k
            if k < 0 or stack[k][3] >= now[3]:
                break
            now[0], now[2] = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append(now)
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def _best(scores: np.ndarray) -> float:
    total = np.concatenate(([0.0], np.cumsum(scores)))
    return float((total - np.minimum.accumulate(total)).max())


def evidence(scores: np.ndarray, decay: float, log_k: float) -> tuple[np.ndarray, list[dict]]:
    """Features of a text and its significant passages (fewer than one as good expected in a harmless text)."""
    n = max(1, len(scores))
    base = log_k + np.log(n)
    found = []
    if decay * _best(scores) > base:
        found = [(a, b, s) for a, b, s in segments(scores) if decay * s > base]
    parts = sorted((decay * s - base for _, _, s in found), reverse=True)
    x = np.array([np.log1p(parts[0]) if parts else 0.0, np.log1p(sum(parts)), min(len(parts), 20) / 4,
                  np.clip(decay * _best(scores) - base, -10, 10) / 4, (np.log1p(n) - 5) / 2])
    return x, [{"first_word": a, "n_words": b - a, "score": s, "expected": float(np.exp(base - decay * s))} for a, b, s in found]


def counts(docs: DataFrame, known: dict[int, tuple[int, int]]) -> np.ndarray:
    """Rows of token counts: all of the corpus, then documents with the token by fold and label.

    Every document is counted; ``known`` holds (fold, label) of the bounded sample.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)
    rows = 1 + 2 * FOLDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = sent.value, np.zeros((rows, BUCKETS))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in slices(batch):
                token, bounds = _tokens(texts)
                total[0] += np.bincount(token.ravel(), minlength=BUCKETS)
                for k in range(len(texts)):
                    if (at := known.get(ids[first + k])) is not None:
                        total[1 + 2 * at[0] + at[1], np.unique(token[:, bounds[k]:bounds[k + 1]])] += 1
        yield as_blocks(total.ravel(), 64 * rows)

    return add_up(_narrow(docs).mapInArrow(run, "block int, values binary"), rows * BUCKETS).reshape(rows, BUCKETS)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights with the constant last, by Newton steps with a small ridge."""
    z = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    ridge = 0.05 * np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, sample: int = SAMPLE) -> Model:
    """The model from all documents' counts and a bounded sample of labelled rows outside the held-out fold."""
    labelled = labelled_sample(labels, "toxic", sample, fold(F.col("doc_id"), modulus) != held)
    known = {i: (k % FOLDS, labelled[i]) for k, i in enumerate(sorted(labelled))}
    table = counts(docs, known)
    corpus, by_fold = table[0], table[1:].reshape(FOLDS, 2, BUCKETS)
    n = np.zeros((FOLDS, 2), int)
    for f, y in known.values():
        n[f, y] += 1

    def odds_of(folds: list[int]) -> np.ndarray:
        size, seen = n[folds].sum(axis=0), by_fold[folds].sum(axis=0)
        if not size.all():
            return np.zeros(BUCKETS, np.float32)
        return log_odds(corpus, seen[1], seen[0], size[1], size[0]).astype(np.float32)

    odds = odds_of(list(range(FOLDS)))
    others = [odds_of([f for f in range(FOLDS) if f != g]) for g in range(FOLDS)]
    sent = docs.sparkSession.sparkContext.broadcast((others, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others, known = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [k for k, i in enumerate(ids) if i in known]
            batch = batch.take(pa.array(rows, pa.int64()))
            out = []
            for first, texts in slices(batch):
                token, bounds = _tokens(texts)
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    out.append(_word_scores(token[:, a:b], others[known[ids[rows[first + k]]][0]]).tobytes())
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known[ids[k]][1] for k in rows], pa.int32()),
                                                  pa.array(out, pa.binary())], names=["doc_id", "y", "scores"])

    rows = materialize(_narrow(docs).mapInArrow(run, "doc_id long, y int, scores binary"), "toxic_calibration")
    best = [(r.y, r.n, r.best) for r in rows.mapInArrow(_best_rows, "doc_id long, y int, n long, best double")
            .orderBy("doc_id", "n", "best").limit(2 * sample).collect()]
    harmless = np.array([(np.log(max(1, n)), s) for y, n, s in best if not y]).reshape(-1, 2)
    if len(harmless) < 10 or harmless[:, 1].std() < 1e-9:
        decay, log_k = 1.0, 0.0
    else:  # moments of the law: spread pi / (decay sqrt 6), mean (log k + log n + gamma) / decay
        decay = np.pi / (harmless[:, 1].std() * np.sqrt(6))
        log_k = decay * harmless[:, 1].mean() - np.euler_gamma - harmless[:, 0].mean()
    sent_law = (float(decay), float(log_k))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [evidence(np.frombuffer(s, np.float32).astype(np.float64), *sent_law)[0].tolist() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(features, "doc_id long, y int, x array<double>").orderBy("doc_id", "x").limit(2 * sample).collect()
    y = np.array([r.y for r in got], float)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.01, 0.01, 0.99))
        weights = np.array([0.0] * 5 + [np.log(share / (1 - share))])
    else:
        weights = _logistic(np.array([r.x for r in got]), y)
    return Model(odds, *sent_law, weights)


def _best_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [np.frombuffer(s, np.float32).astype(np.float64) for s in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(s) for s in scores], pa.int64()), pa.array([_best(s) for s in scores], pa.float64())],
            names=["doc_id", "y", "n", "best"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score, the probability of being toxic, and the significant passages with the best first."""
    docs = drop_columns(docs, {"score", "passages"})
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores, passages = [], []
            for _, texts in slices(batch):
                token, bounds = _tokens(texts)
                odds = _word_scores(token, model.odds).astype(np.float64)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    x, found = evidence(odds[a:b], model.decay, model.log_k)
                    scores.append(1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -40, 40))))
                    passages.append(sorted(found, key=lambda p: (p["expected"], p["first_word"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)],
                                             names=[*batch.schema.names, "score", "passages"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGES)]))


def report(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and passages of every document.

    Null and empty texts have no passages and a score. Ids may be null or
    repeat; without labels of both kinds all scores are the same.
    """
    narrow = docs.select(docs["doc_id"], docs["text"])
    scored = score(narrow, fit(docs, labels, modulus, held))
    return scored.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
