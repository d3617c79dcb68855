"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import op13_negatives, queries


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95):
    whole = [(i, str(y), [math.floor(256 * float(np.float64(x))) for x in v]) for i, v, y in rows
             if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v in sorted((r for r in whole if r[0] is not None and anchor(r[0])), key=lambda r: r[1:]):
        anchors.setdefault(i, (y, v))
    out = []
    for a, (label, v) in anchors.items():
        found = sorted((-sum(p * q for p, q in zip(v, w)), i is None, i or 0, y) for i, y, w in whole if i != a)
        for s, none, i, y in [f for f in found if f[3] == label][:positives]:
            near = [f for f in found if f[3] != label and low * -s <= 100 * -f[0] <= high * -s][:negatives]
            out += [(a, None if none else i, r + 1, None if f[1] else f[2], -s, -f[0]) for r, f in enumerate(near)]
    return sorted(out, key=repr)


def rows(frame):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


def test_query_matches_brute_force_and_sql(spark, folder, tables):
    data = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    data = [(i, v, (y + 1) % 10 if i % 7 == 0 and y is not None else y) for i, v, y in data]
    got = rows(queries.QUERIES["op13_hard_negatives"](spark, folder))
    assert got == brute(data, lambda i: i % 50 == 0) and got
    cur = tables.execute(queries.CHECKS["op13_hard_negatives"])
    names = [c[0] for c in cur.description]
    order = [names.index(c) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]
    assert got == sorted((tuple(r[k] for k in order) for r in cur.fetchall()), key=repr)


def vectors(rng, n, width=21):
    centres = rng.normal(size=(4, width))
    return [(k, (centres[k % 4] * rng.choice([0.2, 1.0, 3.0]) + rng.normal(size=width) * 0.4).tolist(), int(rng.integers(0, 3))) for k in range(n)]


@pytest.mark.parametrize("sample", [0, 40, 5_000])
def test_odd_tables(spark, monkeypatch, sample):
    monkeypatch.setattr(op13_negatives, "PACK_BYTES", 8_000)
    monkeypatch.setattr(op13_negatives, "ANCHOR_BYTES", 1_500)
    rng = np.random.default_rng(11)
    data = vectors(rng, 260)
    data += [(None, data[1][1], 0), (None, data[1][1], 1), (5, data[9][1], 1), (300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 21, 1),
             (303, [float("inf")] + [0.0] * 20, 1), (304, data[0][1], None), (305, [], 1), (306, [2.0, -1.0], 0), (307, [0.0] * 21, 2)]
    data += [(400 + k, data[3][1], k % 2) for k in range(90)]  # copies
    frame = spark.createDataFrame([(*d, "x", 1) for d in data], "vec_id long, embedding array<double>, label int, anchor string, v int")
    got = op13_negatives.mine(frame.repartition(5), F.col("vec_id") % 10 == 0, sample_rows=sample)
    assert rows(got) == brute(data, lambda i: i % 10 == 0)


def test_reach_is_exact(monkeypatch):
    rng = np.random.default_rng(3)
    for share in (0.0, 0.02, 1.1):
        monkeypatch.setattr(op13_negatives, "SPARSE", share)
        for dtype in (np.float64, np.int64):
            q, y = ((rng.normal(size=(n, 40)) * 100 / np.arange(1, 41)).astype(np.int64).astype(dtype) for n in (30, 200))
            scores = (q @ y.T).astype(np.int64)
            for top in (-10 ** 6, 0, 5_000, 10 ** 7):
                low = rng.integers(top - 2_000, top + 2_000, 30)
                a, r, s = op13_negatives.reach(q, op13_negatives._norms(q), low, y, op13_negatives._norms(y))
                want = {(i, j, scores[i, j]) for i, j in zip(*np.nonzero(scores >= low[:, None]))}
                assert set(zip(a.tolist(), r.tolist(), s.tolist())) == want and len(a) == len(want)


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.5], 1), (2, [1.0, 0.25], 1), (3, [0.75, 0.25], 2)], "vec_id long, embedding array<float>, label int")
    assert rows(op13_negatives.mine(frame.limit(0), F.col("vec_id") == 1)) == []
    assert rows(op13_negatives.mine(frame, F.col("vec_id") == 9)) == []
    assert rows(op13_negatives.mine(frame, F.col("vec_id") == 1)) == brute([tuple(r) for r in frame.collect()], lambda i: i == 1)
