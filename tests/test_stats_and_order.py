"""Exact quantiles, modes, running totals and ranks, on the small and the split paths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions.binning import count_below, cut, quantile_label
from pulseframe.operators import evaluation, monitoring, ordered, rollups, stats


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    out = [rng.gauss(0, 1) for _ in range(3000)] + [7.0] * 1500 + [rng.expovariate(1) ** 4 for _ in range(1500)]
    rng.shuffle(out)
    return out


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize("cells", [65_536, 16])
def test_quantiles_are_exact_with_few_and_many_cells(spark, values, cells):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(4)
    got = stats.quantiles(df, {"x": PROBS}, cells=cells)["x"]
    assert got == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12)


def test_several_wide_columns_share_the_passes(spark, values):
    shifted = [v * 2 + 1 for v in values]
    df = spark.createDataFrame(list(zip(values, shifted)), "x double, y double")
    got = stats.quantiles(df, {"x": [0.3, 0.5], "y": [0.25, 0.9]}, cells=64)
    assert got["x"] == pytest.approx(np.quantile(values, [0.3, 0.5]).tolist(), rel=1e-12)
    assert got["y"] == pytest.approx(np.quantile(shifted, [0.25, 0.9]).tolist(), rel=1e-12)


def test_quantiles_with_far_values_and_many_marks(spark, values):
    odd = values + [1e300, -1e300, 5e-324, 0.0, -0.0, 1e-300, 3.0, 3.0000000000000004] * 3 + [float("inf")]
    marks = np.linspace(0, 1, 201).tolist()
    df = spark.createDataFrame([(v,) for v in odd] + [(None,), (float("nan"),)], "x double").repartition(3)
    got = stats.quantiles(df, {"x": marks}, cells=2_000)["x"]
    ordered_values, n = sorted(odd), len(odd) - 1
    for p, g in zip(marks, got):
        lo, hi = ordered_values[int(np.floor(n * p))], ordered_values[int(np.ceil(n * p))]
        assert g == pytest.approx(lo if lo == hi else lo + (hi - lo) * (n * p - np.floor(n * p)), rel=1e-9)


def test_quantiles_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 4.0), (None, 4.0)], "a double, b double")
    assert stats.quantiles(df, {"a": [0.5], "b": [0.1, 0.9]}) == {"a": [None], "b": [4.0, 4.0]}


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), ("c", None)], "x string, y string")
    assert stats.modes(df, ["x", "y"]) == {"x": "a", "y": None}


def test_adjusted_skewness(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 9.0]
    n, m, s = len(xs), np.mean(xs), np.std(xs)
    want = np.mean(((np.array(xs) - m) / s) ** 3) * np.sqrt(n * (n - 1)) / (n - 2)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert df.agg(stats.adjusted_skewness(F.col("x"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("chunk", [10 ** 6, 37])
@pytest.mark.parametrize("down", [False, True])
def test_running_totals(spark, chunk, down):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(3), rng.randrange(400)) for _ in range(500)})
    data = [(g, k, k % 7) for g, k in rows]
    df = spark.createDataFrame(data, "g int, k int, v int").repartition(3)
    got = {(r["g"], r["k"]): r["t"] for r in
           ordered.running_totals(df, "k", {"t": "v"}, by=["g"], descending=down, chunk_rows=chunk).collect()}
    assert len(got) == len(data)
    for g in range(3):
        total = 0
        for k, v in sorted(((k, v) for h, k, v in data if h == g), reverse=down):
            total += v
            assert got[(g, k)] == total


@pytest.mark.parametrize("chunk", [10 ** 6, 40])
def test_row_numbers_span_chunks(spark, chunk):
    data = [("hot" if i % 3 else "cold", i * 7919 % 1000) for i in range(300)]
    df = spark.createDataFrame(data, "g string, k int")
    got = ordered.row_numbers(df, ["g"], [F.col("k")], "n", chunk).collect()
    for g in ("hot", "cold"):
        ks = sorted(k for h, k in data if h == g)
        assert [(r["k"], r["n"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["n"])] == [
            (k, i + 1) for i, k in enumerate(ks)]


@pytest.mark.parametrize("chunk", [10 ** 6, 5])
def test_index_values_of_text(spark, chunk):
    words = [f"w{i * 37 % 50}" for i in range(200)]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    got = {r["w"]: r["code"] for r in ordered.index_values(df, "w", chunk_rows=chunk).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


@pytest.mark.parametrize("hot", [10 ** 6, 2])
def test_next_in_group_across_chunks(spark, hot):
    days = [("a", d) for d in (1, 2, 15, 40, 41, 95)] + [("b", 3)]
    df = spark.createDataFrame(days, "g string, d int")
    got = {(r["g"], r["d"]): r["n"] for r in
           ordered.next_in_group(df, ["g"], "d", F.floor(F.col("d") / 30), "n", hot).collect()}
    assert got == {("a", 1): 2, ("a", 2): 15, ("a", 15): 40, ("a", 40): 41, ("a", 41): 95, ("a", 95): None, ("b", 3): None}
    nulls = spark.createDataFrame(days + [("a", None), ("c", None)], "g string, d int")
    rows = ordered.next_in_group(nulls, ["g"], "d", F.floor(F.col("d") / 30), "n", hot).collect()
    assert {(r["g"], r["d"]): r["n"] for r in rows} == got | {("a", None): None, ("c", None): None}


def test_cut_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 18.5, 18.6, 25.0, 50.0, 50.1, None)], "x double")
    edges, labels = (0, 18.5, 25, 50), ("u", "n", "o")
    right = [r[0] for r in df.select(cut(F.col("x"), edges, labels)).collect()]
    left = [r[0] for r in df.select(cut(F.col("x"), edges, labels, right=False)).collect()]
    assert right == [None, "u", "n", "n", "o", None, None]
    assert left == ["u", "n", "n", "o", None, None, None]


def test_quantile_label_keeps_ties_together(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 1, 2, 3, 4, 9)], "x double")
    edges = stats.quantiles(df, {"x": [0, 0.25, 0.5, 0.75, 1]})["x"]
    assert edges == [1.0, 1.0, 1.5, 3.25, 9.0]
    got = [r[0] for r in df.select(quantile_label(F.col("x"), edges)).collect()]
    assert got == [0, 0, 0, 0, 1, 1, 2, 2]


def test_count_below_is_strict(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4)], "x int")
    assert [r[0] for r in df.select(count_below(F.col("x"), [1, 2, 3])).collect()] == [0, 0, 1, 2, 3]


def _scored(spark, n=400):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y"]), int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, y int, s double")


def _auc(rows):
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("chunk", [10 ** 6, 9])
def test_auc_matches_pair_counting(spark, chunk):
    rows, df = _scored(spark)
    assert evaluation.roc_auc(df, "y", "s", chunk_rows=chunk).first()["roc_auc"] == pytest.approx(_auc(rows))
    flipped = df.withColumn("s", 1 - F.col("s"))
    assert evaluation.roc_auc(flipped, "y", "s").first()["roc_auc"] == pytest.approx(1 - _auc(rows))
    by = {r["g"]: r["roc_auc"] for r in evaluation.roc_auc(df, "y", "s", ["g"], chunk).collect()}
    for g in ("x", "y"):
        assert by[g] == pytest.approx(_auc([r for r in rows if r[0] == g]))


@pytest.mark.parametrize("chunk", [10 ** 6, 9])
def test_average_precision_and_ks_on_split_paths(spark, chunk):
    rows, df = _scored(spark)
    marks = sorted({s for _, _, s in rows}, reverse=True)
    total, last, want = sum(y for _, y, _ in rows), 0, 0.0
    for m in marks:
        tp = sum(y for _, y, s in rows if s >= m)
        want += (tp - last) / total * tp / sum(s >= m for _, _, s in rows)
        last = tp
    assert evaluation.average_precision(df, "y", "s", chunk).first()[0] == pytest.approx(want)
    ks = monitoring.drift_ks(df.withColumn("t", F.col("g")), F.lit("y"), "s", "t", chunk_rows=chunk).first()
    a, b = [s for g, _, s in rows if g < "y"], [s for g, _, s in rows if g >= "y"]
    gap = max(abs(sum(v <= m for v in a) / len(a) - sum(v <= m for v in b) / len(b)) for m in marks)
    assert ks["ks_statistic"] == pytest.approx(gap)


@pytest.mark.parametrize("chunk", [10 ** 6, 9])
def test_peer_percentile_split(spark, chunk):
    rows, df = _scored(spark)
    got = rollups.peer_percentile(df, ["g"], "s", chunk).collect()
    assert len(got) == len(rows)
    for r in got[:50]:
        mine = [s for g, _, s in rows if g == r["g"]]
        assert r["percentile"] == pytest.approx(sum(s < r["s"] for s in mine) / (len(mine) - 1))
        assert r["peer_average"] == pytest.approx(sum(mine) / len(mine))


def test_threshold_sweep_matches_direct_counts(spark):
    rows, df = _scored(spark)
    for r in evaluation.threshold_sweep(df, "y", "s").collect():
        tp = sum(y and s >= r["threshold"] for _, y, s in rows)
        fp = sum((not y) and s >= r["threshold"] for _, y, s in rows)
        fn = sum(y and s < r["threshold"] for _, y, s in rows)
        assert r["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0.0)
        assert r["recall"] == pytest.approx(tp / (tp + fn))


def test_area_under_roc_writes_no_scores(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ordered, "materialize", lambda df, name="": written.append(name) or df)
    draw = random.Random(8)
    rows = [(g, draw.choice([0, 1]), draw.choice([0.5, -0.0, 0.0, float("nan"), draw.random()])) for g in ("a", None) for _ in range(300)]
    rows += [("b", 1, 0.5), ("b", 1, 0.6), ("a", None, 0.5), ("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    rank = lambda x: (x != x, x if x == x else 0.0)  # noqa: E731  NaN is above all
    for chunk in (7, 1_000):
        got = {r["g"]: r for r in evaluation.roc_auc(df, "y", "s", ["g"], chunk).collect()}
        for g in ("a", None):
            pos, neg = ([rank(s) for h, y, s in rows if h == g and y == k and s is not None] for k in (1, 0))
            wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
            assert got[g]["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
            assert (got[g]["positives"], got[g]["negatives"]) == (len(pos), len(neg))
        assert got["b"]["roc_auc"] is None and len(got) == 3
    assert not written
