"""Fits from sums, shared logistic scans and binned forests against plain numpy and Spark ML."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pulseframe.functions import text as tx
from pulseframe.operators import bagged, boosting, forest, gram, quality, training
from pulseframe.plans import jobs

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 4)) * [1, 5, 0.2, 30] + [0, 1000, 0, -3]
    y = x @ [0.7, -0.2, 0.0, 0.01] + rng.normal(size=900)
    return np.column_stack([np.arange(900), x, y, (rng.random(900) < 1 / (1 + np.exp(-x[:, 0] - 0.5))).astype(float)])


@pytest.fixture(scope="module")
def frame(spark, table):
    return spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in table], "id long, a double, b double, c double, d double, y double, k double").repartition(5)


def folds_of(frame, k=5):
    rows = frame.select("id", tx.hash_bucket([F.col("id")], k).alias("f"), tx.hash_bucket([F.col("id"), F.lit("curve")], 10_000).alias("s")).collect()
    by = {r["id"]: (r["f"], r["s"]) for r in rows}
    return np.array([by[i][0] for i in range(len(by))]), np.array([by[i][1] for i in range(len(by))])


def scaled(table):
    x = table[:, 1:5]
    return (x - x.mean(axis=0)) / x.std(axis=0)


def ridge(x, y, alpha):
    xm, ym = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return lambda u: u @ w + ym - xm @ w


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_cross_validation_equals_fits_over_the_rows(frame, table):
    x, y, (fold, _) = scaled(table), table[:, 5], folds_of(frame)
    got = {r["fold"]: r for r in training.cross_validate(frame, NAMES, "y", "ridge", ["id"]).collect()}
    for f in range(5):
        p = ridge(x[fold != f], y[fold != f], 1.0)(x[fold == f])
        e = y[fold == f] - p
        assert (got[f]["r2"], got[f]["neg_mse"], got[f]["neg_mae"]) == pytest.approx((r2(y[fold == f], p), -(e ** 2).mean(), -np.abs(e).mean()), rel=1e-9)


@pytest.mark.parametrize("kind,params", [("ridge", {"alpha": 40.0}), ("lasso", {"alpha": 0.2}), ("elastic_net", {"alpha": 0.3, "l1_ratio": 0.4})])
def test_fits_have_the_usual_penalty(frame, table, kind, params):
    x, y = scaled(table), table[:, 5] * 7
    model = training.fit(frame.withColumn("y", F.col("y") * 7), NAMES, "y", kind, **params).stages[-1]
    w = model.coefficients.toArray()
    strength, mix = training._penalty(kind, len(y), **params)
    slope = x.T @ (y - x @ w - model.intercept) / len(y) - strength * (1 - mix) * w
    for s, v in zip(slope, w):
        assert abs(s) <= strength * mix + 1e-4 if abs(v) < 1e-9 else s == pytest.approx(math.copysign(strength * mix, v), abs=1e-4)


def test_learning_curve_equals_fits_over_the_rows(frame, table):
    x, y, (fold, slot) = scaled(table), table[:, 5], folds_of(frame)
    got = {(r["share"], r["side"]): r for r in training.learning_curve(frame, NAMES, "y", "ridge", ["id"], sizes=4).collect()}
    for share in (0.1, 0.4, 0.7, 1.0):
        sides = {"train": [], "validation": []}
        for f in range(5):
            at = (fold != f) & (slot < round(share * 10_000))
            fit = ridge(x[at], y[at], 1.0)
            sides["train"].append(r2(y[at], fit(x[at])))
            sides["validation"].append(r2(y[fold == f], fit(x[fold == f])))
        for side, scores in sides.items():
            assert got[(share, side)]["score_mean"] == pytest.approx(np.mean(scores), rel=1e-9)
            assert got[(share, side)]["score_std"] == pytest.approx(np.std(scores), rel=1e-6)


def test_lasso_meets_the_optimality_conditions(frame, table):
    m = gram.moments(frame, [*NAMES, "y"], F.lit(0))[0]
    for strength, mix in ((0.05, 1.0), (0.3, 0.5)):
        w = gram.linear(m, strength, mix)
        x, y = table[:, 1:5], table[:, 5]
        slope = x.T @ (y - x @ w.weights - w.bias) / len(y) - strength * (1 - mix) * w.weights
        for s, v in zip(slope, w.weights):
            assert abs(s) <= strength * mix + 1e-7 if v == 0 else s == pytest.approx(math.copysign(strength * mix, v), abs=1e-7)


@pytest.mark.parametrize("mix", [0.0, 1.0, 0.5])
def test_logistic_fits_equal_spark_ml(frame, mix):
    z = frame.select("k", *[((F.col(c) - m) / s).alias(c) for c, m, s in (("a", 0, 1), ("b", 1000, 5), ("c", 0, 0.2), ("d", -3, 30))], (F.col("id") % 3).cast("int").alias("fold"))
    got = gram.logistic(z, NAMES, "k", "fold", [gram.Task(f, s, mix) for f in (None, 1) for s in (0.0, 0.02, 0.1)])
    packed = VectorAssembler(inputCols=NAMES, outputCol="features").transform(z)
    for model, (held, strength) in zip(got, [(h, s) for h in (None, 1) for s in (0.0, 0.02, 0.1)]):
        want = LogisticRegression(labelCol="k", regParam=strength, elasticNetParam=mix, standardization=False, maxIter=500, tol=1e-12).fit(
            packed if held is None else packed.where(F.col("fold") != held))
        assert model.weights == pytest.approx(want.coefficients.toArray(), abs=2e-5) and model.bias == pytest.approx(want.intercept, abs=2e-5)


def test_searches(spark, frame, table):
    found = training.search(frame, NAMES, "y", "lasso", ["id"], task="regression", grid={"regParam": [0.01, 10.0], "maxIter": [100]})
    assert found.best() == 0 and found.mean[1] < 0.1 and training.search_table(found, spark).count() == 2
    found = training.search(frame, NAMES, "k", "logistic_regression", ["id"])
    assert len(found.mean) == 8 and max(found.mean) > 0.7 and all(s >= 0 for s in found.std)
    again = training.search(frame.repartition(1), NAMES, "k", "logistic_regression", ["id"])
    assert again.mean == pytest.approx(found.mean, abs=1e-6)
    trees = training.search(frame, NAMES, "k", "random_forest", ["id"], grid={"numTrees": [3], "maxDepth": [2]}, k=2)
    assert len(trees.mean) == 1 and trees.mean[0] > 0.6


@pytest.mark.parametrize("kind", ["ridge", "random_forest"])
def test_bootstrap_does_not_depend_on_partitions(frame, kind):
    params = {"numTrees": 3, "maxDepth": 3} if kind == "random_forest" else {}
    one, other = (training.bootstrap_stability(frame.repartition(n), NAMES, "y", kind, 3, keys=["id"], **params).first() for n in (1, 8))
    assert one["mean_prediction_std"] > 0 and one.asDict() == pytest.approx(other.asDict(), rel=1e-6)


def test_poisson_weights_have_mean_and_variance_one():
    w = gram.poisson_weights(np.arange(200_000), 5)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    n = np.repeat([1, 7, 200], 60_000)
    w = forest._weights(forest._keys(np.arange(len(n) * 4, dtype=np.uint32).view(np.uint8).reshape(len(n), 16)), n, 3)
    for k in (1, 7, 200):
        assert w[n == k].mean() == pytest.approx(k, rel=0.02) and w[n == k].var() == pytest.approx(k, rel=0.05)


def test_correlations_of_present_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) + 1e6
    x[:, 1] = x[:, 0] + rng.normal(size=400) * 0.1
    x[:, 5] = 3.0
    there = rng.random(x.shape) < 0.7
    names = [f"c {i}" for i in range(6)]
    df = spark.createDataFrame([tuple(float(v) if t else None for v, t in zip(r, m)) for r, m in zip(x, there)], ", ".join(f"`{n}` double" for n in names))
    got = gram.correlations(df, names)
    for i in range(5):
        for j in range(5):
            at = there[:, i] & there[:, j]
            assert got[i, j] == pytest.approx(np.corrcoef(x[at, i], x[at, j])[0, 1], abs=1e-8)
    assert np.isnan(got[5]).all()
    assert [(r["feature1"], r["feature2"]) for r in quality.high_correlations(df, names).collect()] == [("c 0", "c 1")]


def test_correlations_of_many_columns(spark):
    base = spark.range(300)
    df = base.select(*[(F.rand(i) + F.col("id") * (0.01 if i % 100 == 0 else 0)).alias(f"c{i}") for i in range(500)])
    found = {(r["feature1"], r["feature2"]) for r in quality.high_correlations(df).collect()}
    assert found == {(f"c{100 * i}", f"c{100 * j}") for i in range(5) for j in range(i + 1, 5)}


@pytest.fixture(scope="module")
def binned(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 5, 3_000), rng.normal(size=(3_000, 7))]).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 0.3) ^ (rng.random(3_000) < 0.1)).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(k)) for r, k in zip(x, y)], ", ".join(f"f{i} double" for i in range(8)) + ", y double")
    return df, forest.binned(df.repartition(3), [f"f{i}" for i in range(8)], "y")


def test_forest_finds_the_features_that_matter(binned):
    df, data = binned
    found = forest.importances(data, data.features, 20, 4)
    assert sum(found.values()) == pytest.approx(1) and {"f0", "f1"} == set(sorted(found, key=found.get)[-2:])
    assert forest.importances(forest.binned(df.repartition(1), data.features, "y"), data.features, 20, 4) == pytest.approx(found, rel=1e-9)
    assert set(forest.eliminate(data, data.features, 2, trees=10, depth=4)) == {"f0", "f1"}


def test_dropping_features_gives_the_forest_without_them(binned):
    _, data = binned
    kept = forest.Forest(data, data.features, 8, 4)
    kept.drop(["f1"])
    kept.drop(["f5", "f0"])
    fresh = forest.Forest(data, data.features, 8, 4)
    fresh.gone = kept.gone.copy()
    fresh.left = list(kept.left)
    fresh.counts.clear()
    fresh.feature[:] = -1
    fresh._grow()
    assert (fresh.feature == kept.feature).all() and fresh.importances() == pytest.approx(kept.importances())
    assert set(kept.importances()) == {"f2", "f3", "f4", "f6", "f7"}


def test_forest_of_an_empty_table(spark):
    df = spark.createDataFrame([], "f0 double, f1 double, y double")
    assert forest.importances(forest.binned(df, ["f0", "f1"], "y"), ["f0", "f1"], 2, 2) == {"f0": 0.0, "f1": 0.0}


# -- other estimates ----------------------------------------------------------------

def test_exact_drift_test_equals_enumerated_orders():
    from itertools import combinations

    from pulseframe.operators import monitoring
    for n1, n2 in ((3, 4), (5, 5), (2, 7)):
        gaps = []
        for chosen in combinations(range(n1 + n2), n1):
            a = b = top = 0
            for k in range(n1 + n2):
                a, b = (a + 1, b) if k in chosen else (a, b + 1)
                top = max(top, abs(a * n2 - b * n1))
            gaps.append(top)
        for h in sorted(set(gaps)):
            assert monitoring.ks_exact(h, n1, n2) == pytest.approx(sum(g >= h for g in gaps) / len(gaps), rel=1e-12)
    n = 4_000
    assert monitoring.ks_exact(150 * n, n, n) == pytest.approx(monitoring.ks_p_value(150 / n, n, n), rel=0.05)


def test_neighbour_information_equals_brute_force(spark):
    from pulseframe.operators import selection
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 260)
    x = np.column_stack([rng.normal(size=260) + y, rng.integers(0, 6, 260), rng.normal(size=260), np.full(260, 2.0)])
    y = np.append(y, 9)
    x = np.vstack([x, [0.1, 0.2, 0.3, 2.0]])  # a class of one row

    def psi(n):
        return -0.5772156649015329 + sum(1 / k for k in range(1, int(n)))

    def brute(v):
        keep = np.isin(y, [c for c in set(y) if (y == c).sum() > 1])
        u, c = v[keep], y[keep]
        terms = []
        for i in range(len(u)):
            d = np.sort(np.abs(np.delete(u[c == c[i]], np.flatnonzero(np.flatnonzero(c == c[i]) == i)) - u[i]))
            k = min(3, len(d))
            r = d[k - 1]
            m = (u == u[i]).sum() if r == 0 else ((u > u[i] - r) & (u < u[i] + r)).sum()
            terms.append(psi(k) - psi((c == c[i]).sum()) - psi(m))
        return max(0.0, psi(len(u)) + np.mean(terms))

    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, c double, d double, y int").repartition(4)
    got = {r["feature"]: r["score"] for r in selection.mutual_information_neighbours(df, ["a", "b", "c", "d"], "y").collect()}
    assert got == pytest.approx({n: brute(x[:, k]) for k, n in enumerate("abcd")}, abs=1e-9) and got["a"] > 0.2


def test_normal_scores_on_odd_values(spark):
    from pulseframe.operators import scaling
    rows = [None, float("nan"), *[1.0] * 40, *map(float, range(2, 60))]
    df = spark.createDataFrame([(v, 5.0, None) for v in rows], "x double, flat double, none double")
    got = [r["x"] for r in scaling.quantile_normal(df).orderBy("x").collect()]
    assert got[0] is None and math.isnan(got[-1]) and got[1] == got[40] == pytest.approx(-5.199337582) and got[-2] == pytest.approx(5.199337582)
    assert got[1:-1] == sorted(got[1:-1])


def test_training_job_with_a_family_of_trees(frame, tmp_path):
    rows = frame.withColumn("k", F.col("k").cast("int"))
    out = jobs.training_job(rows, ["id"], NAMES, "k", str(tmp_path), "2024-01-31 00:00:00", {"random_forest": {"numTrees": [2], "maxDepth": [2]}}, k=2).first()
    assert out["is_best"] and 0.5 < out["cv_roc_auc_mean"] <= 1 and out["cv_roc_auc_std"] >= 0


def test_held_out_scores_leave_the_model_out_of_the_plan(frame):
    scored = training.held_out_scores(frame.where("id % 3 > 0"), frame.where("id % 3 = 0"), NAMES, "k", "random_forest", numTrees=2, maxDepth=2)
    assert scored.count() == 300 and scored.where("score between 0 and 1").count() == 300
    assert "UDF" not in scored._jdf.queryExecution().executedPlan().toString()


def test_a_dropped_feature_weighs_rows_on_the_way_to_its_nodes_only(monkeypatch):
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 16, (3_000, 9)).astype(np.uint8)
    y = (codes[:, 0] + codes[:, 1] + rng.integers(0, 8, 3_000) > 18).astype(np.int32)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(y), pa.array(rng.choice([1, 2, 40], 3_000))], names=["bins", "y", "n"])
    weighed, real = [], forest._weights
    monkeypatch.setattr(forest, "add_up", lambda table, kernel: {k: v.astype(np.float64) for k, v in kernel(batch)})
    monkeypatch.setattr(forest, "_weights", lambda key, n, draw: weighed.append(len(key)) or real(key, n, draw))
    data = forest.Binned(None, [f"f{i}" for i in range(9)], [0.0, 1.0], 16)
    kept = forest.Forest(data, data.features, 10, 5)
    assert sum(weighed) == 10 * 5 * 3_000
    weighed.clear()
    kept.drop(["f8"])
    assert 0 < sum(weighed) < 0.9 * len(weighed) * 3_000


def test_forests_keep_the_nodes_of_rows_from_level_to_level(spark, frame):
    assert all(make("random_forest", 10).getCacheNodeIds() for make in (training.classifier, training.regressor))
    weights = []
    for kept in (True, False):
        model = training.fit(frame, NAMES, "k", "random_forest", "classification", numTrees=5, maxDepth=4, cacheNodeIds=kept)
        weights.append([r["weight"] for r in training.importance_table(model, NAMES, spark).collect()])
    assert weights[0] == weights[1] and max(weights[0]) > 0


def test_rows_are_scored_once_for_all_figures_of_their_errors(spark, frame, monkeypatch):
    scored, predict = spark.sparkContext.accumulator(0), training.predict

    def counted(*args):
        @F.udf("double")
        def seen(x):
            scored.add(1)
            return x
        return predict(*args).withColumn("p", seen.asNondeterministic()("p"))

    monkeypatch.setattr(training, "predict", counted)
    model = training.fit(frame, NAMES, "k", "random_forest", numTrees=2, maxDepth=2)
    row = training.evaluate_regression(model, frame.drop(NAMES[-1]), NAMES, "k").first()
    assert row["mse"] >= 0 and scored.value == frame.count()  # a missing column is read as 0


def test_boosted_trees_over_binned_rows_score_as_those_of_spark(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=12_000), rng.integers(0, 90, 12_000), rng.integers(0, 20, 12_000), rng.random(12_000) < 0.05, np.ones(12_000)])
    y = rng.random(12_000) < 1 / (1 + np.exp(-x[:, 0] - (x[:, 1] > 60) * x[:, 3] * 2 + 0.2 * (x[:, 2] % 3)))
    names = ["a", "b", "c", "d", "e"]
    rows = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, e double, k int")
    rows = training.materialize(rows, "rows")
    train, test = rows.where("id % 5 > 0 or id < 1500"), rows.where("id % 5 = 0")
    monkeypatch.setattr(boosting, "LEAST", 2_000)  # several parts
    got = training.held_out_scores(train, test, names, "k", "gradient_boosting", maxIter=8).collect()
    model = training.fit(train, names, "k", "gradient_boosting", "classification", maxIter=8)
    want = training.predict(model, test, names, ["k"], "score").collect()
    assert sorted((r["k"], r["score"]) for r in got) == [(k, pytest.approx(s, abs=1e-12)) for k, s in sorted((r["k"], r["score"]) for r in want)]
    with pytest.raises(ValueError):
        training.held_out_scores(train.withColumn("k", F.col("k") + 1), test, names, "k", "gradient_boosting", maxIter=1)


def test_rows_of_equal_bins_are_one_row_of_a_boosting_round(spark):
    rows = spark.range(5_000).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"), (F.col("id") % 5 > 2).cast("double").alias("y"))
    model = boosting.Boosted(boosting.spark_cuts(rows, ["a", "b"]), 0.1)
    assert [c.tolist() for c in model.cuts] == [[0.5, 1.5], [0.5, 1.5, 2.5]]
    blocks = boosting._binned(rows, ["a", "b"], F.col("y"), model).collect()
    n, total = (np.concatenate([np.frombuffer(r[c]) for r in blocks]) for c in ("n", "total"))
    assert len(n) == 12 and n.sum() == 5_000 and total.sum() == -1_000


def test_a_split_hashes_its_keys_once_for_all_rounds(spark, frame, monkeypatch):
    hashed, hash60 = spark.sparkContext.accumulator(0), tx.hash60

    def counted(cols):
        @F.udf("long")
        def seen(h):
            hashed.add(1)
            return h
        return seen.asNondeterministic()(hash60(cols))

    monkeypatch.setattr(tx, "hash60", counted)
    out = training.stratified_split(frame, ["id"], "k")
    assert hashed.value == frame.count() and out.where("is_test").count() == sum(round(0.2 * r["count"]) for r in frame.groupBy("k").count().collect())


@pytest.mark.parametrize("task,label,params", [
    ("classification", "k", {"numTrees": 12, "maxDepth": 9}), ("classification", "three", {"numTrees": 3, "maxDepth": 20, "minInstancesPerNode": 2}),
    ("regression", "k", {"numTrees": 6, "maxDepth": 4})])
def test_forests_over_blocks_are_those_of_spark(spark, frame, monkeypatch, task, label, params):
    rows = frame.select("id", "a", F.floor("b").alias("b"), "c", (F.col("id") % 2).alias("d"), "k", (F.col("k") + (F.col("a") > 1).cast("int")).alias("three"))
    want = training.fit(rows, NAMES, label, "random_forest", task, cacheNodeIds=True, **params).stages[-1]
    monkeypatch.setattr(type(training.classifier("random_forest", 1)), "_fit", None)  # Spark's fit keeps its draws as objects
    monkeypatch.setattr(type(training.regressor("random_forest", 1)), "_fit", None)
    monkeypatch.setattr(bagged, "BLOCK", 50)
    got = training.fit(rows, NAMES, label, "random_forest", task, **params)
    assert got.stages[-1].toDebugString.split("\n")[1:] == want.toDebugString.split("\n")[1:] and type(got.stages[-1]) is type(want)
    assert got.stages[-1].featureImportances == want.featureImportances
    assert training.predict(got, rows, NAMES, ["id"]).where("prediction between 0 and 2").count() == 900


def test_cuts_are_drawn_from_the_rows_that_spark_samples(spark):
    from pyspark.ml.regression import DecisionTreeRegressor
    rows = spark.range(0, 30_000, 1, 5).select((F.col("id") * 7919 % 10_007 / 3).alias("x"), (F.col("id") % 3).cast("double").alias("few"))
    rows = rows.select("x", "few", F.col("x").alias("label"))
    tree = DecisionTreeRegressor(maxDepth=30, seed=42).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    cuts = bagged.spark_cuts(rows, ["x", "few"])
    assert {float(line.split("<= ")[1].rstrip(")")) for line in tree.toDebugString.split("\n") if "<=" in line} == set(cuts[0].tolist())
    assert cuts[1].tolist() == [0.5, 1.5]


def test_numbers_drawn_as_by_java_and_spark(spark):
    jvm = spark.sparkContext._jvm
    for seed in (42, -7, 2 ** 40 + 3):
        java, ours = jvm.java.util.Random(seed), bagged.JavaRandom(seed)
        assert [java.nextLong() for _ in range(4)] == [ours.long() for _ in range(4)]
        spark_s, xor = jvm.org.apache.spark.util.random.XORShiftRandom(seed), bagged.XorShift(seed)
        assert [spark_s.nextDouble() for _ in range(4)] == [xor.double() for _ in range(4)] and spark_s.nextInt() == xor.int()


def test_boosted_regressions_are_those_of_spark_in_few_jobs(spark, frame, monkeypatch):
    rows = frame.select("id", F.floor(F.col("a") * 2).alias("a"), (F.col("id") % 3).alias("b"), (F.col("d") > 0).alias("c"), F.lit(1).alias("d"), "y")
    want = training.fit(rows, NAMES, "y", "gradient_boosting", maxIter=12, maxDepth=3)  # with its depth given, Spark fits it
    monkeypatch.setattr(type(training.regressor("gradient_boosting", 1)), "_fit", None)
    passes = []
    monkeypatch.setattr(boosting.RDD, "mapPartitions", lambda *args: passes.append(args))
    got = training.fit(rows, NAMES, "y", "gradient_boosting", maxIter=12)
    assert not passes  # 36 passes over few rows of bins start no job
    monkeypatch.undo()
    a, b = (sorted((r["id"], r["prediction"]) for r in training.predict(m, rows, NAMES, ["id"]).collect()) for m in (want, got))
    assert a == [(i, pytest.approx(p, abs=1e-9)) for i, p in b]
    one, two = (m.stages[-1] for m in (want, got))
    assert one.featureImportances.toArray() == pytest.approx(two.featureImportances.toArray()) and list(one.treeWeights) == list(two.treeWeights)
