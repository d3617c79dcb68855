"""Splits, model fits, search, validation and scoring with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions import risk
from pulseframe.functions import text as tx
from pulseframe.operators import bagged, boosting, evaluation, gram, stats
from pulseframe.session import materialize, spread

DIGITS = 12  # bits looked at per round of the split search


# -- splits -------------------------------------------------------------------

def random_split(df: DataFrame, keys: Sequence[str], fraction: float = 0.2, out: str = "is_test") -> DataFrame:
    """Repeatable split: the md5 bucket of the key decides, whatever the partitioning."""
    bucket = tx.hash_bucket([F.col(k) for k in keys], 10_000)
    return df.withColumn(out, bucket < int(fraction * 10_000))


def stratified_split(
    df: DataFrame, keys: Sequence[str], label: str, fraction: float = 0.2, out: str = "is_test"
) -> DataFrame:
    """The ``fraction`` of each class with the lowest key hash goes to the test side.

    The cut-off hash per class is found digit by digit from counts of at most
    4096 buckets per class, so no class is ever sorted or gathered.
    """
    hashed = df.withColumn("_h", tx.hash60([F.col(k) for k in keys]))
    marks = materialize(hashed.select(label, "_h"), "marks")  # hashed once for all rounds
    sizes = {r[label]: r["count"] for r in marks.groupBy(label).count().collect()}
    want = {c: int(round(n * fraction)) for c, n in sizes.items()}
    cut = {c: 0 for c in sizes}        # hashes below the cut-off are in
    open_ = {c: want[c] for c in sizes if 0 < want[c] < sizes[c]}
    prefix = {c: 0 for c in open_}
    for shift in range(60 - DIGITS, -1, -DIGITS):
        if not open_:
            break
        inside = F.lit(False)
        for c in open_:
            same = F.shiftright("_h", shift + DIGITS) == F.lit(prefix[c]) if shift < 60 - DIGITS else F.lit(True)
            inside = inside | (F.col(label).eqNullSafe(F.lit(c)) & same)
        digit = F.shiftright("_h", shift).bitwiseAND(F.lit((1 << DIGITS) - 1)).alias("d")
        rows = marks.where(inside).groupBy(label, digit).count().collect()
        for c in list(open_):
            left = open_[c]
            counts = sorted((r["d"], r["count"]) for r in rows if r[label] == c)
            for d, n in counts:
                if left < n:
                    break
                left -= n
                d = d + 1
            base = (prefix[c] << DIGITS) + d
            prefix[c], open_[c], cut[c] = base, left, base << shift
            if left == 0:
                del open_[c]
    test = F.lit(False)
    for c, n in sizes.items():
        if want[c] >= n:
            test = test | F.col(label).eqNullSafe(F.lit(c))
        elif want[c]:
            test = test | (F.col(label).eqNullSafe(F.lit(c)) & (F.col("_h") < F.lit(cut[c])))
    return hashed.withColumn(out, test).drop("_h")


def with_folds(df: DataFrame, keys: Sequence[str], k: int = 5, out: str = "fold") -> DataFrame:
    return df.withColumn(out, tx.hash_bucket([F.col(c) for c in keys], k))


# -- features -----------------------------------------------------------------

def _as_number(df: DataFrame, c: str) -> Column:
    if c not in df.columns:
        return F.lit(0.0)
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        value = F.lower(F.col(c)).isin("true", "yes", "1").cast("double")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        value = F.col(c).cast("double")
    else:
        value = F.lit(0.0)
    return F.coalesce(value, F.lit(0.0))


def prepare_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Model columns in model order as numbers; missing values and columns → 0."""
    return df.select(*keep, *[_as_number(df, c).alias(c) for c in features])


def scaling_stage(df: DataFrame, features: Sequence[str]) -> tuple[SQLTransformer, int]:
    """Population scaling as a stage that is saved with the model, and the row count."""
    found = stats.fused(df, {
        "n": F.count(F.lit(1)),
        **{("m", c): F.avg(c) for c in features}, **{("s", c): F.stddev_pop(c) for c in features}})
    cols = [f"(`{c}` - ({found[('m', c)] or 0.0!r}D)) / {(found[('s', c)] or 1.0)!r}D AS `{c}__z`" for c in features]
    return SQLTransformer(statement=f"SELECT *, {', '.join(cols)} FROM __THIS__"), found["n"]


def feature_stages(df: DataFrame, features: Sequence[str], out: str = "features") -> tuple[list, int]:
    scale, n = scaling_stage(df, features)
    return [scale, VectorAssembler(inputCols=[f"{c}__z" for c in features], outputCol=out)], n


# -- registries ---------------------------------------------------------------

#: Share of absolute values in the penalty of the linear families.
LINEAR_MIX = {"ridge": 0.0, "lasso": 1.0, "elastic_net": 0.5, "linear_regression": 0.0}
#: A forest keeps each row's nodes from level to level instead of walking all trees from their roots for every level.
KEPT_NODES = {"cacheNodeIds": True}
#: Settings of a forest with which it grows over blocks of binned rows.
BAGGED = {"numTrees", "maxDepth", "minInstancesPerNode", "seed"}
#: Settings of boosted trees that rounds over binned rows take, by their names there.
BOOSTED = {"maxIter": "trees", "stepSize": "step", "seed": "seed"}


def regressor(kind: str, rows: int, label: str = "label", label_std: float = 1.0, **params):
    """Estimator by family. The ridge penalty is divided by the row count and
    columns are not rescaled again, so ``alpha`` keeps its usual meaning.

    Spark divides the squared part of a penalty by the label's deviation; ``label_std`` (of the population) makes up for it.
    """
    common = {"featuresCol": "features", "labelCol": label}
    if kind in LINEAR_MIX:
        alpha = params.pop("alpha", 0.0 if kind == "linear_regression" else 1.0)
        mix = params.pop("l1_ratio", LINEAR_MIX[kind])
        strength = alpha / max(rows, 1) if kind == "ridge" else alpha
        one, two = strength * mix, strength * (1 - mix) * (label_std or 1.0)
        return LinearRegression(regParam=one + two, elasticNetParam=one / (one + two) if one + two else 0.0, standardization=False,
                                **common, **params)
    if kind == "random_forest":
        return RandomForestRegressor(**{"numTrees": 100, "seed": 42, **KEPT_NODES, **common, **params})
    if kind == "gradient_boosting":
        return GBTRegressor(**{"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": 42, **common, **params})
    raise ValueError(f"unknown model type {kind}")


def classifier(kind: str, rows: int, label: str = "label", **params):
    common = {"featuresCol": "features", "labelCol": label}
    if kind == "random_forest":
        return RandomForestClassifier(**{"numTrees": 100, "maxDepth": 10, "seed": 42, **KEPT_NODES, **common, **params})
    if kind == "gradient_boosting":
        return GBTClassifier(**{"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": 42, **common, **params})
    if kind == "logistic_regression":
        c, penalty = params.pop("C", 1.0), params.pop("penalty", "l2")
        return LogisticRegression(regParam=1.0 / (c * max(rows, 1)), maxIter=params.pop("maxIter", 100),
                                  elasticNetParam=1.0 if penalty == "l1" else 0.0,
                                  standardization=False, **common, **params)
    if kind == "linear_svm":
        c = params.pop("C", 1.0)
        return LinearSVC(regParam=1.0 / (c * max(rows, 1)), standardization=False,
                         maxIter=params.pop("maxIter", 100), **common, **params)
    raise ValueError(f"unknown model type {kind}")


# The settings that the searches try.
CLASSIFIER_GRIDS = {
    "random_forest": {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4]},
    "gradient_boosting": {"maxIter": [100, 200], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 5, 7],
                          "subsamplingRate": [0.8, 0.9, 1.0]},
    "logistic_regression": {"regParam": [100.0, 10.0, 1.0, 0.1], "elasticNetParam": [1.0, 0.0]},
    "linear_svm": {"regParam": [10.0, 1.0, 0.1]},
}
REGRESSOR_GRIDS = {
    "ridge": {"regParam": [0.1, 1.0, 10.0, 100.0]},
    "lasso": {"regParam": [0.01, 0.1, 1.0, 10.0], "maxIter": [1000, 2000, 5000]},
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4]},
    "gradient_boosting": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7],
                          "subsamplingRate": [0.8, 0.9, 1.0]},
}
PER_ROW_PENALTY = ("ridge", "logistic_regression", "linear_svm")


def param_maps(estimator, grid: Mapping[str, Sequence], scale: float = 1.0) -> list[dict]:
    """All combinations; penalties that are totals over the rows are divided by ``scale``."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        if name == "regParam" and scale != 1.0:
            values = [v / scale for v in values]
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def sampled(maps: Sequence[dict], n: int, seed: int = 42) -> list[dict]:
    """A seeded draw without repetition, or all of them when there are not more."""
    return list(maps) if len(maps) <= n else random.Random(seed).sample(list(maps), n)


def _evaluator(task: str, label: str, metric: str | None):
    if task == "regression":
        return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric or "r2")
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                         metricName=metric or "areaUnderROC")


def packed(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> tuple[DataFrame, list, int]:
    """Number columns plus label, the stages that turn them into a vector, and the row count."""
    rows = df.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double"))
    rows = prepare_features(rows, features, ["label", *[k for k in keep if k not in features]])
    return rows, *feature_stages(rows, features)


def _z_columns(stages: Sequence, rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Label and scaled features as the columns ``z0``…, and their names."""
    z = [f"z{i}" for i in range(len(features))]
    return stages[0].transform(rows).select("label", *[F.col(f"`{c}__z`").alias(a) for c, a in zip(features, z)]), z


def fit(df: DataFrame, features: Sequence[str], label: str, kind: str, task: str = "regression",
        **params) -> PipelineModel:
    rows, stages, n = packed(df, features, label)
    if task == "regression" and kind in LINEAR_MIX:
        params["label_std"] = rows.agg(F.stddev_pop("label")).first()[0] or 1.0
    make = regressor if task == "regression" else classifier
    estimator = make(kind, n, **params)
    if kind == "random_forest" and set(params) <= BAGGED:
        return PipelineModel([*stages, bagged.fit(*_z_columns(stages, spread(rows), features), estimator)])
    if kind == "gradient_boosting" and task == "regression" and set(params) <= set(BOOSTED):
        return PipelineModel([*stages, boosting.regression(*_z_columns(stages, spread(rows), features), estimator)])
    # The linear solver reads the rows once; the others come back many times.
    return Pipeline(stages=[*stages, estimator]).fit(rows if isinstance(estimator, LinearRegression) else spread(rows))


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str],
            out: str = "prediction") -> DataFrame:
    """Kept columns and the predicted value; probability of class 1 where the model has one."""
    numbers = {f"_f_{c}": _as_number(df, c) for c in features}
    rows = df.select(*keep, *[e.alias(n) for n, e in numbers.items()])
    renamed = rows.select(*[F.col(k).alias(f"_k_{k}") for k in keep],
                          *[F.col(f"_f_{c}").alias(c) for c in features])
    scored = model.transform(renamed)
    value = F.col("prediction")
    if "probability" in scored.columns:
        value = vector_to_array("probability")[1]
    elif "rawPrediction" in scored.columns:
        value = vector_to_array("rawPrediction")[1]
    cols = [F.col(f"_k_{k}").alias(k) for k in keep] + [value.alias(out)]
    if out != "prediction" and "rawPrediction" in scored.columns:
        cols.append(F.col("prediction").alias("predicted_class"))
    return scored.select(*cols)


def held_out_scores(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, kind: str, **params) -> DataFrame:
    """Label and score of the test rows by a classifier of the training rows.

    They are written, so that what is made of them is a plan over plain columns that takes no model to the tasks.
    """
    if kind == "gradient_boosting" and set(params) <= set(BOOSTED):
        scored = _boosted_scores(train, test, features, label, **{BOOSTED[p]: v for p, v in params.items()})
    else:
        scored = predict(fit(train, features, label, kind, "classification", **params), test, features, [label], "score")
    return materialize(scored, "held_out")


def _boosted_scores(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, **params) -> DataFrame:
    """Scores of the trees that ``fit`` would boost, from rounds over binned rows."""
    rows, stages, _ = packed(train, features, label)
    z = {f"z{i}": F.col(f"`{c}__z`") for i, c in enumerate(features)}
    model = boosting.fit(stages[0].transform(spread(rows)).select("label", *[e.alias(a) for a, e in z.items()]), list(z), "label", **params)
    held = stages[0].transform(test.select(F.col(label).alias("_k"), *[_as_number(test, c).alias(c) for c in features]))
    return boosting.scores(model, held.select("_k", *[e.alias(a) for a, e in z.items()]), list(z), "_k").withColumnRenamed("_k", label)


def score_batch(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str], key: str,
                version: str) -> DataFrame:
    """Score, category, confidence, version and a repeatable prediction id per row."""
    scored = predict(model, df, features, [*dict.fromkeys([key, *keep, *[c for c in features if c in df.columns]])],
                     "risk_score")
    interval = risk.confidence_interval(F.col("risk_score"), [_as_number(df, c) for c in features])
    out = scored.withColumns({
        "risk_category": risk.risk_category(F.col("risk_score")), **interval,
        "model_version": F.lit(version),
        "prediction_id": tx.stable_key([F.col(key), F.lit(version)]),
    })
    names = [*dict.fromkeys([key, *keep])]
    return out.select(*names, "prediction_id", "model_version", "risk_score", "risk_category",
                      *interval.keys())


# -- search and validation ----------------------------------------------------

@dataclass
class SearchResult:
    """Settings tried, with mean and deviation of their scores over the folds."""

    settings: list[dict]
    mean: list[float]
    std: list[float]

    def best(self) -> int:
        return max(range(len(self.mean)), key=lambda i: self.mean[i])


def _scaled(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str]) -> tuple[DataFrame, list[str], int]:
    """Label and kept columns with the features as scaled doubles ``z0``…, their names and the row count."""
    rows, stages, n = packed(df, features, label, keep)
    kept = ["label", *[k for k in keep if k not in features]]
    z = [f"z{i}" for i in range(len(features))]
    return stages[0].transform(rows).select(*kept, *[k for k in keep if k in features], *[F.col(f"`{c}__z`").alias(a) for c, a in zip(features, z)]), z, n


def _penalty(kind: str, n: float, alpha: float | None = None, l1_ratio: float | None = None, **_) -> tuple[float, float]:
    """(strength per row, mix) of a linear model, as ``regressor`` reads its parameters."""
    alpha = (0.0 if kind == "linear_regression" else 1.0) if alpha is None else alpha
    return (alpha / max(n, 1.0) if kind == "ridge" else alpha), (LINEAR_MIX[kind] if l1_ratio is None else l1_ratio)


def _sum(parts: Sequence[gram.Moments]) -> gram.Moments:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _line(model: gram.Linear, z: Sequence[str]) -> Column:
    out = F.lit(model.bias)
    for w, c in zip(model.weights.tolist(), z):
        out = out + F.lit(w) * F.col(c)
    return out


def _by_fold(models: Mapping[int, gram.Linear], z: Sequence[str]) -> Column:
    """The value of each row's fold's model."""
    out = F.lit(None).cast("double")
    for f, m in models.items():
        out = F.when(F.col("fold") == f, _line(m, z)).otherwise(out)
    return out


def search(df: DataFrame, features: Sequence[str], label: str, kind: str, keys: Sequence[str],
           task: str = "classification", grid: Mapping[str, Sequence] | None = None, k: int = 5,
           n_iter: int | None = None, metric: str | None = None, **params) -> SearchResult:
    """Grid search, or a seeded draw of ``n_iter`` settings, over hash folds.

    Linear models are solved for all folds and settings from one scan's sums, and logistic ones share every
    round's scan. The other families are fitted one by one from a vector table that is written once: a
    fit keeps the cluster busy, and fits side by side share plans that are not made for it.
    """
    grids = REGRESSOR_GRIDS if task == "regression" else CLASSIFIER_GRIDS
    make = regressor if task == "regression" else classifier
    rows, z, n = _scaled(df, features, label, keys)
    estimator = make(kind, n, **params)
    scale = float(n) if kind in PER_ROW_PENALTY else 1.0
    maps = param_maps(estimator, grids[kind] if grid is None else grid, scale)
    if n_iter is not None:
        maps = sampled(maps, n_iter)
    settings = [{p.name: v for p, v in m.items()} for m in maps]
    ready = with_folds(rows, keys, k).select("label", "fold", *z)
    closed = {"maxIter", "regParam", "elasticNetParam"}
    plain = not params and metric is None and all(set(s) <= closed for s in settings)
    if plain and task == "regression" and kind in LINEAR_MIX:
        scores = _linear_scores(ready, z, k, kind, n, settings)
    elif plain and kind == "logistic_regression":
        scores = _logistic_scores(ready, z, k, n, settings)
    else:
        ready = spread(materialize(VectorAssembler(inputCols=z, outputCol="features").transform(ready).select("label", "features", "fold"), "folds"))
        found = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=_evaluator(task, "label", metric),
                               numFolds=k, foldCol="fold", parallelism=1).fit(ready)
        return SearchResult(settings, [float(m) for m in found.avgMetrics], [float(d) for d in found.stdMetrics])
    return SearchResult(settings, [float(np.mean(s)) for s in scores], [float(np.std(s)) for s in scores])


def _linear_scores(ready: DataFrame, z: Sequence[str], k: int, kind: str, n: int, settings: Sequence[Mapping]) -> list[list[float]]:
    """r2 of every setting on every fold, from the moments of the folds."""
    sums = gram.moments(ready, [*z, "label"], F.col("fold"))
    folds = [f for f in range(k) if f in sums]
    strength, mix = _penalty(kind, n)
    out = []
    for s in settings:
        models = {f: gram.linear(_sum([sums[g] for g in folds if g != f]), s.get("regParam", strength), s.get("elasticNetParam", mix)) for f in folds}
        out.append([sums[f].r2(models[f]) or 0.0 for f in folds])
    return out


def _logistic_scores(ready: DataFrame, z: Sequence[str], k: int, n: int, settings: Sequence[Mapping]) -> list[list[float]]:
    """Areas under the ROC curve of every setting on every fold; the fits share their scans."""
    ready = materialize(spread(ready), "folds")  # dealt once, read by every round
    folds = sorted(r["fold"] for r in ready.select("fold").distinct().collect())  # k of them
    tasks = [gram.Task(f, s.get("regParam", 1.0 / max(n, 1)), s.get("elasticNetParam", 0.0)) for s in settings for f in folds]
    models = gram.logistic(ready, z, "label", "fold", tasks)
    named = {f"s{i}": {f: models[i * len(folds) + j] for j, f in enumerate(folds)} for i in range(len(settings))}
    scored = ready.select("label", "fold", *[_by_fold(m, z).alias(c) for c, m in named.items()])
    long = scored.unpivot(["label", "fold"], list(named), "setting", "score")
    areas = {(r["setting"], r["fold"]): r["roc_auc"] for r in evaluation.roc_auc(long, "label", "score", ["setting", "fold"]).collect()}
    return [[areas.get((c, f)) or 0.0 for f in folds] for c in named]


def search_table(found: SearchResult, spark) -> DataFrame:
    """One row per setting tried: values, mean and deviation of the folds."""
    rows = [(", ".join(f"{p}={v}" for p, v in sorted(s.items())), float(m), float(d)) for s, m, d in zip(found.settings, found.mean, found.std)]
    return spark.createDataFrame(rows, "setting string, mean_score double, std_score double")


def cross_validate(df: DataFrame, features: Sequence[str], label: str, kind: str, keys: Sequence[str],
                   k: int = 5, **params) -> DataFrame:
    """r2, negated mse and negated mae of a regression, per held-out fold.

    Linear models come from one scan's sums per fold; a second one takes their errors.
    """
    if kind in LINEAR_MIX:
        rows, z, _ = _scaled(df, features, label, keys)
        ready = with_folds(rows, keys, k).select("label", "fold", *z)
        sums = gram.moments(ready, [*z, "label"], F.col("fold"))
        models = {}
        for f in sums:
            train = [m for g, m in sums.items() if g != f]
            if train:
                train = _sum(train)
                models[f] = gram.linear(train, *_penalty(kind, train.n, **params))
        held = ready.select("fold", "label", _by_fold(models, z).alias("prediction"))
    else:
        rows, stages, n = packed(df, features, label, keys)
        ready = Pipeline(stages=stages).fit(rows).transform(with_folds(rows, keys, k))
        ready = spread(materialize(ready.select("label", "features", "fold"), "folds"))
        held = None
        for i in range(k):
            train = ready.where(F.col("fold") != i)
            part = regressor(kind, train.count(), **dict(params)).fit(train).transform(ready.where(F.col("fold") == i))
            part = part.select("fold", "label", "prediction")
            held = part if held is None else held.unionByName(part)
    e = F.col("label") - F.col("prediction")
    return held.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop("label") * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
        (-F.avg(e * e)).alias("neg_mse"), (-F.avg(F.abs(e))).alias("neg_mae"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean, population deviation and extremes of every fold score."""
    long = folds.unpivot(["fold"], ["r2", "neg_mse", "neg_mae"], "metric", "score")
    return long.groupBy("metric").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
                                      F.min("score").alias("min"), F.max("score").alias("max"))


def learning_curve(df: DataFrame, features: Sequence[str], label: str, kind: str, keys: Sequence[str],
                   sizes: int = 10, k: int = 5, **params) -> DataFrame:
    """r2 on training rows and on held-out folds for nested training shares 0.1…1.

    Linear models come from one scan: the sums of every fold and step of the shares add up to any training set.
    """
    shares = [(0.1 + 0.9 * s / (sizes - 1)) if sizes > 1 else 1.0 for s in range(sizes)]
    marks = [int(round(s * 10_000)) for s in shares]
    slot = tx.hash_bucket([*[F.col(c) for c in keys], F.lit("curve")], 10_000)
    spark, found = df.sparkSession, []
    if kind in LINEAR_MIX:
        rows, z, _ = _scaled(df, features, label, keys)
        step = sum((slot >= m).cast("int") for m in marks) if marks else F.lit(0)  # from len(marks) on in no share
        ready = with_folds(rows, keys, k).withColumn("step", step)
        sums = gram.moments(ready, [*z, "label"], F.col("fold") * (sizes + 1) + F.col("step"))
        for i in range(k):
            held = [m for g, m in sums.items() if g // (sizes + 1) == i]
            for s, share in enumerate(shares):
                train = [m for g, m in sums.items() if g // (sizes + 1) != i and g % (sizes + 1) <= s]
                if held and train:
                    whole = _sum(train)
                    model = gram.linear(whole, *_penalty(kind, whole.n, **params))
                    found += [(round(share, 4), int(whole.n), "train", whole.r2(model)),
                              (round(share, 4), int(whole.n), "validation", _sum(held).r2(model))]
    else:
        rows, stages, _ = packed(df, features, label, keys)
        ready = Pipeline(stages=stages).fit(rows).transform(with_folds(rows, keys, k).withColumn("slot", slot))
        ready = spread(materialize(ready.select("label", "features", "fold", "slot"), "curve"))
        e = F.col("label") - F.col("prediction")
        r2 = (1 - F.sum(e * e) / F.nullif(F.var_pop("label") * F.count(F.lit(1)), F.lit(0.0))).alias("r2")
        for i in range(k):
            held = ready.where(F.col("fold") == i)
            for share, mark in zip(shares, marks):
                train = ready.where((F.col("fold") != i) & (F.col("slot") < mark))
                n = train.count()
                model = regressor(kind, n, **dict(params)).fit(train)
                found += [(round(share, 4), n, side, model.transform(part).agg(r2).first()["r2"]) for side, part in (("train", train), ("validation", held))]
    results = spark.createDataFrame(found, "share double, rows long, side string, r2 double")
    return results.groupBy("share", "side").agg(
        F.avg("rows").alias("mean_rows"), F.avg("r2").alias("score_mean"), F.stddev_pop("r2").alias("score_std"))


def bootstrap_stability(df: DataFrame, features: Sequence[str], label: str, kind: str, refits: int = 10,
                        seed: int = 42, keys: Sequence[str] | None = None, **params) -> DataFrame:
    """Spread of the predictions of models refitted on resampled rows.

    A draw weighs every row by a Poisson number hashed from its key (without ``keys``, from its values), so the
    result is the same for any partitions. Linear models of all draws come from one scan. All models score
    the same row side by side, so the per-row deviation is column arithmetic and nothing is shuffled by row.
    """
    if kind in LINEAR_MIX:
        ready, z, _ = _scaled(df, features, label, keys or ())
        key = F.xxhash64(*[F.col(c) for c in keys]) if keys else F.xxhash64("label", *z)
        sums = gram.drawn_moments(ready, [*z, "label"], key, refits, seed)
        models = [gram.linear(m, *_penalty(kind, m.n, **params)) for _, m in sorted(sums.items())]
        values = F.array(*[_line(m, z) for m in models])
        out = ready
    else:
        rows, stages, _ = packed(df, features, label, keys or ())
        key = F.xxhash64(*[F.col(c) for c in keys or ("label", *features)])
        unit = lambda i: F.shiftrightunsigned(F.xxhash64(key, F.lit(seed + i)), 11) * F.lit(2.0 ** -53)
        weights = {f"w{i}": sum((unit(i) >= F.lit(float(p))).cast("double") for p in gram.POISSON) for i in range(refits)}
        ready = Pipeline(stages=stages).fit(rows).transform(rows.withColumns({"key": key, **weights}))
        out = ready = spread(materialize(ready.select("label", "features", "key", *weights), "bootstrap"), by=["key"])
        for i in range(refits):
            drawn = ready.where(F.col(f"w{i}") > 0)
            model = regressor(kind, drawn.count(), **dict(params), predictionCol=f"p{i}", weightCol=f"w{i}").fit(drawn)
            out = model.transform(out)
        values = F.array(*[F.col(f"p{i}") for i in range(refits)])
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.lit(float(refits))
    per_row = out.select(values.alias("v")).withColumn("m", mean).select(
        "m", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m")))
                    / F.lit(float(refits))).alias("sd"))
    per_row = materialize(per_row.withColumn("cv", F.col("sd") / (F.col("m") + F.lit(1e-8))), "spread")
    median = stats.quantiles(per_row, {"sd": [0.5]})["sd"][0]
    return per_row.agg(
        F.avg("sd").alias("mean_prediction_std"), F.max(F.lit(median)).alias("median_prediction_std"),
        F.avg("cv").alias("mean_coefficient_variation"), F.max("cv").alias("max_coefficient_variation"),
        (1.0 / (1.0 + F.avg("cv"))).alias("stability_score"), F.lit(refits).alias("bootstrap_iterations"))


# -- importances and persistence ----------------------------------------------

def importance_table(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Weight of each feature in the last stage: impurity share or coefficient."""
    last = model.stages[-1]
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(f, float(w)) for f, w in zip(features, weights.toArray())]
    return spark.createDataFrame(rows, "feature string, weight double")


def save_model(model: PipelineModel, path: str, version: str, model_type: str, metrics_json: str,
               features: Sequence[str], hyperparameters: Mapping[str, float], created_at: str,
               threshold_met: bool, spark) -> DataFrame:
    """Write the model and append its metadata row."""
    model.write().overwrite().save(f"{path}/models/version={version}")
    row = spark.createDataFrame(
        [(version, model_type, created_at, metrics_json, list(features), dict(hyperparameters), "active",
          threshold_met)],
        "version string, model_type string, created_at string, performance_metrics string, "
        "feature_columns array<string>, hyperparameters map<string,double>, status string, threshold_met boolean")
    row.write.mode("append").parquet(f"{path}/metadata")
    return row


def load_model(path: str, version: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/models/version={version}")


def list_models(path: str, spark) -> DataFrame:
    return spark.read.parquet(f"{path}/metadata").orderBy(F.col("created_at").desc(), "version")


def evaluate_regression(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Figures of the errors; rows are dealt out, and scored once for the several passes over the errors."""
    rows = df.select(*[c for c in dict.fromkeys([label, *features]) if c in df.columns])
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 100_000)))
    scored = materialize(predict(model, rows, features, [label], "p"), "scored")
    return evaluation.regression_metrics(scored, label, "p")
