"""Model evaluation: regression, category and binary metrics, curves, fairness.

Curve metrics work on counts per distinct score, so equal scores cost one row,
and cumulate with :mod:`ordered`, which never sorts the table in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import risk
from pulseframe.functions.binning import count_below
from pulseframe.operators import ordered, stats
from pulseframe.session import materialize

CLASSES = ("low", "medium", "high")
TINY = 2.220446049250313e-16
# The sweep runs from 0.1 in steps of 0.05 and stays below 1.
THRESHOLDS = tuple(0.1 + 0.05 * i for i in range(18))
GATE = {"accuracy": 0.75, "precision": 0.70, "recall": 0.70, "f1_score": 0.70, "roc_auc": 0.80}
PERFORMANCE_LIMITS = {"r2_score": 0.7, "mse": 1_000_000.0}


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when there is nothing to divide by."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


# -- regression ---------------------------------------------------------------

def regression_metrics(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """Fit, error and residual figures in one row; quantiles of the errors are exact."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(
        F.col(actual).cast("double").alias("y"), F.col(predicted).cast("double").alias("p"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    rows = rows.withColumns({"e": F.col("y") - F.col("p"), "a": F.abs(F.col("y") - F.col("p"))})
    q50, q75, q95 = stats.quantiles(rows, {"a": [0.5, 0.75, 0.95]})["a"]
    w = F.col("w")
    total = F.sum(w)
    # Centre on means found first: squared sums around zero would lose digits.
    means = stats.fused(rows, {"y": F.sum(w * F.col("y")) / total, "e": F.sum(w * F.col("e")) / total})
    my, me = F.lit(means["y"]).cast("double"), F.lit(means["e"]).cast("double")
    sse = F.sum(w * F.col("e") * F.col("e"))
    sst = F.sum(w * F.pow(F.col("y") - my, F.lit(2)))
    var_e = F.sum(w * F.pow(F.col("e") - me, F.lit(2)))
    mape = F.sum(w * F.col("a") / F.greatest(F.abs("y"), F.lit(TINY))) / total
    return rows.agg(
        (1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2_score"), (sse / total).alias("mse"),
        (F.sum(w * F.col("a")) / total).alias("mae"), F.sqrt(sse / total).alias("rmse"),
        (1 - var_e / F.nullif(sst, F.lit(0.0))).alias("explained_variance"), mape.alias("mape"),
        F.avg("e").alias("mean_residual"), F.stddev_pop("e").alias("std_residual"),
        F.skewness("e").alias("residual_skewness"), F.kurtosis("e").alias("residual_kurtosis"),
        F.avg("p").alias("mean_prediction"), F.stddev_pop("p").alias("std_prediction"),
        F.min("p").alias("min_prediction"), F.max("p").alias("max_prediction"),
        (F.max("p") - F.min("p")).alias("prediction_range"),
        F.max(F.lit(q50)).alias("median_absolute_error"), F.max(F.lit(q75)).alias("q75_absolute_error"),
        F.max(F.lit(q95)).alias("q95_absolute_error"), F.max("a").alias("max_absolute_error"))


# -- categories ---------------------------------------------------------------

def _categorised(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).select(
        risk.risk_category(F.col(actual)).alias("a"), risk.risk_category(F.col(predicted)).alias("p"))


def category_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, per-class precision, recall, F1 and support, macro and weighted means."""
    rows = _categorised(df, actual, predicted)
    base = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if((F.col("a") == c) & (F.col("p") == c)).alias(f"tp_{c}") for c in CLASSES],
        *[F.count_if(F.col("a") == c).alias(f"ac_{c}") for c in CLASSES],
        *[F.count_if(F.col("p") == c).alias(f"pc_{c}") for c in CLASSES])
    p = {c: ratio(F.col(f"tp_{c}"), F.col(f"pc_{c}")) for c in CLASSES}
    rc = {c: ratio(F.col(f"tp_{c}"), F.col(f"ac_{c}")) for c in CLASSES}
    f = {c: f1(p[c], rc[c]) for c in CLASSES}
    out = [(sum((F.col(f"tp_{c}") for c in CLASSES), F.lit(0)) / F.col("n")).alias("accuracy")]
    for c in CLASSES:
        out += [p[c].alias(f"{c}_precision"), rc[c].alias(f"{c}_recall"), f[c].alias(f"{c}_f1"),
                F.col(f"ac_{c}").alias(f"{c}_support")]
    for name, m in (("precision", p), ("recall", rc), ("f1", f)):
        out.append((sum(m.values(), F.lit(0.0)) / 3).alias(f"macro_{name}"))
        weighted = sum((m[c] * F.col(f"ac_{c}") for c in CLASSES), F.lit(0.0))
        out.append((weighted / F.col("n")).alias(f"weighted_{name}"))
    return base.select(*out)


def risk_category_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Confusion counts and accuracy per actual category."""
    rows = _categorised(df, actual, predicted)
    cells = rows.groupBy(F.col("a").alias("actual_category")).agg(
        *[F.count_if(F.col("p") == c).alias(f"predicted_{c}") for c in CLASSES],
        F.count_if(F.col("a") == F.col("p")).alias("_hit"), F.count(F.lit(1)).alias("_n"))
    return cells.select("actual_category", *[f"predicted_{c}" for c in CLASSES],
                        (F.col("_hit") / F.col("_n")).alias("category_accuracy"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual")).agg(
        *[F.count_if(F.col(predicted) == v).alias(f"predicted_{v}") for v in labels])


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from one shuffle of class pairs."""
    pairs = df.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("pred"), hit.alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("pred"),
                 F.lit(0).cast("long").alias("tp")))))
    tot = sides.groupBy("label").agg(F.sum("sup").alias("sup"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"))
    p, rc = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("sup"))
    return tot.select("label", p.alias("precision"), rc.alias("recall"), f1(p, rc).alias("f1_score"),
                      F.col("sup").alias("support"))


# -- binary -------------------------------------------------------------------

def _confusion(y: Column, pred: Column) -> list[Column]:
    return [F.count_if((y == 1) & (pred == 1)).alias("tp"), F.count_if((y == 0) & (pred == 1)).alias("fp"),
            F.count_if((y == 0) & (pred == 0)).alias("tn"), F.count_if((y == 1) & (pred == 0)).alias("fn")]


def binary_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, class-weighted precision/recall/F1, sensitivity, specificity, NPV."""
    base = df.agg(*_confusion(F.col(label), F.col(predicted)))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n, pos, neg = tp + fp + tn + fn, tp + fn, tn + fp
    p1, r1, p0, r0 = ratio(tp, tp + fp), ratio(tp, pos), ratio(tn, tn + fn), ratio(tn, neg)

    def weighted(one: Column, zero: Column) -> Column:
        return (one * pos + zero * neg) / n

    return base.select(
        ((tp + tn) / n).alias("accuracy"), weighted(p1, p0).alias("precision"), weighted(r1, r0).alias("recall"),
        weighted(f1(p1, r1), f1(p0, r0)).alias("f1_score"), r1.alias("sensitivity"), r0.alias("specificity"),
        p0.alias("npv"), "tp", "fp", "tn", "fn")


def score_cells(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label)
    known = df.where(y.isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))


#: Shares of a group's scores at which they may be cut; one score of so many is looked at to find them.
CUTS, ONE_OF = 256, 16


def _cut(rows: DataFrame, score: str, by: Sequence[str], chunk_rows: int) -> DataFrame:
    """Add ``_chunk``, from 0 in order of a group's scores: some ``chunk_rows`` rows each, equal scores together.

    Chunks end at approximate quantiles of scores chosen by their hash. These decide nothing but the sizes of the chunks, and all rows are in one.
    """
    shares, few = [i / CUTS for i in range(1, CUTS)], F.pmod(F.xxhash64(score), F.lit(ONE_OF)) == 0
    marks = rows.where(few).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(score, shares, 4 * CUTS).alias("_marks"))
    marks = materialize(marks, "marks")
    parts = min(CUTS, -(-(marks.agg(F.max("_n")).first()[0] or 0) * ONE_OF // chunk_rows))
    if parts <= 1:
        return rows.withColumn("_chunk", F.lit(0))
    ends = F.array(*[F.col("_marks")[CUTS * i // parts - 1] for i in range(1, parts)])
    small = marks.where("_marks is not null").select(*[F.col(b).alias(f"_b_{b}") for b in by], ends.alias("_ends"))
    match = F.lit(True)
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    chunk = F.when(F.col("_ends").isNull(), 0).otherwise(F.size(F.filter("_ends", lambda e: e < F.col(score))))
    return rows.join(small, match, "left").withColumn("_chunk", chunk).drop("_ends", *[f"_b_{b}" for b in by])


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), chunk_rows=ordered.CHUNK_ROWS) -> DataFrame:
    """Area under the ROC curve with ties counted half; null where a class is missing.

    Chunks of a group's scores are ordered by themselves; of those before it a chunk needs the negatives only.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*by, F.col(label).alias("_y"), F.col(score).alias("_s"))
    cells = score_cells(_cut(rows, "_s", by, chunk_rows), "_y", "_s", [*by, "_chunk"])
    inside = Window.partitionBy(*by, "_chunk").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wins = F.col("pos") * (F.sum("neg").over(inside) - F.col("neg") / 2)
    chunks = cells.withColumn("_wins", wins).groupBy(*by, "_chunk").agg(F.sum("_wins").alias("_wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ran = chunks.withColumn("_before", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    wins = F.sum(F.col("_wins") + F.col("pos") * F.col("_before"))
    p, n = F.sum("pos"), F.sum("neg")
    area = F.when((p > 0) & (n > 0), wins / (p.cast("double") * n)).alias("roc_auc")
    return (ran.groupBy(*by) if by else ran).agg(area, p.alias("positives"), n.alias("negatives"))


def _descending(df: DataFrame, label: str, score: str, chunk_rows: int) -> tuple[DataFrame, int, int]:
    cells = score_cells(df, label, score)
    found = stats.fused(cells, {"p": F.sum("pos"), "n": F.sum("neg")})
    ran = ordered.running_totals(cells, "score", {"tp": "pos", "fp": "neg"}, descending=True, chunk_rows=chunk_rows)
    return ran, found["p"] or 0, found["n"] or 0


def roc_curve(df: DataFrame, label: str, score: str, chunk_rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """A point per distinct score, from the strictest threshold on, plus the origin."""
    ran, p, n = _descending(df, label, score, chunk_rows)
    points = ran.select(F.col("score").alias("threshold"), (F.col("fp") / F.lit(float(n or 1))).alias("fpr"),
                        (F.col("tp") / F.lit(float(p or 1))).alias("tpr"))
    origin = ran.agg((F.max("score") + 1).alias("threshold")).select(
        "threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_curve(df: DataFrame, label: str, score: str, chunk_rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    ran, p, _ = _descending(df, label, score, chunk_rows)
    return ran.select(F.col("score").alias("threshold"),
                      (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                      (F.col("tp") / F.lit(float(p or 1))).alias("recall"))


def average_precision(df: DataFrame, label: str, score: str, chunk_rows: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Sum over distinct scores of recall gained times precision there."""
    ran, p, _ = _descending(df, label, score, chunk_rows)
    gain = F.col("pos") / F.lit(float(p or 1)) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return ran.agg(F.sum(gain).alias("average_precision"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and share of positives per quantile bin; empty bins do not appear."""
    edges = stats.quantiles(df, {score: [i / bins for i in range(bins + 1)]})[score]
    inner = [e for e in edges[1:-1] if e is not None]
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(count_below(F.col(score), inner).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_predicted_value"),
        F.avg(F.col(label).cast("double")).alias("fraction_of_positives"))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    gap = F.col(score) - F.col(label)
    return df.agg(F.avg(gap * gap).alias("brier_score"))


def threshold_sweep(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Binary metrics at every threshold from one pass.

    Each row goes to the slot of the highest threshold it reaches; the at most
    len(thresholds)+1 slot counts are then cumulated.
    """
    marks = list(thresholds)
    # Thresholds reached = all of them minus those strictly above the score.
    reached = len(marks) - count_below(-F.col(score), [-t for t in reversed(marks)])
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    slots = known.groupBy(reached.alias("slot")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    # Every slot row carries the thresholds it passes; both lists are short constants.
    marked = slots.select("slot", "pos", "neg", F.posexplode(F.array(*map(F.lit, marks))).alias("i", "threshold"))
    above = F.col("slot") > F.col("i")
    base = marked.groupBy("threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, rc = ratio(tp, tp + fp), ratio(tp, tp + fn)
    both = (tp + fn > 0) | (tp + fp > 0)
    spec = F.when(both, ratio(tn, tn + fp)).otherwise(F.lit(0.0))
    return base.select(
        "threshold", ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), p.alias("precision"),
        rc.alias("recall"), f1(p, rc).alias("f1_score"), spec.alias("specificity"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of highest F1; the lowest one on a tie."""
    best = F.min(F.struct((-F.col("f1_score")).alias("cost"), F.col("threshold"))).alias("b")
    return sweep.agg(best).select(F.col("b.threshold").alias("optimal_threshold"),
                                  (-F.col("b.cost")).alias("f1_score"))


def fairness(
    df: DataFrame, label: str, predicted: str, score: str, sensitive: Sequence[str],
    chunk_rows: int = ordered.CHUNK_ROWS,
) -> DataFrame:
    """Size, accuracy, precision, recall, F1 and AUC per value of each sensitive column."""
    present = [c for c in sensitive if c in df.columns]
    long = df.select(
        F.col(label).alias("_y"), F.col(predicted).alias("_p"), F.col(score).alias("_s"),
        *[F.col(c).cast("string").alias(c) for c in present],
    ).unpivot(["_y", "_p", "_s"], present, "feature", "value")
    base = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("sample_size"),
                                                *_confusion(F.col("_y"), F.col("_p")))
    auc = roc_auc(long, "_y", "_s", ["feature", "value"], chunk_rows)
    auc = auc.select(F.col("feature").alias("_f"), F.col("value").alias("_v"), "roc_auc")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, rc = ratio(tp, tp + fp), ratio(tp, tp + fn)
    joined = base.join(auc, (F.col("feature") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v")), "left")
    return joined.select(
        "feature", "value", "sample_size", ((tp + tn) / F.col("sample_size")).alias("accuracy"),
        p.alias("precision"), rc.alias("recall"), f1(p, rc).alias("f1_score"),
        F.coalesce(F.col("roc_auc"), F.lit(0.0)).alias("roc_auc"))


# -- gates --------------------------------------------------------------------

def gate_model(metrics: DataFrame, minimum: Mapping[str, float] = GATE, key: str = "version") -> DataFrame:
    """Each required metric of each version against its minimum; a missing metric reads as 0."""
    checks = [F.struct(
        F.lit(m).alias("metric"),
        F.coalesce(F.col(m), F.lit(0.0)).alias("value") if m in metrics.columns else F.lit(0.0).alias("value"),
        F.lit(t).alias("threshold")) for m, t in minimum.items()]
    return metrics.select(key, F.inline(F.array(*checks))).withColumn("passed", F.col("value") >= F.col("threshold"))


def grade_models(metrics: DataFrame, limits: Mapping[str, float] = PERFORMANCE_LIMITS,
                 key: str = "version") -> DataFrame:
    """Failed limits per version and the grade: A when all hold, F otherwise.

    The grades between would need warnings, which no limit produces.
    """
    failed = []
    for m, t in limits.items():
        if m in metrics.columns:
            broken = F.col(m) > t if m in ("mse", "mae") else F.col(m) < t
            failed.append(F.when(broken, m))
    listed = F.array_join(F.array_compact(F.array(*failed)), ", ")
    return metrics.select(key, (listed == "").alias("meets_requirements"), listed.alias("failed_checks"),
                          F.when(listed == "", "A").otherwise("F").alias("performance_grade"))
