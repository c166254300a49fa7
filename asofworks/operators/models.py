"""Walk-forward models: every fold fitted at once, with a scaler of its own, and models held against each other."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import settle
from . import evaluation

#: Folds of one fit: their sums come to the driver, some (features + 1) squared numbers each.
MOST_FOLDS = 10_000


def _sum(terms: list[Column]) -> Column:
    return reduce(Column.__add__, terms)


def fit_folds(folded: DataFrame, features: list[str], label: str, l2: float = 1.0, rounds: int = 30, close: float = 1e-8) -> DataFrame:
    """``(fold, n_train, means, sizes, weights)``: a logistic regression for each fold of ``folded(fold, part, ...)`` on its training rows.

    Features are standardised by the fold's own training rows (one without spread counts as it is), weights beside the intercept
    are held back by ``l2``. All folds take each Newton step together: one grouped pass sums gradient and curvature of every fold, with
    partial sums in each task; the driver solves one small system a fold. Rows with a null among their values are left out.
    A fold whose training rows have one label only gets that label's prior from the penalty alone.
    """
    spark = folded.sparkSession
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*features, label)])
    train = settle(folded.where((F.col("part") == "train") & whole).select("fold", F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]), "train")
    x = [f"x{i}" for i in range(len(features))]
    sums = train.groupBy("fold").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in x], *[F.stddev_pop(c).alias(f"s_{c}") for c in x]).limit(MOST_FOLDS + 1).collect()
    if len(sums) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    kind = "fold int, n_train long, means array<double>, sizes array<double>, weights array<double>"
    scale = {r.fold: ([r[f"m_{c}"] for c in x], [r[f"s_{c}"] or 1.0 for c in x], r.n) for r in sums}
    weights = {f: np.zeros(len(x) + 1) for f in scale}

    def table(folds) -> DataFrame:
        return spark.createDataFrame([(f, scale[f][2], scale[f][0], scale[f][1], weights[f].tolist()) for f in folds], kind)

    z = [F.lit(1.0), *[(F.col(c) - F.get("means", F.lit(i))) / F.get("sizes", F.lit(i)) for i, c in enumerate(x)]]
    size = len(z)
    moving = set(weights)
    for _ in range(rounds):
        if not moving:
            break
        rows = train.join(F.broadcast(table(moving)), "fold").select("fold", "y", *[c.alias(f"z{i}") for i, c in enumerate(z)], "weights")
        p = 1 / (1 + F.exp(-_sum([F.col(f"z{i}") * F.get("weights", F.lit(i)) for i in range(size)])))
        rows = rows.withColumn("p", p)
        gradient = [F.sum((F.col("y") - F.col("p")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(size)]
        curve = [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(size) for j in range(i + 1)]
        penalty = l2 * np.diag([0.0] + [1.0] * len(x))
        for r in rows.groupBy("fold").agg(*gradient, *curve).collect():
            h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)]) + penalty + 1e-12 * np.eye(size)
            step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(size)]) - penalty @ weights[r.fold])
            step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))  # a separable fold moves in bounded steps
            weights[r.fold] = weights[r.fold] + step
            if float(np.abs(step).max()) < close:
                moving.discard(r.fold)
    return table(sorted(weights))


def predict_folds(folded: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """The test rows of every fold with ``probability`` by the fold's own model; null where a feature is."""
    score = _sum([F.get("weights", F.lit(0)), *[(F.col(c).cast("double") - F.get("means", F.lit(i))) / F.get("sizes", F.lit(i)) * F.get("weights", F.lit(i + 1)) for i, c in enumerate(features)]])
    return folded.where("part = 'test'").join(F.broadcast(models), "fold").withColumn("probability", 1 / (1 + F.exp(-score))).drop("means", "sizes", "weights", "n_train")


def prior(folded: DataFrame, label: str) -> DataFrame:
    """The test rows with the share of positive labels among their fold's training rows as ``probability``: what any model must beat."""
    shares = folded.where((F.col("part") == "train") & F.col(label).isNotNull()).groupBy("fold").agg(F.avg(F.col(label).cast("double")).alias("probability"))
    return folded.where("part = 'test'").join(F.broadcast(shares), "fold")


def fold_table(predicted: DataFrame, label: str, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Counts and rates of each fold, a probability of one half or more being positive."""
    held = predicted.where(F.col("probability").isNotNull() & F.col(label).isNotNull())
    positive = F.col("probability") >= 0.5
    n = held.groupBy(*by).agg(
        F.count("*").alias("n_test"), F.count_if(positive & (F.col(label) == 1)).alias("tp"), F.count_if(positive & (F.col(label) == 0)).alias("fp"), F.count_if(~positive & (F.col(label) == 1)).alias("fn"), F.count_if(~positive & (F.col(label) == 0)).alias("tn"),
    )
    return evaluation.rates(n)


def compare(folded: DataFrame, label: str, sets: dict[str, list[str]], l2: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``(folds, summary)`` of several feature sets and of the prior over the same folds.

    ``folds`` has the rates of each model and fold; ``summary`` the area under the curve and mean accuracy of each model, its mean
    difference from the prior over folds, and the p of the signed-rank test of these differences.
    """
    marked = [prior(folded, label).select("fold", label, "probability").withColumn("model", F.lit("prior"))]
    for name, features in sets.items():
        marked.append(predict_folds(folded, fit_folds(folded, features, label, l2), features).select("fold", label, "probability").withColumn("model", F.lit(name)))
    rows = settle(reduce(DataFrame.unionByName, marked), "predicted")
    folds = fold_table(rows, label, ("model", "fold"))
    base = folds.where("model = 'prior'").select("fold", F.col("accuracy").alias("base_"))
    paired = folds.join(base, "fold")
    tested = evaluation.wilcoxon(paired, ["model"], "accuracy", "base_").select("model", "p")
    auc = evaluation.roc_auc(rows.where(F.col("probability").isNotNull() & F.col(label).isNotNull()).withColumn(label, F.col(label).cast("long")), ["model"], "probability", label)
    summary = paired.groupBy("model").agg(F.count("*").alias("n_folds"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"), F.round(F.avg(F.col("accuracy") - F.col("base_")), 6).alias("mean_difference"))
    return folds, summary.join(auc, "model", "left").join(tested, "model", "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
