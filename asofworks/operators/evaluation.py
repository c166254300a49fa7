"""Evaluation beyond one question: documents, suites, classes, exact tests, sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def document_metrics(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Hit and recall at each k over documents in order of rank, and the share of a question's documents found at all where it has several; ``results(question_id, document_id, rank)``."""
    rel = relevant.select("question_id", "document_id").distinct()
    firsts = results.groupBy("question_id", "document_id").agg(F.min("rank").alias("first"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("first", "document_id"))
    hits = firsts.withColumn("place", place).join(rel, ["question_id", "document_id"], "left_semi")
    sums = hits.groupBy("question_id").agg(*[F.count_if(F.col("place") <= k).alias(f"h{k}") for k in ks], F.count("*").alias("all_"))
    out = rel.groupBy("question_id").agg(F.count("*").alias("n")).join(sums, "question_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    cols = [x for k in ks for x in ((zero(f"h{k}") > 0).cast("int").alias(f"doc_hit_{k}"), F.round(zero(f"h{k}") / F.col("n"), 6).alias(f"doc_recall_{k}"))]
    return out.select("question_id", *cols, F.when(F.col("n") > 1, F.round(zero("all_") / F.col("n"), 6)).otherwise(0.0).alias("coverage"))


def macro_averages(rows: DataFrame, metrics: list[str], conditional: dict[str, Column] | None = None) -> DataFrame:
    """Means over answerable questions; metrics of ``conditional`` over those that are marked or positive only, 0 without any."""
    good = rows.where("answerable")
    conditional = conditional or {}
    means = [F.round(F.avg(m), 6) for m in metrics if m not in conditional]
    cond = [F.round(F.coalesce(F.avg(F.when(mark | (F.col(m) > 0), F.col(m))), F.lit(0.0)), 6) for m, mark in conditional.items()]
    names = [m for m in metrics if m not in conditional] + list(conditional)
    return good.agg(F.count("*").alias("n"), *[c.alias(f"mean_{m}") for c, m in zip(means + cond, names, strict=True)])


def refusal_metrics(rows: DataFrame) -> DataFrame:
    """Counts and rates of ``rows(answerable, refused)``; a rate without cases is 0."""
    tp, fp = F.count_if(~F.col("answerable") & F.col("refused")), F.count_if(F.col("answerable") & F.col("refused"))
    fn, tn = F.count_if(~F.col("answerable") & ~F.col("refused")), F.count_if(F.col("answerable") & ~F.col("refused"))
    n = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    return rates(n)


def rates(n: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy, balanced accuracy of ``(tp, fp, fn, tn)``; a rate without cases is 0."""
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r, s = over(tp, tp + fp), over(tp, tp + fn), over(tn, tn + fp)
    out = {"precision": p, "recall": r, "f1": over(2 * p * r, p + r), "accuracy": over(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (r + s) / 2}
    return n.select("*", *[F.round(c, 6).alias(k) for k, c in out.items()])


def roc_auc(rows: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """The area under the curve by the rank sum, ties counting half: scores are added up first, so the windows run over distinct scores."""
    n = rows.groupBy(*by, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    w = Window.partitionBy(*by).orderBy(score)
    below = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    u = n.withColumn("u", F.col("p") * (F.coalesce(below, F.lit(0)) + F.col("n") / 2))
    return u.groupBy(*by).agg(F.round(F.try_divide(F.sum("u"), F.sum("p") * F.sum("n")), 6).alias("auc"))


def threshold_sweep(rows: DataFrame, thresholds: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """Rates at each threshold, counted in one pass: a row goes to the highest threshold it reaches, and counts are summed from there down."""
    ts = sorted(thresholds)
    at = F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: t <= F.col(score)))
    n = rows.groupBy(at.alias("at")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    total = n.agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    table = rows.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(ts)], "i int, threshold double")
    hit = F.col("at") >= F.col("i")
    counts = table.join(F.broadcast(n)).groupBy("i", "threshold").agg(F.coalesce(F.sum(F.when(hit, F.col("p"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("fp")).join(F.broadcast(total))
    return rates(counts.select("threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn")))


def _log_factorial(n: Column) -> Column:
    """ln n! as a sum; for counts of a few thousand."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int"))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the table [[a, b], [c, d]]: the tables of the same margins that are no likelier."""
    a, b, c, d = (x.cast("int") for x in (a, b, c, d))
    choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    r1, r2, c1 = a + b, c + d, a + c
    whole = choose(r1 + r2, c1)
    p = lambda x: F.exp(choose(r1, x) + choose(r2, c1 - x) - whole)
    seen = p(a)
    xs = F.sequence(F.greatest(F.lit(0), c1 - r2), F.least(r1, c1))
    return F.least(F.lit(1.0), F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.when(p(x) <= seen * (1 + 1e-7), p(x)).otherwise(0.0)))


def normal_tail(z: Column) -> Column:
    """P(|Z| >= z) of a standard normal, by a published approximation of the error function (1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # Coefficients of the approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


#: Differences of a group up to which the rank test is exact.
EXACT = 50


def _rank_sum_p(ranks: Column, w: Column) -> Column:
    """Two-sided p of a signed-rank sum: every rank counts or not with equal chance, and the chances of all sums come from adding one rank after the other. Ranks and the sum are doubled, so that ties stay whole."""
    r2 = F.transform(ranks, lambda r: F.round(r * 2).cast("int"))
    size = F.aggregate(r2, F.lit(0), lambda s, r: s + r) + 1
    start = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    shifted = lambda p, r: F.slice(F.concat(F.array_repeat(F.lit(0.0), r), p), F.lit(1), F.size(p))
    chances = F.aggregate(r2, start, lambda p, r: F.zip_with(p, shifted(p, r), lambda a, b: (a + b) / 2))
    return F.least(F.lit(1.0), 2 * F.aggregate(F.slice(chances, F.lit(1), F.round(w * 2).cast("int") + 1), F.lit(0.0), lambda s, x: s + x))


def wilcoxon(pairs: DataFrame, by: list[str], x: str, y: str, exact: int = EXACT) -> DataFrame:
    """Signed-rank test of paired values: (w, n, p) with the smaller rank sum, the number of differences that are not zero, and a two-sided p.

    p is exact for at most ``exact`` differences, ties included (tied ones share their mean rank and the distribution is that of these ranks);
    beyond, it is that of the normal approximation with ties corrected. Without differences p is 1.
    """
    d = pairs.select(*by, (F.col(x) - F.col(y)).alias("d")).where("d <> 0").withColumn("m", F.round(F.abs("d"), 12))
    ties = d.groupBy(*by, "m").agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    w = Window.partitionBy(*by).orderBy("m")
    rank = F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("t") + 1) / 2
    ranked = ties.withColumn("r", rank).withColumn("upto", F.sum("t").over(w))
    few = F.when(F.col("upto") <= exact, F.array_repeat("r", F.col("t").cast("int")))
    s = ranked.groupBy(*by).agg(
        F.sum(F.col("r") * F.col("up")).alias("plus"), F.sum(F.col("r") * (F.col("t") - F.col("up"))).alias("minus"), F.sum("t").cast("double").alias("n"),
        F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tied"), F.flatten(F.collect_list(few)).alias("ranks"),
    )
    n, low = F.col("n"), F.least("plus", "minus")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    z = F.try_divide(low - n * (n + 1) / 4, sd)
    p = F.when(n <= exact, _rank_sum_p(F.when(n <= exact, F.col("ranks")).otherwise(F.array(F.lit(1.0))), low)).otherwise(F.coalesce(normal_tail(z), F.lit(1.0)))
    return s.select(*by, low.alias("w"), n.cast("long").alias("n"), F.round(p, 6).alias("p"))


def friedman(rows: DataFrame, fold: str, config: str, value: str) -> DataFrame:
    """Chi-square of the ranks of configurations over the folds that have all of them, ties sharing their mean rank."""
    n_configs = rows.select(config).distinct().count()
    own = rows.groupBy(fold).agg(F.count_distinct(config).alias("k")).where(F.col("k") == n_configs).select(fold)
    held = rows.join(own, fold)
    w = Window.partitionBy(fold)
    below = F.rank().over(w.orderBy(value))
    r = below + (F.count("*").over(Window.partitionBy(fold, value)) - 1) / 2
    sums = held.withColumn("r", r).groupBy(config).agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    k = n_configs
    return sums.agg(F.round(12 / (F.first("n") * k * (k + 1)) * F.sum(F.col("s") * F.col("s")) - 3 * F.first("n") * (k + 1), 6).alias("chi2"), F.lit(k - 1).alias("df"), F.first("n").alias("n_folds"))


def constant_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """The columns with at most one distinct value, found in one pass by their extremes and nulls."""
    sums = rows.agg(*[x for c in columns for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"), F.count(c).alias(f"n_{c}"))], F.count("*").alias("n_")).first()
    return [c for c in columns if sums[f"a_{c}"] == sums[f"b_{c}"] and sums[f"n_{c}"] in (0, sums["n_"])]


def numeric_score(predicted: Column, unit: Column, truth: Column, kind: Column) -> Column:
    """``struct(best, relative_error, within_0_5pct, within_1pct, within_2pct)`` of a predicted amount in the truth's unit.

    An amount said in billions counts in millions; one a hundred times too small or too large is also tried as
    billions or single dollars. Earnings a share are held to half a cent.
    """
    eps = kind == "diluted_eps"
    said = unit.isin("billion", "bn", "b")
    tried = F.when(eps, F.array(predicted)).when(said, F.array(predicted * 1000)).when(F.abs(predicted) * 100 < F.abs(truth), F.array(predicted, predicted * 1000))
    tried = F.when(predicted.isNull(), F.expr("cast(array() as array<double>)")).otherwise(tried.when(F.abs(predicted) > F.abs(truth) * 100, F.array(predicted, predicted / 1e6)).otherwise(F.array(predicted)))
    best = F.array_min(F.transform(tried, lambda c: F.struct(F.abs(c - truth).alias("d"), c.alias("c"))))["c"]

    def within(tol: float) -> Column:
        near = lambda c: F.abs(c - truth) <= tol * F.abs(truth)
        cents = lambda c: F.abs(c - truth) <= (F.lit(0.005) if tol == 0.01 else F.greatest(tol * F.abs(truth), F.lit(0.005))) + 1e-9
        return F.exists(tried, lambda c: F.when(eps, cents(c)).otherwise(near(c)))

    return F.struct(best.alias("best"), F.try_divide(F.abs(best - truth), F.abs(truth)).alias("relative_error"), within(0.005).alias("within_0_5pct"), within(0.01).alias("within_1pct"), within(0.02).alias("within_2pct"))


def logistic(train: DataFrame, features: list[str], label: str):
    """A pipeline of standardised features (fitted on the training rows only) and logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="raw_", handleInvalid="skip"), StandardScaler(inputCol="raw_", outputCol="features_", withMean=True), LogisticRegression(featuresCol="features_", labelCol=label, probabilityCol="probability_", rawPredictionCol="margin_", predictionCol="predicted", maxIter=50)]
    return Pipeline(stages=stages).fit(train)
