"""How much of the future gets into each stage of an answer, by question and over a suite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stages of an answer: what was found, what passed the time filter, what the model was given, what it cited.
STAGES = ("pre_filter", "post_filter", "context", "cited")


def question_rows(questions: DataFrame, items: DataFrame) -> DataFrame:
    """``(question_id, reference, feir_<stage>, n_<stage>, rejections, valid)`` of every question.

    ``questions(question_id, reference)``, ``items(question_id, stage, available_ts)``. The rate of a stage is the share of its items
    from after the reference; null without items or without a reference; an item without time counts below the line only.
    Rejections are future items of the first stage. A question with a reference is valid if some later stage has items and none
    of them is from the future, one without always.
    """
    joined = items.join(questions.select("question_id", "reference"), "question_id")
    late = F.coalesce(F.col("available_ts") > F.col("reference"), F.lit(False))
    counts = joined.groupBy("question_id").agg(
        *[F.count_if(F.col("stage") == s).alias(f"n_{s}") for s in STAGES], *[F.count_if((F.col("stage") == s) & late).alias(f"late_{s}") for s in STAGES]
    )
    out = questions.select("question_id", "reference").join(counts, "question_id", "left").na.fill(0, [f"{k}_{s}" for k in ("n", "late") for s in STAGES])
    timed = F.col("reference").isNotNull()
    rates = [F.when(timed, F.try_divide(f"late_{s}", f"n_{s}")).alias(f"feir_{s}") for s in STAGES]
    later = [f"{{}}_{s}" for s in STAGES[1:]]
    seen, broken = sum(F.col(c.format("n")) for c in later) > 0, sum(F.col(c.format("late")) for c in later) > 0
    return out.select("question_id", "reference", *rates, *[f"n_{s}" for s in STAGES], F.col("late_pre_filter").alias("rejections"), (~timed | (seen & ~broken)).alias("valid"))


def suite(rows: DataFrame) -> DataFrame:
    """One row: questions, those with a reference, mean rate of each stage over the questions that have one, rejections and items in all, and the share of valid ones among those with a reference (0 without any)."""
    timed = rows.where("reference is not null")
    sums = timed.agg(
        F.count("*").alias("n_temporal"), *[F.round(F.avg(f"feir_{s}"), 6).alias(f"feir_{s}") for s in STAGES], *[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"n_{s}") for s in STAGES],
        F.coalesce(F.sum("rejections"), F.lit(0)).alias("rejections"), F.round(F.coalesce(F.avg(F.col("valid").cast("double")), F.lit(0.0)), 6).alias("compliance"),
    )
    return rows.agg(F.count("*").alias("n_questions")).join(F.broadcast(sums))


def ablation(rows: DataFrame) -> DataFrame:
    """One row: the mean rates with and without the time filter, and what it takes away."""
    with_, without = F.avg("feir_post_filter"), F.avg("feir_pre_filter")
    means = rows.where("reference is not null").agg(F.coalesce(with_, F.lit(0.0)).alias("a"), F.coalesce(without, F.lit(0.0)).alias("b"), F.coalesce(F.sum("rejections"), F.lit(0)).alias("rejections"))
    return means.select(F.round("a", 6).alias("with_filter"), F.round("b", 6).alias("without_filter"), F.round(F.col("b") - F.col("a"), 6).alias("absolute"), F.round(F.when(F.col("b") > 0, 100 * (F.col("b") - F.col("a")) / F.col("b")).otherwise(0.0), 4).alias("relative_pct"), "rejections")
