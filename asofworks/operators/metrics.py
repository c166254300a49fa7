"""Retrieval, answer and leakage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Hit, precision, recall at each k, reciprocal rank and NDCG at the largest, for each question of ``relevant(question_id, id)``; ``results(question_id, id, rank)``."""
    n = relevant.groupBy("question_id").agg(F.count("*").alias("n_rel"))
    hits = results.join(relevant, ["question_id", "id"], "left_semi").groupBy("question_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks],
        (1 / F.min("rank")).alias("rr"),
        F.sum(F.when(F.col("rank") <= max(ks), 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel").cast("int"), F.lit(max(ks)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = n.join(hits, "question_id", "left")
    cols = []
    for k in ks:
        h = F.coalesce(f"h{k}", F.lit(0))
        cols += [(h > 0).cast("int").alias(f"hit_{k}"), F.round(h / k, 6).alias(f"precision_{k}"), F.round(h / F.col("n_rel"), 6).alias(f"recall_{k}")]
    return out.select("question_id", *cols, F.round(F.coalesce("rr", F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of the Wilson interval."""
    p = hits / n
    mid, half, base = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / base, (mid + half) / base


def upper_median(c: str) -> Column:
    """Element n div 2 of the sorted values; not interpolated. For groups of bounded size."""
    return F.expr(f"element_at(sort_array(collect_list({c})), cast(count({c}) div 2 + 1 as int))")


def feir(available: Column, cut: Column) -> Column:
    """Share of rows from the future; rows without time count below the line only."""
    return F.count_if(F.coalesce(available > cut, F.lit(False))) / F.nullif(F.count("*"), F.lit(0))
