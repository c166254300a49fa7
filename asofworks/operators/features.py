"""Time-series and point-in-time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import settle


def returns(series: DataFrame, value: str, n: int, by: list[str], order: str) -> Column:
    """Relative change to the value ``n`` rows before; null without it or where it is 0."""
    before = F.lag(value, n).over(Window.partitionBy(*by).orderBy(order))
    return (F.col(value) - before) / F.when(before != 0, before)


def rolling(fn, value: str, rows: int, by: list[str], order: str) -> Column:
    """``fn`` over the last ``rows`` rows; null before there are so many."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.when(F.row_number().over(w) >= rows, fn(value).over(w.rowsBetween(1 - rows, 0)))


def last_before(points: DataFrame, series: DataFrame, by: str, at: str, ts: str, value: str) -> DataFrame:
    """As-of join: for each row of ``points(by, at)`` the last ``value`` with ``ts <= at``.

    Both tables are merged and sorted once within each key, so the work is linear; a
    range join would compare every pair of a key.
    """
    both = points.select(by, F.col(at).alias("_t"), F.lit(None).cast(series.schema[value].dataType).alias("_v"), F.lit(1).alias("_p")).union(series.select(by, ts, value, F.lit(0)))
    w = Window.partitionBy(by).orderBy("_t", "_p").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", True).over(w)).where("_p = 1").select(by, F.col("_t").alias(at), value)


def positions(rows: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """Rows with their place from 0 in a total order, without one task for all.

    Rows are sorted over ranges of the order column; a range's first place is the number of
    rows in the ranges before, which are as many numbers as there are partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(n, order).withColumn("part_", F.spark_partition_id()), "ranges")
    sizes = {r.part_: r.n for r in dealt.groupBy("part_").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for p in sorted(sizes):
        first[p], total = total, total + sizes[p]
    start = F.create_map(*[F.lit(x) for p, v in first.items() for x in (p, v)]) if first else F.create_map(F.lit(0), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part_").orderBy(order)) - 1 + start[F.col("part_")]
    return dealt.withColumn(name, place.cast("long")).drop("part_")


def walk_forward(rows: DataFrame, order: str, first: int, step: int) -> DataFrame:
    """Expanding splits: fold k trains on rows before ``first + k * step`` and tests on the next ``step``.

    A row is in the folds that begin behind it, and in the one that tests it.
    """
    placed = positions(rows, order)
    n = placed.count()
    last = max(0, -(-(n - first) // step) - 1)
    own = F.greatest(F.lit(0), F.floor((F.col("pos") - first) / step)).cast("int")  # the fold that tests the row, or the first one
    out = placed.withColumn("fold", F.explode(F.sequence(F.least(own, F.lit(last)), F.lit(last))))
    start = F.lit(first) + F.col("fold") * step
    return out.withColumn("part", F.when(F.col("pos") < start, "train").when(F.col("pos") < start + step, "test")).where("part is not null")


def fold_sizes(rows: DataFrame, first: int, step: int) -> DataFrame:
    """``(fold, n_train, n_test)`` of the same splits, from the number of rows alone."""
    n = rows.agg(F.count("*").alias("n"))
    fold = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - first) / step) - 1).cast("int")))
    start = F.lit(first) + F.col("fold") * step
    out = n.withColumn("fold", fold)
    return out.select("fold", F.least(F.col("n"), start).cast("long").alias("n_train"), F.greatest(F.lit(0), F.least(F.col("n") - start, F.lit(step))).cast("long").alias("n_test"))


def chronological(rows: DataFrame, order: str, share: float = 0.8) -> DataFrame:
    """``part``: train for the first ``share`` of the rows in order, test for the rest."""
    placed = positions(rows, order)
    cut = int(placed.count() * share)
    return placed.withColumn("part", F.when(F.col("pos") < cut, "train").otherwise("test")).drop("pos")
