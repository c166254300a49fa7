"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, each star is settled in the shared
folder, and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted, settle, ship


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links seen in one task by a forest with the same components."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def drain() -> pa.RecordBatch:
        rows = [(x, root(x)) for x in list(up)]
        rows = [(x, r) for x, r in rows if x != r]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 500_000:
            yield drain()
    yield drain()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        near = edges.union(edges.select(F.col("v"), F.col("u")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = salted(near, low, ["u"], "v")  # a root may have a third of all nodes
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``links(u, v)``; component is the smallest node reachable.

    Self links and repeated links are allowed; null ends are ignored.
    """
    ship(links.sparkSession)
    edges = settle(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null").mapInArrow(_forest, "u long, v long"), "links")
    seen = None
    for _ in range(max_rounds):
        after = settle(_stars(_stars(edges, True), False), "stars")
        mark = after.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        discard(edges)
        edges = after
        if seen == (mark.n, mark.x):
            break
        seen = (mark.n, mark.x)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
