"""As-of snapshots of a node and edge table, and queries on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import is_available


def snapshot_nodes(nodes: DataFrame, as_of: Column) -> DataFrame:
    """Nodes known at ``as_of``; companies always are."""
    return nodes.where((F.lower("node_type") == "company") | is_available(F.col("available_ts"), as_of))


def snapshot_edges(edges: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """Edges known at ``as_of`` whose two ends are nodes of the snapshot: the time filter reaches the scan, then two semi-joins."""
    kept = snapshot_nodes(nodes, as_of).select("node_id")
    out = edges.where(is_available(F.col("available_ts"), as_of))
    for end in ("src", "dst"):
        out = out.join(kept.withColumnRenamed("node_id", end), end, "left_semi")
    return out.select(edges.columns)


def neighbours(edges: DataFrame, node: Column) -> DataFrame:
    """Edges at a node with their other end; a self loop's is the node itself."""
    return edges.where((F.col("src") == node) | (F.col("dst") == node)).withColumn("other", F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node_id, out_degree, in_degree, degree)``; a self loop counts on both sides."""
    end = lambda c, o, i: F.struct(F.col(c).alias("node_id"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = edges.select(F.inline(F.array(end("src", 1, 0), end("dst", 0, 1))))  # both ends in one pass over the edges
    return ends.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def walk(edges: DataFrame, seeds: DataFrame, hops: int, as_of: Column | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Simple paths of one to ``hops`` (at most three) edges from ``seeds(node_id)``, walked in both directions.

    ``edges(edge_id, src, dst, available_ts, confidence)``. Times are checked before any
    join: an edge without a time is unknown, a node (companies too) only if its time is
    later. Rows: path (nodes in walk order), edge_ids, hop_count, confidence (product),
    available_ts (latest).
    """
    hops = max(1, min(3, hops))
    if as_of is not None:
        edges = edges.where(is_available(F.col("available_ts"), as_of))
    both = edges.select("edge_id", F.col("src").alias("a"), F.col("dst").alias("b"), "available_ts", "confidence").union(edges.select("edge_id", "dst", "src", "available_ts", "confidence"))
    if nodes is not None and as_of is not None:
        late = nodes.where(F.coalesce(F.col("available_ts") > as_of, F.lit(False))).select(F.col("node_id").alias("b"))
        both = both.join(late, "b", "left_anti")
        seeds = seeds.join(late.withColumnRenamed("b", "node_id"), "node_id", "left_anti")
    front = seeds.select(F.array("node_id").alias("path"), F.expr("cast(array() as array<string>)").alias("edge_ids"), F.lit(1.0).alias("confidence"), F.lit(None).cast("timestamp_ntz").alias("available_ts"))
    out = None
    for k in range(1, hops + 1):
        step = front.withColumn("a", F.element_at("path", -1)).join(both.withColumnRenamed("confidence", "c").withColumnRenamed("available_ts", "t"), "a").where(~F.array_contains("path", F.col("b")))
        front = step.select(F.concat("path", F.array("b")).alias("path"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), (F.col("confidence") * F.col("c")).alias("confidence"), F.greatest("available_ts", "t").alias("available_ts"))
        found = front.withColumn("hop_count", F.lit(k))
        out = found if out is None else out.union(found)
    return out


def score_paths(paths: DataFrame, intent: Column | None = None, any_intent: Column | None = None) -> DataFrame:
    """Confidence, discounted by half for each further hop; with intents times 8 (all), 5 (some) or 0.2 (none)."""
    base = F.col("confidence") / (1 + 0.5 * (F.col("hop_count") - 1))
    return paths.withColumn("score", base if intent is None else base * F.when(intent, 8.0).when(any_intent, 5.0).otherwise(0.2))
