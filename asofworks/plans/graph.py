"""Snapshots, paths, neighbourhoods and integrity of the derived trade graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof
from .base import EDGES, both, query, run, trade

CUT = "TIMESTAMP '1995-02-15 00:00:00'"
NODES = "SELECT n_nationkey AS node_id, CASE WHEN n_regionkey = 0 THEN 'company' ELSE 'product' END AS node_type, n_name AS name, MIN(o_orderdate) AS available_ts FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey, n_regionkey, n_name"
LATE = "TIMESTAMP '1995-01-03 00:00:00'"


@query(f"WITH nodes AS ({NODES}) SELECT node_id, node_type, name FROM nodes WHERE node_type = 'company' OR available_ts <= {LATE}")
def asof_snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.snapshot_nodes(run(spark, sf_dir, NODES), F.expr(LATE)).select("node_id", "node_type", "name")


@query(f"WITH nodes AS ({NODES}), edges AS ({EDGES}), kept AS (SELECT node_id FROM nodes WHERE node_type = 'company' OR available_ts <= {CUT}) SELECT src, dst, n FROM edges WHERE available_ts <= {CUT} AND src IN (SELECT node_id FROM kept) AND dst IN (SELECT node_id FROM kept)")
def asof_snapshot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.snapshot_edges(trade(spark, sf_dir), run(spark, sf_dir, NODES), F.expr(CUT)).select("src", "dst", "n")


@query(f"WITH edges AS ({EDGES}) SELECT CASE WHEN src = 3 THEN dst ELSE src END AS partner, n_name AS name, CASE WHEN src = 3 THEN 'out' ELSE 'in' END AS direction, n FROM edges JOIN nation ON n_nationkey = CASE WHEN src = 3 THEN dst ELSE src END WHERE (src = 3 OR dst = 3) AND available_ts <= {CUT}")
def company_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade(spark, sf_dir).where(asof.is_available(F.col("available_ts"), F.expr(CUT)))
    near = asof.neighbours(edges, F.lit(3)).withColumnRenamed("other", "partner")
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("partner"), F.col("n_name").alias("name"))
    return near.join(names, "partner").select("partner", "name", F.when(F.col("src") == 3, "out").otherwise("in").alias("direction"), "n")


both("snapshot_counts_over_time", f"""WITH edges AS ({EDGES}), dates(d) AS (VALUES (TIMESTAMP '1995-01-15 00:00:00'), (TIMESTAMP '1995-02-01 00:00:00'), (TIMESTAMP '1995-03-01 00:00:00'), (TIMESTAMP '1996-01-01 00:00:00'))
SELECT CAST(d AS VARCHAR) AS as_of, COUNT(*) AS n_edges, COUNT(DISTINCT src) AS n_sources FROM dates JOIN edges ON available_ts <= d GROUP BY d""",
     f"""WITH edges AS ({EDGES}), dates(d) AS (VALUES (TIMESTAMP_NTZ '1995-01-15 00:00:00'), (TIMESTAMP_NTZ '1995-02-01 00:00:00'), (TIMESTAMP_NTZ '1995-03-01 00:00:00'), (TIMESTAMP_NTZ '1996-01-01 00:00:00'))
SELECT CAST(d AS STRING) AS as_of, COUNT(*) AS n_edges, COUNT(DISTINCT src) AS n_sources FROM dates JOIN edges ON available_ts <= d GROUP BY d""")


def _walk(hops: int, cut: str | None) -> str:
    when = f"WHERE available_ts <= {cut}" if cut else ""
    return f"""WITH RECURSIVE edges AS ({EDGES}), e AS (SELECT * FROM edges {when}),
b AS (SELECT CAST(src AS VARCHAR) AS a, CAST(dst AS VARCHAR) AS b, src || '>' || dst AS id, confidence, available_ts FROM e UNION ALL SELECT CAST(dst AS VARCHAR), CAST(src AS VARCHAR), src || '>' || dst, confidence, available_ts FROM e),
p(path, ids, node, hop, c, t) AS (SELECT ['3'], CAST([] AS VARCHAR[]), '3', 0, 1.0::DOUBLE, NULL::TIMESTAMP UNION ALL
  SELECT list_append(path, b.b), list_append(ids, b.id), b.b, hop + 1, c * confidence, greatest(t, available_ts) FROM p JOIN b ON b.a = p.node WHERE hop < {hops} AND NOT list_contains(path, b.b))
"""


def _paths(spark: SparkSession, sf_dir: str, hops: int, cut: str | None) -> DataFrame:
    edges = trade(spark, sf_dir).select(F.expr("concat(src, '>', dst)").alias("edge_id"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "available_ts", "confidence")
    seeds = spark.range(1).select(F.lit("3").alias("node_id"))
    return asof.walk(edges, seeds, hops, F.expr(cut) if cut else None)


_OUT = "SELECT array_to_string(path, ',') AS path, array_to_string(ids, ',') AS edge_ids, CAST(hop AS INTEGER) AS hop_count, ROUND(c, 6) AS confidence FROM p WHERE hop > 0"


def _shown(paths: DataFrame) -> DataFrame:
    return paths.select(F.array_join("path", ",").alias("path"), F.array_join("edge_ids", ",").alias("edge_ids"), F.col("hop_count").cast("int"), F.round("confidence", 6).alias("confidence"))


@query(_walk(1, None) + _OUT)
def path_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_paths(spark, sf_dir, 1, None))


@query(_walk(2, CUT) + _OUT)
def path_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_paths(spark, sf_dir, 2, CUT))


@query(_walk(3, "TIMESTAMP '1995-02-01 00:00:00'") + _OUT)
def path_3hop_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_paths(spark, sf_dir, 3, "TIMESTAMP '1995-02-01 00:00:00'"))


@query(_walk(2, CUT) + "SELECT array_to_string(path, ',') AS path, array_to_string(ids, ',') AS edge_ids, ROUND(c / (1 + 0.5 * (hop - 1)), 6) AS score FROM p WHERE hop > 0 ORDER BY score DESC, hop, edge_ids LIMIT 20")
def path_scored_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = asof.score_paths(_paths(spark, sf_dir, 2, CUT)).select(F.array_join("path", ",").alias("path"), F.array_join("edge_ids", ",").alias("edge_ids"), "hop_count", F.round("score", 6).alias("score"))
    return paths.orderBy(F.desc("score"), "hop_count", "edge_ids").limit(20).drop("hop_count")


#: Lines of which a task takes the distinct pairs.
LINES = 2**20
_SUPPLY = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem"


@query(f"WITH e AS ({_SUPPLY}), x AS (SELECT 's' || src AS node_id, 1 AS o, 0 AS i FROM e UNION ALL SELECT 'p' || dst, 0, 1 FROM e) SELECT node_id, CAST(SUM(o) AS BIGINT) AS out_degree, CAST(SUM(i) AS BIGINT) AS in_degree, COUNT(*) AS degree FROM x GROUP BY node_id")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = run(spark, sf_dir, _SUPPLY.replace("DISTINCT ", ""))
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-lines.count() // LINES))  # short rows: by their bytes, many millions would be put in one task
    pairs = lines.repartition(parts, "src", "dst").distinct()
    return asof.degrees(pairs.select(F.concat(F.lit("s"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst")))


both("subgraph_page", f"WITH e AS ({_SUPPLY}), d AS (SELECT dst, COUNT(*) AS degree FROM e GROUP BY dst) SELECT e.dst AS part, d.degree FROM e JOIN d ON e.dst = d.dst WHERE e.src = 7 ORDER BY d.degree DESC, e.dst LIMIT 20 OFFSET 10")
both("node_search", f"WITH e AS ({_SUPPLY}), d AS (SELECT dst, COUNT(*) AS degree FROM e GROUP BY dst) SELECT p_partkey AS node_id, p_name AS name, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON dst = p_partkey WHERE lower(p_name) LIKE '%a%' OR lower(p_brand) LIKE '%1%' ORDER BY degree DESC, node_id LIMIT 25")
both("priority_listing", "SELECT n_name AS name, COUNT(s_suppkey) AS degree FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY CASE n_name WHEN 'NATION_3' THEN 0 WHEN 'NATION_1' THEN 1 ELSE 2 END, degree DESC, name LIMIT 15")
both("edge_provenance_labels", """SELECT l_suppkey, l_linenumber, l_orderkey, CASE WHEN l_returnflag IS NULL THEN 'missing_provenance' WHEN s_nationkey = c_nationkey THEN 'verified_issuer' WHEN l_returnflag = 'R' THEN 'unsupported_cross_company' ELSE 'verified_cross_company' END AS status
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
both("graph_integrity", f"WITH e AS ({EDGES}) SELECT COUNT(*) AS n_edges, CAST(SUM(CASE WHEN available_ts < event_ts THEN 1 ELSE 0 END) AS BIGINT) AS before_event, CAST(SUM(CASE WHEN src = dst THEN 1 ELSE 0 END) AS BIGINT) AS loops, CAST(SUM(CASE WHEN n_nationkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dangling FROM e LEFT JOIN nation ON n_nationkey = dst")
both("leakage_audit", f"WITH e AS ({EDGES}), s AS (SELECT * FROM e WHERE available_ts <= {CUT}) SELECT COUNT(*) AS n_rows, CAST(SUM(CASE WHEN available_ts > {CUT} THEN 1 ELSE 0 END) AS BIGINT) AS future_rows, COUNT(*) - COUNT(available_ts) AS no_time FROM s")
both("graph_build_edges", "SELECT 'supplier:' || s_suppkey AS source, 'LOCATED_IN' AS relationship, 'nation:' || s_nationkey AS target, 1.0 AS confidence FROM supplier WHERE s_nationkey IS NOT NULL UNION ALL SELECT 'customer:' || c_custkey, 'LOCATED_IN', 'nation:' || c_nationkey, 1.0 FROM customer",
     "SELECT concat('supplier:', s_suppkey) AS source, 'LOCATED_IN' AS relationship, concat('nation:', s_nationkey) AS target, 1.0D AS confidence FROM supplier WHERE s_nationkey IS NOT NULL UNION ALL SELECT concat('customer:', c_custkey), 'LOCATED_IN', concat('nation:', c_nationkey), 1.0D FROM customer")
both("induced_pairs", f"WITH e AS ({EDGES}), k AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1)) SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src IN (SELECT n_nationkey FROM k) AND dst IN (SELECT n_nationkey FROM k)")
both("supplier_risk_chain", f"WITH e AS ({EDGES}), risk AS (SELECT l_suppkey, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey HAVING COUNT(*) > 5) SELECT DISTINCT e.dst AS target, s_suppkey AS supplier, risk.n AS n_risk FROM e JOIN supplier ON s_nationkey = e.src JOIN risk ON l_suppkey = s_suppkey WHERE e.dst = 3 AND e.available_ts <= {CUT}")
both("three_hop_chain", f"WITH e AS (SELECT * FROM ({EDGES}) x WHERE available_ts <= {CUT}) SELECT a.src AS landlord, b.src AS partner, b.dst AS target, COUNT(*) AS n_risk FROM e a JOIN e b ON a.dst = b.src JOIN e r ON r.src = a.src WHERE b.dst = 3 AND a.src <> b.dst AND r.dst <> b.src GROUP BY a.src, b.src, b.dst")
both("path_match_accuracy", f"WITH e AS ({EDGES}), expected(q, src, dst) AS (VALUES (1, 3, 5), (2, 5, 3), (3, 3, 3), (4, 9, 12)) SELECT q, CASE WHEN e.src IS NOT NULL THEN 1 ELSE 0 END AS matched, CASE WHEN r.src IS NOT NULL THEN 1 ELSE 0 END AS reversed_exists FROM expected x LEFT JOIN e ON e.src = x.src AND e.dst = x.dst AND e.available_ts <= {CUT} LEFT JOIN e r ON r.src = x.dst AND r.dst = x.src AND r.available_ts <= {CUT}")
