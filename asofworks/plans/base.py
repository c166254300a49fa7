"""Registering queries: each has a Spark form and, where it exists, DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import exists, fingerprint, remove, scratch, settle

#: A table after FROM, JOIN or a comma of them, and the word behind it.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KEYWORDS = "JOIN|LEFT|RIGHT|FULL|INNER|CROSS|WHERE|GROUP|ORDER|UNION|ON|USING|LIMIT|HAVING|WINDOW|LATERAL|QUALIFY|ANTI|SEMI|EXCEPT|INTERSECT"
NAMED = re.compile(rf"(?i)\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b(?:\s+(?:AS\s+)?(?!(?:{KEYWORDS})\b)([A-Za-z_]+)\b)?")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement over the driver's tables. Each table's name in it is read as the files' path, so the caller's session gets no views."""
    def read(m: re.Match) -> str:
        return f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` AS {m[3] or m[2]}"

    return spark.sql(NAMED.sub(read, text))


def both(name: str, text: str, spark_text: str | None = None) -> None:
    """A query whose text both engines read, or with its own Spark text."""
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, spark_text or text)
    SQL[name] = text


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Trade edges between nations, visible since their first shipment.
EDGES = """SELECT s_nationkey AS src, c_nationkey AS dst, MIN(l_shipdate) AS available_ts, MIN(o_orderdate) AS event_ts, COUNT(*) AS n, ROUND(1 - AVG(l_discount), 6) AS confidence
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey"""

_settled: dict[tuple[str, str], tuple[str, str, DataFrame]] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table of a folder, computed once an application for all queries that read it, and again when a file of ``tables`` changes; the outdated one is deleted."""
    key, print_ = (spark.sparkContext.applicationId, f"{name} {sf_dir}"), fingerprint(spark, *[f"{sf_dir}/{t}.parquet" for t in tables])
    held = _settled.get(key)
    if held and held[0] == print_ and exists(spark, held[1]):
        return held[2]
    if held:
        remove(spark, held[1])
    path = scratch(spark, f"{name}-{print_}")
    _settled[key] = (print_, path, settle(make(), name, path))
    return _settled[key][2]


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade edges of a table folder."""
    return kept(spark, sf_dir, "trade", ("lineitem", "supplier", "orders", "customer"), lambda: run(spark, sf_dir, EDGES))
