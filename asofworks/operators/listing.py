"""Pages of a graph and of a corpus, with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import degrees, neighbours

# The largest page.
MOST = 500


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[list, int, bool]:
    """The rows of one page in a total order, how many there are in all, and whether more follow."""
    limit, offset = max(1, min(MOST, limit)), max(0, offset)
    total = rows.count()
    return rows.orderBy(*order).offset(offset).limit(limit).collect(), total, offset + limit < total


def filtered(rows: DataFrame, company: str | None = None, document_id: str | None = None, document_type: str | None = None, types: list[str] | None = None, live: bool | None = None) -> DataFrame:
    """Rows that meet every condition that is given: company and type in capitals, a list of types, and the live corpus or all but it."""
    if company:
        rows = rows.where(F.upper("company") == company.strip().upper())
    if document_id:
        rows = rows.where(F.col("document_id") == document_id)
    if document_type:
        rows = rows.where(F.upper("document_type") == document_type.strip().upper())
    if types:
        rows = rows.where(F.col("document_type").isin(*types))
    if live is not None:
        rows = rows.where(F.coalesce(F.col("corpus") == "live", F.lit(False)) == F.lit(live))  # an unknown corpus is not live
    return rows


def subgraph(nodes: DataFrame, edges: DataFrame, node_id: str, kind: str | None = None) -> DataFrame:
    """Edges at a node with the other end's name, type and degree; of one type of neighbours if ``kind`` is given."""
    near = neighbours(edges, F.lit(node_id)).withColumnRenamed("other", "node_id")
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    degree = ends.join(near.select("node_id").distinct(), "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("degree"))
    out = near.join(nodes.select("node_id", "name", "node_type"), "node_id", "left").join(degree, "node_id", "left")
    return out if kind is None else out.where(F.lower("node_type") == kind.lower())


def search(nodes: DataFrame, edges: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Nodes whose id or name holds the text, by degree; all matches are ranked before the cut."""
    low = text.strip().lower()
    found = nodes.where(F.lower("node_id").contains(low) | F.lower("name").contains(low))
    return found.join(degrees(edges), "node_id", "left").na.fill(0, ["degree"]).orderBy(F.desc("degree"), "node_id").limit(max(1, min(MOST, limit)))


def companies(nodes: DataFrame, edges: DataFrame, first: tuple[str, ...] = ()) -> DataFrame:
    """Company nodes with degree: the preferred ones in their order, then by degree."""
    own = nodes.where(F.lower("node_type") == "company").join(degrees(edges).select("node_id", "degree"), "node_id", "left").na.fill(0, ["degree"])
    place = F.array_position(F.array(*map(F.lit, first)), F.col("node_id")) if first else F.lit(0)
    return own.orderBy(F.when(place > 0, place).otherwise(2**31 - 1), F.desc("degree"), "node_id")


def type_counts(nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row: how many nodes of each type, 0 for those without, and in all."""
    return nodes.agg(*[F.count_if(F.lower("node_type") == t.lower()).alias(t) for t in types], F.count("*").alias("total"))


def corpus_coverage(documents: DataFrame) -> DataFrame:
    """Filings, chunks, dates and counts by type of each company, and a row ``*`` for all; types in a string, by name."""
    per = documents.groupBy("company", "document_type").agg(F.count("*").alias("n"), F.sum("chunk_count").alias("chunks"), F.min("publication_date").alias("first"), F.max("publication_date").alias("last"))
    whole = per.groupBy("document_type").agg(F.sum("n").alias("n"), F.sum("chunks").alias("chunks"), F.min("first").alias("first"), F.max("last").alias("last"))
    both = per.unionByName(whole.withColumn("company", F.lit("*")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document_type", "n"))), lambda x: F.concat(x["document_type"], F.lit(":"), x["n"].cast("string"))), ",")
    return both.groupBy("company").agg(F.sum("n").alias("filings"), F.sum("chunks").alias("chunks"), F.min("first").alias("first_date"), F.max("last").alias("last_date"), said.alias("by_type"))
