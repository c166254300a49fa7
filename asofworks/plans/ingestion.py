"""Queries that run the micro-batch ingestion over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import readers
from ..sources.sinks import scratch
from ..streaming import ingest
from .base import query


_folders: dict[tuple[str, str], str] = {}


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """The folder of one ingestion of a table for each application; asked again, the stream only takes what is new."""
    folder = _folders.setdefault((spark.sparkContext.applicationId, sf_dir), scratch(spark, "live"))
    stream = readers.parquet_stream(spark, f"{sf_dir}/documents.parquet", "doc_id long, text string")
    ingest.ingest_available(stream, folder)
    return folder


@query("""SELECT doc_id, CASE WHEN trim(coalesce(t, '')) = '' THEN 'failed' ELSE 'completed' END AS status,
  CAST(CASE WHEN trim(coalesce(t, '')) = '' THEN 0 WHEN length(t) <= 1800 THEN 1 ELSE 1 + ceil((length(t) - 1800) / 1550.0) END AS BIGINT) AS n_chunks
FROM (SELECT doc_id, min(text) AS t FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)""")
def live_micro_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after all documents went through the stream."""
    return ingest.manifest(spark, _ingested(spark, sf_dir))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, doc_id || ':' || i AS chunk_id, substring(t, CAST(i * 1550 + 1 AS BIGINT), 1800) AS text, 'live' AS corpus
FROM (SELECT doc_id, t, unnest(generate_series(0, CAST(CASE WHEN length(t) <= 1800 THEN 0 ELSE ceil((length(t) - 1800) / 1550.0) END AS BIGINT))) AS i
  FROM (SELECT doc_id, min(text) AS t FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id) WHERE trim(coalesce(t, '')) <> '')""")
def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the stream appended."""
    return ingest.chunks(spark, _ingested(spark, sf_dir))
