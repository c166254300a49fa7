"""Micro-batch ingestion of documents: known ones are skipped, new ones cut into chunks, every outcome goes to a manifest.

A batch first settles its chunks and then the manifest rows that count them, each in the
batch's own folder. If the stream is stopped in between, its checkpoint delivers the batch
again and both folders are replaced, so nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import windows
from ..sources.sinks import append_batch, before

MANIFEST = "doc_id long, status string, n_chunks long, batch_id long"
CHUNKS = "chunk_id string, doc_id long, chunk_index int, text string, corpus string, batch_id long"
#: So many ids are sent to all executors at most; where more of a batch are repeated or known, all its texts are grouped by id.
APART = 2**20


def _least(rows: DataFrame) -> DataFrame:
    """The least text of each id; null only where it has no other."""
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))


def _new_texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of each id that is not known. A text whose id comes once is not brought together with others, only those of repeated ids are.

    Texts that come once stay where they lie, unless one part of ``rows`` holds more than twice a core's share (a file
    with one large row group): then they are dealt out by id, without a sort.
    """
    apart, repeated = F.expr("n > 1 or known"), F.expr("n > 1 and known is null")
    of_parts = ids.groupBy("part").agg(F.sum("n").alias("n"), F.count_if(apart).alias("apart"), F.count_if(repeated).alias("repeated"))
    said = of_parts.agg(F.max("n").alias("most"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "apart", "repeated")]).first()
    if said.apart > APART:
        return _least(rows).join(ids.where("known"), "doc_id", "left_anti")
    new = rows.join(F.broadcast(ids.where(apart).select("doc_id")), "doc_id", "left_anti") if said.apart else rows
    if said.n and said.most * rows.sparkSession.sparkContext.defaultParallelism > 2 * said.n:
        new = new.repartition("doc_id")
    return new.union(_least(rows.join(F.broadcast(ids.where(repeated).select("doc_id")), "doc_id", "left_semi"))) if said.repeated else new


def ingest_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """One micro-batch of ``(doc_id, text)``. Documents completed before are skipped, failed ones (no text) tried again when they return."""
    spark = batch.sparkSession
    rows = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    done = before(spark, f"{folder}/manifest", MANIFEST, batch_id).where("status = 'completed'").select("doc_id").distinct()
    counted = rows.withColumn("part", F.spark_partition_id()).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("part").alias("part"))
    ids = counted.join(done.withColumn("known", F.lit(True)), "doc_id", "left").persist()
    try:
        cut = _new_texts(rows, ids).where(F.length(F.trim("text")) > 0).select("doc_id", F.posexplode(windows(F.col("text"))).alias("chunk_index", "text"))
        append_batch(cut.select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "text", F.lit("live").alias("corpus")), f"{folder}/chunks", batch_id)
        held = spark.read.schema(CHUNKS).option("basePath", f"{folder}/chunks").parquet(f"{folder}/chunks/batch_id={batch_id}").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        outcome = F.when(F.col("n_chunks") > 0, "completed").otherwise("failed").alias("status")
        append_batch(ids.where("known is null").join(held, "doc_id", "left").select("doc_id", outcome, F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks")), f"{folder}/manifest", batch_id)
    finally:
        ids.unpersist()


def ingest_available(stream: DataFrame, folder: str) -> None:
    """Ingest all that the stream has now and return; the next call goes on where this one ended."""
    query = stream.writeStream.foreachBatch(lambda b, i: ingest_batch(b, i, folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The last outcome of each document."""
    rows = spark.read.schema(MANIFEST).option("basePath", f"{folder}/manifest").parquet(f"{folder}/manifest")
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("status", "n_chunks"), "batch_id").alias("r")).select("doc_id", "r.*")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHUNKS).option("basePath", f"{folder}/chunks").parquet(f"{folder}/chunks").drop("batch_id")
