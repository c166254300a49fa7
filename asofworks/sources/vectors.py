"""A vector table as Parquet: made, filled without repeats, scanned a page at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from .sinks import append_batch, exists, one_per_key, remove

POINT = "point_id string, chunk_id string, document_id string, text string, available_time string, embedding array<float>"
#: Texts that an encoder gets at once.
ENCODE_ROWS = 64


def create(spark: SparkSession, path: str, recreate: bool = False) -> None:
    """An empty collection; an existing one stays unless ``recreate``."""
    if recreate or not exists(spark, path):
        remove(spark, path)
        append_batch(spark.createDataFrame([], POINT), path, 0)


def collection(spark: SparkSession, path: str) -> DataFrame:
    """The last version of each point."""
    rows = spark.read.schema(POINT + ", batch_id long").option("basePath", path).parquet(path)
    last = rows.groupBy("point_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, ["point_id", "batch_id"], "left_semi").drop("batch_id")


def encode(chunks: DataFrame, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``chunks`` with ``embedding``, by an encoder that gets lists of at most ``ENCODE_ROWS`` texts on the workers; a null text is encoded as empty."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, ENCODE_ROWS):
                part = b.slice(at, ENCODE_ROWS)
                got = encoder([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    kept = chunks.drop("embedding")
    return kept.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["embedding array<float>"]))


def upsert(chunks: DataFrame, path: str, batch_id: int) -> None:
    """Points of ``chunks(chunk_id, document_id, text, available_time, embedding)`` under the name-based UUIDs of their chunk_id: the same batch again replaces itself, a later one replaces the points it names."""
    rows = one_per_key(chunks.select("chunk_id", "document_id", "text", "available_time", F.col("embedding").cast("array<float>").alias("embedding")), "chunk_id")
    append_batch(rows.select(uuid5(F.col("chunk_id")).alias("point_id"), *rows.columns), path, batch_id)


def scroll(rows: DataFrame, fields: list[str], after: str | None = None, limit: int = 512, keep: Column | None = None) -> DataFrame:
    """The next ``limit`` points behind the cursor ``after``, with the wanted fields only (others are not read); the last row's point_id is the next cursor."""
    rows = rows if keep is None else rows.where(keep)
    rows = rows if after is None else rows.where(F.col("point_id") > after)
    return rows.select("point_id", *[f for f in fields if f != "point_id"]).orderBy("point_id").limit(limit)
