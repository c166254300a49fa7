"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

Part of subpackage ``llm``: needs it and goes with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofworks.llm import decontam, langid, linededup, minhash, pieces
from asofworks.llm.common import passing, remove, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others (null or empty text, no letter, or no learned language) go.

    The model learns from the labelled rows of ``docs`` itself. Repeated rows share a fate;
    of an empty table nothing stays; columns of any name are carried as they are.
    """
    return langid.identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document of smaller doc_id holds; ``n_chars``, where there is one, follows the text.

    A null text becomes an empty one; rows without doc_id lose nothing; rows of one doc_id
    are one document. Other columns are carried as they are, whatever their names.
    """
    out = linededup.rewritten(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    The smallest doc_id of a group stays, with all its rows. Texts without words and rows
    without doc_id are alike to nothing and stay. Other columns are carried as they are.
    """
    return minhash.one_of_each(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; a null text has none. Other columns are carried as they are."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the ids of each text's pieces with digests of both directions (columns of these names are replaced)."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece", tokenize),
]

#: Language identification has no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read as the next one's input.

    A stage's input and whatever it settled on the way are deleted when its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/asofworks-pipeline-{k}-{uuid.uuid4().hex}"
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
