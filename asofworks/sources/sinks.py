"""Sinks that can be run again: a batch owns its folder, so a repeated write replaces what the lost one left."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share: ``spark.checkpoint.dir``. Where it is unset a local master gets a temporary one; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="asofworks-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/asofworks-{name}-{uuid.uuid4().hex}"


#: Scratch paths of settled tables by application.
_settled: dict[str, list[str]] = {}


def settle(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to a scratch path and read it again, so that what reads it several times computes it once and survives lost executors. It lies there until :func:`release`."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every table of this application that is still settled, once the results that read them are done; returns how many."""
    held = _settled.pop(spark.sparkContext.applicationId, [])
    for path in held:
        remove(spark, path)
    return len(held)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of names, sizes and times of the files at ``paths``: it changes when any of them is written anew."""
    said = []
    for path in paths:
        p, fs = _file_system(spark, path)
        if not fs.exists(p):
            said.append(f"{path} -")
            continue
        files = fs.listFiles(p, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        said += sorted(found)
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:16]


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.getFileStatus(p).isDirectory()


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key, the least by all its other columns; rows without key are dropped."""
    rest = [c for c in rows.columns if c != key]
    kept = rows.where(F.col(key).isNotNull())
    return kept.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*").select(rows.columns)


def append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write ``rows`` as one batch of the table at ``path``; the same batch again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def before(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame:
    """What batches earlier than ``batch_id`` left at ``path``: partition pruning keeps the others unread."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch_id") < batch_id)


def upsert(old: DataFrame, new: DataFrame, key: str, path: str) -> DataFrame:
    """``old`` with ``new`` in the place of its keys, written as a table of its own at ``path`` (a crash leaves ``old`` whole)."""
    fresh = one_per_key(new, key).select(old.columns)
    old.join(fresh.select(key), key, "left_anti").select(old.columns).union(fresh).write.mode("errorifexists").parquet(path)
    return old.sparkSession.read.schema(old.schema).parquet(path)


def log_failures(failures: DataFrame, path: str) -> None:
    """Append failures as JSON lines."""
    failures.write.mode("append").json(path)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls written out, replacing what lies there."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_metrics(rows: DataFrame, path: str, form: str = "json") -> None:
    """Metric rows as JSON lines or CSV with header."""
    writer = rows.write.mode("overwrite")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two Parquet tables in one folder."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def resume(items: DataFrame, path: str, key: list[str], work, batch_id: int) -> DataFrame:
    """Run ``work(items) -> (key, status)`` on the items that the manifest at ``path`` does not call completed, add the outcome as a batch, and return the last outcome of each key.

    The key may be several columns (ticker and accession number); failed items come again at the next call.
    """
    spark = items.sparkSession
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*key).schema] + ["status string", "batch_id long"])
    done = before(spark, path, schema, batch_id)
    last = done.groupBy(*key).agg(F.max_by("status", "batch_id").alias("status")).where("status = 'completed'")
    append_batch(work(items.join(last.select(*key), key, "left_anti")).select(*key, "status"), path, batch_id)
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    return rows.groupBy(*key).agg(F.max_by("status", "batch_id").alias("status"))
