"""Helpers shared by the corpus operators: scratch tables, Arrow maps, text rules."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch, and a batch function sees at once; Spark bounds a batch by bytes too (spark.sql.execution.arrow.maxBytesPerBatch).
ARROW_ROWS = 400

#: ``A-Z`` to ``a-z`` in UTF-8 bytes; every other byte stays.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: ASCII white space as the contracts name it: ``[\x20\x09-\x0D]``.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


_held: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """A worker's compiled tables, kept from task to task; those of one operator at a time, so a worker that serves many stays small."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="asofworks-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/asofworks_code.zip", "w") as z:
        for f in (top / "__init__.py", *sorted(Path(__file__).resolve().parent.glob("*.py"))):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(f"{folder}/asofworks_code.zip")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a local master gets a temporary one; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="asofworks-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    context.setCheckpointDir(base)
    return base


#: Folders of settled tables by application, oldest first.
_settled: dict[str, list[str]] = {}


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: later stages start from files that survive the loss of
    any executor. The table lies there until :func:`discard` or :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/asofworks-{name}-{uuid.uuid4().hex}"
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`settle` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        held = _settled.get(spark.sparkContext.applicationId, [])
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("asofworks-"):
                held[:] = [x for x in held if not x.endswith(folder.getName())]
                remove(spark, folder.toString())


def release(spark: SparkSession) -> int:
    """Delete every table of this application that is still settled, once the results that read them are done; returns how many."""
    held = _settled.pop(spark.sparkContext.applicationId, [])
    for path in held:
        remove(spark, path)
    return len(held)


def forget(spark: SparkSession) -> None:
    """Let go of the shuffle files of stages whose results are settled.

    Spark deletes them once the driver's collector finds that nothing refers to them. That takes two rounds: the first frees what
    the finished queries hold, and Spark's cleaner needs a moment for it. It is a matter of disk alone; results do not depend on it.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


#: Parts that a salted join splits each key into.
SALTS = 8


def salted(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row a key: a key's rows are dealt over ``SALTS`` parts by ``by`` and its row is sent to each, so one hot key is not one task."""
    one = big.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    two = small.withColumn("salt_", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return one.join(two, [*on, "salt_"], how).drop("salt_")


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables settled within are deleted at the end: for work whose result is written before."""
    before = set(_settled.get(spark.sparkContext.applicationId, []))
    yield
    held = _settled.get(spark.sparkContext.applicationId, [])
    for path in [x for x in held if x not in before]:
        held.remove(path)
        remove(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underlines behind it: a name no column of ``df`` has (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` as its needed columns and a struct ``row_`` of all others, so that no name can clash with what an operator adds."""
    rest = [c for c in df.columns if c not in needed]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("struct<none: int>")
    return df.select(*[F.col(f"`{c}`") for c in needed], row.alias("row_"))


def restore_columns(like: DataFrame, *needed: str) -> list[Column]:
    """The columns of ``like`` in what :func:`carried` made of it."""
    return [F.col(f"`{c}`") if c in needed else F.col("row_").getField(c).alias(c) for c in like.columns]


def restored(df: DataFrame, like: DataFrame, *needed: str) -> DataFrame:
    return df.select(*restore_columns(like, *needed))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of ``ARROW_ROWS``; ``make`` runs once in each task and returns the batch function.

    Spark reads the session's limit when the plan runs, so a larger one is lowered and stays lowered.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ARROW_ROWS):
                yield work(batch.slice(at, ARROW_ROWS))

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces_of(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in stretches of about ``size`` bytes, cut at spaces: no word is cut, and a long text needs no list of all its words."""
    at = 0
    while len(data) - at > size:
        end = data.find(b" ", at + size)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:] if at else data
