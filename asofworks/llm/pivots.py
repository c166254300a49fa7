"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of vectors serves as pivots. Every vector is described by its
nearest pivots in order and posted to the inverted list of each of them; two vectors
meet in the lists they share. In a list, vectors that share enough pivots are
candidates, and the cosine of every candidate pair is verified in double precision.
A pair that meets in several lists is counted in the list of its smallest shared pivot.

Equal vectors of one label are one class from the start. A list longer than a block
is split into blocks whose pairs of blocks are separate groups, so no group holds more
than two blocks whatever the size of a list. Vectors travel in their own precision and are
compared in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, column, discard, settle
from .components import connected_components

COSINE = 0.98
#: Nearest pivots in a vector's description, and how many of them two candidates share at least.
NEAREST, SHARED = 6, 2
#: Pivots: four times the root of the number of classes, within these bounds (the table of pivots is broadcast).
PIVOTS = (64, 16_384)
#: Two pivots have a cosine below this.
APART = 0.9
#: Vectors of a block: a list's rows are sent once for each of its blocks, so larger blocks send fewer; two of them are compared in some thirty megabytes.
BLOCK = 1024


def can_link():
    """vec_id, label and embedding not null, all components finite, not all zero."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def _classes(vectors: DataFrame) -> DataFrame:
    """One row for each label and distinct vector: ``c1, c2`` (its name), ``cid`` (smallest vec_id), ``copies``."""
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(can_link()).select("vec_id", "label", "embedding", *_name())
    found = named.groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("vec_id", "label", "embedding")).alias("r"))
    return found.select("c1", "c2", F.col("r.vec_id").alias("cid"), "copies", F.col("r.label").alias("label"), F.col("r.embedding").alias("embedding"))


def _name() -> list:
    """128 bits that name a label and a vector."""
    e = F.col("embedding").cast("array<double>")
    return [F.xxhash64(F.lit(k), F.col("label"), e).alias(f"c{k}") for k in (1, 2)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spread(sample: np.ndarray, apart: float = APART, block: int = 512) -> np.ndarray:
    """The sampled unit vectors that are not within ``apart`` of an earlier one that is kept: else a dense group would hold many pivots, and their order would be noise."""
    kept = np.empty_like(sample)
    n = 0
    unit = _unit(sample)
    for at in range(0, len(unit), block):
        x = unit[at : at + block]
        x = x[(kept[:n] @ x.T).max(0, initial=-1) < apart]  # against the blocks before at once
        first = n
        for v in x:
            if n == first or (kept[first:n] @ v).max() < apart:
                kept[n] = v
                n += 1
    return kept[:n]


def _matrix(a: pa.ListArray, width: int) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def postings(classes: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """``(label, pivot, cid, copies, near, embedding)``: one row for each class and pivot of its description."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)
    width = pivots.shape[1]

    def make():
        p = sent.value
        k = min(nearest, len(p))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _unit(_matrix(column(batch, "embedding"), width))
            close = x @ p.T
            top = np.argpartition(-close, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable"), 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, k, dtype=np.int32)), pa.array(top.ravel()))
            return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "near"])

        return work

    label, vector = (classes.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    described = arrow_map(classes.select("label", "cid", "copies", "embedding"), make, f"label {label}, cid long, copies long, embedding {vector}, near array<int>")
    return described.select("label", F.explode("near").alias("pivot"), "cid", "copies", "near", "embedding")


def _compare(cosine: float, shared: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pivot, i, j = (x.as_py() for x in key[1:])
        rows = rows.combine_chunks()
        near = _matrix(rows.column("near").chunk(0), len(rows.column("near")[0])).astype(np.int32)
        x = _unit(_matrix(rows.column("embedding").chunk(0), len(rows.column("embedding")[0])))
        names, own = np.unique(near, return_inverse=True)
        flag = np.zeros((len(rows), len(names)), np.float32)
        flag[np.arange(len(rows))[:, None], own.reshape(near.shape)] = 1
        block = rows.column("blk").to_numpy()
        a = np.flatnonzero(block == i)
        b = a if i == j else np.flatnonzero(block == j)
        cid, copies = rows.column("cid").to_numpy(), rows.column("copies").to_numpy()
        candidate = flag[a] @ flag[b].T >= min(shared, near.shape[1])
        if i == j:
            candidate = np.triu(candidate, 1)
        u, v = np.nonzero(candidate & (x[a] @ x[b].T >= cosine))
        u, v = a[u], b[v]
        if len(u):  # the first shared pivot's list counts a pair
            first = names[np.argmax(flag[u] * flag[v], axis=1)]
            u, v = u[first == pivot], v[first == pivot]
        more = np.bincount(u, copies[v], len(rows)) + np.bincount(v, copies[u], len(rows))
        some = np.flatnonzero(more)
        up = {}

        def root(t):
            while (s := up.setdefault(t, t)) != t:
                up[t] = up[s]
                t = s
            return t

        tree = []
        for s, t in zip(cid[u].tolist(), cid[v].tolist(), strict=True):
            s, t = root(s), root(t)
            if s != t:
                up[max(s, t)] = min(s, t)
                tree.append((s, t))
        gap = [None] * len(tree)
        return pa.table({"u": pa.array([*cid[some].tolist(), *(s for s, _ in tree)], pa.int64()), "v": pa.array([*[None] * len(some), *(t for _, t in tree)], pa.int64()), "n": pa.array([*more[some].astype(np.int64).tolist(), *gap], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED, n_pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, label, embedding)``.

    Vectors of one label whose cosine is at least ``cosine`` are linked (found through the
    index, none below it). n_links counts other rows, copies included. Vectors that are
    null, zero or hold null or non-finite components, and rows without label, link with
    nothing and are their own component; rows without vec_id have a null component and
    are kept. Vectors of different lengths never link. Extra columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "embedding")
    classes = settle(_classes(rows), "vectors")
    widths = [r.w for r in classes.select(F.size("embedding").alias("w")).distinct().collect()]
    found = None
    for width in widths:
        own = classes.where(F.size("embedding") == width)
        m = n_pivots or min(PIVOTS[1], max(PIVOTS[0], int(4 * own.count() ** 0.5)))
        drawn = own.orderBy(F.xxhash64("cid"), "c1").limit(m).select("embedding").collect()
        posts = settle(postings(own, spread(np.array([r.embedding for r in drawn], np.float64)), nearest), "postings")
        sizes = posts.groupBy("label", "pivot").agg(F.count("*").alias("n")).where(f"n > {block}")
        dealt = posts.join(sizes, ["label", "pivot"], "left").withColumn("m", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("m")).cast("int"))
        pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        pairs = pairs.select("label", "pivot", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "cid", "copies", "near", "embedding")
        # by number, so that adaptive execution does not merge these few but busy partitions
        pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "pivot", "i", "j")
        part = settle(pairs.groupBy("label", "pivot", "i", "j").applyInArrow(_compare(cosine, shared), "u long, v long, n long"), "met")
        discard(posts)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "u long, v long, n long")
    more = found.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("more"))
    parts = connected_components(found.where("v is not null").select("u", "v"))
    known = classes.select("c1", "c2", "cid", "copies").join(more, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("c1", "c2", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("component", "cid").alias("part"))
    ids = F.col("vec_id").cast("long")
    named = rows.where(can_link()).select("vec_id", *_name()).join(known, ["c1", "c2"]).select("vec_id", "n", "part")
    rest = rows.where(~can_link()).select("vec_id", F.lit(0).cast("long").alias("n"), ids.alias("part"))
    out = named.union(rest)
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("part").alias("component_id"), F.coalesce(ids == F.col("part"), F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
