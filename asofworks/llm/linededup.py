"""Line deduplication with sharded cuckoo filters backed by exact reference-count tables.

The index is made of tables in the shared folder, all of them logs in which the last
version of a key counts, so an update adds rows and rewrites none:

* ``refs`` (h1, h2, doc_id, version): each distinct line key of each document;
* ``members`` (doc_id, version, live): the documents;
* ``counts`` (shard, h1, h2, n_docs, keeper, version): the exact reference count of each
  key and the smallest document that holds it;
* ``filters`` (shard, filter, spare, version): one cuckoo filter a shard of the key space,
  holding the keys of at least one reference.

A batch of documents is first added up to one row a key. Shard by shard its keys meet the
shard's filter: what the filter lacks is new and needs no look-up, which holds for most
lines; only what it may hold is looked up in ``counts``. Deleting documents takes their
references away, and a key without any leaves its filter, so both directions touch the
batch's keys alone and deletion undoes insertion. Nothing is broadcast, at any size.

Keys are 128-bit hashes of the stripped, ASCII-lower-cased line.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_SPACE, arrow_map, carried, column, discard, fresh, restore_columns, restored, settle, ship, texts
from .cuckoo import CuckooFilter

MIN_POINTS = 10
#: Keys a shard is made for. Beyond twice as many on average, an insertion deals the keys over more shards.
SHARD_KEYS = 200_000
#: A new index takes a corpus in so many insertions.
BATCHES = 2


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text (UTF-8) and their keys; null and empty are one empty line."""
    raw = (text or "").encode()
    lines = raw.split(b"\n")
    return lines, [x.strip(ASCII_SPACE) for x in raw.translate(ASCII_LOWER).split(b"\n")]


def _long(key: bytes) -> bool:
    n = len(key)
    return n >= MIN_POINTS and (n >= 4 * MIN_POINTS or len(key.decode()) >= MIN_POINTS)


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Shape (keys, 2), signed 64-bit halves."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").astype(np.int64).reshape(-1, 2)


def references(docs: DataFrame) -> DataFrame:
    """``(h1, h2, doc_id)``: each distinct key of at least ten code points of each row. Rows without doc_id hold no reference."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, keys = [], []
            for d, t in zip(column(batch, "doc_id").to_pylist(), texts(batch), strict=True):
                own = {k for k in line_keys(t)[1] if _long(k)}
                keys += own
                ids += [d] * len(own)
            h = _hashes(keys)
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], names=["h1", "h2", "doc_id"])

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null"), make, "h1 long, h2 long, doc_id long")


_FILTER = "shard long, filter binary, spare array<array<long>>"


def _open(rows: pa.Table, n_keys: int) -> CuckooFilter:
    """The filter in a shard's row, or a new one with room to grow."""
    if not len(rows):
        return CuckooFilter(max(n_keys, SHARD_KEYS) if n_keys > SHARD_KEYS // 4 else 4 * n_keys)
    row = rows.slice(0, 1).to_pylist()[0]
    return CuckooFilter.from_bytes(row["filter"], [tuple(x) for x in row["spare"]])


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The batch's keys of one shard, marked by the shard's filter."""
    maybe = _open(filters, 0).contains(keys.column("h1").to_numpy()) if len(filters) else np.zeros(len(keys), bool)
    return keys.append_column("maybe", pa.array(maybe))


def _update(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's filter after its keys' counts went from ``was`` to ``n_docs``."""
    if not len(keys):  # a shard that the batch does not touch stays as it is
        return filters.slice(0, 0)
    h, was, now = (keys.column(c).to_numpy() for c in ("h1", "was", "n_docs"))
    f = _open(filters, int((now > 0).sum()))
    f.delete(h[(was > 0) & (now == 0)])
    f.insert(h[(was == 0) & (now > 0)])
    spare = [[int(t), int(at), n] for (t, at), n in f.overflow.items()]
    return pa.table({"shard": keys.column("shard").slice(0, 1), "filter": pa.array([f.to_bytes()], pa.binary()), "spare": pa.array([spare], pa.list_(pa.list_(pa.int64())))})


def _by_shard(keys: DataFrame, filters: DataFrame, work, schema: str) -> DataFrame:
    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(work, schema)


def _last(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key."""
    rest = [c for c in log.columns if c not in (*keys, "version")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*")


class LineIndex:
    """An immutable view of the logs; ``insert`` and ``delete`` return the next one, and the view before stays valid."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        empty = lambda schema: spark.createDataFrame([], schema)
        self.spark, self.version, self.n_shards, self.n_keys, self.pruned = spark, 0, 0, 0, False
        self.refs, self.members = empty("h1 long, h2 long, doc_id long, version long"), empty("doc_id long, version long, live boolean")
        self.counts = empty("shard long, h1 long, h2 long, n_docs long, keeper long, version long")
        self.filters = empty(f"{_FILTER}, version long")

    @classmethod
    def of(cls, docs: DataFrame, batches: int = BATCHES) -> LineIndex:
        """The index of a corpus, inserted in batches dealt by doc_id, so that no insertion holds all of it."""
        index = cls(docs.sparkSession)
        for k in range(batches):
            index = index.insert(docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(batches)) == k), known=True)
        return index

    def _next(self, changed: DataFrame, refs: DataFrame | None, members: DataFrame, pruned: bool) -> LineIndex:
        """The view after ``changed`` (shard, h1, h2, n_docs, keeper, was) is settled."""
        out = LineIndex.__new__(LineIndex)
        out.spark, out.version, out.n_shards, out.pruned = self.spark, self.version + 1, self.n_shards, pruned
        mark = F.lit(out.version).cast("long").alias("version")
        moved = changed.agg(F.sum((F.col("n_docs") > 0).cast("int") - (F.col("was") > 0).cast("int")).alias("n")).first().n or 0
        out.n_keys = self.n_keys + moved
        own = settle(_by_shard(changed.select("shard", "h1", "was", "n_docs"), self.current_filters(), _update, _FILTER).select("*", mark), "line-filters")
        add = lambda old, new: new if self.version == 0 else old.union(new)
        out.filters = add(self.filters, own)
        out.counts = add(self.counts, changed.select("shard", "h1", "h2", "n_docs", "keeper", mark))
        out.refs = self.refs if refs is None else add(self.refs, refs.select("h1", "h2", "doc_id", mark))
        out.members = add(self.members, members.select("doc_id", mark, F.lit(refs is not None).alias("live")))
        return out

    def insert(self, docs: DataFrame, known: bool = False) -> LineIndex:
        """The index with more documents. One that is there already stays as it is; ``known`` says that none of them is.

        Null and empty texts make members without references, rows without doc_id none; rows of one doc_id are one document.
        """
        if not known:
            gone = self.current_members().select(F.col("doc_id").alias(fresh(docs, "there")))
            docs = docs.join(gone, F.col("doc_id").cast("long") == F.col(gone.columns[0]), "left_anti")
        refs = settle(references(docs).distinct(), "line-refs")
        members = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "line-members")
        batch = settle(refs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), "line-batch")
        n = batch.count()
        index = self
        if not self.n_shards or self.n_keys + n > 2 * SHARD_KEYS * self.n_shards:
            index = self._dealt(max(1, math.ceil((self.n_keys + n) * (1 if self.n_shards else BATCHES) / SHARD_KEYS)))
        keys = batch.select(F.pmod("h2", F.lit(index.n_shards)).alias("shard"), "h1", "h2", "n", "low")
        if index.n_keys:
            keys = settle(_by_shard(keys, index.current_filters(), _probe, "shard long, h1 long, h2 long, n long, low long, maybe boolean"), "line-probed")
            asked = keys.where("maybe").select("shard", "h1", "h2")
            found = _last(index.counts.join(asked, ["shard", "h1", "h2"], "left_semi"), ["shard", "h1", "h2"]).withColumnRenamed("n_docs", "was")
            joined = keys.where("maybe").join(found, ["shard", "h1", "h2"], "left").drop("maybe")
            changed = joined.unionByName(keys.where("not maybe").drop("maybe").withColumns({"was": F.lit(0).cast("long"), "keeper": F.lit(None).cast("long")}))
        else:
            changed = keys.withColumns({"was": F.lit(0).cast("long"), "keeper": F.lit(None).cast("long")})
        was = F.coalesce("was", F.lit(0))
        low = F.when(was > 0, F.least("low", "keeper")).otherwise(F.col("low"))
        changed = settle(changed.select("shard", "h1", "h2", (was + F.col("n")).alias("n_docs"), low.alias("keeper"), was.alias("was")), "line-counts")
        out = index._next(changed, refs, members, index.pruned)
        discard(batch, *([keys] if index.n_keys else []))
        return out

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents in ``ids(doc_id)``; ids that are not there are ignored."""
        key = ["h1", "h2"]
        gone = settle(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(self.current_members(), "doc_id", "left_semi"), "line-gone")
        refs = self.current_refs()
        lost = refs.join(gone, "doc_id", "left_semi").groupBy(*key).agg(F.count("*").alias("lost"))
        lost = settle(lost, "line-lost")
        rest = refs.join(gone, "doc_id", "left_anti").join(lost, key, "left_semi").groupBy(*key).agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"))
        n = F.coalesce("n", F.lit(0))
        changed = lost.join(rest, key, "left").select(F.pmod("h2", F.lit(max(1, self.n_shards))).alias("shard"), *key, n.alias("n_docs"), "keeper", (n + F.col("lost")).alias("was"))
        out = self._next(settle(changed, "line-counts"), None, gone, True)
        discard(lost)
        return out

    def _dealt(self, n_shards: int) -> LineIndex:
        """The same index over another number of shards, in one version."""
        out = LineIndex(self.spark)
        out.n_shards = n_shards
        if not self.n_keys:
            out.refs, out.members, out.version, out.pruned = self.refs, self.members, self.version, self.pruned
            return out
        counts = self.current_counts().select(F.pmod("h2", F.lit(n_shards)).alias("shard"), "h1", "h2", "n_docs", "keeper", F.lit(0).cast("long").alias("was"))
        members = settle(self.current_members(), "line-members")
        return out._next(settle(counts, "line-counts"), settle(self.current_refs(), "line-refs"), members, False)

    def current_members(self) -> DataFrame:
        return _last(self.members, ["doc_id"]).where("live").select("doc_id")

    def current_refs(self) -> DataFrame:
        """``(h1, h2, doc_id)`` of the documents that are there."""
        if not self.pruned:  # nothing was ever deleted
            return self.refs.select("h1", "h2", "doc_id")
        last = self.members.groupBy("doc_id").agg(F.max("version").alias("version"), F.max_by("live", "version").alias("live")).where("live").drop("live")
        return self.refs.join(last, ["doc_id", "version"], "left_semi").select("h1", "h2", "doc_id")

    def current_counts(self) -> DataFrame:
        """``(shard, h1, h2, n_docs, keeper)`` of the keys with a reference."""
        return _last(self.counts, ["shard", "h1", "h2"]).where("n_docs > 0")

    def current_filters(self) -> DataFrame:
        return _last(self.filters, ["shard"])

    def losses(self) -> DataFrame:
        """``(doc_id, lost)``: for each document that loses lines, the concatenated 128-bit keys, at most as many as it has lines."""
        shared = self.current_counts().where("n_docs > 1").select("h1", "h2", "keeper")
        lost = self.current_refs().join(shared, ["h1", "h2"]).where("doc_id <> keeper")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("lost"))


def _dedup(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``(text, row_, n_lines, n_dropped)`` of ``docs`` as :func:`carried` gives it."""
    losses = index.losses().select(F.col("doc_id").alias("lost_id"), "lost")
    joined = carried(docs, "text").join(losses, F.col("row_.doc_id").cast("long") == F.col("lost_id"), "left").drop("lost_id")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, n_lines, n_dropped = [], [], []
            for t, lost in zip(texts(batch), column(batch, "lost").to_pylist(), strict=True):
                if not lost:
                    out.append(t or "")
                    n_lines.append((t or "").count("\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = {(x["h1"], x["h2"]) for x in lost}
                lines, keys = line_keys(t)
                there = sorted({k for k in keys if _long(k)})
                dead = {k for k, h in zip(there, _hashes(there).tolist(), strict=True) if tuple(h) in gone}
                left = [x for x, k in zip(lines, keys, strict=True) if k not in dead]
                out.append(b"\n".join(left).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), column(batch, "row_"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["text", "row_", "n_lines", "n_dropped"])

        return work

    return arrow_map(joined, make, f"text string, row_ {joined.schema['row_'].dataType.simpleString()}, n_lines long, n_dropped long")


def dedup(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, and ``n_lines``, ``n_dropped`` (columns of these two names are replaced).

    A key found in at least two documents keeps its lines (repeats within the document
    too) in the document of smallest doc_id alone. Rows of one doc_id count as one
    document. Null and empty texts are one empty line and come out empty; rows without
    doc_id hold no keys and lose nothing; an empty table gives none. Other columns are carried.
    """
    rest = docs.drop("n_lines", "n_dropped")
    return _dedup(rest, index or LineIndex.of(docs)).select(*restore_columns(rest, "text"), "n_lines", "n_dropped")


def rewritten(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """``docs`` with its own columns, whatever these are named, and ``text`` as :func:`dedup` leaves it."""
    return restored(_dedup(docs, index or LineIndex.of(docs)), docs, "text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, x AS line, translate(rtrim(ltrim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
shared AS (SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
