"""Ranked lexical search: a sparse matrix product in blocks.

The items make a matrix of terms with their multiplicity, the documents a matrix of terms
with integer impacts. Documents are cut into terms once, where they lie, and only the terms
that some item holds become entries. A task then takes blocks of documents: a block's rows
by term are merged into one dense row of scores for each item (Gustavson's product, a row
at a time), and the best of the row go to the item's list. A task gives back its best rows
only, which are reduced in two steps.

Items come in blocks too: the entries of one block are broadcast, so they are summed up
first and a larger set of items is dealt to as many blocks as it needs, each one a pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, column, pieces_of, settle, ship
from .decontam import WORD, WORD_BYTES

#: Entries of one block of items (an entry is a term of an item): what is broadcast.
ENTRIES = 1 << 20
#: Documents and entries of one block of the product: a worker's memory is some 30 bytes an entry.
BLOCK_DOCS, BLOCK_ENTRIES = 1 << 16, 1 << 21
#: Parts that an item's best rows are reduced in before they meet.
PARTS = 32


def item_terms(items: DataFrame) -> DataFrame:
    """Rows (item_id, term, times) of the items' terms; items without id or terms have none, rows of one id are one item."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.where("item_id is not null").select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _term_matrix(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """Rows (doc_id, n, terms, tfs): the count of all terms, and the coded terms with their occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(codes)

    def make():
        known = sent.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, lengths, terms, tfs = [], [], [], []
            for at, text in enumerate(column(batch, "text").cast(pa.binary()).to_pylist()):
                n, found = 0, Counter()
                for part in pieces_of((text or b"").translate(WORD_BYTES)):
                    words = part.split()
                    n += len(words)
                    found.update(c for c in map(known.get, words) if c is not None)
                if n:
                    kept.append(at)
                    lengths.append(n)
                    terms.append(list(found.keys()))
                    tfs.append(list(found.values()))
            arrays = [column(batch, "doc_id").take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "tfs"])

        return work

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(own, make, "doc_id long, n long, terms array<int>, tfs array<long>")


class _Best:
    """The ``k`` best documents of each item so far: highest score, then smallest doc_id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.ids = [np.empty(0, np.int64)] * n_items
        self.scores = [np.empty(0, np.int64)] * n_items

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        least = int(self.scores[item][-1]) if len(self.scores[item]) == self.k else 1
        hit = np.flatnonzero(scores >= least)
        if not len(hit):
            return
        if len(hit) > 4 * self.k:  # the k-th score bounds the candidates; ties at it all stay
            bound = np.partition(scores[hit], len(hit) - self.k)[len(hit) - self.k]
            hit = hit[scores[hit] >= bound]
        s, d = np.concatenate([self.scores[item], scores[hit]]), np.concatenate([self.ids[item], ids[hit]])
        order = np.lexsort((d, -s))[: self.k]
        self.scores[item], self.ids[item] = s[order], d[order]


def _product(items: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int, best: _Best) -> None:
    """One block: ``items`` holds term codes with weights, ``rows``, ``terms`` and ``impacts`` are the block's entries."""
    order = np.argsort(terms, kind="stable")
    rows, impacts = rows[order], impacts[order]
    starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
    merged = np.zeros(len(ids), np.int64)
    for item, (codes, weights) in enumerate(items):
        merged.fill(0)
        for code, weight in zip(codes.tolist(), weights.tolist(), strict=True):
            a, b = starts[code], starts[code + 1]
            if a < b:
                merged[rows[a:b]] += weight * impacts[a:b]  # a document is in a term's row once
        best.add(item, ids, merged)


def _multiply(matrix: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, n_docs: int, n_words: int, k: int) -> DataFrame:
    """Rows (item, doc_id, score, part): each task's best documents of each item."""
    ship(matrix.sparkSession)
    sent = matrix.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of, best, part = sent.value, _Best(len(sent.value), k), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, ...]] = []

        def block() -> None:
            ids, lengths, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rows = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
            m = 100 - 90 + (90 * lengths * n_docs) // n_words
            _product(rows_of, ids, rows, terms, (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[rows]), n_terms, best)

        for batch in batches:
            terms, tfs = column(batch, "terms"), column(batch, "tfs")
            sizes = np.diff(terms.offsets.to_numpy())
            held.append((column(batch, "doc_id").to_numpy(), column(batch, "n").to_numpy(), sizes, terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
            if sum(len(x[0]) for x in held) >= BLOCK_DOCS or sum(len(x[3]) for x in held) >= BLOCK_ENTRIES:
                block()
        if held:
            block()
        sizes = [len(x) for x in best.ids]
        if sum(sizes):
            arrays = [np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.concatenate(best.ids), np.concatenate(best.scores), np.full(sum(sizes), part, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["item", "doc_id", "score", "part"])

    return matrix.mapInArrow(run, "item int, doc_id long, score long, part int")


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, multiplicity: bool = True, entries: int = ENTRIES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of every item, of score above 0; fewer where fewer match.

    Terms are runs of ASCII letters, digits and all other non-ASCII characters, with A-Z
    lower-cased, over whole texts. A document's impact of a term is
    ``10**9 * tf div (1000 * tf + 8 * m)`` with ``m = 10 + 90 * n * N div L``, a term's weight
    ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``; a score sums weight times impact, and
    times the term's occurrences in the item with ``multiplicity``. N, L and df are counted
    over all documents. Equal scores go by ascending doc_id.

    Null and empty texts have no terms and are no documents of N; rows without doc_id, and
    items without item_id, are left out. A row is a document: repeated rows rank one behind
    the other. Items of one id are one item. Extra columns are ignored. No documents or no
    items give no rows. An item of more than four times ``entries`` distinct terms is an error.
    """
    spark = docs.sparkSession
    wanted = settle(item_terms(items.select("item_id", "text")), "items")
    kind = wanted.schema["item_id"].dataType.simpleString()
    total = wanted.count()
    n_blocks = max(1, -(-total // entries))
    out = None
    for b in range(n_blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b)
        if n_blocks > 1 and block.count() > 4 * entries:
            raise ValueError(f"an item has more than {4 * entries} distinct terms: cut it into several")
        held: dict = {}
        for r in block.toLocalIterator():  # bounded by the count above
            held.setdefault(r.item_id, []).append((r.term.encode(), r.times if multiplicity else 1))
        names = sorted(held)
        codes = {t: c for c, t in enumerate(sorted({t for x in held.values() for t, _ in x}))}
        matrix = settle(_term_matrix(docs, codes), "terms")
        size = matrix.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
        weights = np.zeros(len(codes), np.int64)
        for r in matrix.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():  # a row for each code at most
            weights[r.t] = math.floor(1000 * math.log((2 * size.docs + 2) / (2 * r.df + 1)))
        rows = []
        for name in names:
            own = np.array([codes[t] for t, _ in held[name]], np.int64)
            rows.append((own, weights[own] * np.array([n for _, n in held[name]], np.int64)))
        best = _multiply(matrix, rows, len(codes), size.docs, size.words or 1, k)
        best = _top(best.withColumn("part", F.pmod("part", F.lit(PARTS))), ["item", "part"], k).drop("part", "rank")
        named = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
        done = _top(best, ["item"], k).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = done if out is None else out.union(done)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), items, multiplicity=False)


OP11_SQL = r"""
WITH dw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
iw AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dw GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, whole GROUP BY term, big_n),
m AS (SELECT doc_id, 100 - 90 + (90 * n * big_n) // l AS m FROM n, whole),
scores AS (
  SELECT iw.item_id, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
  FROM iw JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
