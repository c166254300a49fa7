"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, whatever their order. Adding a
letter adds its power to the key, removing one takes it off, and an exchange does both. So
every word is listed under its own key and under its key less the power of each of its
letters: two words are one addition or removal apart where the whole key of one is a
lessened key of the other, and one exchange apart where two lessened keys are equal. The
order of the letters that remain travels as a digest beside the key and is part of the
join, so words that merely share their letters never meet: a group holds no more words than
the alphabet has letters, however many anagrams a key has. The edit distance decides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, arrow_map, column, discard, salted, settle, ship

#: Letters of words, once A-Z are lower-cased: a-z and U+00C0 to U+00FF.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
POWER = 5
VALUE = {chr(c): (i + 1) ** POWER for i, c in enumerate(LETTERS)}
RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words a task counts before it passes them on.
HELD = 100_000
#: Characters of a text looked at at once.
STRETCH = 1 << 20
#: The order digest is a polynomial modulo a prime.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A8642C1
#: One document and run in so many loses a letter in the query's test rows.
NOISE = 97


def _stretches(text: str) -> Iterator[str]:
    at, cut = 0, re.compile("[^a-zÀ-ÿ]")
    while len(text) - at > STRETCH:
        end = cut.search(text, at + STRETCH)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text


def runs_of(text: bytes | None) -> Counter:
    """The runs of letters of a text with their numbers of occurrences."""
    found: Counter = Counter()
    for part in _stretches((text or b"").translate(ASCII_LOWER).decode()):
        found.update(RUN.findall(part))
    return found


def lessened(doc_id: int | None, run: str, noise: int | None) -> str:
    """The run itself, or without one letter where ``noise`` divides its checksum under the document's id."""
    if noise is None:
        return run
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, noise: int | None = None) -> DataFrame:
    """Rows (word, n) of words of ``shortest`` letters that occur ``least`` times in all texts; counts are added up in each task first."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def drain() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").cast(pa.binary()).to_pylist(), strict=True):
                for found, n in runs_of(text).items():
                    word = lessened(doc_id, found, noise)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield drain()
        if held:
            yield drain()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def keys(word: str) -> tuple[int, int, list[tuple[int, int, int, bool]]]:
    """The anagram key and the order digest of a word, and of each place (key, digest, place, first of equal letters) without its letter."""
    whole = sum(VALUE[c] for c in word)
    before = [0]
    for c in word:
        before.append((before[-1] * BASE + ord(c)) % PRIME)
    out, behind, scale = [], 0, 1
    for at in range(len(word) - 1, -1, -1):
        out.append((whole - VALUE[word[at]], (before[at] * scale + behind) % PRIME, at, at == 0 or word[at - 1] != word[at]))
        behind = (behind + ord(word[at]) * scale) % PRIME
        scale = scale * BASE % PRIME
    return whole, before[-1], out


def _keyed(words: DataFrame) -> DataFrame:
    """Rows (id, n, k, o, less): a long word is not repeated for each of its letters, its id is."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            own, orders, less = [], [], []
            for w in column(batch, "word").to_pylist():
                whole, order, rest = keys(w)
                own.append(whole)
                orders.append(order)
                less.append([{"k": k, "o": o, "at": at, "lead": lead} for k, o, at, lead in rest])
            kind = pa.list_(pa.struct([("k", pa.int64()), ("o", pa.int64()), ("at", pa.int32()), ("lead", pa.bool_())]))
            arrays = [column(batch, "id"), column(batch, "n"), pa.array(own, pa.int64()), pa.array(orders, pa.int64()), pa.array(less, kind)]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "n", "k", "o", "less"])

        return work

    return arrow_map(words, make, "id long, n long, k long, o long, less array<struct<k:long,o:long,at:int,lead:boolean>>")


def near_words(words: DataFrame) -> DataFrame:
    """Rows (id, word, near, n_near) for every word of ``words(id, word, n)`` and each word one edit away, both ways round."""
    keyed = settle(_keyed(words), "keys")
    whole = keyed.select("id", "k", "o")
    less = keyed.select("id", F.inline("less"))
    one = lambda df, *extra: df.select(F.col("id").alias("a"), "k", "o", *extra)
    two = lambda df, *extra: df.select(F.col("id").alias("b"), "k", "o", *extra)
    exchanged = one(less, "at").join(two(less, "at"), ["k", "o", "at"]).where("a < b")
    added = one(whole).join(two(less.where("lead")), ["k", "o"])
    pairs = exchanged.select("a", "b").union(added.select("a", "b"))
    for side in "ab":
        pairs = pairs.join(words.select(F.col("id").alias(side), F.col("word").alias(f"word_{side}"), F.col("n").alias(f"n_{side}")), side)
    way = lambda x, y: F.struct(F.col(x).alias("id"), F.col(f"word_{x}").alias("word"), F.col(f"word_{y}").alias("near"), F.col(f"n_{y}").alias("n_near"))
    return pairs.where(F.levenshtein("word_a", "word_b", 1) == 1).select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("x")).select("x.*")


def roots(forms: DataFrame, most: int = 40) -> DataFrame:
    """Rows (word, root) for ``forms(word, form)``: forms are followed to the last, twice as far in each round.

    A form's count is at least twice its word's, so a chain has no circle and fewer steps than a count has bits.
    """
    at = settle(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = settle(salted(at, further, ["root"], "word", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at
    raise RuntimeError(f"chains of forms did not end in {most} rounds")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, ratio: int = 2, noise: int | None = None) -> DataFrame:
    """One row for each word of the corpus: (word, form, root, n, n_near, form_n).

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in whole texts, only A-Z lower-cased,
    of at least ``shortest`` letters and ``least`` occurrences (n). Words are near if one added,
    removed or exchanged letter apart; ``n_near`` counts them. The form is the near word of
    largest n (ties: the smallest in code point order) if that is at least ``ratio`` times the
    word's n, else null; the root is the last form reached, the word itself if it has none.
    ``noise`` (for test rows) takes a letter from one document and run in so many.

    Null and empty texts have no words; a row without doc_id counts as one of an empty id.
    Every row counts, repeated ones too. Extra columns are ignored. An empty table gives no rows.
    """
    words = settle(word_counts(docs, shortest, least, noise).withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("m"), F.col("near"))).alias("best"))
    best_n = -F.col("best.m")
    formed = best_n >= ratio * F.col("n")
    out = settle(
        words.join(near, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, best_n).alias("form_n")), "forms"
    )
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), noise=NOISE)


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, r, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS r FROM documents)
  GROUP BY ALL),
hex AS (SELECT doc_id, r, c, hex(encode(CAST(doc_id AS VARCHAR) || ':' || r)) AS x FROM runs),
hashed AS (
  SELECT r, c, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda h, b: xor(h >> 8, crc.t[xor(h & 255, b) + 1])), 4294967295) AS h FROM hex, crc),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN r[1 : h % length(r)] || r[h % length(r) + 2 :] ELSE r END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, n, p, word[1 : p - 1] || word[p + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
one AS (
  SELECT DISTINCT a.word AS u, b.word AS v, b.n AS n_v FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.rest),
best AS (SELECT u, v, n_v, count(*) OVER (PARTITION BY u) AS n_near, row_number() OVER (PARTITION BY u ORDER BY n_v DESC, v) AS k FROM one),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n_v >= 2 * w.n THEN b.v END AS form, CASE WHEN b.n_v >= 2 * w.n THEN b.n_v END AS form_n
  FROM words w LEFT JOIN best b ON b.u = w.word AND b.k = 1),
chase AS (
  SELECT word, word AS tip, 0 AS step FROM formed
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chase c JOIN formed f ON c.tip = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.tip AS root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(tip, step) AS tip FROM chase GROUP BY word) c USING (word)
"""
