"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

A text is normalised once (ASCII lower-cased, cut into words); every window of ten item
words is one pattern. The automaton reads words, not characters: each distinct benchmark
word has a short code, and all words that no item holds have one other. So a text is scanned once, hits come as word ranges, and these
are mapped back to offsets of the original text.

The automaton is broadcast, so its size is bounded: the benchmark's words are summed up
before anything is collected, and a benchmark beyond the bound is an error.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, held, restore_columns, restored, texts

WINDOW = 10
#: Words of all patterns together, each of two or three states at most (about 100 bytes of worker memory each).
PATTERN_WORDS = 2_000_000

#: Letters of a place in a word's code.
BASE = 48

#: Bytes of UTF-8 that are part of words: 0-9, a-z (after lower-casing A-Z) and all non-ASCII; the rest become spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: The same words for Spark's regular expressions.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    w = words(text)
    return [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def patterns(benchmark: DataFrame, width: int = WINDOW, most: int = PATTERN_WORDS) -> list[tuple[bytes, tuple[str, ...]]]:
    """The distinct windows with the ids of the items that hold them, in order.

    Their words are counted first; more than ``most`` raise a ValueError, and nothing is collected.
    """
    n = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long")
    wide = F.when(n > width, (n - width + 1) * width).otherwise(n)
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("text is not null")
    total = items.agg(F.sum(wide).alias("n")).first().n or 0
    if total > most:
        raise ValueError(f"the benchmark makes patterns of {total} words, more than the automaton's bound of {most}: scan for its parts one after the other")
    found: dict[bytes, set[str]] = {}
    for r in items.toLocalIterator():
        for w in windows(r.text, width):
            found.setdefault(w, set())
            if r.i is not None:
                found[w].add(r.i)
    return [(w, tuple(sorted(found[w]))) for w in sorted(found)]


class Scanner:
    """The automaton over numbered words.

    A word's number is written with ``places`` digits, each place with letters of its own, so a
    code is found at the beginning of a word only and no state has more than ``BASE`` arcs.
    """

    def __init__(self, held: list[tuple[bytes, tuple[str, ...]]]):
        own = sorted({w for p, _ in held for w in p.split()})
        self.places = 1
        while BASE**self.places < len(own):
            self.places += 1
        self.codes = {w: "".join([chr(1 + BASE * k + n // BASE**k % BASE) for k in range(self.places)]) for n, w in enumerate(own)}
        self.automaton = ahocorasick.Automaton() if held else None
        for p, ids in held:
            w = p.split()
            self.automaton.add_word("".join([self.codes[x] for x in w]), (len(w), ids))
        if held:
            self.automaton.make_automaton()

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges of all hits, and the ids of the items they come from."""
        ranges, names = [], set()
        if self.automaton is not None and w:
            line = "".join(map(self.codes.get, w, repeat("\0" * self.places)))
            for end, (n, ids) in self.automaton.iter(line):
                last = end // self.places + 1
                ranges.append((last - n, last))
                names.update(ids)
        return _merge(ranges), names


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(docs: DataFrame, benchmark: DataFrame, width: int, most: int) -> DataFrame:
    """The columns of ``docs``, none of them named as the four that are added."""
    listed = patterns(benchmark, width, most)
    mark = hashlib.sha256(repr(listed).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(listed)

    def make():
        scanner = held(("automaton", mark), lambda: Scanner(sent.value))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, hits, items, spans = [], [], [], []
            for t in texts(batch):
                w = words(t)
                own, names = scanner.scan(w)
                n_words.append(len(w))
                hits.append([list(x) for x in own])
                items.append(sorted(names))
                spans.append(_spans(t, own) if own else [])
            added = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
            return pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "n_words", "hits", "items", "spans"])

        return work

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return arrow_map(docs, make, ", ".join([*kept, "n_words long", "hits array<array<int>>", "items array<string>", "spans array<array<int>>"]))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: int = PATTERN_WORDS) -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``hits`` (merged word ranges, end exclusive), ``items`` (ids of items with an occurring window, as sorted strings), ``spans`` (the ranges as code points of the text).

    A null text has no words. An empty benchmark hits nothing. Items without id count
    for hits but are not listed; items of one id count as one. Each row is scanned whole and
    by itself. Extra columns stay; columns of the four names are replaced. A benchmark
    whose patterns hold more than ``most`` words is an error.
    """
    rest = docs.drop("n_words", "hits", "items", "spans")
    out = _scan(carried(rest, "text"), benchmark, width, most)
    return out.select(*restore_columns(rest, "text"), "n_words", "hits", "items", "spans")


def _spans(text: str, hits: list[tuple[int, int]]) -> list[list[int]]:
    """Word ranges as code point ranges of the original text."""
    raw = text.encode()
    flat = raw.translate(WORD_BYTES)
    starts, ends, at = [], [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, done, points = [], 0, 0
    for a, b in hits:  # each stretch is decoded once
        points += len(raw[done : starts[a]].decode())
        size = len(raw[starts[a] : ends[b - 1]].decode())
        out.append([points, points + size])
        points, done = points + size, ends[b - 1]
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns only, whatever these are named. A null text is clean."""
    return restored(_scan(carried(docs, "text"), benchmark, WINDOW, PATTERN_WORDS).where(F.size("hits") == 0), docs, "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + (x[1] - x[0]).cast("long"))
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT d.doc_id, z.n, d.p, array_to_string(d.w[d.p : d.p + z.n - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM dw WHERE len(w) > 0) d, sizes z WHERE d.p + z.n - 1 <= len(d.w)),
occ AS (SELECT s.doc_id, s.p, s.n, w.item_id FROM spots s JOIN wins w ON s.s = w.s AND s.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN ids i ON d.doc_id = i.doc_id
"""
