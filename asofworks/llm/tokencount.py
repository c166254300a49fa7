"""Token counts by a two-tier look-up of pre-token lengths.

A text is split into pre-tokens as the tokenizer splits it. The first tier is a
table of the lengths of frequent pre-tokens, made on the driver from a bounded
sample and broadcast; the second is a bounded cache in each worker that encodes
what the first tier lacks. Pre-tokens never leave their row, so nothing is
shuffled, and the sample only warms a cache: it cannot change a count.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, held, restore_columns, texts

#: Pre-tokens in the broadcast table, documents it is drawn from (and characters of one's excerpt), characters that the pre-tokens in a worker's cache have together at most, and characters of the longest one kept.
FREQUENT, SAMPLE_DOCS, SAMPLE_CHARS, CACHE_CHARS, LONGEST = 20_000, 600, 20_000, 4_000_000, 64

#: Code points up to here (and general punctuation) have had the same categories in all Unicode versions in use; other texts are split by the tokenizer's own pre-tokenizer.
PLAIN = 0x24F


def _klass(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN + 1) if unicodedata.category(chr(c))[0] == kind)


#: Characters with the property White_Space among the plain ones.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f"
_L, _N = _klass("L"), _klass("N")
#: The published split pattern with its classes written out for plain text.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{SPACE}{_L}{_N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
ODD = re.compile(f"[^\x00-{chr(PLAIN)} - ]|[\x1c-\x1f]|[ⁱ⁰]")


class Lengths(dict):
    """Pre-token to token count; a missing one is encoded, and kept if it is short and there is room."""

    def __init__(self, frequent: dict[str, int], tokenizer, room: int = CACHE_CHARS):
        super().__init__(frequent)
        self.frequent, self.tokenizer, self.room, self.used = frequent, tokenizer, room, 0

    def __missing__(self, token: str) -> int:
        n = len(self.tokenizer.encode(token, add_special_tokens=False).ids)
        if len(token) <= LONGEST:
            if self.used + len(token) > self.room:
                self.clear()
                self.update(self.frequent)
                self.used = 0
            self[token] = n
            self.used += len(token) + 8  # so that the number of entries is bounded too
        return n


class Counter:
    """Counts tokens of whole texts as the library does, special strings included (one token each)."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normaliser is needed")
        special = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.lengths = Lengths(frequent or {}, self.tokenizer)

    def split(self, text: str) -> list[str]:
        if text.isascii() and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text) or not ODD.search(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get = self.lengths.__getitem__
        if self.special is None or not self.special.search(text):
            return sum(map(get, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(get, self.split(p))) for p in parts)


def frequent_lengths(docs: DataFrame, path: str, k: int = FREQUENT, sample: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> dict[str, int]:
    """The first tier: lengths of the most frequent pre-tokens of a bounded sample.

    ``sample`` documents are expected, drawn with the same chance by a hash of all their
    columns but the text (so copies of one text do not come together) and at most twice as many; of a
    long one an excerpt from a place drawn likewise. The sample only decides which pre-tokens are found at
    once, never a count.
    """
    from collections import Counter as Bag

    counter, bag = Counter(path), Bag()
    share = min(1.0, sample / max(1, docs.count()))
    names = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and f.dataType.typeName() not in ("map", "variant")]
    place = F.xxhash64(*names) if names else F.xxhash64("text")
    start = F.pmod(F.shiftright(place, 24), F.greatest(F.lit(1), F.length("text") - max_chars + 1)) + 1
    drawn = docs.where(F.pmod(place, F.lit(1 << 20)) < share * (1 << 20)).select(F.substring(F.col("text"), start.cast("int"), F.lit(max_chars)).alias("text"))
    for r in drawn.where("text is not null").limit(2 * sample).toLocalIterator():
        bag.update(counter.split(r.text))
    return {t: counter.lengths[t] for t, _ in sorted(bag.items(), key=lambda x: (-x[1], x[0]))[:k]}


def count_tokens(docs: DataFrame, path: str, frequent: dict[str, int] | None = None) -> DataFrame:
    """All columns of ``docs`` and ``n_bytes``, ``n_tokens``. A null text counts as empty: 0 and 0.

    Each row is counted whole and by itself: repeated rows count alike, and an empty table
    gives none. Extra columns stay; columns of the two names are replaced. ``path`` must be
    readable on every node, as installed vocabularies are.
    """
    rest = docs.drop("n_bytes", "n_tokens")
    kept = carried(rest, "text")
    sent = docs.sparkSession.sparkContext.broadcast(frequent if frequent is not None else frequent_lengths(docs, path))

    def make():
        counter = _counter(path, sent)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = texts(batch)
            n_bytes = [len(t) if t.isascii() else len(t.encode()) for t in (t or "" for t in raw)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_bytes, pa.int64()), pa.array([counter.count(t) for t in raw], pa.int64())], names=[*batch.schema.names, "n_bytes", "n_tokens"])

        return work

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_bytes long", "n_tokens long"])
    return arrow_map(kept, make, schema).select(*restore_columns(rest, "text"), "n_bytes", "n_tokens")


def _counter(path: str, sent) -> Counter:
    """One counter for all tasks of a worker, so its cache outlives a task."""
    return held(("tokens", path, id(sent.value)), lambda: Counter(path, sent.value))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
