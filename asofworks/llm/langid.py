"""Language identification by prediction by partial matching (PPM).

One variable-order byte context tree per language is frozen after training. A
text's code length under a tree is the exact number of bits PPM would need: the
longest known context predicts, an escape (method C) passes what it has not seen
to the next shorter context, with the symbols already offered excluded. The
language with the shortest code wins.

Because statistics are frozen, the code of a byte depends on the three bytes
before it only, so the trees compile to one table of bits by (context, byte,
language), and a batch of whole texts is scored with array look-ups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, restore_columns, restored, texts

ORDER = 3
#: Bounds of the training sample: documents a language (expected; twice that at most) and characters of one of them (a longer one gives an excerpt from a place drawn by its id).
TRAIN_DOCS, TRAIN_CHARS = 300, 60_000
#: A context is kept if some language has it this often.
MIN_CONTEXT = 2
#: Bytes of the table of code lengths, which is broadcast: with many languages the rarest of the longest contexts are pruned, and shorter ones predict in their place.
TABLE_BYTES = 96 << 20
#: Distinct ``lang`` values a model may have; a column with more holds no languages.
MAX_LANGS = 256
#: A text is in no learned language if its best code needs more bits a byte than MAX_BITS and more than MAX_EXCESS bits over that rate in all, so a few odd characters reject nothing.
MAX_BITS, MAX_EXCESS = 7.0, 24.0


class PpmModel:
    """Frozen trees of all languages as look-up tables.

    ``cls`` maps a byte to a class (0: never seen in training), ``state`` maps three
    classes to the longest known context, ``bits[l]`` holds code lengths by context and class.
    """

    def __init__(self, langs: list[str], cls: np.ndarray, state: np.ndarray, bits: np.ndarray):
        self.langs, self.cls, self.state, self.bits = langs, cls, state, bits

    @classmethod
    def train(cls, samples: dict[str, list[bytes]], min_context: int = MIN_CONTEXT, table_bytes: int = TABLE_BYTES) -> PpmModel:
        """Count contexts of up to three bytes in each language's texts and freeze them; a language without any text is not learned."""
        langs = sorted(lang for lang, parts in samples.items() if any(parts))  # a language without text has no tree
        samples = {lang: samples[lang] for lang in langs}
        seen = sorted({b for x in samples.values() for t in x for b in set(t)})
        a = len(seen) + 1
        classes = np.zeros(256, np.int32)
        classes[seen] = np.arange(1, a)
        #: counts[l][k]: (code of context and symbol, count); a context's code is base-a with 0 for "before the text".
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in langs:
            parts = [classes[np.frombuffer(t, np.uint8)] for t in samples[lang] if t]
            per = []
            for k in range(ORDER + 1):
                codes = []
                for x in parts:
                    padded = np.concatenate([np.zeros(k, np.int64), x.astype(np.int64)])
                    code = np.zeros(len(x), np.int64)
                    for i in range(k + 1):
                        code = code * a + padded[i : i + len(x)]
                    codes.append(code)
                code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
                value, n = np.unique(code, return_counts=True)
                if k:  # contexts that reach before the text are not contexts of this length
                    inside = (value // a) % a ** k >= a ** (k - 1)
                    value, n = value[inside], n[inside]
                per.append((value, n))
            counts.append(per)
        #: The union of all languages' contexts, by length, so that one state serves every language.
        keys = [np.zeros(1, np.int64)]
        room = table_bytes // (4 * a * max(1, len(langs))) - 1
        for k in range(1, ORDER + 1):
            found, often = [], []
            for per in counts:
                value, n = per[k]
                ctx, at = np.unique(value // a, return_inverse=True)
                times = np.bincount(at, n, len(ctx)) if len(ctx) else np.zeros(0)
                found.append(ctx[times >= min_context])
                often.append(times[times >= min_context])
            ctx, at = np.unique(np.concatenate(found), return_inverse=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(ctx) > room:  # the most frequent ones, ties by code
                times = np.bincount(at, np.concatenate(often), len(ctx))
                ctx = np.sort(ctx[np.lexsort((ctx, -times))[: max(0, room)]])
            room -= len(ctx)
            keys.append(ctx)
        first = np.cumsum([0, *[len(x) for x in keys]])
        bits = np.empty((len(langs), int(first[-1]), a), np.float32)
        for li, per in enumerate(counts):
            prob = np.full((int(first[-1]), a), 0.0)
            uniform = np.full(a, 1 / 256)
            weight = np.ones(a)
            weight[0] = 257 - a  # class 0 stands for every byte that training lacks
            for k, ctx in enumerate(keys):
                lower = uniform[None, :].repeat(len(ctx), 0) if k == 0 else prob[cls._parents(ctx, k, a, keys, first)]
                c = np.zeros((len(ctx), a))
                value, n = per[k]
                at = np.searchsorted(ctx, value // a)
                at[at == len(ctx)] = 0
                hit = ctx[at] == value // a if len(ctx) else np.zeros(0, bool)
                c[at[hit], value[hit] % a] = n[hit]
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                rest = np.where(c > 0, 0.0, lower)
                room = (rest * weight).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    mixed = np.where(c > 0, c / (total + kinds), kinds / (total + kinds) * rest / room)
                prob[first[k] : first[k + 1]] = np.where(total > 0, mixed, lower)
            bits[li] = -np.log2(np.maximum(prob, 1e-12))
        state = np.zeros(a**ORDER, np.int32)
        for k in range(1, ORDER + 1):  # longer contexts overwrite shorter ones
            tail = a**k
            for ctx, row in zip(keys[k].tolist(), range(int(first[k]), int(first[k + 1])), strict=True):
                state[ctx::tail] = row
        return cls(langs, classes, state, bits)

    @staticmethod
    def _parents(ctx: np.ndarray, k: int, a: int, keys: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """The row of the longest known proper suffix of each context of length k."""
        row = np.zeros(len(ctx), np.int64)
        for j in range(1, k):
            tail = ctx % a**j
            at = np.searchsorted(keys[j], tail)
            at[at == len(keys[j])] = 0
            hit = keys[j][at] == tail if len(keys[j]) else np.zeros(len(ctx), bool)
            row[hit] = first[j] + at[hit]
        return row

    def code_lengths(self, batch: list[bytes]) -> np.ndarray:
        """Bits of each text under each language, shape (texts, languages)."""
        out = np.zeros((len(batch), len(self.langs)))
        a = self.bits.shape[2]
        full = [i for i, t in enumerate(batch) if t]
        # texts are joined in runs of a few megabytes, each text behind its own empty past
        start = 0
        while start < len(full):
            end, size = start, 0
            while end < len(full) and (size < 1 << 20 or end == start):
                size += len(batch[full[end]])
                end += 1
            rows = full[start:end]
            lens = np.array([len(batch[i]) for i in rows])
            joined = self.cls[np.frombuffer((b"\0" * ORDER).join(batch[i] for i in rows), np.uint8)]
            begins = np.concatenate([[0], np.cumsum(lens + ORDER)[:-1]])
            x = np.concatenate([np.zeros(ORDER, np.int32), joined])
            for j in range(ORDER):  # the separators are no bytes of any text
                x[begins + j] = 0
            n = len(joined)
            past = (x[:n] * a + x[1 : n + 1]) * a + x[2 : n + 2]
            cell = self.state[past] * np.int32(a) + x[ORDER:]
            ends = np.stack([begins, begins + lens], 1).ravel()
            for li in range(len(self.langs)):
                cost = np.append(self.bits[li].ravel()[cell], np.float32(0))
                out[rows, li] = np.add.reduceat(cost, ends, dtype=np.float64)[::2]
            start = end
        return out


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows a model may learn from: crc32 of doc_id as text not divisible by 5, lang and text not null."""
    return docs.select("doc_id", "text", "lang").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0 and lang is not null and text is not null")


def fit(docs: DataFrame, per_lang: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> PpmModel:
    """Fit on a bounded sample: documents of each language drawn by a hash of doc_id, at most ``2 * per_lang`` a language, and of a document longer than ``max_chars`` an excerpt of that length from a place drawn by its id."""
    rows = training_rows(docs)
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(counted) > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")
    n = {r.lang: r.n for r in counted}
    if not n:
        return PpmModel.train({})
    share = F.create_map(*[x for lang, k in n.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / k)))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - max_chars + 1)) + 1
    drawn = rows.where(place < share[F.col("lang")] * (1 << 20)).select("doc_id", "lang", F.substring(F.col("text"), start.cast("int"), F.lit(max_chars)).alias("text"))
    got = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_lang * len(n)).collect()
    return PpmModel.train({lang: [r.text.encode() for r in got if r.lang == lang] for lang in n})


def _predict(docs: DataFrame, model: PpmModel) -> DataFrame:
    """The columns of ``docs``, none of them named ``lang_pred``, ``score``, ``bits`` or ``excess``, and these four."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.cls, model.state, model.bits))

    def make():
        m = PpmModel(*shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = texts(batch)
            use = [bool(m.langs) and t is not None and (t.isalpha() or any(map(str.isalpha, t))) for t in raw]
            data = [t.encode() if u else b"" for t, u in zip(raw, use, strict=True)]
            lang, score, bits, excess = ["und"] * len(raw), [0.0] * len(raw), [None] * len(raw), [None] * len(raw)
            if m.langs:
                cost = m.code_lengths(data)
                best = cost.argmin(1)
                low = cost.min(1)
                post = 1 / np.exp2(np.maximum(low[:, None] - cost, -1000)).sum(1)
                for i, u in enumerate(use):
                    if u:
                        lang[i], score[i], bits[i], excess[i] = m.langs[best[i]], float(post[i]), float(low[i] / len(data[i])), float(low[i] - MAX_BITS * len(data[i]))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(excess, pa.float64())], names=[*batch.schema.names, "lang_pred", "score", "bits", "excess"])

        return work

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double", "bits double", "excess double"])
    return arrow_map(docs, make, schema)


def predict(docs: DataFrame, model: PpmModel) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` (posterior of the code lengths, 0 to 1), ``bits`` (a byte, of the best code).

    A text that is null or has no letter is ``und`` with score 0 and null bits; so is
    every text if no language was learned. Equal codes: the first language by name.
    Every row is scored by itself, so repeated rows score alike, and an empty table gives none.
    Extra columns stay as they are; columns of the three names are replaced.
    """
    rest = docs.drop("lang_pred", "score", "bits")
    out = _predict(carried(rest, "text"), model)
    return out.select(*restore_columns(rest, "text"), "lang_pred", "score", "bits")


def identified(docs: DataFrame, model: PpmModel | None = None) -> DataFrame:
    """The documents whose language is identified, with their own columns only, whatever these are named.

    ``und`` (null, empty or no letter) goes, and so does a text that no learned language
    codes: more than ``MAX_BITS`` bits a byte and ``MAX_EXCESS`` bits over that rate in all.
    """
    known = _predict(carried(docs, "text"), model or fit(docs)).where(f"lang_pred <> 'und' and not (excess > {MAX_EXCESS})")
    return restored(known, docs, "text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.select("doc_id", "text")
    return predict(named, fit(docs)).select("doc_id", F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)").alias("held_out"), "lang_pred", "score", "bits")
