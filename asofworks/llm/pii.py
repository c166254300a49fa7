"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (their shape, digit count, checksum, context),
and dynamic programming over a bounded number of tokens an entity chooses boundaries and
types jointly. A token outside all segments scores 0, so text without a trigger
(a digit, an at sign or a spelled-out one) cannot change the best labelling; decoding
runs in the regions around triggers alone and is exact for the whole text.

Training maximises the conditional likelihood of labelled regions made by rule from a
fixed seed: valid forms, spelled-out forms, and near misses as negatives.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, carried, restore_columns, texts

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest segment, and scored spans that a worker keeps.
MAX_TOKENS, KNOWN = 40, 50_000

# The base patterns, fixed by the contract.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The same matches without a second look at a run of digits: a match can only start where its run of digits starts.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]+")

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
#: What a segment holds at least: digits, an at sign, or "at" or "dot" in brackets or between spaces (ASCII letters of either case).
TRIGGER = re.compile(r"[0-9]+|@|[\[(][aA][tT][\])]|[\[(][dD][oO][tT][\])]|(?<=\s)[aA][tT](?=\s)|(?<=\s)[dD][oO][tT](?=\s)")
BREAK = re.compile(r"[ \n]")
OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]+)+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from the at signs: no word is scanned in vain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base matches by start, then kind."""
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 if len(x) < 9 else not x.strip("0") or int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = NOT_DIGIT.sub("", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _side(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def features(text: str, a: int, b: int) -> list[str]:
    """Whole-span features of text[a:b], the same for every kind."""
    x = text[a:b]
    digits = NOT_DIGIT.sub("", x)
    shape = re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 20)}", re.sub(r"[A-Za-z]+", "a", x))
    out = ["bias", "shape " + shape[:40], "form " + re.sub(r"d[0-9]+", "d", shape)[:40], f"digits {min(len(digits), 20)}", "left " + _side(text[a - 1 : a] if a else ""), "right " + _side(text[b : b + 1])]
    n = len(digits)
    if 12 <= n <= 19:
        out.append("luhn" if luhn(digits) else "no luhn")
    if "@" in x:
        out.append("address" if DOMAIN.fullmatch(x.partition("@")[2]) and x[0] != "@" else "at")
    elif OBFUSCATED.fullmatch(x):
        out.append("spelled address")
        out.append("bracketed" if re.search(r"[\[(]at", x, re.I) else "bare at")
        out.append("digit or dot" if re.search(r"[0-9]|\bdot\b", x, re.I) else "plain")
    elif any(c.isalpha() for c in x):
        out.append("letters")
    parts = x.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 for p in parts):
        out.append("quad" if all(int(p) < 256 for p in parts) else "wide quad")
    if x[0] in "+(":
        out.append("opens " + x[0])
    if 9 <= n <= 15:
        out.append("phone length")
    if re.fullmatch(r"\+?[0-9]{0,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}", x):
        out.append("grouped number")
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that hold every possible segment: words with triggers (a digit, an at sign, a spelled-out at or dot) and what joins them."""
    found = [(m.start(), m.end(), m.group() if m.group().isdigit() or m.group() == "@" else "") for m in TRIGGER.finditer(text)]
    breaks = [m.start() for m in BREAK.finditer(text)] if found else []
    out: list[list[int]] = []
    for first, end, plain in found:
        if plain and out and end <= out[-1][1]:
            continue
        a, b = first, end - 1
        for _ in range(1 if plain else 3):  # a spelled address reaches over spaces
            before, after = bisect_left(breaks, max(a - 1, 0)) - 1, bisect_left(breaks, b + 1)
            a = breaks[before] + 1 if before >= 0 else 0
            b = breaks[after] if after < len(breaks) else len(text)
        a = min(a, first)
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def segments(text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Token boundaries of a region and its candidate segments (as token numbers)."""
    cuts = [a]
    for m in TOKEN.finditer(text, a, b):
        cuts.append(m.end())
    firsts, lasts = [], []
    for i in range(len(cuts) - 1):
        c = text[cuts[i]]
        if (c.isalnum() or c in "+(._%-" and cuts[i] + 1 < b and text[cuts[i] + 1].isalnum()) and not (cuts[i] and text[cuts[i] - 1].isalnum()):
            firsts.append(i)
        c = text[cuts[i + 1] - 1]
        if c.isalnum() and not (cuts[i + 1] < len(text) and text[cuts[i + 1]].isalnum()):
            lasts.append(i + 1)
    digits = np.cumsum([0, *[sum(ch.isdigit() for ch in text[cuts[i] : cuts[i + 1]]) for i in range(len(cuts) - 1)]])
    marks = np.cumsum([0, *[text[cuts[i] : cuts[i + 1]].lower() in ("@", "at") for i in range(len(cuts) - 1)]])
    found, start = [], 0
    for i in firsts:
        while start < len(lasts) and lasts[start] <= i:
            start += 1
        for at in range(start, len(lasts)):
            j = lasts[at]
            if j - i > MAX_TOKENS:
                break
            if 4 <= digits[j] - digits[i] <= 20 or marks[j] - marks[i] == 1:
                found.append((i, j))
    return cuts, found


class SemiCrf:
    """Weights of (feature, kind); decoding and training on candidate lattices."""

    def __init__(self, weights: dict[str, tuple[float, ...]] | None = None):
        self.weights = weights or {}
        #: Best kind and score by span and neighbours; cleared when full, so repeated passages cost one look-up a segment.
        self.known: dict[tuple[str, str, str], tuple[int, float]] = {}

    def best(self, text: str, a: int, b: int) -> tuple[int, float]:
        """The best kind of text[a:b] and its score, which depend on the span and the characters beside it only."""
        key = (text[a - 1 : a] if a else "", text[a:b], text[b : b + 1])
        if (got := self.known.get(key)) is None:
            s = self.scores(features(text, a, b))
            k = max(range(len(KINDS)), key=s.__getitem__)
            got = k, s[k]
            if len(self.known) >= KNOWN:
                self.known.clear()
            if b - a <= 80:
                self.known[key] = got
        return got

    def scores(self, names: list[str]) -> list[float]:
        total = [0.0] * len(KINDS)
        for n in names:
            if (w := self.weights.get(n)) is not None:
                total = [t + x for t, x in zip(total, w, strict=True)]
        return total

    def decode(self, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
        """The best labelling of one region."""
        cuts, found = segments(text, a, b)
        if not found:
            return []
        ending: dict[int, list[tuple[int, float, int]]] = {}
        for i, j in found:
            k, s = self.best(text, cuts[i], cuts[j])
            if s > 0:
                ending.setdefault(j, []).append((i, s, k))
        best, back = [0.0] * len(cuts), [None] * len(cuts)
        for j in range(1, len(cuts)):
            best[j] = best[j - 1]
            for i, s, k in ending.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k)
        out, j = [], len(cuts) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((KINDS[k], cuts[i], cuts[j]))
                j = i
        return out[::-1]

    @classmethod
    def fit(cls, labelled: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> SemiCrf:
        """Stochastic gradient ascent on the conditional likelihood, by forward and backward sums over each lattice."""
        index: dict[str, int] = {}
        items = []
        for text, truth in labelled:
            for a, b in regions(text):
                cuts, found = segments(text, a, b)
                if not found:
                    continue
                feats = [[index.setdefault(f, len(index)) for f in features(text, cuts[i], cuts[j])] for i, j in found]
                spot = {c: n for n, c in enumerate(cuts)}
                gold = {(spot[x], spot[y]): KINDS.index(k) for k, x, y in truth if x in spot and y in spot}
                items.append((len(cuts), found, feats, gold))
        w = np.zeros((len(index), len(KINDS)))
        order = random.Random(7)
        for epoch in range(epochs):
            order.shuffle(items)
            step = rate / (1 + epoch)
            for n, found, feats, gold in items:
                score = np.array([w[f].sum(0) for f in feats])
                ahead, behind = np.full(n, -np.inf), np.full(n, -np.inf)
                ahead[0] = behind[n - 1] = 0.0
                total = np.logaddexp.reduce(score, axis=1)
                into: dict[int, list[int]] = {}
                outof: dict[int, list[int]] = {}
                for s, (i, j) in enumerate(found):
                    into.setdefault(j, []).append(s)
                    outof.setdefault(i, []).append(s)
                for j in range(1, n):
                    ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[found[s][0]] + total[s] for s in into.get(j, ()))])
                for i in range(n - 2, -1, -1):
                    behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[found[s][1]] + total[s] for s in outof.get(i, ()))])
                for s, (i, j) in enumerate(found):
                    grad = -np.exp(np.minimum(0, ahead[i] + behind[j] + score[s] - ahead[n - 1]))
                    if (i, j) in gold:
                        grad[gold[i, j]] += 1
                    if np.abs(grad).max() > 1e-4:
                        w[feats[s]] += step * (grad - decay * w[feats[s]])
        return cls({f: tuple(w[i].round(6).tolist()) for f, i in index.items() if np.abs(w[i]).max() > 1e-6})


def labelled_regions(n: int = 260, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Training texts made by rule: one entity or near miss in a few words."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))

    def card() -> str:
        d = r.choice("3456") + digit(r.choice((13, 14, 14)))
        return d + next(c for c in "0123456789" if luhn(d + c))

    def address(at: str, dot: str) -> str:
        return r.choice((word(), word() + digit(2), digit(2), f"{word()}.{word()}")) + at + dot.join((*r.choice(((), (word() + digit(1),))), word(), r.choice(("com", "org", "net", "de"))))

    def phone() -> str:
        return r.choice((f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"1-{digit(3)}-{digit(3)}-{digit(4)}", f"+{digit(1)} ({digit(3)}) {digit(3)}-{digit(4)}", f"+{digit(2)} {digit(3)} {digit(7)}", f"+{digit(11)}"))

    quad = lambda top: ".".join(str(r.randint(0, top)) for _ in range(4))
    makers = [
        ("email", lambda: address("@", ".")), ("email", lambda: address(*r.choice((("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" at ", " dot "))))), ("ip", lambda: quad(255)), ("card", card),
        ("card", lambda: "-".join(re.findall("....", card().ljust(16, "0")[:16]))), ("phone", phone), ("phone", phone),
        (None, lambda: digit(r.randint(4, 11))), (None, lambda: digit(r.randint(12, 20))), (None, lambda: f"{digit(1)}.{digit(1)}.{digit(2)}"), (None, lambda: ".".join(str(r.randint(256, 999)) for _ in range(4))),
        (None, lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))), (None, lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"), (None, lambda: f"{digit(2)}.{digit(2)}.{r.randint(1900, 2030)}"),
        (None, lambda: f"{word()} at {word()}.{digit(4)}"), (None, lambda: f"{digit(4)} {digit(4)}"), (None, lambda: f"{digit(3)},{digit(3)},{digit(3)}.{digit(2)}"), (None, lambda: f"{word()}@{digit(4)}"), (None, lambda: f"{digit(4)}-{digit(4)}"), (None, lambda: f"{digit(2)}:{digit(2)}:{digit(2)}"),
    ]
    out = []
    for i in range(n):
        kind, make = makers[i % len(makers)]
        x, left = make(), word() + r.choice((" ", " ", "\n", ": ", " \""))
        if kind == "card" and not luhn(NOT_DIGIT.sub("", x)):
            kind = None
        text = left + x + r.choice((" ", ". ", ", ", "\n", "!! ", "### ")) + word()
        out.append((text, [(kind, len(left), len(left) + len(x))] if kind else []))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiCrf:
    return SemiCrf.fit(labelled_regions())


def all_spans(text: str, field: SemiCrf, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Base spans and the field's spans that overlap none of them, by start, then kind."""
    base = base_spans(text) if base is None else base
    found = list(base)
    reach, at = -1, 0  # the furthest end of base spans that start before the field's span
    for a, b in regions(text):  # regions and their spans come in order, so one pass over the base spans is enough
        for kind, x, y in field.decode(text, a, b):
            while at < len(base) and base[at][1] < y:
                reach = max(reach, base[at][2])
                at += 1
            if reach <= x:
                found.append((kind, x, y))
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: SemiCrf | None = None) -> DataFrame:
    """All columns of ``docs`` and counts of base spans by kind, ``base_sha256`` and ``spans``.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null
    text is empty: no spans. Each row is scanned whole and by itself, so repeated rows get the
    same spans and an empty table none. Extra columns stay; columns of these names are replaced.
    """
    names = [f"n_{k}" for k in KINDS]
    rest = docs.drop(*names, "base_sha256", "spans")
    kept = carried(rest, "text")
    sent = docs.sparkSession.sparkContext.broadcast((field or trained()).weights)

    def make():
        crf = SemiCrf(sent.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: list[list[int]] = [[] for _ in KINDS]
            sha, spans = [], []
            for t in texts(batch):
                base = base_spans(t) if t else []
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(sum(x[0] == k for x in base))
                sha.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(all_spans(t, crf, base)) if t else "")
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(spans)], names=[*batch.schema.names, *names, "base_sha256", "spans"])

        return work

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{n} long" for n in names] + ["base_sha256 string", "spans string"])
    return arrow_map(kept, make, schema).select(*restore_columns(rest, "text"), *names, "base_sha256", "spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")
