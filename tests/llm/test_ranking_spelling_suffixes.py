"""Ranked search, spelling variants and repeated passages against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofworks.llm import ranking, spelling, suffixes

NAMES = ("term", "n", "tf", "part", "rank", "score", "word", "near", "id", "key", "k", "o", "name", "digest", "at", "tag", "raw", "open", "places", "row_", "spans", "kept", "several", "doc_id_")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extra(df):
    """With extra columns of the names the operators use themselves."""
    return df.select("*", *[F.lit("x").alias(c) for c in NAMES if c not in df.columns])


# ranked search


def brute_search(docs, items, k, multiplicity):
    tfs = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs if d is not None]
    tfs = [(d, c) for d, c in tfs if c]
    n, total = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        own = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for d, c in tfs:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum((q if multiplicity else 1) * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in own.items() if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("multiplicity", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, multiplicity):
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 7)  # several blocks a task
    r = random.Random(5)
    words = ["Apple", "apple", "ÄPFEL", "äpfel", "x1", "the", "of", "zz_y", "日本", "run-time"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 12)))) for i in range(80)] + [(80, None), (81, ""), (None, "apple"), (82, "apple"), (83, "apple"), (84, "apple " * 300_000), (5000, "!!!")]
    items = [(1, "apple the the"), (2, "ÄPFEL äpfel"), (3, None), (4, "!!"), (5, "nowhere"), (6, "日本 of x1 x1 zz y"), (None, "apple")]
    d, i = extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)), extra(spark.createDataFrame(items, "item_id long, text string"))
    want = brute_search(docs, [x for x in items if x[0] is not None], 6, multiplicity)
    for entries in (1 << 20, 4):  # one block of items, and several
        got = ranking.search(d, i, 6, multiplicity, entries)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect())) == want


def test_search_of_nothing(spark):
    d, i = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a")], "doc_id long, text string"), spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a")], "item_id string, text string")
    assert ranking.search(d.limit(0), i).count() == 0 and ranking.search(d, i.limit(0)).count() == 0
    got = [(r.item_id, r["rank"], r.doc_id) for r in ranking.search(d, i).orderBy("item_id", "rank").collect()]
    assert got[:2] == [("q", 1, 1), ("q", 2, 1)]  # repeated rows rank one behind the other, items of one id are one
    with pytest.raises(ValueError):
        ranking.search(d, spark.createDataFrame([(1, "a b c d e f g h i"), (2, "z")], "item_id long, text string"), entries=2)


# spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, shortest, least, noise):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            if noise:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                if h % noise == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    words = {w: c for w, c in n.items() if c >= least}
    form, links = {}, defaultdict(list)
    for w in words:
        links[w] = [v for v in words if near(w, v)]
        best = min(links[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(links[w]), words.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("noise", [None, 7])
def test_variants_equal_brute_force(spark, noise):
    r = random.Random(3)
    letters, docs = "abcdeéÿ", []
    for i in range(120):
        docs.append((i, " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 6))) for _ in range(r.randrange(1, 60)))))
    docs += [(200, None), (201, ""), (202, "Word wORD words. swords! wort " * 9), (None, "words " * 5), (203, "words"), (203, "words"), (204, "aabbb aabb aabbbb abbb " * 4), (205, "anagram nagaram margana " * 3), (206, "z" * 70_000 + " " + "z" * 69_999 + " "), (207, "×÷àß " * 4)]
    docs += [(210 + i, "z" * 70_000 + " ") for i in range(3)] + [(220 + i, "z" * 69_999) for i in range(2)]
    df = extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    got = spelling.variants(df, 3, 2, noise=noise)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = sorted(map(tuple, got.collect()), key=lambda x: x[0])
    assert rows == sorted(brute_variants(docs, 3, 2, noise), key=lambda x: x[0]) and any(x[1] and x[1] != x[2] for x in rows)
    assert spelling.variants(df.limit(0)).count() == 0


def test_keys_ignore_order_and_digests_do_not():
    a, b = spelling.keys("listen"), spelling.keys("silent")
    assert a[0] == b[0] and a[1] != b[1] and len(a[2]) == 6
    whole, order, _ = spelling.keys("words")
    less = {(k, o) for k, o, _, lead in spelling.keys("swords")[2] if lead}
    assert (whole, order) in less  # one letter removed
    assert [lead for *_, at, lead in sorted(spelling.keys("aabb")[2], key=lambda x: x[2])] == [True, False, True, False]


# repeated passages


def brute_spans(docs, width):
    seen, out = {}, {}
    for d, t in sorted((d, t) for d, t in docs if d is not None):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            s = raw[p : p + width]
            if seen.setdefault(s, (d, p)) != (d, p):
                gone[p : p + width] = b"\1" * width
        out[d] = ([list(m.span()) for m in re.finditer(b"\1+", bytes(gone))], bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("width", "chunk"), [(20, 64), (7, 1 << 16), (100, 1 << 16)])
def test_spans_equal_brute_force(spark, monkeypatch, width, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    r = random.Random(width)
    vocabulary = ["alpha", "beta", "gamma", "dé", "日本", "x"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages = [text(r.randrange(5, 60)) for _ in range(6)]
    docs = [(i, text(r.randrange(0, 30)) + "".join(r.choice(passages) + text(r.randrange(0, 4)) for _ in range(r.randrange(0, 4)))) for i in range(70)]
    docs += [(100, None), (101, ""), (102, "short"), (103, "a" * 500), (104, "b" + "a" * 150), (105, "ab" * 200), (106, docs[3][1]), (107, docs[3][1]), (108, "ab" * 30 + "c" + "ab" * 80), (109, "q" * width), (110, "q" * width), (111, "q" * (width - 1))]
    df = extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = suffixes.dedup(df, width)
    assert got.columns[: len([c for c in df.columns if c not in ("spans", "kept")])] == [c for c in df.columns if c not in ("spans", "kept")]
    rows = got.collect()
    want = brute_spans(docs, width)
    assert len(rows) == len(docs)
    for x in rows:
        assert (x.spans, bytes(x.kept)) == want[x.doc_id] and x.n_bytes == len((dict(docs)[x.doc_id] or "").encode()), x.doc_id
        assert x.places == "x" and x.row_ == "x" and x.tag == "x"


def test_hot_passages_over_many_tasks(spark):
    """A passage that a third of the documents hold, in unlike surroundings, over many ranges of the sorts."""
    r = random.Random(2)
    hot = "".join(r.choice("abcdefgh ") for _ in range(230))
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(30, 90)))
    docs = [(i, word() + (hot if i % 3 == 0 else word()) + word()) for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = suffixes.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_spans(docs, 100)
    assert {x.doc_id: x.spans for x in rows} == {d: s for d, (s, _) in want.items()} and sum(bool(x.spans) for x in rows) == 199


def test_repeated_rows_and_no_ids(spark):
    t = "the same text in every row, longer than a hundred bytes, which is what the operator asks of a passage at the very least"
    docs = spark.createDataFrame([(1, t), (1, t), (2, t), (2, "y" + t), (None, t), (None, t)], "doc_id long, text string")
    rows = suffixes.dedup(docs).collect()
    assert len(rows) == 6 and all(not x.spans for x in rows if x.doc_id in (1, None)) and all(x.spans for x in rows if x.doc_id == 2)
    assert suffixes.dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.dedup(docs, 3)


def test_names_tell_strings_apart():
    data = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    for length in (1, 2, 3, 5, 6, 7, 11):
        got = suffixes.names(data, length)
        raw = data.tobytes()
        own = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        assert len(got) == len(own) and all((got[i] == got[j]) == (own[i] == own[j]) for i in range(len(own)) for j in range(len(own)))


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    rows = suffixes.op13_suffix_dedup(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_spans(docs, 100)
    assert {(x.doc_id, x.n_removed, x.n_spans, x.kept_sha256) for x in rows} == {(d, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for d, (s, k) in want.items()}
