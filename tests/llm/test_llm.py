"""The corpus operators on small tables: edge cases, brute force, round trips, held-out accuracy."""

import os
import random
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from asofworks.llm import components, decontam, entries, langid, licence_texts, licenses, linededup, minhash, pieces, pii, pivots, tokencount, warc
from asofworks.llm.cuckoo import CuckooFilter

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "the long line of words that goes on " * 3000
ROWS = [
    (0, "Shared line of text\nfirst", "en", "s"), (1, "shared LINE of text \nsecond\nsecond", "en", "s"), (2, None, None, None), (3, "", "fr", "s"), (4, LONG, "en", "s"), (5, LONG, "en", "s"),
    (5, LONG, "en", "s"), (None, "Shared line of text", "de", "s"), (6, "12 34 !!", "en", None), (7, "mail bob.x@mail.example.com now, 10.0.0.255 +1 (499) 555-6503 or 4111 1111 1111 1111", "en", "s"),
    (8, "Released under the MIT License.", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("key", "id", "n_lines", "score", "bands", "hits", "n_tokens", "spans", "n_pieces"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_language(spark, docs, none):
    sf = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op3_language_id(spark, SF).join(sf.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    model = langid.PpmModel.train({"a": [b"abababab" * 20], "b": [b"cdcdcdcd" * 20]})
    cost = model.code_lengths([b"abab", b"cdcd", b"", b"zz"])
    assert cost[0].argmin() == 0 and cost[1].argmin() == 1 and cost[2].sum() == 0
    out = langid.predict(docs, model).collect()
    assert {r.lang_pred for r in out if r.doc_id in (2, 3, 6)} == {"und"} and len(out) == len(ROWS)
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


def test_code_lengths_are_those_of_a_tree_walk():
    """Brute force: walk the tree for every byte."""
    train = {"x": [b"the cat sat on the mat. the cat.", b"cat"], "y": [b"le chat est sur le tapis"]}
    m = langid.PpmModel.train(train, 1)
    ctx = {}
    for lang, parts in train.items():
        for t in parts:
            for i in range(len(t)):
                for k in range(min(i, 3) + 1):
                    ctx.setdefault((lang, t[i - k : i]), {}).setdefault(t[i], 0)
                    ctx[lang, t[i - k : i]][t[i]] += 1

    @lru_cache(maxsize=None)
    def prob(lang, past, sym):
        while (lang, past) not in ctx:
            if not past:
                return 1 / 256
            past = past[1:]
        c = ctx[lang, past]
        n, d = sum(c.values()), len(c)
        if sym in c:
            return c[sym] / (n + d)
        lower = (lambda s: prob(lang, past[1:], s)) if past else (lambda s: 1 / 256)
        return d / (n + d) * lower(sym) / sum(lower(s) for s in range(256) if s not in c)

    for text in (b"the chat sat", b"zz the", b"c"):
        for li, lang in enumerate(m.langs):
            want = -sum(np.log2(prob(lang, text[max(0, i - 3) : i], text[i])) for i in range(len(text)))
            assert abs(m.code_lengths([text])[0, li] - want) < 1e-3


def test_line_dedup(spark, docs, none):
    got = by_id(linededup.dedup(docs.drop("n_lines")))
    assert (got[0].n_dropped, got[1].n_dropped, got[1].text, got[2].text, got[2].n_lines) == (0, 1, "second\nsecond", "", 1)
    assert got[4].n_dropped == 0 and got[5].text == "" and got[None].n_dropped == 0
    assert linededup.dedup(none).count() == 0
    base = linededup.LineIndex.of(docs.where("doc_id < 2"))
    first = sorted(map(tuple, base.current_counts().collect()))
    more = base.insert(docs.where("doc_id in (4, 5)"))
    assert more.losses().count() == 2
    assert sorted(map(tuple, more.delete(docs.where("doc_id >= 4")).current_counts().collect())) == first


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=400))
def test_cuckoo(keys):
    f = CuckooFilter(max(1, len(keys)))
    k = np.array(keys, np.int64)
    f.insert(k)
    assert f.contains(k).all()
    half = len(keys) // 2
    f.delete(k[:half])
    assert f.contains(k[half:]).all()


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "second"), (2, "Words that goes ON the long line of words that"), (3, None), (4, ""), (5, "absent item")], "item_id long, text string")
    got = by_id(decontam.scan(docs.drop("hits", "spans"), items))
    assert got[1].items == ["1"] and got[1].hits == [[4, 6]] and got[4].items == ["2"] and got[2].n_words == 0
    (a, b), = got[1].spans
    assert ROWS[1][1][a:b] == "second\nsecond"
    assert decontam.scan(none, items).count() == 0 and decontam.scan(docs, items.limit(0)).where("size(hits) > 0").count() == 0


def test_pieces(spark, docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in pieces.encode(docs, PIECES).collect():
        assert r.piece_ids == (lib.encode(r.text) if r.text else []) and r.round_trip
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    assert all(r.decoded == (r.text or "") for r in back.collect()) and pieces.encode(none, PIECES).count() == 0
    t = pieces.transducer(open(PIECES, "rb").read())
    r = random.Random(2)
    for _ in range(1500):
        x = "".join(r.choice("  ▁ abtheñé①😀\n\t12") for _ in range(r.randint(0, 40)))
        assert list(memoryview(t.encode(x)).cast("i")) == lib.encode(x)


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    for r in tokencount.count_tokens(docs.drop("n_tokens"), BPE).collect():
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())
    assert tokencount.count_tokens(none, BPE).count() == 0
    c, r = tokencount.Counter(BPE), random.Random(3)
    for _ in range(1500):
        x = "".join(r.choice([" ", "'s", "d", "é", "12", "\xa0", "日", "²", "\x1c", "\n", "<|endoftext|>", "!?"]) for _ in range(r.randint(0, 30)))
        assert c.count(x) == len(lib.encode(x, add_special_tokens=False).ids)


def test_pii(spark, docs, none):
    got = by_id(pii.find(docs.drop("spans")))
    assert [got[7][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1] and got[2].spans == "" and pii.find(none).count() == 0
    email, r = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), random.Random(5)
    for _ in range(4000):
        x = "".join(r.choice("ab1.@-_ %+c") for _ in range(r.randint(0, 50)))
        assert [m.span() for m in email.finditer(x)] == pii.emails(x)
    field, wrong = pii.trained(), 0
    held = pii.labelled_regions(300, 99)
    for t, gold in held:
        wrong += [s for a, b in pii.regions(t) for s in field.decode(t, a, b)] != gold
    assert wrong / len(held) < 0.1
    twice = "4465758382889437 4465758382889437"
    assert pii.base_spans(twice) == [] and [k for k, _, _ in pii.all_spans(twice, field)] == ["card", "card"]


def brute_components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame([*links, (None, 3)], "u long, v long")).collect()}
    want = brute_components(341, links)
    assert all(got[x] == want[x] for x in got) and {a for p in links for a in p if p[0] != p[1]} <= set(got)


def test_minhash(spark, docs, none):
    got = by_id(minhash.near_duplicates(docs))
    assert got[5].component_id == 4 and not got[5].kept and got[2].kept and got[2].n_shingles == 0 and got[None].component_id is None and got[None].kept
    assert minhash.near_duplicates(none).count() == 0
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(90):
        w = list(base) if i % 3 else [f"v{r.randrange(900)}" for _ in range(60)]
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"e{r.randrange(40)}"
        texts.append(" ".join(w))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    links = [(i, j) for i in range(90) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(links) > 20
    assert {k: v.component_id for k, v in by_id(minhash.near_duplicates(table)).items()} == dict(enumerate(brute_components(90, links)))


def test_embeddings(spark):
    r = np.random.default_rng(0)
    centre = r.normal(size=(40, 16))
    x = np.concatenate([centre, centre[:20] + r.normal(size=(20, 16)) * 0.05, np.repeat(centre[:1], 700, 0) + r.normal(size=(700, 16)) * 0.08, centre[:3]])
    rows = [(i, [float(v) for v in np.float32(e)], int(i % 2)) for i, e in enumerate(x)]
    bad = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] * 16, 0), (9005, rows[0][1], None), (None, rows[0][1], 0), (9006, [1.0], 0)]
    got = {v.vec_id: v for v in pivots.near_duplicates(spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int")).collect()}
    unit = np.array([e for _, e, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    want = brute_components(len(x), links)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.9 * 2 * len(links) <= found <= 2 * len(links)
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) > 0.95
    assert all(got[k].n_links == 0 and got[k].kept for k in (9001, 9002, 9003, 9004, 9005, 9006, None))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pivots.near_duplicates(empty).count() == 0


def test_licences(spark):
    files = spark.createDataFrame([("a/LICENSE", "x\nreleased under the MIT license", 1), ("a/b/c.txt", "code", 1), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0.", 1), ("z/c.txt", None, 1), (None, "MIT License", 1), ("LICENSE.txt", "", 1), ("a/d.txt", "Licensed under the Apache License, Version 2.0.", 1)], "path string, text string, licence int")
    got = {r.path: (r.own_licence, r.licence, r.from_dir) for r in licenses.scan(files).collect()}
    assert got["a/b/c.txt"] == (None, "Apache-2.0", "a/b") and got["a/LICENSE"][:2] == ("MIT", "MIT") and got["z/c.txt"] == (None, None, None) and got["a/d.txt"][1] == "Apache-2.0"
    assert licenses.scan(files.limit(0)).count() == 0
    tie = spark.createDataFrame([("p/LICENSE-b", "Released under the ISC License."), ("p/LICENSE-a", "Released under the MIT License."), ("p/LICENSE-a", "Released under the MIT License."), ("p/x", "y " * 200_000)], "path string, text string")
    got = [r for r in licenses.scan(tie).collect()]
    assert len(got) == 4 and {r.licence for r in got if r.path == "p/x"} == {"MIT"}  # equal cosines: the first path declares


def test_licence_texts(spark):
    """Whole files, headers, wrapped lines, titles and tags are found; near misses are not, among the driver's documents."""
    mit = "\n\n".join(("MIT License", "Copyright (c) 2020 Foo Corp.", licence_texts._GRANT_MIT, licence_texts._NOTICE_MIT, licence_texts._WARRANTY_MIT))
    gpl = licence_texts._gnu("GNU General Public License", "3", "This program").replace(". ", ".\n * ")
    want = {
        "MIT License": "MIT", "The MIT License (MIT)": "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT", "GNU GENERAL PUBLIC LICENSE": "GPL",
        "Mozilla Public License Version 2.0": "MPL-2.0", "Redistribution and use in source and binary forms, with or without": "BSD-3-Clause", "modification, are permitted provided that the following conditions are met:": "BSD-3-Clause",
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': "Apache-2.0",
        "Copyright 2020 Foo Corp. Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", mit: "MIT", mit.replace("\n", "\n# "): "MIT", f"/* {gpl} */\nint main()": "GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nCopyright (C) 1989": "GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;": "GPL-2.0-or-later",
    }
    want |= dict.fromkeys(("mit mit", "the mit campus", "SPDX-License-Identifier: Foo-1.0", "a driving license is needed", "prose that is licensed under nothing", "Apache helicopters", "free of charge", "Version 2.0", "Public License", "Creative Commons"))
    want |= {text: name for name, text, _ in licence_texts.forms()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")
    files = spark.createDataFrame([(f"x/{i}", t) for i, t in enumerate(want)], "path string, text string")
    got = {r.path: r.licence for r in licenses.own_licences(files.union(docs)).collect()}
    assert {t: got.get(f"x/{i}") for i, t in enumerate(want)} == want
    lines = [(r.path, x) for r in docs.where("text rlike '(?i)licen[sc]e'").collect() for x in r.text.split("\n") if re.search("(?i)licen[sc]e", x)]
    said = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    assert {x for _, x in lines} == set(said) and all(got[p] in {said[x] for q, x in lines if q == p} for p, _ in lines)


def test_merkle_audit(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" if i % 50 else None) for i in range(600)] + [(None, "x", "y"), (3, "u3", "<p>3</p>")], "page_id long, url string, html string")
    other = pages.where("page_id is null or page_id <> 40").withColumn("html", F.when(F.col("page_id") == 300, "zz").otherwise(F.col("html"))).union(spark.createDataFrame([(600, "n", "n")], pages.schema))
    one = warc.MerkleTree(warc.leaves(pages))
    bad, marks = warc.audit(one, warc.MerkleTree(warc.leaves(other)))
    assert {(r.page_id, r.state) for r in bad.collect()} == {(40, "missing"), (300, "changed"), (600, "extra")}
    assert [m.count() for m in marks] == [3, 3, 3]
    same, _ = warc.audit(one, one)
    assert same.count() == 0


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = entries.queries()[name](spark, SF).toPandas(), c.sql(entries.oracle_sql()[name]).df()

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return None
        return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)  # pandas makes floats of whole numbers beside nulls

    rows = lambda d: sorted(str([cell(v) for v in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline(spark):
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    table = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # brute force of every stage but language ID, whose predictions are taken as they are
    kept = {k: r.text or "" for k, r in table.items()}
    named = {r.doc_id for r in langid.identified(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id").collect()}
    kept = {k: t for k, t in kept.items() if k in named}
    holders: dict = {}
    for k, t in kept.items():
        for key in {b.decode() for b in linededup.line_keys(t)[1]}:
            if len(key) >= 10:
                holders.setdefault(key, set()).add(k)
    for k, t in kept.items():
        lines, keys = linededup.line_keys(t)
        kept[k] = b"\n".join(x for x, key in zip(lines, keys, strict=True) if len(h := holders.get(key.decode(), ())) < 2 or min(h) == k).decode()
    ids = sorted(kept)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for k in ids:
        w = re.findall(r"[^ \t-\r]+", kept[k].translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    firsts = [k for k, c in zip(ids, brute_components(len(ids), links), strict=True) if ids[c] == k]
    grams = {w for t in bench for w in decontam.windows(t)}
    clean = {k for k in firsts if not any(w in b" ".join(decontam.words(kept[k])) and f" {w.decode()} " in f" {b' '.join(decontam.words(kept[k])).decode()} " for w in grams)}
    assert set(got) == clean and all(got[k].text == kept[k] and got[k].round_trip for k in clean)
