"""Bounds, hot groups, clashing names, nulls, empty tables and long texts of the corpus operators."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from asofworks.llm import common, decontam, langid, licenses, linededup, minhash, pieces, pii, pivots, tokencount, warc
from asofworks.llm.cuckoo import CuckooFilter

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Every name an operator uses for a column of its own.
NAMES = (
    "_gone", "gone", "row_", "salt_", "score", "bits", "excess", "lang_pred", "hits", "items", "spans", "n_words", "n_lines", "n_dropped", "lost", "lost_id", "n_pieces", "ids", "piece_ids", "n_tokens",
    "n_bytes", "base_sha256", "n_email", "key", "id", "rep", "u", "v", "node", "component", "shard", "h1", "version", "live", "there", "bands", "c1", "n", "path", "unit", "near", "blk", "pivot", "cid", "file", "slot", "hash", "offset",
)
ROWS = [
    (0, "The shared line of text is here\nfirst words of the text", "en"), (1, "the shared LINE of text is here \nsecond words of the text", "en"), (2, None, None), (3, "", "fr"), (None, "The shared line of text is here", "de"),
    (4, "w " * 50_000, "en"), (4, "w " * 50_000, "en"), (5, "12 34 !!", "en"), (6, "mail bob.x@mail.example.com", "en"),
]
OPERATORS = {
    "language": lambda d: langid.predict(d, langid.fit(d)),
    "identified": lambda d: langid.identified(d),
    "lines": linededup.dedup,
    "rewritten": linededup.rewritten,
    "minhash": minhash.one_of_each,
    "decontamination": lambda d: decontam.scan(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 6")),
    "clean": lambda d: decontam.clean(d, d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 6")),
    "pieces": lambda d: pieces.encode(d, PIECES),
    "tokens": lambda d: tokencount.count_tokens(d, BPE),
    "pii": pii.find,
}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_any_name_and_empty_tables(spark, docs, name):
    out = OPERATORS[name](docs)
    own = {c for c, t in out.dtypes if c in docs.columns and (docs.schema[c].dataType != out.schema[c].dataType)}
    rows = out.collect()
    added = set(out.columns) - set(docs.columns)
    for r in rows:  # carried columns hold what they held
        tag = "-" if r.doc_id is None else str(r.doc_id)
        kept = [c for c in NAMES if c in out.columns and c not in own and isinstance(r[c], str) and r[c].startswith(f"{c} ")]
        assert all(r[c] == f"{c} {tag}" for c in kept) and len(kept) + len(own) + 8 >= len(NAMES), (name, own, added)
    if name in ("identified", "clean", "minhash", "rewritten"):
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in NAMES)
    else:
        assert len(rows) == len(ROWS)
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_pipeline_takes_empty_null_and_clashing(spark, docs, tmp_path):
    import corpus_pipeline

    docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(str(tmp_path / "a/benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert {r.doc_id for r in got} <= {0, 1, None, 4, 6} and all(r["score"] == f"score {'-' if r.doc_id is None else r.doc_id}" for r in got) and got
    docs.limit(0).withColumn("n_chars", F.lit(0).cast("long")).write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "b/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_language_without_text_is_not_learned():
    m = langid.PpmModel.train({"en": [b"the cat sat on the mat"], "zz": [], "yy": [b""]})
    assert m.langs == ["en"]
    full = langid.PpmModel.train({"en": [b"the cat sat on the mat, the cat"], "fr": [b"le chat est sur le tapis, le chat"]}, 1)
    small = langid.PpmModel.train({"en": [b"the cat sat on the mat, the cat"], "fr": [b"le chat est sur le tapis, le chat"]}, 1, table_bytes=4 * 30 * 2 * 20)
    assert small.bits.shape[1] < full.bits.shape[1] and small.code_lengths([b"the cat"])[0].argmin() == 0


def test_long_labelled_texts_train_and_many_labels_are_an_error(spark):
    d = spark.createDataFrame([(i, f"{w} " * 40_000, lang) for i, (w, lang) in enumerate([("abab", "a"), ("cdcd", "c")] * 12)], "doc_id long, text string, lang string")
    assert langid.fit(d).langs == ["a", "c"]
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        langid.fit(many)


def test_benchmark_beyond_the_bound_is_an_error(spark, docs):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert len(decontam.patterns(items)) == 3
    with pytest.raises(ValueError):
        decontam.patterns(items, most=29)


def test_word_codes_of_several_places():
    words = [f"w{i}".encode() for i in range(5000)]
    s = decontam.Scanner([(b" ".join(words[i : i + 3]), (str(i),)) for i in range(0, 4998, 3)])
    assert s.places == 3
    text = [b"x", *words[6:9], b"w1", *words[15:18], *words[15:17]]
    assert s.scan(text) == ([(1, 4), (5, 8)], {"6", "15"})


def test_fixity_of_negative_ids_and_whole_replicas(spark):
    pages = spark.createDataFrame([(i, f"u{i}", None if i % 3 else "b" * abs(i)) for i in range(-600, 5000, 7)], "page_id long, url string, html string").withColumn("slot", F.lit("x"))
    one = warc.MerkleTree(warc.leaves(pages))
    assert one.leaves.where("page_id < 0 and file >= 0").count() == 0 and one.leaves.select("file", "slot").distinct().count() == one.leaves.count()
    changed = pages.withColumn("html", F.when(F.col("page_id") == -5, "zz").otherwise(F.col("html"))).withColumn("html", F.when(F.col("page_id") == 2004, "y" * 9).otherwise(F.col("html")))
    two = warc.MerkleTree(warc.leaves(changed))
    bad, marks = warc.audit(one, two)
    assert {(r.page_id, r.state) for r in bad.collect()} == {(p, "changed") for p in (-5, 2004) if p in range(-600, 5000, 7)} and one.root != two.root
    same, _ = warc.audit(one, warc.MerkleTree(warc.leaves(pages)))
    assert same.count() == 0
    assert warc.MerkleTree(warc.leaves(pages.limit(0))).root == ""


def test_line_index_grows_and_shrinks_by_batches(spark, monkeypatch):
    """Filters decide what is looked up; counts equal those of an index of the same documents, over few and many shards."""
    r = random.Random(3)
    rows = [(i, "\n".join(f"line number {r.randrange(400)} of them" for _ in range(5))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = lambda x: sorted(tuple(c) for c in x.current_counts().select("h1", "h2", "n_docs", "keeper").collect())
    monkeypatch.setattr(linededup, "SHARD_KEYS", 60)
    index = linededup.LineIndex.of(docs.where("doc_id < 100"))
    shards, first = index.n_shards, seen(index)
    assert shards > 1 and index.insert(docs.where("doc_id < 50")).n_keys == index.n_keys  # known documents change nothing
    grown = index.insert(docs.where("doc_id >= 100"))
    assert seen(grown) == seen(linededup.LineIndex.of(docs, batches=1)) and grown.n_keys == len(seen(grown))
    back = grown.delete(docs.where("doc_id >= 100"))
    assert seen(back) == first and back.n_keys == len(first)
    again = back.insert(docs.where("doc_id >= 100"))
    assert seen(again) == seen(grown) and again.losses().count() == grown.losses().count()


def test_cuckoo_deletes_among_copies():
    f, k = CuckooFilter(64), np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000))
    f.insert(k)
    assert f.contains(k).all()  # far beyond its capacity
    f.delete(k[:1500])
    assert f.contains(k[1500:]).all() and f.contains(k[:1500]).mean() < 1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and plain_luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], list(BASE).index(x[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(8)
    for alphabet in ("ab1.@-_ %+c", "12.. 5-", "+1 (2).3-x", "4 -1", "0123456789. -+@a"):
        for _ in range(4000):
            x = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            assert pii.base_spans(x) == brute_base(x), x


def test_decoding_a_region_is_the_best_labelling():
    """Brute force over all sets of segments that do not overlap; regions against the whole text as one."""
    field, r = pii.trained(), random.Random(2)
    for _ in range(150):
        x = " ".join(r.choice(("bob", "at", "[at]", "example.org", "dot", "com", "10.0.0.1", "555-123-4567", "4111111111111111", "x", "+1", "(499)", "555-6503")) for _ in range(r.randint(1, 5)))
        cuts, found = pii.segments(x, 0, len(x))
        scored = [(i, j, *field.best(x, cuts[i], cuts[j])) for i, j in found]

        def best(at):
            out = 0.0
            for i, j, _, s in scored:
                if i >= at and s > 0:
                    out = max(out, s + best(j))
            return out

        got = field.decode(x, 0, len(x))
        total = sum(s for i, j, k, s in scored if (pii.KINDS[k], cuts[i], cuts[j]) in got)
        assert abs(total - best(0)) < 1e-9
        inside = [s for a, b in pii.regions(x) for s in field.decode(x, a, b)]
        assert inside == got, x


@pytest.mark.parametrize("text", ["7" * 1_000_000, "1." * 30_000, " at " * 20_000, "@" * 200_000, "+1 " * 30_000, " ".join(f"a{i}@b.com" for i in range(2000))], ids=["digits", "dots", "at", "ats", "plus", "addresses"])
def test_long_runs_stay_linear(text):
    began = time.perf_counter()
    pii.all_spans(text, pii.trained())
    assert time.perf_counter() - began < 30


def test_bands_follow_the_threshold():
    for percent in (50, 60, 70, 80, 85, 95):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS and (bands * rows <= minhash.COORDINATES or rows == 1)


def brute_components(texts, words, percent):
    sets = [{tuple(w[i : i + words]) for i in range(len(w) - words + 1)} for w in map(str.split, texts)]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_template_pages_just_below_and_at_the_threshold(spark):
    """A shingle that more sets hold than are joined goes through blocks; all components are those of brute force."""
    r = random.Random(5)
    base, texts = [f"w{r.randrange(5000)}" for _ in range(110)], []
    for i in range(220):
        w = list(base)
        for _ in range(4 if i % 4 else 2):
            w[r.randrange(110)] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(table).collect()}
    assert got == dict(enumerate(brute_components(texts, 3, 85)))


def test_intersections_of_blocks():
    r = np.random.default_rng(1)
    one, two = ([np.unique(r.integers(0, 300, n)) for n in r.integers(1, 90, k)] for k in (17, 23))
    assert (minhash.intersections(one, two, chunk=64) == [[len(np.intersect1d(a, b)) for b in two] for a in one]).all()


def test_pivots_are_apart_over_blocks():
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(40, 8)), 30, 0) + r.normal(size=(1200, 8)) * 0.05
    kept = pivots.spread(x, 0.9, block=100)
    near = kept @ kept.T
    assert (near[np.triu_indices(len(kept), 1)] < 0.9).all() and (np.abs((pivots._unit(x) @ kept.T).max(1)) >= 0.9).all()


def test_grammar_arcs_are_those_of_merging():
    t = pieces.transducer(open(PIECES, "rb").read())
    ids = [i for i in t.ids.values() if t._merged(t.names[i]) == [t.names[i]]]
    short, r = [i for i in ids if len(t.names[i]) < 4], random.Random(6)
    for pool in (ids, short):
        for _ in range(3000):
            a, b = r.choice(pool), r.choice(pool)
            assert t._follows(a, b) == (t._merged(t.names[a] + t.names[b]) == [t.names[a], t.names[b]])


def test_settled_tables_are_released(spark):
    a, b = (common.settle(spark.range(5).toDF("x"), "probe") for _ in range(2))
    common.discard(a)
    with common.passing(spark):
        c = common.settle(spark.range(3).toDF("x"), "probe")
    assert b.count() == 5 and common.release(spark) >= 1
    for gone in (a, b, c):
        with pytest.raises(Exception):
            spark.read.parquet(gone.inputFiles()[0] if gone is a else "nowhere").count()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, _jsc = "spark://x:7077", spark.sparkContext._jsc

    class Session:
        sparkContext, conf = Context, spark.conf

    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError):
            common.shared_dir(Session)


def test_any_word_pattern():
    words = ["agpl-3.0", "agpl-3.0-only", "apache", "apache-2.0", "a", "mit", "mitx"]
    found = re.compile(licenses.any_word(words))
    assert all(found.search(f"z {w}.") for w in words) and not any(found.search(x) for x in ("licens", "amit", "apach"))
