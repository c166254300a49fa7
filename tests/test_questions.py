"""Golden values of question analysis, evidence, answers, chunks, graph building and evaluation."""

import json

import pytest
from pyspark.sql import functions as F

from asofworks.functions import records, time
from asofworks.functions import text as T
from asofworks.operators import analysis, answers, build, evaluation, hybrid, listing, traversal, validation
from asofworks.service import Service
from asofworks.sources.sinks import settle

QUESTIONS = [
    (1, "What risks affected NVIDIA as of June 1, 2025?", "2025-06-01 00:00:00"), (2, "What companies did Apple supply before 2024-03-31?", "2024-03-31 00:00:00"),
    (3, "What were Microsoft's primary risks in 2024?", "2024-12-31 23:59:59"), (4, "What companies does NVIDIA depend on?", None), (5, "What company supplies NVIDIA?", None),
    (6, "What supplier does NVIDIA depend on for a product?", None), (7, "What risks affect companies that supply NVIDIA?", None), (8, "Which company had higher revenue, Apple or Microsoft?", None),
    (9, "Results of Q2 2024", "2024-06-30 23:59:59"), (10, "Who owned it by the end of 2023?", "2023-12-31 23:59:59"), (11, "Sales before 2025", "2024-12-31 23:59:59"),
    (12, "as of 2022 please", "2022-12-31 23:59:59"), (13, "the fiscal year 2021 outlook", "2021-12-31 23:59:59"), (14, "on February 30, 2025", None), (15, "TSMC and ASML Holding N.V. with Zanzibar", None),
]
NODES = [("company:NVDA", "NVIDIA Corporation", ["nvidia"]), ("company:AAPL", "Apple Inc.", None), ("company:MSFT", "Microsoft Corporation", None), ("company:TSM", "Taiwan Semiconductor Manufacturing Company", ["TSMC"]), ("company:ASML", "ASML Holding", None), ("risk:cyber", "Cyber Attack", None)]
EDGES = [
    ("e1", "company:TSM", "company:NVDA", "SUPPLIES", "2024-02-01 12:00:00", 0.95, "c1", "d1"), ("e2", "company:ASML", "company:TSM", "SUPPLIES", "2024-02-15 12:00:00", 0.90, "c2", "d2"),
    ("e7", "company:NVDA", "risk:cyber", "HAS_RISK", "2024-01-15 12:00:00", 0.90, "c3", "d1"), ("e9", "company:AAPL", "company:NVDA", "COMPETES_WITH", "2024-01-15 12:00:00", 0.88, "c4", "d3"), ("e0", "company:NVDA", "company:MSFT", "PARTNERS_WITH", None, 0.9, "c5", "d3"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, "Company" if i.startswith("c") else "Risk", n, a) for i, n, a in NODES], "node_id string, node_type string, name string, aliases array<string>")


@pytest.fixture(scope="module")
def edges(spark):
    rows = spark.createDataFrame(EDGES, "edge_id string, src string, dst string, relationship string, t string, confidence double, chunk_id string, document_id string")
    return rows.withColumn("available_ts", F.col("t").cast("timestamp_ntz")).drop("t")


@pytest.fixture(scope="module")
def analysed(spark, nodes):
    q = spark.createDataFrame([x[:2] for x in QUESTIONS], "question_id int, question string")
    return settle(analysis.analyse(q, analysis.node_terms(nodes)), "analysed")


def test_analysis(analysed):
    got = {r.question_id: r for r in analysed.collect()}
    assert {k: None if r.reference is None else str(r.reference) for k, r in got.items()} == {k: t for k, _, t in QUESTIONS}
    assert str(got[3].window_start) == "2024-01-01 00:00:00" and str(got[11].window_start) == "2000-01-01 00:00:00"
    assert (got[5].hops, got[6].hops, got[7].hops) == (1, 2, 2) and got[7].primary == "multi-hop" and got[8].primary == "comparison" and got[8].cross_document
    assert got[7].intents == ["AFFECTED_BY", "DEPENDS_ON", "HAS_RISK", "SUPPLIES"]
    assert got[1].entities == ["company:NVDA"] and got[8].entities == ["company:AAPL", "company:MSFT"]
    assert got[15].entities == ["company:ASML", "company:TSM"] and "Zanzibar" in got[15].unresolved


def test_longest_names_win(spark, nodes):
    more = nodes.unionByName(spark.createDataFrame([("product:taiwan", "Product", "Taiwan", None)], nodes.schema))
    q = spark.createDataFrame([(1, "Does Taiwan Semiconductor Manufacturing sell in Taiwan?"), (2, "taiwan semiconductor manufacturing company"), (3, "")], "question_id int, question string")
    got = {r.question_id: r.entities for r in analysis.link_entities(q, analysis.node_terms(more)).collect()}
    assert got == {1: ["company:TSM", "product:taiwan"], 2: ["company:TSM"], 3: []}


def test_evidence_follows_time_and_intents(analysed, edges):
    paths = traversal.top_paths(analysed, edges, 10)
    got = {}
    for r in paths.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r)
    assert got[1][0].evidence_id == "edge:e7" and all(r.available_ts is not None for r in got[1])  # a cut-off leaves out unknown times
    assert any(r.evidence_id == "edge:e0" for r in got[4])
    two = [r for r in got[7] if r.hop_count == 2]
    assert two and all(len(set(r.path)) == 3 for r in two) and any(r.evidence_id == "path:e1:e2" and abs(r.confidence - 0.855) < 1e-9 for r in two)
    row = hybrid.evidence_rows(paths.where("question_id = 1"), edges).orderBy(F.desc("score")).first()
    assert row.provenance_verified and row.document_id == "d1" and row.text == "company:NVDA --[HAS_RISK]--> risk:cyber (as of 2024-01-15)"


def test_fusion_of_questions(spark):
    v = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2)], "question_id int, chunk_id string, rank int")
    g = spark.createDataFrame([(1, "edge:a", "c1", 1), (1, "edge:b", "c3", 2), (1, "edge:c", "c1", 3)], "question_id int, evidence_id string, chunk_id string, rank int")
    got = [(r.evidence_id, r.source_type, r.score) for r in hybrid.fuse(v, g).orderBy("rank").collect()]
    assert got == [("hybrid:c1", "hybrid", round(2 / 61, 6)), ("graph:edge:b", "graph", round(1 / 62, 6)), ("vector:c2", "vector", round(1 / 62, 6))]


def test_rerank_and_gate(spark):
    cols = "question_id int, question string, intents array<string>, evidence_id string, text string, relationships array<string>, confidence double, hop_count int, score double, rank int"
    q = "What risks affect it?"
    rows = [(1, q, ["HAS_RISK"], "a", "makes", ["MANUFACTURES"], 1.0, 1, 0.8, 1), (1, q, ["HAS_RISK"], "b", "hit", ["HAS_RISK"], 1.0, 1, 0.75, 2), (2, q, [], "a", "x", ["R"], 0.4, 1, 0.5, 1), (2, q, [], "b", "x", ["R"], 0.99, 1, 0.5, 2), (3, q, [], "a", "x", ["R"], 1.0, 3, 0.5, 1), (3, q, [], "b", "x", ["R"], 1.0, 1, 0.5, 2)]
    best = hybrid.rerank(spark.createDataFrame(rows, cols), 5)
    assert {r.question_id: r.evidence_id for r in best.where("place = 1").collect()} == {1: "b", 2: "b", 3: "b"}


def test_orchestration_asks_again(analysed, edges):
    def retrieve(a, fetch):
        best = traversal.top_paths(a, edges, fetch)
        return hybrid.evidence_rows(best, edges).join(a.select("question_id", "question", "intents"), "question_id")

    some = analysed.where("question_id in (4, 5, 9)")
    best, gated = hybrid.orchestrate(some, retrieve, top_k=3, rounds=1, keep=lambda df: settle(df, "round"))
    got = {r.question_id: r for r in gated.collect()}
    assert got[5].sufficient and got[5].rounds == 0 and got[9].reason == "count" and got[9].rounds == 1
    packed = {r.question_id: r for r in answers.package(some, best, gated).collect()}
    assert packed[5].sources == sorted(set(packed[5].sources), key=packed[5].sources.index) and len(packed[5].evidence) == 3
    raw = answers.generate(answers.prompt(answers.package(some, best, gated)), lambda system, user: json.dumps({"answer": "x", "confidence": 0.5, "evidence_ids": ["edge:e1"]}))
    checked = {r.question_id: r.errors for r in answers.validate(raw, answers.package(some, best, gated)).collect()}
    assert checked[5] == [] and "unrefused" in checked[9] and "unknown_ids" in checked[9]


def test_chunks_and_windows(spark):
    r = spark.createDataFrame([("A" * 6000, "x\n\n" * 3, f"{'a' * 1000}\n\n{'b' * 900}\n\n{'c' * 100}")], "a string, b string, c string").select(*[T.pack_paragraphs(F.col(c)).alias(c) for c in "abc"]).first()
    assert len(r.a) == 4 and max(map(len, r.a)) == 1800 and r.b == ["x\n\nx\n\nx"]
    assert [len(x) for x in r.c] == [1000, 250 + 2 + 900 + 2 + 100] and r.c[1].startswith("a" * 250 + "\n\nb")
    w = spark.createDataFrame([("." * 400 + "needle" + "." * 400,)], "t string").select(T.best_window(F.col("t"), F.array(F.lit("needle")), 100).alias("w")).first().w
    assert "needle" in w and w.startswith("...") and w.endswith("...")


def test_text_values(spark):
    df = spark.createDataFrame([("The Quick, a fox!", "AMAZON COM INC", "0000320193", "0000320193-26-000020", "aapl-20260627.htm", "June 2025")], "a string, n string, c string, x string, d string, t string")
    r = df.select(T.normalize_answer(F.col("a")).alias("a"), T.simplify_registrant(F.col("n")).alias("n"), T.filing_url(F.col("c"), F.col("x"), F.col("d")).alias("u"), time.parse_flexible(F.col("t")).cast("string").alias("t"), T.strip_suffix(F.lit("Bank of X, N.A.")).alias("s"), T.sentiment(F.lit("Strong growth, one loss.")).alias("f")).first()
    assert (r.a, r.n, r.t, r.s) == ("quick fox", "amazon com", "2025-06-01 00:00:00", "bank of x") and r.u.endswith("/320193/000032019326000020/aapl-20260627.htm") and abs(r.f - 1 / 3) < 1e-9
    with pytest.raises(Exception):
        df.select(time.parse_flexible_or_fail(F.lit("soon"))).collect()


def test_graph_from_extractions(spark, tmp_path):
    entity = lambda i, k, n: {"entity_id": i, "entity_type": k, "name": n, "canonical_name": None, "confidence": 0.9}
    rel = lambda s, t, r, **x: {"source_entity_id": s, "target_entity_id": t, "relationship": r, "confidence": 0.5} | x
    rows = [
        {"document_id": "d1", "chunk_id": "c1", "chunk_index": 0, "available_time": "2024-01-05", "entities": [entity("1", "company", "Apple Inc."), entity("2", "RISK", "Cyber"), entity("3", "planet", "Mars")], "relations": [rel("1", "2", "has_risk"), rel("1", "1", "SUPPLIES"), rel("1", "2", "LOVES"), rel("1", "3", "SUPPLIES"), rel("2", "Later Corp", "AFFECTED_BY"), rel("2", "1", "AFFECTED_BY", event_time="2030-01-01")]},
        {"document_id": "d2", "chunk_id": "c2", "chunk_index": 1, "available_time": "2024-01-03", "entities": [entity("9", "Company", "Later Corp"), entity("8", "Company", "APPLE")], "relations": [rel("Later Corp", "apple inc.", "COMPETES_WITH")]},
    ]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    from asofworks.sources import readers

    x = readers.extractions(spark, str(tmp_path))
    universe = spark.createDataFrame([("AAPL", "Apple Inc.")], "ticker string, company string")
    n, e = build.unified_graph(x, universe)
    got = {r.node_id: r for r in n.collect()}
    assert set(got) == {"company:AAPL", "2", "9"} and got["company:AAPL"].available_time == "2024-01-03" and got["company:AAPL"].document_ids == ["d1", "d2"]
    assert {(r.source, r.relationship, r.target) for r in e.collect()} == {("company:AAPL", "HAS_RISK", "2"), ("9", "COMPETES_WITH", "company:AAPL")}
    _, free = build.unified_graph(x, universe, ordered=False)
    assert ("2", "AFFECTED_BY", "9") in {(r.source, r.relationship, r.target) for r in free.collect()}


def test_extraction_client(spark):
    said = {"good": json.dumps({"entities": [{"entity_id": "a", "entity_type": "Company", "name": "A"}, {"entity_id": "b", "entity_type": "Risk", "name": "B"}, {"entity_id": "c", "entity_type": "Star", "name": "C"}], "relations": [{"source": "A", "target": "B", "relationship": "has_risk"}, {"source": "A", "target": "C", "relationship": "HAS_RISK"}, {"source": "A", "target": "A", "relationship": "SUPPLIES"}]})}
    chunks = spark.createDataFrame([("d", "c1", 0, "good", "2024"), ("d", "c2", 1, "bad", "2024")], "document_id string, chunk_id string, chunk_index int, text string, available_time string")
    raw = build.extract(chunks, lambda t: "Here: " + said[t], tries=2, wait=0.01)
    rows = {r.chunk_id: r for r in raw.collect()}
    assert rows["c1"].error is None and rows["c2"].raw is None and rows["c2"].error.startswith("KeyError")
    got = build.parse_extraction(raw.where("raw is not null"), chunks).first()
    assert [e.name for e in got.entities] == ["A", "B"] and [(r.source_entity_id, r.target_entity_id, r.relationship) for r in got.relations] == [("A", "B", "HAS_RISK")]


def test_merge_keeps_the_most_confident(spark):
    rows = spark.createDataFrame([("k", 1, 0.5, {"a": "1", "b": "1"}), ("k", 2, 0.9, {"a": "2"}), ("k", 3, 0.9, {"a": "3", "c": "3"})], "id string, seq int, confidence double, properties map<string,string>")
    r = build.merge_by_confidence(rows, ["id"], ["seq"]).first()
    assert r.seq == 2 and r.properties == {"a": "2", "b": "1", "c": "3"}


def test_exact_tests_and_rates(spark):
    df = spark.createDataFrame([(3, 1, 1, 3), (0, 84, 1, 57)], "a int, b int, c int, d int")
    p = [r.p for r in df.select(evaluation.fisher_exact(*map(F.col, "abcd")).alias("p")).collect()]
    assert abs(p[0] - 0.485714) < 1e-5 and abs(p[1] - 0.4085) < 1e-4
    four = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "answerable boolean, refused boolean")
    r = evaluation.refusal_metrics(four).first()
    assert (r.precision, r.recall, r.accuracy) == (0.5, 0.5, 0.5) and evaluation.refusal_metrics(four.limit(0)).first().precision == 0
    pairs = spark.createDataFrame([(0, x, y) for x, y in ((125, 110), (115, 122), (130, 125), (140, 120), (140, 140), (115, 124), (140, 123), (125, 137), (140, 135), (135, 145))], "g int, x int, y int")
    assert evaluation.wilcoxon(pairs, ["g"], "x", "y").first().w == 18.0
    folds = spark.createDataFrame([(f, c, float(v)) for f, row in enumerate([(1, 2, 3), (1, 3, 2), (1, 2, 3), (1, 2, 3)]) for c, v in zip("xyz", row, strict=True)], "fold int, config string, v double")
    assert abs(evaluation.friedman(folds, "fold", "config", "v").first().chi2 - 6.5) < 1e-6
    docs = spark.createDataFrame([("q", "c1", 1), ("q", "c2", 2), ("q", "c2", 3)], "question_id string, document_id string, rank int")
    rel = spark.createDataFrame([("q", "c2"), ("q", "c9")], "question_id string, document_id string")
    r = evaluation.document_metrics(docs, rel, (1, 3)).first()
    assert (r.doc_hit_1, r.doc_hit_3, r.doc_recall_3, r.coverage) == (0, 1, 0.5, 0.5)


def test_failure_modes(spark):
    names = ["answerable", "refused", "f1", "exact", "retrieved", "in_context", "linked", "hops", "path", "reason", "sufficient"]
    base = (True, True, 0.0, 0.0, True, True, True, 1, 0.0, "count", True)
    cases = {"CORRECT_REFUSAL": (False, *base[1:]), "UNGROUNDED_HALLUCINATION": (False, False, *base[2:]), "NONE_SUCCESS": (True, False, 0.3, *base[3:]), "EVIDENCE_NOT_RETRIEVED": (*base[:4], False, False, True, *base[7:]), "ENTITY_LINKING_FAILURE": (*base[:4], False, False, False, *base[7:]), "EVIDENCE_RANKED_TOO_LOW": (*base[:5], False, *base[6:]), "GRAPH_PATH_FAILURE": (*base[:7], 2, 0.0, "hops", False), "SUFFICIENCY_GATE_FALSE_REFUSAL": (*base[:10], False), "GENERATOR_FAILURE": base}
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], ["want", *names])
    assert all(r.want == r.got for r in df.select("want", answers.failure_mode(*map(F.col, names)).alias("got")).collect())


def test_records_and_coverage(spark):
    raw = spark.createDataFrame([("aapl", "320193", "10-q", "2026-07-30", "2026-06-27", "2026-07-30T18:00:00.000Z", "0000320193-26-000020", "a.htm")], "ticker string, cik string, form string, filingDate string, reportDate string, acceptanceDateTime string, accessionNumber string, primaryDocument string")
    f = records.filing(raw)
    r = f.first()
    assert (r.ticker, r.cik, r.form, r.acceptance_datetime) == ("AAPL", "0000320193", "10-Q", "2026-07-30T18:00:00+00:00")
    doc = records.filing_document(f, spark.createDataFrame([("0000320193-26-000020", "text")], "accession_number string, text string")).first()
    assert doc.document_id == "doc:sec:AAPL:0000320193-26-000020" and doc.metadata["form"] == "10-Q"
    assert f.select(validation.filing_errors().alias("e")).first().e == []
    d = spark.createDataFrame([("A", "10-K", 3, "2024-01-01"), ("A", "10-Q", 2, "2024-02-01"), ("B", "10-K", 1, None)], "company string, document_type string, chunk_count int, publication_date string")
    got = {x.company: (x.filings, x.chunks, x.by_type) for x in listing.corpus_coverage(d).collect()}
    assert got == {"A": (2, 5, "10-K:1,10-Q:1"), "B": (1, 1, "10-K:1"), "*": (3, 6, "10-K:2,10-Q:1")}


def test_service(spark, nodes, edges):
    import threading
    import urllib.request

    from asofworks.service import server

    chunks = spark.createDataFrame([("c1", "d1", "NVDA", "10-K", "t", None), ("c2", "d2", "TSM", "20-F", "t", "live")], "chunk_id string, document_id string, company string, document_type string, text string, corpus string")
    results = spark.createDataFrame([(1, "factual", True, False, 0.5), (2, "factual", False, True, 0.0)], "question_id int, category string, answerable boolean, refused boolean, token_f1 double")
    s = Service(spark, {"nodes": nodes, "edges": edges, "chunks": chunks, "results": results}, fetch=lambda c, f: chunks.limit(1).withColumn("chunk_id", F.lit("new")))
    status, got = s.handle("POST", "/api/v1/query", {"query": "What company supplies NVIDIA?", "top_k": 3})
    assert status == 200 and got["sufficient"] and got["entities"] == ["company:NVDA"] and got["future_items"] == 0
    assert s.handle("GET", "/graph/companies")[1]["companies"][0]["id"] == "company:NVDA"
    page = s.handle("GET", "/graph/subgraph", {"node_id": "company:NVDA", "limit": 2})[1]
    assert page["total"] == 4 and page["has_more"] and len(page["edges"]) == 2
    assert s.handle("GET", "/graph/search", {"q": "apple"})[1]["nodes"][0]["id"] == "company:AAPL"
    assert s.handle("GET", "/evidence/chunks", {"company": "nvda"})[1]["total"] == 1 and s.handle("GET", "/live/filings")[1]["total"] == 1
    assert s.handle("POST", "/live/fetch", {"company": "nvda"})[1]["new_chunks"] == 1 and s.handle("GET", "/evidence/chunks")[1]["total"] == 3
    assert s.handle("GET", "/benchmark/summary")[1]["accuracy"] == 1.0 and s.handle("GET", "/live/resolve", {"q": "Apple"})[1]["registrants"] == ["company:AAPL"]
    assert [s.handle(*x)[0] for x in (("GET", "/nowhere"), ("GET", "/graph/subgraph", {"node_id": "x"}), ("POST", "/query", {"query": "x"}), ("GET", "/corpus/filings"))] == [404, 404, 422, 503]
    http = server(s, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/api/v1/health", timeout=60) as r:
        assert json.loads(r.read())["status"] == "ok"
    http.shutdown()


def test_fetch_over_http(spark):
    import gzip
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from asofworks.sources import readers

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = gzip.compress(b'{"a": 1}') if self.path == "/j" else b"<html>\xff</html>"
            self.send_response(200)
            self.send_header("Content-Type", "application/json" if self.path == "/j" else "text/html")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    site = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{site.server_port}"
    urls = spark.createDataFrame([(f"{top}/j",), (f"{top}/h",), (None,)], "url string")
    got = {r.url: r for r in readers.fetch(urls).collect()}
    assert got[f"{top}/j"].body == '{"a": 1}' and got[f"{top}/h"].error.startswith("no json") and got[None].error == "no url"
    assert readers.fetch(urls.limit(2), "html").where("body like '%html%'").count() == 1
    site.shutdown()


def test_vector_table(spark, tmp_path):
    from asofworks.sources import sinks, vectors

    path = str(tmp_path / "v")
    vectors.create(spark, path)
    rows = spark.createDataFrame([(f"c{i}", "d", f"text {i}", "2024") for i in range(130)], "chunk_id string, document_id string, text string, available_time string")
    coded = vectors.encode(rows, lambda ts: [[float(len(t)), 1.0] for t in ts])
    for _ in range(2):  # a repeated batch replaces itself
        vectors.upsert(coded, path, 1)
    vectors.upsert(coded.where("chunk_id = 'c5'").withColumn("text", F.lit("new")), path, 2)
    own = vectors.collection(spark, path)
    assert own.count() == 130 and own.where("text = 'new'").count() == 1
    seen, after = [], None
    while got := vectors.scroll(own, ["text"], after, 50).collect():
        seen += [r.point_id for r in got]
        after = seen[-1]
    assert len(seen) == len(set(seen)) == 130
    work = lambda todo: todo.select("t", "a", F.when(F.col("a") == "2", "failed").otherwise("completed").alias("status"))
    items = spark.createDataFrame([("x", "1"), ("x", "2")], "t string, a string")
    assert {(r.a, r.status) for r in sinks.resume(items, str(tmp_path / "m"), ["t", "a"], work, 1).collect()} == {("1", "completed"), ("2", "failed")}
    done = sinks.resume(items, str(tmp_path / "m"), ["t", "a"], lambda todo: todo.withColumn("status", F.lit("completed")), 2)
    assert {r.status for r in done.collect()} == {"completed"} and spark.read.parquet(str(tmp_path / "m/batch_id=2")).count() == 1


def test_corpus_config(tmp_path):
    from asofworks.sources import readers

    f = tmp_path / "c.yaml"
    f.write_text("# corpus\nforms:\n  10-K: 2\n  8-K: 1\ntickers: [AAPL, MSFT]\nsources:\n  - name: sec\n    on: true\n  - name: rss\nempty:\nnote: 'a: b'\n")
    assert readers.corpus_config(str(f)) == {"forms": {"10-K": 2, "8-K": 1}, "tickers": ["AAPL", "MSFT"], "sources": [{"name": "sec", "on": True}, {"name": "rss"}], "empty": None, "note": "a: b"}
