"""Bounded walks, labels by text, filtered search, the gate, path matches, ids and exact tests against brute force and golden values."""

import hashlib
import itertools
import json
import random
import uuid
import xml.etree.ElementTree as ET
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofworks.functions import html, ids, time
from asofworks.operators import analysis, build, evaluation, features, gate, hybrid, models, pathmatch, provenance, retrieval, temporal, traversal, validation
from asofworks.sources import sinks

T0 = datetime(2024, 1, 1)
ASKED = "question_id int, question string, entities array<string>, intents array<string>, reference timestamp_ntz, hops int, multi_hop boolean, unreadable boolean"


# walks


def brute_paths(asked, edges, nodes, k):
    near, late, company = {}, {n: t for n, _, t in nodes}, {n for n, kind, _ in nodes if kind == "Company"}
    for e in edges:
        if e[6] is not False and e[1] != e[2]:
            near.setdefault(e[1], []).append((e[2], True, e))
            near.setdefault(e[2], []).append((e[1], False, e))
    out = {}
    for q, text, entities, intents, ref, hops, _, unreadable in asked:
        seen = lambda t: ref is None or (t is not None and t <= ref)  # noqa: B023, E731
        found = {}

        def go(path, own, forward):
            for b, f, e in near.get(path[-1], []) if len(own) < min(3, max(1, hops)) else []:  # noqa: B023
                if b in path or not seen(e[4]) or not (late.get(b) is None or seen(late[b])):  # noqa: B023
                    continue
                es, fw = [*own, e], forward if own else f
                c = 1.0
                for x in es:
                    c *= x[5]
                rels = [x[3] for x in es]
                hit = [r for r in rels if r in intents]  # noqa: B023
                m = 1.0 if not intents else 8.0 if len(hit) == len(rels) else 5.0 if hit else 0.2  # noqa: B023
                low = text.lower()  # noqa: B023
                m2 = 1.5 if intents and any(w in low for w in ("company", "companies", "firm", "firms", "corporation")) and b in company else 1.0  # noqa: B023
                d = 1.0
                if "depend" in low and intents and len(es) == 1:  # noqa: B023
                    src, dst = (path[0], b) if fw else (b, path[0])
                    d *= ({"SUPPLIES": 0.1, "DEPENDS_ON": 2.0}.get(rels[0], 1.0) if src in entities else 1.0) * (2.0 if dst in entities and rels[0] == "SUPPLIES" else 1.0)  # noqa: B023
                times = [x[4] for x in es if x[4] is not None]
                name = ("edge:" if len(es) == 1 else "path:") + ":".join(x[0] for x in es)
                score = c / (1 + 0.5 * (len(es) - 1)) * m * m2 * d
                found.setdefault(name, (-score, len(es), not times, name, [*path, b]))  # noqa: B023
                go([*path, b], es, fw)

        if not unreadable:
            for s in sorted(entities):
                if s in late and (late[s] is None or ref is None or late[s] <= ref):
                    go([s], [], True)
        out[q] = [(x[3], x[4]) for x in sorted(found.values())[:k]]
    return out


def check_paths(spark, asked, edges, nodes, k):
    a = spark.createDataFrame(asked, ASKED)
    e = spark.createDataFrame(edges, "edge_id string, src string, dst string, relationship string, available_ts timestamp_ntz, confidence double, provenance_verified boolean")
    n = spark.createDataFrame(nodes, "node_id string, node_type string, available_ts timestamp_ntz")
    got = {}
    for r in traversal.top_paths(a, e, k, n, lambda df: sinks.settle(df, "t")).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.evidence_id, r.path))
    want = {q: x for q, x in brute_paths(asked, edges, nodes, k).items() if x}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_walks_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(traversal, "PART", 3)  # every node's edges in several parts
    r = random.Random(seed)
    nodes = [(f"{'company' if i % 3 else 'risk'}:{i}", "Company" if i % 3 else "Risk", T0 + timedelta(days=r.randrange(60)) if r.random() < 0.3 else None) for i in range(14)]
    name = [n for n, _, _ in nodes]
    edges = []
    for i in range(60):
        s, d = r.choice(name), r.choice(name)
        edges.append((f"e{i}", s, d, r.choice(["SUPPLIES", "DEPENDS_ON", "HAS_RISK", "PARTNERS_WITH"]), T0 + timedelta(days=r.randrange(90)) if r.random() < 0.9 else None, r.choice([0.5, 0.9, 0.9, 0.95, 1.0, 0.77]), r.choice([True, None, None, None, False])))
    texts = ["What does it depend on?", "Which company is it?", "Plain words", "What companies depend on it?"]
    asked = []
    for q in range(24):
        intents = r.choice([[], ["SUPPLIES"], ["DEPENDS_ON", "SUPPLIES"], ["HAS_RISK"]])
        asked.append((q, r.choice(texts), r.sample(name, r.randrange(0, 4)), intents, T0 + timedelta(days=r.randrange(100)) if r.random() < 0.6 else None, r.randrange(1, 4), True, q == 5))
    for k in (1, 4, 12):
        check_paths(spark, asked, edges, nodes, k)


def test_walks_through_a_hub(spark):
    """Hundreds of equal edges at one node: the best few of some hundred thousand paths of three hops."""
    nodes = [(f"company:{i}", "Company", None) for i in range(160)]
    edges = [(f"h{i:03}", f"company:{i}", "company:0", "SUPPLIES", T0, 0.9 if i % 5 else 0.91, None) for i in range(1, 160)]
    edges += [(f"x{i:03}", f"company:{i}", f"company:{i + 1}", "HAS_RISK", T0, 0.8, None) for i in range(1, 159)]
    asked = [(1, "a", ["company:0"], ["HAS_RISK"], None, 3, True, False), (2, "b", ["company:7"], [], None, 3, True, False), (3, "c", ["company:9", "company:40"], ["SUPPLIES"], None, 3, True, False)]
    check_paths(spark, asked, edges, nodes, 6)


def test_evidence_of_paths(spark):
    edges = spark.createDataFrame(
        [("e1", "company:TSM", "company:NVDA", "SUPPLIES", "2024-02-01", "2024-01-20", 0.95, "c1", "d1", "TSM", True, "Q1"), ("e2", "company:ASML", "company:TSM", "SUPPLIES", "2024-02-15", None, 0.9, "c2", "d2", "ASML", None, None)],
        "edge_id string, src string, dst string, relationship string, a string, b string, confidence double, chunk_id string, document_id string, source_company string, provenance_verified boolean, fiscal_period string",
    ).withColumns({"available_ts": F.col("a").cast("timestamp_ntz"), "event_ts": F.col("b").cast("timestamp_ntz")})
    asked = spark.createDataFrame([(1, "q", ["company:NVDA"], [], None, 2, True, False)], ASKED)
    rows = {r.evidence_id: r for r in hybrid.evidence_rows(traversal.top_paths(asked, edges, 9), edges, spark.createDataFrame([("company:TSM", "TSMC")], "node_id string, name string")).collect()}
    one, two = rows["edge:e1"], rows["path:e1:e2"]
    assert one.text == "TSMC --[SUPPLIES]--> company:NVDA (period: Q1, as of 2024-02-01)" and one.attribution_status == "verified" and one.provenance_verified
    assert two.text == "TSMC --[SUPPLIES]--> company:NVDA -> company:ASML --[SUPPLIES]--> TSMC" and (two.document_id, two.chunk_id, two.source_company) == ("d2", "c2", "TSM")
    assert str(two.event_ts) == "2024-01-20 00:00:00" and str(two.available_ts) == "2024-02-15 00:00:00" and two.attribution_status == "verified_path"
    assert [(e.source, e.target) for e in two.graph_edges] == [("company:TSM", "company:NVDA"), ("company:ASML", "company:TSM")]
    doubted = edges.withColumn("provenance_verified", F.col("edge_id") != "e2")
    assert traversal.top_paths(asked, doubted, 9).count() == 1  # what is not verified is not walked
    held = hybrid.evidence_rows(traversal.top_paths(asked, edges, 9), doubted).where("hop_count = 2").first()
    assert not held.provenance_verified and held.attribution_status == "unverified_path_edge"  # a path holds if each of its edges does


# labels


def test_labels_by_text(spark):
    rows = [
        ("a", "company:NVDA", "risk:x", "HAS_RISK", "doc:sec:1", "k1", None), ("b", "company:TSM", "company:AAPL", "SUPPLIES", "doc:sec:2", "k2", None), ("c", "company:AAPL", "risk:y", "HAS_RISK", "doc:sec:2", "k2", None),
        ("d", "company:TSM", "risk:y", "HAS_RISK", "doc:sec:2", "k2", None), ("e", "company:TSM", "risk:y", "HAS_RISK", "doc:sec:2", "k3", None), ("f", "company:AAPL", "company:MSFT", "PARTNERS_WITH", "doc:sec:2", "k2", None),
        ("g", "company:AAPL", "company:MSFT", "PARTNERS_WITH", "doc:sec:2", "nowhere", None), ("h", "company:TSM", "x", "SUPPLIES", "doc:sec:2", "nowhere", None), ("i", "x", "y", "SUPPLIES", None, "k1", None),
        ("j", "company:NVDA", "y", "SUPPLIES", "doc:sec:9", "k1", None), ("k", "company:NVDA", "y", "SUPPLIES", "doc_amd_10k", "k1", None), ("l", "company:NVDA", "y", "SUPPLIES", "doc:sec:9", "k1", False), ("m", "risk:y", "risk:x", "AFFECTED_BY", "doc:sec:2", "k2", None),
    ]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, relationship string, document_id string, chunk_id string, provenance_verified boolean")
    chunks = spark.createDataFrame([("k1", "Our servers, including graphics processing units."), ("k2", "We depend on suppliers including TSMC for silicon."), ("k3", "Delays from TSMC would hurt.")], "chunk_id string, text string")
    issuers = spark.createDataFrame([("doc:sec:1", "MSFT"), ("doc:sec:2", "AAPL")], "document_id string, issuer string")
    terms = spark.createDataFrame([("company:NVDA", ["nvidia"]), ("company:TSM", ["tsmc"]), ("company:MSFT", ["microsoft"])], "node_id string, terms array<string>")
    got = {r.edge_id: (r.provenance_verified, r.attribution_status, r.source_company) for r in provenance.label_edges(edges, chunks, issuers, terms).collect()}
    assert got == {
        "a": (False, "unsupported_cross_company", "MSFT"), "b": (True, "verified_cross_company", "AAPL"), "c": (True, "verified_issuer", "AAPL"), "d": (False, "unsupported_cross_company_risk", "AAPL"), "e": (True, "verified_cross_company", "AAPL"),
        "f": (False, "unsupported_cross_company", "AAPL"), "g": (True, "verified_issuer", "AAPL"), "h": (False, "unsupported_cross_company", "AAPL"), "i": (False, "missing_provenance", None), "j": (False, "unknown_issuer", None),
        "k": (True, "verified_mock_fixture", "AMD"), "l": (False, "explicit", None), "m": (True, "verified_cross_company", "AAPL"),
    }
    free = provenance.label_edges(edges.where("edge_id in ('i', 'k')"), chunks, issuers, terms).collect()  # a graph without filings
    assert {r.attribution_status for r in free} == {"verified_mock_fixture"}
    assert provenance.label_edges(edges.limit(0), chunks, issuers, terms).count() == 0


# search


def test_search_under_filters_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v[i].tolist(), f"c{i % 4 if i < 200 else 0}", "p" + str(i % 3), ["10-K", "10-Q"][i % 2], None if i % 11 == 0 else T0 + timedelta(days=i % 50)) for i in range(300)]
    rows += [(1000, None, "c1", "p0", "10-K", T0), (1001, [0.0] * 8, "c1", "p0", "10-K", T0), (1002, [float("nan")] * 8, "c1", "p0", "10-K", T0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, company string, fiscal_period string, document_type string, available_ts timestamp_ntz")
    searches = []
    for s in range(60):
        q = rng.normal(size=8).tolist()
        searches.append((s, q, int(rng.integers(1, 9)), [None, T0 + timedelta(days=int(rng.integers(0, 50)))][s % 2], [None, "c0", "c1", "zz"][s % 4], [None, "p1"][(s // 4) % 2], [None, "10-Q"][(s // 8) % 2]))
    asked = spark.createDataFrame(searches, "search_id long, q array<double>, k int, reference timestamp_ntz, company string, fiscal_period string, document_type string")
    got = {}
    for r in retrieval.search(vectors, asked, vector_block=16, search_block=5).orderBy("search_id", "rank").collect():
        got.setdefault(r.search_id, []).append((r.vec_id, r.score))
    for s, q, k, ref, company, period, form in searches:
        ok = [i for i, _, c, p, d, t in rows[:300] if (company is None or c == company) and (period is None or p == period) and (form is None or d == form) and (ref is None or (t is not None and t <= ref))]
        cos = {i: round(float(v[i].astype(float) @ np.array(q) / np.linalg.norm(v[i].astype(float)) / np.linalg.norm(q)), 6) for i in ok}
        assert [i for i, _ in got.get(s, [])] == sorted(ok, key=lambda i: (-cos[i], i))[:k]  # noqa: B023
    assert retrieval.search(vectors.limit(0), asked).count() == 0 and retrieval.search(vectors, asked.limit(0)).count() == 0


def test_scoped_searches_come_first(spark):
    at = lambda d: T0 + timedelta(days=d)
    rows = [(1, [1.0, 0.1], "company:A", "2023-12-31", "10-K", at(1)), (2, [1.0, 0.2], "company:A", "2024-03-31", "10-Q", at(9)), (3, [1.0, 0.3], "company:B", "2024-03-31", "10-Q", at(1)), (4, [1.0, 0.0], "company:C", None, "8-K", at(1)), (5, [1.0, 0.4], "company:A", None, "DEF 14A", at(1))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, company string, fiscal_period string, document_type string, available_ts timestamp_ntz")
    asked = spark.createDataFrame(
        [(1, "the latest of it", ["company:A"], [], at(5), 1, False, False), (2, "who owns it", ["company:A"], [], at(5), 1, False, False), (3, "who owns it", ["company:B"], [], None, 1, False, False), (4, "the latest of it", ["company:A"], [], None, 1, False, True)], ASKED
    )
    side = hybrid.vector_side(asked, vectors, lambda c: F.array(F.lit(1.0), F.lit(0.0)), 3)
    got = {}
    for r in side.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.chunk_id, r.topical))
    assert got[1] == [(1, False), (5, False), (4, False)]  # its newest known period, the rest of its own, then all; vector 2 is later
    assert got[2] == [(5, True), (1, False), (4, False)] and got[3][0] == (3, True) and 4 not in got  # the topic's form, any form without it; no reading of a time, no search


# the gate

EV = "question_id int, rank int, evidence_id string, text string, document_id string, chunk_id string, available_ts timestamp_ntz, hop_count int, relationships array<string>, source_company string, provenance_verified boolean, attribution_status string, graph_edges array<struct<source:string,relationship:string,target:string>>, path array<string>"
NODES = [("company:NVDA", "NVIDIA Corporation", None), ("company:AAPL", "Apple Inc.", None), ("company:MSFT", "Microsoft Corporation", None), ("company:TSM", "Taiwan Semiconductor Manufacturing", ["tsmc"])]


def check_gate(spark, cases):
    """Each case is (question, entities, intents, hops), evidence, what is expected (a reason, or missing entities), and modes; one run for each combination of modes."""
    asked, rows, groups = [], [], {}
    for q, ((question, entities, intents, hops), evidence, _, modes) in enumerate(cases):
        modes = dict(modes)
        asked.append((q, question, entities, intents, modes.pop("reference", None), hops, hops > 1, modes.pop("unreadable", False)))
        groups.setdefault(tuple(sorted(modes.items())), []).append(q)
        for i, e in enumerate(evidence, 1):
            edges = e.get("edges", [])
            rows.append((q, i, f"e{i}", e.get("text", ""), e.get("doc", "d"), "c", e.get("at", T0), e.get("hops", 1), e.get("rels", [r for _, r, _ in edges]), e.get("company"), e.get("verified", True), e.get("status"), edges, e.get("path", [])))
    terms = gate.entity_terms(spark.createDataFrame(NODES, "node_id string, name string, aliases array<string>"))
    a, ev = spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, EV)
    for modes, own in groups.items():
        for r in gate.gate(a.where(F.col("question_id").isin(own)), ev, terms, **dict(modes)).collect():
            want = cases[r.question_id][2]
            assert (r.missing_entities if isinstance(want, list) else r.reason) == want, (cases[r.question_id], r)
            assert r.sufficient == (r.reason in ("sufficient", "disabled"))


def test_gate_in_order(spark):
    risk = ("What risks affect NVIDIA?", ["company:NVDA"], ["HAS_RISK", "AFFECTED_BY"], 1)
    supplies = ("What company supplies NVIDIA?", ["company:NVDA"], ["SUPPLIES"], 1)
    two = ("Does TSMC supply Apple and Microsoft?", ["company:AAPL", "company:MSFT"], ["SUPPLIES"], 1)
    indirect = ("Which supplier connects ASML to NVIDIA indirectly?", ["company:NVDA"], ["SUPPLIES"], 2)
    half = ("x", ["company:AAPL", "company:MSFT", "company:NVDA"], [], 1)
    good = {"text": "TSMC --[SUPPLIES]--> NVIDIA", "rels": ["SUPPLIES"]}
    check_gate(
        spark,
        [
            (supplies, [good], "sufficient", {}), (supplies, [], "count", {}), (supplies, [good], "temporal", {"reference": datetime(2023, 1, 1)}), (supplies, [good], "temporal", {"unreadable": True}), (supplies, [good | {"doc": None}], "provenance", {}),
            (supplies, [good | {"verified": False, "status": "unsupported_cross_company"}, {"text": "other"}], ["company:NVDA"], {}), (two, [{"text": "TSMC supplies Apple Inc.", "rels": ["SUPPLIES"]}], ["company:MSFT"], {}),
            (risk, [{"text": "NVIDIA manufactures GPUs", "rels": ["MANUFACTURES"]}], "relationship", {}), (risk, [{"text": "NVIDIA is exposed to threats"}], "sufficient", {"relationship_mode": "textual"}),
            (indirect, [good], "hops", {}), (indirect, [good], "sufficient", {"hop_mode": "soft"}), (indirect, [good], "hops", {"hop_mode": "adaptive"}), (indirect, [good | {"hops": 2}], "sufficient", {}),
            (risk, [{"text": "x"}], "disabled", {"enabled": False}), (half, [{"text": "apple"}], "entity", {"entity_mode": "partial"}), (half, [{"text": "apple and nvidia"}], "sufficient", {"entity_mode": "partial"}),
        ],
    )
    with pytest.raises(ValueError):
        check_gate(spark, [(half, [good], "", {"hop_mode": "loose"})])


def test_gate_of_regulators_and_documents(spark):
    asked = ("What regulatory action did the FTC or the European Commission take on Apple?", ["company:AAPL", "regulator:EC", "regulator:FTC"], [], 1)
    check_gate(
        spark,
        [
            (asked, [{"text": "The Federal Trade Commission opened an investigation of Apple"}], "sufficient", {}),  # one of the two will do
            (asked, [{"text": "The FTC is in Washington, Apple is not"}], ["regulator:EC", "regulator:FTC"], {}), (("What do SEC filings say of Apple?", ["company:AAPL", "regulator:SEC"], [], 1), [{"text": "apple"}], "sufficient", {}),
        ],
    )


def test_chains(spark):
    q = ("What risks affect the real estate landlords leasing data centers to Microsoft's cloud infrastructure partners?", ["company:MSFT"], ["PARTNERS_WITH", "HAS_RISK"], 3)
    partner = {"text": "Equinix partners with Microsoft", "edges": [("Equinix", "PARTNERS_WITH", "company:MSFT")]}
    lease = {"text": "Digital Realty leases to Equinix", "edges": [("Digital Realty", "LEASES_TO", "Equinix")]}
    risk = {"text": "Digital Realty faces risks", "edges": [("Digital Realty", "HAS_RISK", "Power Grid")]}
    whole = {"text": "Microsoft", "edges": [("x", "LEASES", "Equinix"), ("equinix", "PARTNERS_WITH", "y"), ("y", "OWNS", "company:MSFT"), ("X", "AFFECTED_BY", "z")]}
    s = ("What risks affect companies that supply NVIDIA?", ["company:NVDA"], ["SUPPLIES", "HAS_RISK"], 2)
    supply, own = {"text": "nvidia", "edges": [("company:TSM", "SUPPLIES", "company:NVDA")]}, {"text": "risk", "edges": [("TSMC", "HAS_RISK", "risk:quake")]}
    direct = ("How is NVIDIA connected to TSMC through supply?", ["company:NVDA", "company:TSM"], ["DEPENDS_ON", "SUPPLIES"], 2)
    soft, adaptive = {"hop_mode": "soft"}, {"hop_mode": "adaptive"}
    check_gate(
        spark,
        [
            (q, [partner, lease, risk], "sufficient", soft), (q, [partner, risk], "chain", soft), (q, [partner, lease | {"edges": [("Digital Realty", "LEASES_TO", "CyrusOne")]}, risk], "chain", soft),
            (q, [whole, partner | {"edges": [("a", "PARTNERS_WITH", "b")]}], "sufficient", soft),  # one path of three
            (s, [supply, own], "sufficient", soft),  # one by its id, one by its alias
            (s, [supply, {"text": "risk", "edges": [("company:NVDA", "HAS_RISK", "risk:quake")]}], "chain", soft),  # the target's own risk
            (s, [{"text": "nvidia", "edges": [("company:NVDA", "SUPPLIES", "company:TSM")]}, own], "chain", soft),  # reversed
            (s, [supply, own], "sufficient", adaptive), (s, [supply, own], "hops", {}), (s, [{"text": "x"}] * 10 + [supply, own], "chain", soft),  # beyond the first ten
            (s, [{"text": "nvidia's vendor has a shortage", "rels": ["SUPPLIES"]}], "sufficient", soft | {"relationship_mode": "textual"}),
            (direct, [{"text": "We use TSMC", "company": "NVDA", "edges": [("company:NVDA", "DEPENDS_ON", "company:TSM")]}], "sufficient", adaptive), (direct, [{"text": "We use TSMC", "rels": ["SUPPLIES"]}, {"text": "nvidia"}], "hops", adaptive),
        ],
    )


# paths, ids, times, tests


def test_path_matches(spark):
    want = [("company:NVDA", "DEPENDS_ON", "USG"), ("USG", "HAS_RISK", "Export Restrictions")]
    cases = {
        1: ([want], True), 2: ([[("USG", "DEPENDS_ON", "company:NVDA"), want[1]]], False), 3: ([[("company:NVDA", "COMPETES_WITH", "USG"), want[1]]], False), 4: ([[("company:NVDA", "DEPENDS_ON", "TSMC"), want[1]]], False),
        5: ([], False), 6: ([[("company:AAPL", "COMPETES_WITH", "x")], [want[1]], [("Company NVDA Corp", "depends_on", "the usg"), ("usg", "has_risk", "export-restrictions"), ("a", "B", "c")]], True), 7: ([[want[0]]], False),
    }
    kind = f"question_id int, edges {pathmatch.EDGE}"
    expected = spark.createDataFrame([(q, want) for q in cases], kind)
    found = spark.createDataFrame([(q, p, i) for q, (paths, _) in cases.items() for i, p in enumerate(paths, 1)], kind + ", rank int")
    got = {r.question_id: r for r in pathmatch.match_paths(expected, found).collect()}
    assert {q: r.matched for q, r in got.items()} == {q: ok for q, (_, ok) in cases.items()} and got[6].first_rank == 3 and got[5].n_retrieved == 0
    assert pathmatch.path_accuracy(pathmatch.match_paths(expected, found)).first().accuracy == round(2 / 7, 6)
    one = spark.createDataFrame([(1, [("a", None, None)])], kind)
    assert pathmatch.match_paths(one, spark.createDataFrame([(1, [("A:1", "X", "y")], 1)], kind + ", rank int")).first().matched


def test_canonical_ids(spark):
    texts = ["plain", 'quo"te \\ back', "tab\tnl\n\r\b\f\x01\x1f\x7f", "é ñ 日本", "😀  ", "", "ends\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", ids.json_string(F.col("t")).alias("a"), ids.json_string(F.col("t"), ascii=False).alias("u"), ids.uuid5(F.col("t")).alias("v")).collect():
        assert r.a == json.dumps(r.t) and r.u == json.dumps(r.t, ensure_ascii=False), r.t
        assert r.t is None or r.v == str(uuid.uuid5(uuid.NAMESPACE_URL, r.t))
    own = {"source": "s é", "target": "t", "relationship": "R", "event_time": None, "available_time": "2024", "properties": {"a": 1, "b": "x"}}
    props = ids.json_object({"b": ids.json_string(F.lit("x")), "a": ids.json_number(F.lit(1))})
    got = spark.range(1).select(ids.edge_id(F.lit("s é"), F.lit("R"), F.lit("t"), F.lit(None).cast("string"), F.lit("2024"), props).alias("e"), ids.document_id(F.lit("sec"), F.lit("Ñ"), F.lit("10-K"), F.lit(None).cast("string"), F.lit("u")).alias("d")).first()
    assert got.e == "s é->R->t:" + hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    doc = {"source": "sec", "company": "Ñ", "document_type": "10-K", "source_reference": None, "source_url": "u"}
    assert got.d == "doc:sec:" + hashlib.sha256(json.dumps(doc, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def test_times_and_cutoffs(spark):
    said = {
        "as of Jun 5, 2025": "2025-06-05 00:00:00", "by Sept 30 2024": "2024-09-30 00:00:00", "prior to Dec 1, 2023": "2023-12-01 00:00:00", "in may 3, 2024": "2024-05-03 00:00:00", "none at all": None, "by Feb 30, 2024": "unreadable", "2023-13-01": "unreadable",
    }
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", time.reference_time(F.col("t")).alias("r"), time.cutoff_window(F.col("t")).alias("c"))
    rows = {r.t: r for r in df.collect()}
    shown = lambda w: None if w is None else "unreadable" if w.unreadable else str(w.reference)
    assert {t: shown(r.r) for t, r in rows.items()} == said
    assert shown(rows["in may 3, 2024"].c) is None and shown(rows["by Feb 30, 2024"].c) == "unreadable" and shown(rows["as of Jun 5, 2025"].c) == "2025-06-05 00:00:00"


def test_analysis_of_documents_and_regulators(spark):
    nodes = spark.createDataFrame([("company:AAPL", "Company", "Apple Inc.", None), ("risk:competition", "Risk", "Competition", None), ("company:firm", "Company", "firm", None), ("event:may", "Event", "May", None)], "node_id string, node_type string, name string, aliases array<string>")
    q = {
        1: "How do Apple and the FTC connect?", 2: "Compare margins", 3: "What do SEC filings of Apple say?", 4: "What did the SEC and the U.S. Federal Trade Commission do?", 5: "What firm did Apple face competition from in May?", 6: "What of XYZ and ABC?", 7: "the $1,000 of 2025",
    }
    got = {r.question_id: r for r in analysis.analyse(spark.createDataFrame(list(q.items()), "question_id int, question string"), analysis.node_terms(nodes)).collect()}
    assert {k: r.entities for k, r in got.items()} == {1: ["company:AAPL", "regulator:FTC"], 2: [], 3: ["company:AAPL"], 4: ["regulator:FTC", "regulator:SEC"], 5: ["company:AAPL"], 6: ["company:ABC", "company:XYZ"], 7: []}
    assert got[1].cross_document and got[2].cross_document and not got[3].cross_document
    off = spark.createDataFrame([("the capital return plan",), ("a poem",), ("10-K",), ("stocky",), ("aim",)], "t string").select("t", analysis.off_topic(F.col("t"), F.lit(0)).alias("o")).collect()
    assert {r.t: r.o for r in off} == {"the capital return plan": False, "a poem": True, "10-K": False, "stocky": False, "aim": True}


def test_exact_signed_ranks(spark):
    r = random.Random(4)
    rows, want = [], {}
    for g in range(12):
        d = [r.choice([-3, -2, -1, 0, 1, 1, 2, 4, 5]) for _ in range(r.randrange(1, 11))]
        rows += [(g, x, 0) for x in d]
        d = [x for x in d if x]
        if not d:
            continue
        size = sorted(abs(x) for x in d)
        rank = [size.index(abs(x)) + (size.count(abs(x)) + 1) / 2 for x in d]
        w = min(sum(k for k, x in zip(rank, d, strict=True) if x > 0), sum(k for k, x in zip(rank, d, strict=True) if x < 0))
        sums = [sum(itertools.compress(rank, bits)) for bits in itertools.product((0, 1), repeat=len(d))]
        want[g] = (w, len(d), round(min(1.0, 2 * sum(s <= w for s in sums) / len(sums)), 6))
    got = {x.g: (x.w, x.n, x.p) for x in evaluation.wilcoxon(spark.createDataFrame(rows, "g int, x int, y int"), ["g"], "x", "y").collect()}
    assert got == want
    many = spark.createDataFrame([(0, i, 0 if i % 3 else 2 * i) for i in range(1, 121)], "g int, x int, y int")
    exact, normal = (evaluation.wilcoxon(many, ["g"], "x", "y", exact=e).first().p for e in (200, 50))
    assert abs(exact - normal) < 0.01


# pages


def shown_text(root):
    """The same of well-formed pages, by a tree and recursion."""
    parts = []

    def go(e):
        style = e.attrib.get("style", "").replace(" ", "").lower()
        name = e.tag.split("}")[-1].lower()
        if name in ("script", "style", "noscript", "svg", "head", "header-ix") or "hidden" in e.attrib or e.attrib.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            return
        for t in (e.text, *[x for c in e for x in (c, c.tail)]):
            if isinstance(t, ET.Element):
                go(t)
            elif t and t.strip():
                parts.append(t.strip())

    go(root)
    return " ".join(" ".join(parts).split())


def test_visible_text(spark):
    r = random.Random(8)

    def page(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice(["words", "more &amp; words", " x ", "", "é"])
        tag = r.choice(["div", "p", "span", "b", "script", "td", "svg", "noscript"])
        attr = r.choice(["", "", "", ' hidden="hidden"', ' aria-hidden="true"', ' aria-hidden="false"', ' style="DISPLAY : none"', ' style="color:red"', ' style="visibility: hidden"'])
        inner = r.choice(["words", "y"]) if tag == "script" else "".join(page(depth - 1) for _ in range(r.randrange(0, 4)))
        return f"<{tag}{attr}>{inner}</{tag}>"

    pages = ["<html><body>" + page(5) + page(5) + "</body></html>" for _ in range(150)]
    special = {
        "<ix:header><div>gone</div><ix:hidden>x</ix:hidden></ix:header><p>A&nbsp;B</p>": "A B", "<div hidden><p>in<br>side</div>out": "out", "a<!-- no -->b<br/>c": "a b c", "</p>x<b>y": "x y", "": "", "one\n\n\n\ntwo": "one\n\ntwo",
        "<p style='display:none'>x<p>y</p></p>z": "z", "<head><title>t</title></head>t": "t",
    }
    rows = [(i, p) for i, p in enumerate([*pages, *special])] + [(-1, None)]
    got = {x.i: x.t for x in spark.createDataFrame(rows, "i int, p string").select("i", html.visible_text(F.col("p")).alias("t")).collect()}
    assert got[-1] is None and [got[len(pages) + k] for k in range(len(special))] == list(special.values())
    for i, p in enumerate(pages):
        assert " ".join(got[i].split()) == shown_text(ET.fromstring(p)), p
    long = "<div>" * 100_000 + "x" + "</i></b>" * 100_000
    assert spark.createDataFrame([(long,)], "p string").select(html.visible_text(F.col("p")).alias("t")).first().t == "x"


def test_settled_tables_follow_their_files(spark, tmp_path):
    from asofworks.plans import base

    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "a.parquet"))

    get = lambda: base.kept(spark, str(tmp_path), "thing", ("a", "absent"), make)
    first = get()
    assert get() is first and len(made) == 1 and first.count() == 3
    folder = first.inputFiles()[0].rpartition("/")[0]
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "a.parquet"))
    assert get().count() == 5 and len(made) == 2 and not sinks.exists(spark, folder)
    assert sinks.release(spark) > 0 and get().count() == 5 and len(made) == 3


def test_balance_shares_out(spark):
    """Against the greedy choice, piece by piece."""
    r = random.Random(6)
    asked, rows, want = [], [], {}
    for q in range(40):
        entities = r.sample(["company:A", "company:B", "company:C", "regulator:FTC"], r.randrange(0, 4))
        asked.append((q, "q", entities, [], None, 1, False, False))
        pool = []
        for i in range(1, 12):
            edges = [(f"company:{r.choice('ABX')}", "R", f"company:{r.choice('CY')}")] if r.random() < 0.4 else []
            pool.append((q, i, f"e{i:02}", round(r.choice([0.1, 0.2, 0.3]), 2), r.choice(["ftc said", "of c", "nothing", "A B"]), r.choice([None, "A", "b", "z"]), r.choice([True, None, False]), edges))
        rows += pool

        def speaks(p, e):
            bare = e.split(":")[1]
            ends = [x for s, _, t in p[7] for x in (s, t)]
            return (p[5] or "").upper() == bare.upper() or e in ends or bare.upper() in [x.upper() for x in ends] or (p[6] is not False and bare.lower() in p[4].lower())

        taken = []
        for e in entities if len(entities) > 1 else []:
            taken += [p for p in pool if p not in taken and speaks(p, e)][:2]
        taken += [p for p in pool if p not in taken][: max(0, 5 - len(taken))]
        want[q] = [p[2] for p in sorted(taken, key=lambda p: (-p[3], p[1], p[2]))][:5]
    ev = spark.createDataFrame(rows, "question_id int, rank int, evidence_id string, score double, text string, source_company string, provenance_verified boolean, graph_edges array<struct<source:string,relationship:string,target:string>>")
    got = {}
    for x in hybrid.balance(ev, spark.createDataFrame(asked, ASKED), 5, 2).orderBy("question_id", "rank").collect():
        got.setdefault(x.question_id, []).append(x.evidence_id)
    assert got == want


def test_rates_of_the_future(spark):
    day = lambda d: T0 + timedelta(days=d)
    q = spark.createDataFrame([(1, day(5)), (2, day(5)), (3, None), (4, day(5))], "question_id int, reference timestamp_ntz")
    items = [(1, "pre_filter", day(9)), (1, "pre_filter", day(1)), (1, "post_filter", day(1)), (2, "pre_filter", None), (2, "context", day(8)), (2, "cited", day(1)), (3, "cited", day(99))]
    rows = temporal.question_rows(q, spark.createDataFrame(items, "question_id int, stage string, available_ts timestamp_ntz"))
    got = {r.question_id: r for r in rows.collect()}
    assert (got[1].feir_pre_filter, got[1].feir_post_filter, got[1].feir_cited, got[1].rejections, got[1].valid) == (0.5, 0.0, None, 1, True)
    assert (got[2].feir_pre_filter, got[2].feir_context, got[2].valid) == (0.0, 1.0, False) and got[3].valid and got[3].feir_cited is None
    assert not got[4].valid  # nothing was looked at, so nothing is shown
    s = temporal.suite(rows).first()
    assert (s.n_questions, s.n_temporal, s.feir_pre_filter, s.n_cited, s.rejections, s.compliance) == (4, 3, 0.25, 1, 1, round(1 / 3, 6))
    none = temporal.suite(rows.where("question_id = 3")).first()
    assert none.n_temporal == 0 and none.compliance == 0.0 and none.feir_cited is None
    a = temporal.ablation(rows).first()
    assert (a.without_filter, a.with_filter, a.relative_pct) == (0.25, 0.0, 100.0)


def test_walk_forward_fits_every_fold(spark):
    """Weights of all folds against a fit of each fold alone; a scaler never sees the rows it is tested on."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 2)) * [1.0, 50.0] + [0.0, 7.0]
    y = (x[:, 0] + 0.02 * x[:, 1] + rng.normal(size=260) > 0).astype(int)
    rows = spark.createDataFrame([(f"{i:04}", float(a), float(b) if i % 50 else None, int(k)) for i, ((a, b), k) in enumerate(zip(x, y, strict=True))], "d string, a double, b double, label int")
    folded = features.walk_forward(rows, "d", 100, 40)
    fitted = {r.fold: r for r in models.fit_folds(folded, ["a", "b"], "label").collect()}
    assert sorted(fitted) == [0, 1, 2, 3]
    for f, r in fitted.items():
        use = [i for i in range(100 + 40 * f) if i % 50]
        m, s = x[use].mean(0), x[use].std(0)
        z, w = np.column_stack([np.ones(len(use)), (x[use] - m) / s]), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([0, 1, 1]), z.T @ (y[use] - p) - np.array([0, 1, 1]) * w)
        assert np.allclose(r.weights, w, atol=1e-6) and np.allclose(r.means, m) and np.allclose(r.sizes, s) and r.n_train == len(use)
    folds, summary = models.compare(folded, "label", {"both": ["a", "b"], "noise": ["b"]})
    table = {(r.model, r.fold): r for r in folds.collect()}
    assert len(table) == 12 and all(0 <= r.accuracy <= 1 for r in table.values())
    best = {r.model: r for r in summary.collect()}
    assert best["both"].mean_accuracy > best["prior"].mean_accuracy and best["prior"].mean_difference == 0 and best["both"].auc > best["noise"].auc and best["prior"].p == 1.0


def test_node_types_fail_where_unknown(spark):
    df = spark.createDataFrame([(" company ",), ("RISK",)], "t string")
    assert [r.t for r in df.select(build.node_type_or_fail(F.col("t")).alias("t")).collect()] == ["Company", "Risk"]
    with pytest.raises(Exception, match="Unknown node type"):
        spark.createDataFrame([("planet",)], "t string").select(build.node_type_or_fail(F.col("t"))).collect()


def test_candidates_meet_few_chunks(spark):
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdE é日") for _ in range(n))
    chunks = [(f"c{i:02}", text(r.randrange(0, 60))) for i in range(50)] + [("n", None), ("long", "xyz" * 40_000 + "needle")]
    items = [(i, r.sample(["a", "b", "z"], r.randrange(0, 3)), [text(r.randrange(0, 4)) for _ in range(r.randrange(0, 3))]) for i in range(40)] + [(90, None, None), (91, ["a"], ["NEEDLE"]), (92, ["a"], ["absent"])]
    got = validation.verify_candidates(
        spark.createDataFrame(items, "item_id int, entities array<string>, required array<string>"), spark.createDataFrame(chunks, "chunk_id string, text string"), spark.createDataFrame([("a",), ("b",)], "node_id string"), 3
    )
    rows = {x.item_id: x for x in got.collect()}
    for i, entities, required in items:
        hit = [] if required is None else sorted(c for c, t in chunks if t is not None and all(q.lower() in t.lower() for q in required))
        assert (rows[i].n_chunks, rows[i].chunk_ids, rows[i].verified) == (len(hit), hit[:3], bool(hit) and all(e in "ab" for e in entities or [])), (i, required)
