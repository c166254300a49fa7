"""The query surface as plain calls, and over HTTP with the standard library.

``Service.handle(method, path, params)`` answers with a status and a JSON object; errors have one shape,
``{"error": {"code", "message"}}``. Every answer is a page or a summary, so little reaches the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import analysis, answers, hybrid, listing, traversal
from .sources.sinks import settle


class Fault(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def _whole(params: dict, name: str, default: int, low: int, high: int) -> int:
    try:
        n = int(params.get(name, default))
    except (TypeError, ValueError):
        raise Fault(422, f"{name} must be a whole number") from None
    if not low <= n <= high:
        raise Fault(422, f"{name} must be from {low} to {high}")
    return n


class Service:
    """Endpoints over ``nodes(node_id, node_type, name, aliases)``, ``edges(edge_id, src, dst, relationship, available_ts, confidence,
    chunk_id, document_id)``, ``chunks(chunk_id, document_id, company, document_type, text, corpus)``, ``documents(company, document_type,
    chunk_count, publication_date)`` and ``results(question_id, category, answerable, refused, token_f1)``.

    ``client(system, user)`` writes answers (without one the evidence alone is returned), ``fetch(company, form)`` brings new filings.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], client: Callable[[str, str], str] | None = None, fetch: Callable[[str, str], DataFrame] | None = None, prefix: str = "/api/v1"):
        self.spark, self.tables, self.client, self.fetch, self.prefix = spark, tables, client, fetch, prefix
        self.routes = {
            ("POST", "/query"): self.query, ("GET", "/graph/companies"): self.companies, ("GET", "/graph/subgraph"): self.subgraph, ("GET", "/graph/search"): self.search,
            ("GET", "/evidence/chunks"): self.chunks, ("GET", "/corpus/filings"): self.filings, ("GET", "/benchmark/summary"): self.summary, ("GET", "/benchmark/per-question"): self.per_question,
            ("GET", "/benchmark/demo-questions"): self.demo_questions, ("GET", "/benchmark/parametric-leakage"): self.leakage, ("GET", "/live/resolve"): self.resolve,
            ("GET", "/live/filings"): self.live_filings, ("POST", "/live/fetch"): self.live_fetch, ("GET", "/health"): self.health,
        }

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise Fault(503, f"no table of {name}")
        return self.tables[name]

    def handle(self, method: str, path: str, params: dict | None = None) -> tuple[int, dict]:
        route = self.routes.get((method.upper(), path.removeprefix(self.prefix)))
        try:
            if route is None:
                raise Fault(404, f"no {method} {path}")
            return 200, route(params or {})
        except Fault as e:
            return e.status, {"error": {"code": e.status, "message": str(e)}}
        except Exception as e:  # noqa: BLE001  a service answers whatever happens
            return 500, {"error": {"code": 500, "message": type(e).__name__}}

    def _analysed(self, text: str) -> DataFrame:
        asked = self.spark.createDataFrame([(0, text)], "question_id long, question string")
        return analysis.analyse(asked, analysis.node_terms(self.table("nodes")))

    def query(self, p: dict) -> dict:
        """Analyse, retrieve, rerank, judge; then package, and answer and check the answer if there is a client."""
        text = str(p.get("query", "")).strip()
        if not 2 <= len(text) <= 1000:
            raise Fault(422, "query must have 2 to 1000 characters")
        k = _whole(p, "top_k", 8, 1, 50)
        asked = self._analysed(text)
        edges = self.table("edges")

        def retrieve(a: DataFrame, fetch: int) -> DataFrame:
            best = traversal.top_paths(a, edges, fetch)
            return hybrid.evidence_rows(best, edges).join(a.select("question_id", "question", "intents"), "question_id")

        n = len(asked.first().entities)
        if asked.select(analysis.off_topic(F.col("question"), F.lit(n)).alias("off")).first().off:
            return {"query": text, "off_topic": True, "evidence": [], "sufficient": False}
        keep = lambda df: settle(df, "service")
        asked = keep(asked)
        best, gated = hybrid.orchestrate(asked, retrieve, top_k=k, keep=keep)
        packed = answers.package(asked, best, gated)
        row = packed.first()
        out = {"query": text, "entities": row.entities, "unresolved": row.unresolved, "intents": row.intents, "type": row.primary, "sufficient": bool(row.sufficient), "reason": row.reason,
               "evidence": [e.asDict() for e in row.evidence or []], "sources": row.sources or [], "paths": row.paths or []}
        late = [e for e in out["evidence"] if row.reference is not None and (e["available_time"] or "9") > str(row.reference)]
        out["future_items"], out["feir"] = len(late), len(late) / len(out["evidence"]) if out["evidence"] else None
        if self.client:
            got = answers.generate(answers.prompt(packed), self.client)
            checked = answers.validate(got, packed).first()
            out |= {"answer": got.first().raw, "valid": checked.is_valid, "errors": checked.errors}
        return out

    def companies(self, p: dict) -> dict:
        rows = listing.companies(self.table("nodes"), self.table("edges"), tuple(filter(None, str(p.get("first", "")).split(",")))).limit(_whole(p, "limit", 100, 1, 500)).collect()
        return {"companies": [{"id": r.node_id, "name": r.name, "degree": r.degree} for r in rows]}

    def subgraph(self, p: dict) -> dict:
        node = p.get("node_id") or ""
        if not self.table("nodes").where(F.col("node_id") == node).limit(1).count():
            raise Fault(404, f"no node {node}")
        rows = listing.subgraph(self.table("nodes"), self.table("edges"), node, p.get("type"))
        found, total, more = listing.page(rows, [F.desc_nulls_last("degree"), F.col("node_id"), F.col("edge_id")], _whole(p, "limit", 25, 1, 500), _whole(p, "offset", 0, 0, 10**9))
        return {"node": node, "total": total, "has_more": more, "edges": [{"id": r.edge_id, "source": r.src, "target": r.dst, "relationship": r.relationship, "neighbour": r.node_id, "name": r.name, "degree": r.degree} for r in found]}

    def search(self, p: dict) -> dict:
        text = str(p.get("q", "")).strip()
        if not text:
            raise Fault(422, "q must not be empty")
        return {"nodes": [{"id": r.node_id, "name": r.name, "degree": r.degree} for r in listing.search(self.table("nodes"), self.table("edges"), text, _whole(p, "limit", 20, 1, 500)).collect()]}

    def chunks(self, p: dict) -> dict:
        rows = listing.filtered(self.table("chunks"), p.get("company"), p.get("document_id"), p.get("document_type"))
        found, total, more = listing.page(rows.select("chunk_id", "document_id", "company", "document_type", T.truncate(F.col("text"), 700).alias("text")), [F.col("chunk_id")], _whole(p, "limit", 25, 1, 500), _whole(p, "offset", 0, 0, 10**9))
        return {"total": total, "has_more": more, "chunks": [r.asDict() for r in found]}

    def filings(self, p: dict) -> dict:
        rows = listing.corpus_coverage(self.table("documents")).orderBy("company").limit(_whole(p, "limit", 500, 1, 500)).collect()
        return {"companies": [r.asDict() for r in rows]}

    def summary(self, p: dict) -> dict:
        from .operators import evaluation

        rows = self.table("results")
        mean = rows.agg(F.count("*").alias("n"), F.round(F.avg("token_f1"), 4).alias("token_f1")).first().asDict()
        return mean | evaluation.refusal_metrics(rows).first().asDict()

    def per_question(self, p: dict) -> dict:
        found, total, more = listing.page(self.table("results"), [F.col("question_id")], _whole(p, "limit", 100, 1, 500), _whole(p, "offset", 0, 0, 10**9))
        return {"total": total, "has_more": more, "questions": [r.asDict() for r in found]}

    def demo_questions(self, p: dict) -> dict:
        from .operators.build import first_per_key

        return {"questions": [r.asDict() for r in first_per_key(self.table("results"), ["category"], ["question_id"]).orderBy("category").limit(50).collect()]}

    def leakage(self, p: dict) -> dict:
        from .operators import metrics

        n = self.table("results").agg(F.count("*").cast("double").alias("n"), F.count_if(~F.col("answerable") & ~F.col("refused")).cast("double").alias("k"))
        low, high = metrics.wilson(F.col("k"), F.col("n"))
        return n.select(F.col("n").cast("long").alias("total"), F.col("k").cast("long").alias("leaked"), F.try_divide("k", "n").alias("rate"), F.when(F.col("n") > 0, low).alias("low"), F.when(F.col("n") > 0, high).alias("high")).first().asDict()

    def resolve(self, p: dict) -> dict:
        """Registrants named in a text, longest names first, then tickers."""
        row = self._analysed(str(p.get("q", "")) or " ").first()
        return {"registrants": [e for e in row.entities if e.startswith("company:")], "unresolved": row.unresolved}

    def live_filings(self, p: dict) -> dict:
        rows = listing.filtered(self.table("chunks"), p.get("company"), live=True).groupBy("company", "document_id", "document_type").agg(F.count("*").alias("chunks"))
        found, total, more = listing.page(rows, [F.col("company"), F.col("document_id")], _whole(p, "limit", 25, 1, 500), _whole(p, "offset", 0, 0, 10**9))
        return {"total": total, "has_more": more, "filings": [r.asDict() for r in found]}

    def live_fetch(self, p: dict) -> dict:
        """New filings of a company through the given function; its tables are read anew from then on."""
        if self.fetch is None:
            raise Fault(503, "no source of new filings")
        company = str(p.get("company", "")).strip().upper()
        if not company:
            raise Fault(422, "company must not be empty")
        got = self.fetch(company, str(p.get("form", "10-K")))
        have = self.table("chunks")
        new = got.join(have.select("chunk_id"), "chunk_id", "left_anti").withColumn("corpus", F.lit("live")).select(have.columns)
        n = new.count()
        self.tables["chunks"] = have.union(new)
        return {"company": company, "new_chunks": n}

    def health(self, p: dict) -> dict:
        return {"status": "ok", "tables": {n: t.count() for n, t in sorted(self.tables.items())}, "client": self.client is not None}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """An HTTP server of the endpoints; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str, params: dict) -> None:
            status, body = service.handle(method, urlsplit(self.path).path, params)
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802  the name is the server's
            self._answer("GET", {k: v[-1] for k, v in parse_qs(urlsplit(self.path).query).items()})

        def do_POST(self) -> None:  # noqa: N802
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                params = json.loads(raw or b"{}")
            except ValueError:
                params = {}
            self._answer("POST", params if isinstance(params, dict) else {})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
