"""Whether an edge's source text bears it out: labels of edges by the chunks they were read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of the filing corpus; a graph without any is a fixture whose edges are taken as they are.
CORPUS = "doc:sec:"
# Relationships that must be discussed where another company's filing tells them, and the phrases that discuss a company's risk ({} is a term).
RISKS = ("HAS_RISK", "AFFECTED_BY")
RISK_PHRASES = ("{} risk", "risk to {}", "risk for {}", "{}'s risk", "{} face", "{} subject to", "disruptions at {}", "delays from {}")
# Tickers looked for, in this order, in the ids of documents outside the corpus.
TICKERS = ("AAPL", "MSFT", "NVDA", "AMZN", "GOOGL", "GOOG", "META", "TSLA", "TSM", "JPM", "XOM", "JNJ", "INTC", "AMD", "ASML", "AVGO", "QCOM")

NEW = ("provenance_verified", "attribution_status", "source_company")


def _own(edges: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in edges.columns else F.lit(None).cast(kind)


def label_edges(edges: DataFrame, chunks: DataFrame, issuers: DataFrame, terms: DataFrame, tickers: tuple[str, ...] = TICKERS) -> DataFrame:
    """``edges`` with ``provenance_verified``, ``attribution_status`` and ``source_company``, as columns of these names.

    ``edges(edge_id, src, dst, relationship, document_id, chunk_id)``, ``chunks(chunk_id, text)``, ``issuers(document_id, issuer)``,
    ``terms(node_id, terms)`` with lower-case terms (a node without any goes by its bare id). Eight outcomes:
    an edge that already says whether it is verified keeps its label (``explicit`` if it has none); without a document it is
    ``missing_provenance``; outside the corpus, or in a graph without corpus documents, ``verified_mock_fixture``;
    of a document without issuer ``unknown_issuer``. Where the source is a company other than the issuer, the chunk must name it
    (``unsupported_cross_company``) and, for a risk, discuss it (``unsupported_cross_company_risk``); where the target is, a
    chunk that has a text must name it. What remains is ``verified_issuer`` if the issuer is the source, else
    ``verified_cross_company``. Terms are looked for as substrings of the lower-cased chunk.

    Only edges that need one meet their chunk, and the text goes no further than that join.
    """
    doc, chunk = F.coalesce(F.col("document_id").cast("string"), F.lit("")), F.col("chunk_id").cast("string")
    known = _own(edges, "provenance_verified", "boolean")
    labelled = edges.withColumns({"known_": known, "label_": _own(edges, "attribution_status", "string"), "company_": _own(edges, "source_company", "string"), "doc_": doc, "chunk_": chunk}).drop(*NEW)
    in_corpus = not labelled.where(F.col("doc_").startswith(CORPUS)).isEmpty()
    one_issuer = issuers.groupBy(F.col("document_id").cast("string").alias("doc_")).agg(F.max("issuer").alias("issuer_"))
    rows = labelled.join(one_issuer, "doc_", "left").withColumn("issuer_", F.coalesce("company_", "issuer_"))
    bare = lambda c: F.regexp_extract(c, "^(?:[^:]*:)?(.*)$", 1)
    other = lambda c: F.col(c).startswith("company:") & (F.upper(bare(F.col(c))) != F.col("issuer_"))
    open_ = F.col("known_").isNull() & F.lit(in_corpus) & F.col("doc_").startswith(CORPUS) & (F.coalesce("issuer_", F.lit("")) != "")
    rows = rows.withColumns({"src_other": F.coalesce(open_ & other("src"), F.lit(False)), "dst_other": F.coalesce(open_ & other("dst"), F.lit(False))})
    asked = rows.where("src_other or dst_other").select("edge_id", "src", "dst", "chunk_").distinct()
    for end in ("src", "dst"):
        held = terms.select(F.col("node_id").alias(end), F.col("terms").alias(f"{end}_terms"))
        asked = asked.join(held, end, "left").withColumn(f"{end}_terms", F.when(F.size(F.coalesce(f"{end}_terms", F.expr("cast(array() as array<string>)"))) > 0, F.col(f"{end}_terms")).otherwise(F.array(F.lower(bare(F.col(end))))))
    texts = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("string").alias("chunk_"), F.lower(F.coalesce("text", F.lit(""))).alias("low_"))
    met = asked.join(texts, "chunk_", "left").withColumn("low_", F.coalesce("low_", F.lit("")))
    # a phrase holds its term, so phrases are looked for only where the term is
    names = lambda terms_, *phrases: F.exists(terms_, lambda t: F.when(F.col("low_").contains(t), _any([F.col("low_").contains(_phrase(p, t)) for p in phrases]) if phrases else F.lit(True)).otherwise(False))
    seen = met.groupBy("edge_id", "src", "dst", F.col("chunk_")).agg(F.max(names("src_terms")).alias("names_src"), F.max(names("src_terms", *RISK_PHRASES)).alias("risk_src"), F.max(names("dst_terms") | (F.col("low_") == "")).alias("names_dst"))
    seen = seen.select(*[F.col(c).alias(f"{c}_s") for c in ("edge_id", "src", "dst", "chunk_")], "names_src", "risk_src", "names_dst")
    same = (F.col("edge_id") == F.col("edge_id_s")) & (F.col("src") == F.col("src_s")) & (F.col("dst") == F.col("dst_s")) & F.col("chunk_").eqNullSafe(F.col("chunk__s"))
    rows = rows.join(seen, same, "left")
    held = lambda c: F.coalesce(F.col(c), F.lit(False))
    fixture = F.lit(not in_corpus)
    status = (
        F.when(F.col("known_").isNotNull(), F.coalesce("label_", F.lit("explicit"))).when(fixture, "verified_mock_fixture").when(F.col("doc_") == "", "missing_provenance")
        .when(~F.col("doc_").startswith(CORPUS), "verified_mock_fixture").when(F.coalesce("issuer_", F.lit("")) == "", "unknown_issuer")
        .when(F.col("src_other") & ~held("names_src"), "unsupported_cross_company").when(F.col("src_other") & F.upper("relationship").isin(*RISKS) & ~held("risk_src"), "unsupported_cross_company_risk")
        .when(F.col("dst_other") & ~held("names_dst"), "unsupported_cross_company").when(F.col("src") == F.concat(F.lit("company:"), F.col("issuer_")), "verified_issuer").otherwise("verified_cross_company")
    )
    spotted = F.coalesce(*[F.when(F.upper("doc_").contains(t), F.lit(t)) for t in tickers])
    company = F.when(F.col("known_").isNotNull(), F.col("company_")).when(F.col("attribution_status") == "verified_mock_fixture", spotted).when(F.col("attribution_status").isin("missing_provenance", "unknown_issuer"), F.lit(None)).otherwise(F.col("issuer_"))
    verified = F.when(F.col("known_").isNotNull(), F.col("known_")).otherwise(F.col("attribution_status").startswith("verified"))
    rows = rows.withColumn("attribution_status", status)
    return rows.select(*[c for c in edges.columns if c not in NEW], verified.alias("provenance_verified"), "attribution_status", company.alias("source_company"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _phrase(pattern: str, term: Column) -> Column:
    before, after = pattern.split("{}")
    return F.concat(F.lit(before), term, F.lit(after))


def verified_only(rows: DataFrame, flag: str = "verified") -> DataFrame:
    """Rows marked as verified; an unmarked one is not."""
    return rows.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
