"""Projections of source records to normal shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import filing_url, normalize_cik, stable_id
from .time import parse_ts

FORMS = ("10-K", "10-Q", "8-K")


def _iso(c: Column) -> Column:
    return F.date_format(parse_ts(c), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def filing(rows: DataFrame) -> DataFrame:
    """Raw filing rows (names as in the source's JSON, ``ticker`` and ``cik`` beside) to normal records."""
    cik = normalize_cik(F.col("cik"))
    return rows.select(
        F.upper(F.trim("ticker")).alias("ticker"), cik.alias("cik"), F.upper(F.trim("form")).alias("form"), F.col("filingDate").alias("filing_date"), F.col("reportDate").alias("report_date"),
        _iso(F.col("acceptanceDateTime")).alias("acceptance_datetime"), F.col("accessionNumber").alias("accession_number"), F.col("primaryDocument").alias("primary_document"),
        filing_url(cik, F.col("accessionNumber"), F.col("primaryDocument")).alias("source_url"),
    )


def _event(kind: str, ticker: Column, event: Column, available: Column, source: Column, data: Column) -> list[Column]:
    return [F.lit(kind).alias("event_type"), F.upper(ticker).alias("ticker"), event.alias("event_time"), available.alias("available_time"), source.alias("source"), data.alias("data")]


def unified(market: DataFrame, news: DataFrame, filings: DataFrame, macro: DataFrame) -> DataFrame:
    """All four sources as ``(event_type, ticker, event_time, available_time, source, data)``, data as JSON, by available_time (unknown first).

    Prices are available at their date's end, news when published, filings when accepted, macro values when ingested.
    """
    whole = lambda df: F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    null = F.lit(None).cast("string")
    parts = [
        market.select(*_event("market", F.col("ticker"), F.col("date").cast("string"), F.concat(F.col("date").cast("string"), F.lit("T23:59:59+00:00")), F.lit("market"), whole(market))),
        news.select(*_event("news", F.col("ticker"), F.col("published_at"), F.col("published_at"), F.col("source"), whole(news))),
        filings.select(*_event("sec_filing", F.col("ticker"), F.col("report_date"), F.coalesce("acceptance_datetime", "filing_date"), F.lit("sec"), whole(filings))),
        macro.select(*_event("macro", null, F.col("date"), F.col("ingested_at"), F.col("source"), whole(macro))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.col("available_time").asc_nulls_first(), "event_type", "ticker", "data")


def news_document(news: DataFrame) -> DataFrame:
    """News as documents: title, a blank line, description; known from publication on."""
    text = F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("description"), F.lit("")))
    ids = stable_id(F.lit("doc:news"), F.col("ticker"), F.col("title"), F.col("published_at"))
    return news.select(ids.alias("document_id"), F.upper("ticker").alias("company"), F.lit("news").alias("document_type"), "title", text.alias("text"), F.col("published_at").alias("publication_date"), F.col("published_at").alias("available_time"), F.col("url").alias("source_url"), F.create_map(F.lit("query"), F.coalesce("query", F.lit(""))).alias("metadata"))


def filing_document(filings: DataFrame, texts: DataFrame) -> DataFrame:
    """Normal filings with the text of their accession number, known from acceptance on; form, CIK and file in the metadata."""
    joined = filings.join(texts, "accession_number")
    ids = F.concat(F.lit("doc:sec:"), F.col("ticker"), F.lit(":"), F.col("accession_number"))
    kept = F.create_map(F.lit("cik"), F.col("cik"), F.lit("form"), F.col("form"), F.lit("primary_document"), F.coalesce("primary_document", F.lit("")))
    return joined.select(ids.alias("document_id"), F.col("ticker").alias("company"), F.col("form").alias("document_type"), F.concat_ws(" ", "ticker", "form", "report_date").alias("title"), "text", F.col("filing_date").alias("publication_date"), F.coalesce("acceptance_datetime", "filing_date").alias("available_time"), "source_url", kept.alias("metadata"))


def counts_by_form(filings: DataFrame, by: str) -> DataFrame:
    """Filings of each form, the rest as other."""
    known = F.col("form").isin(*FORMS)
    return filings.groupBy(by).agg(*[F.count_if(F.col("form") == f).alias("n_" + f.lower().replace("-", "")) for f in FORMS], F.count_if(~F.coalesce(known, F.lit(False))).alias("n_other"), F.count("*").alias("n"))
