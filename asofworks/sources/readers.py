"""Readers: each gives a DataFrame with a stated schema, so nothing is inferred and malformed rows have a defined fate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_cik
from .sinks import is_folder

# Schemas of the documents on disk.
NODE = "node_id string, node_type string, label string, properties map<string,string>, event_time string, available_time string"
EDGE = "edge_id string, source string, target string, relation string, confidence double, properties map<string,string>, event_time string, available_time string"
CHUNK = "chunk_id string, document_id string, chunk_index int, text string, available_time string"
OHLCV = "ticker string, date date, open double, high double, low double, close double, volume long"
FORMS = ("10-K", "10-Q", "8-K")


def company_universe(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``(ticker, company, sector, cik)`` of a CSV with header: trimmed, tickers in capitals, CIK padded to ten digits.

    Rows without ticker, company or CIK are dropped; ``strict`` fails the query on them and on repeated tickers.
    """
    raw = spark.read.option("header", True).csv(path)
    trimmed = raw.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("ticker", "company", "sector", "cik")])
    rows = trimmed.select(F.upper("ticker").alias("ticker"), "company", "sector", normalize_cik(F.col("cik")).alias("cik"))
    whole = (F.col("ticker") != "") & (F.col("company") != "") & (F.col("cik") != "")
    if not strict:
        return rows.where(whole)
    one = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.first(F.struct("company", "sector", "cik")).alias("r")).select("ticker", "r.*", "n")
    fault = F.when(~(whole & (F.length("cik") == 10)), F.raise_error(F.concat(F.lit("bad row of ticker "), "ticker"))).when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated ticker "), "ticker")))
    return one.withColumn("ticker", F.coalesce(fault.cast("string"), "ticker")).drop("n")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON object or an array of them each; ``file`` names the source file."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All chunk arrays of a folder's JSON files; records without chunk_id are no chunks."""
    return json_documents(spark, f"{folder.rstrip('/')}/*.json", CHUNK).where("chunk_id is not null")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph kept as one JSON object with two arrays."""
    whole = spark.read.schema(f"nodes array<struct<{_nested(NODE)}>>, edges array<struct<{_nested(EDGE)}>>").option("multiLine", True).json(path)
    return whole.select(F.inline("nodes")), whole.select(F.inline("edges"))


def _nested(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in schema.split(", ")))


def recent_filings(spark: SparkSession, path: str, forms: tuple[str, ...] = FORMS) -> DataFrame:
    """Filings of JSON documents that hold parallel arrays: one row each, ragged arrays padded with nulls, of the given forms."""
    names = ("accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument")
    held = ", ".join(f"{n}: array<string>" for n in names)
    raw = spark.read.schema(f"cik string, filings struct<recent: struct<{held}>>").option("multiLine", True).json(path)
    zipped = raw.select(normalize_cik(F.col("cik")).alias("cik"), F.explode(F.arrays_zip(*[F.coalesce(f"filings.recent.{n}", F.expr("cast(array() as array<string>)")).alias(n) for n in names])).alias("f"))
    fields = [F.col("f").getField(n).alias(n) for n in names]
    return zipped.select("cik", *fields).where(F.col("form").isin(*forms))


def parse_rfc2822(text: Column) -> Column:
    """``Tue, 03 Mar 2026 10:00:00 GMT`` (or a numeric zone) to a timestamp; otherwise null."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f"d MMM yyyy HH:mm:ss {z}")) for z in ("z", "Z")])


def rss(spark: SparkSession, path: str) -> DataFrame:
    """``(title, link, description, published_at, fingerprint)``; items without title, link or a readable date are dropped."""
    items = spark.read.format("xml").schema("title string, link string, description string, pubDate string").option("rowTag", "item").load(path)
    rows = items.select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), parse_rfc2822(F.col("pubDate")).alias("published_at"))
    mark = F.sha2(F.concat_ws("|", "title", "link", F.col("published_at").cast("string")).cast("binary"), 256)
    return rows.where("title <> '' and link <> '' and published_at is not null").withColumn("fingerprint", mark)


def parquet_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table as a stream of its files: a folder of part files, or a single file (the stream's source must be a folder, so its folder is read by the file's name)."""
    reader = spark.readStream.schema(schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def market(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices of a CSV with header."""
    return spark.read.schema(OHLCV).option("header", True).csv(path)


# Schemas of extraction results, macro series, unified news.
EXTRACTED = (
    "document_id string, chunk_id string, chunk_index int, "
    "entities array<struct<entity_id: string, entity_type: string, name: string, canonical_name: string, confidence: double>>, "
    "relations array<struct<source_entity_id: string, target_entity_id: string, relationship: string, confidence: double, event_time: string, available_time: string>>, "
    "provenance struct<document_id: string, chunk_id: string, source: string, available_time: string>, available_time string"
)
MACRO = "series_id string, series_name string, ticker string, date string, value string, unit string, source string, source_url string, ingested_at string"


def extractions(spark: SparkSession, folder: str) -> DataFrame:
    """All chunk results of a folder's JSON files, with ``seq``: their order by file, chunk index and chunk id."""
    rows = json_documents(spark, f"{folder.rstrip('/')}/*.json", EXTRACTED).where("chunk_id is not null")
    rows = rows.withColumn("available_time", F.coalesce("available_time", "provenance.available_time"))
    return rows.withColumn("seq", F.struct("file", F.coalesce("chunk_index", F.lit(2**31 - 1)).alias("index"), "chunk_id")).drop("provenance")


def macro(spark: SparkSession, path: str, series: tuple[str, ...] = ()) -> DataFrame:
    """Macro observations of JSON files (of the given series), by date and series."""
    rows = json_documents(spark, path, MACRO).drop("file")
    rows = rows.where(F.col("series_id").isin(*series)) if series else rows
    return rows.withColumn("value", F.col("value").try_cast("double")).orderBy("date", "series_id")


def corpus_config(path: str) -> dict:
    """A corpus configuration in YAML's plain subset: nested maps by indentation, lists of scalars or one-line maps, comments. Parameters, not data."""
    with open(path, encoding="utf-8") as f:
        lines = [(len(x) - len(x.lstrip()), x.strip()) for x in f if x.strip() and not x.lstrip().startswith("#")]

    def scalar(text: str):
        text = text.split(" #")[0].strip()
        if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
            return text[1:-1]
        if text.startswith("[") and text.endswith("]"):
            return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
        if text.lower() in ("true", "false"):
            return text.lower() == "true"
        if text.lower() in ("", "null", "~"):
            return None
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                pass
        return text

    def block(at: int, depth: int):
        out = [] if lines[at][1].startswith("- ") else {}
        while at < len(lines) and lines[at][0] == depth:
            text = lines[at][1]
            if isinstance(out, list):
                head = text[2:].strip()
                if ":" in head and head[:1] not in "\"'[":
                    lines[at] = (depth + 2, head)
                    value, at = block(at, depth + 2)
                else:
                    value, at = scalar(head), at + 1
                out.append(value)
                continue
            key, _, rest = text.partition(":")
            at += 1
            if rest.strip():
                out[key.strip()] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- ")):
                out[key.strip()], at = block(at, lines[at][0])
            else:
                out[key.strip()] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def fetch(urls: DataFrame, kind: str = "json", agent: str = "corpus-reader", timeout: float = 30.0) -> DataFrame:
    """``(url, status, body, error)`` of ``urls(url)``, fetched on the workers, one connection a row.

    Compressed answers are unpacked; bytes that are no UTF-8 become U+FFFD. A JSON source must answer in JSON, an
    HTML source in HTML (by its content type, or else by how it begins); other answers, and failures, are errors of their row.
    """

    def run(batches):
        import gzip
        import urllib.request

        import pyarrow as pa

        def get(url):
            try:
                request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept-Encoding": "gzip"})
                with urllib.request.urlopen(request, timeout=timeout) as r:
                    raw, said, status = r.read(), (r.headers.get("Content-Type") or "").lower(), getattr(r, "status", None) or 200
                if raw[:2] == b"\x1f\x8b":
                    raw = gzip.decompress(raw)
                body = raw.decode("utf-8", errors="replace")
                start = body.lstrip()[:200].lower()
                fits = ("json" in said or start[:1] in ("{", "[")) if kind == "json" else ("html" in said or start.startswith("<!doctype html") or "<html" in start)
                return (status, body, None) if fits else (status, None, f"no {kind}: {said or 'unknown type'}")
            except Exception as e:  # noqa: BLE001  any failure is its row's
                return None, None, f"{type(e).__name__}: {e}"

        for b in batches:
            got = [get(u) if u else (None, None, "no url") for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], names=["url", "status", "body", "error"])

    return urls.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "url string, status int, body string, error string")
