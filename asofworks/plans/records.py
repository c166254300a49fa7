"""Records, chunks, graph building, checks and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, records, time
from ..functions import text as T
from ..operators import build, evaluation, validation
from ..operators.analysis import spread
from .base import query, run, table

_TEXT = "regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', '\n\n', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter([trim(x) FOR x IN string_split({_TEXT}, chr(10))], lambda z: z <> '') AS ps FROM documents WHERE text IS NOT NULL),
f(doc_id, ps, i, cur, n, done) AS (SELECT doc_id, ps, 0, '', 0, CAST([] AS VARCHAR[]) FROM d UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN length(p) > 1800 THEN '' WHEN cur = '' THEN p WHEN length(cur) + 2 + length(p) <= 1800 THEN cur || chr(10) || chr(10) || p WHEN length(tail) + 2 + length(p) <= 1800 THEN tail || chr(10) || chr(10) || p ELSE p END, n,
    CASE WHEN length(p) > 1800 THEN list_concat(CASE WHEN cur = '' THEN done ELSE list_append(done, cur) END, [substring(p, CAST(k * 1550 + 1 AS BIGINT), 1800) FOR k IN generate_series(0, CAST(ceil((length(p) - 1800) / 1550.0) AS BIGINT))])
      WHEN cur = '' OR length(cur) + 2 + length(p) <= 1800 THEN done WHEN length(tail) + 2 + length(p) <= 1800 THEN list_append(done, cur) ELSE list_concat(done, [cur, tail]) END
  FROM (SELECT *, ps[i + 1] AS p, trim(right(cur, 250)) AS tail FROM f WHERE i < len(ps)))
SELECT doc_id, len(c) AS n_chunks, sha256(array_to_string(c, '|')) AS digest FROM (SELECT doc_id, CASE WHEN cur = '' THEN done ELSE list_append(done, cur) END AS c FROM f WHERE i = len(ps))""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure-aware chunks of every document (its lines are the paragraphs): how many, and a digest of all."""
    chunks = T.pack_paragraphs(F.col("text"), pattern="\n")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", chunks.alias("c"))
    return rows.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.sha2(F.array_join("c", "|").cast("binary"), 256).alias("digest"))


_TERMS = ("the", "and", "ing", "ous")


@query(f"""WITH s AS (SELECT doc_id, text, unnest(generate_series(0, greatest(1, length(text) - 220), 80)) AS pos FROM documents WHERE length(text) > 220),
n AS (SELECT doc_id, text, pos, {' + '.join(f"(length(w) - length(replace(w, '{t}', ''))) // 3" for t in _TERMS)} AS k FROM (SELECT *, substring(lower(text), pos + 1, 220) AS w FROM s)),
b AS (SELECT doc_id, text, pos FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, pos) = 1)
SELECT doc_id, CASE WHEN pos > 0 THEN '...' ELSE '' END || regexp_replace(substring(text, pos + 1, 220), '^\\s+|\\s+$', '', 'g') || CASE WHEN pos + 220 < length(text) THEN '...' ELSE '' END AS snippet FROM b
UNION ALL SELECT doc_id, text FROM documents WHERE length(text) <= 220""")
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of 220 characters of every document that holds the most of four terms."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", T.best_window(F.col("text"), F.array(*map(F.lit, _TERMS)), 220).alias("snippet"))


# a mark behind every character that is no part of a word, so that neighbouring words need not share one
@query("""WITH m AS (SELECT conv_id, turn, regexp_replace(lower(text), '([^\\p{L}\\p{N}_])', '\\1' || chr(1), 'g') AS t FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(translate(replace(regexp_replace(t, '(^|' || chr(1) || ')(a|an|the)([^\\p{L}\\p{N}_]|$)', '\\1 \\3', 'g'), chr(1), ''), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+', ' ', 'g')) AS t FROM m""")
def answer_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised answers of all turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("t"))


_NAMES = "s_name || CASE s_suppkey % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Holdings & Co' WHEN 2 THEN '.com Group' WHEN 3 THEN ' N.A.' ELSE ' PLC' END"


@query(f"""SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(n), '&', ' and '), '.com', ''), '[,.]?\\s*\\b(inc|incorporated|corp|corporation|co|company|ltd|limited|plc|holdings?|group|n\\.?v|s\\.?a|ag|llc|lp|the)\\b\\.?', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS simple,
  translate(lower(n), '_:- ', '') AS token, CASE WHEN length(n) > 20 THEN substring(n, 1, 20) || '...' ELSE n END AS short, lower(trim(regexp_replace(n, '\\s+', ' ', 'g'))) AS name FROM (SELECT s_suppkey, {_NAMES} AS n FROM supplier)""")
def registrant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, f"SELECT s_suppkey, {_NAMES} AS n FROM supplier")
    n = F.col("n")
    return rows.select("s_suppkey", T.simplify_registrant(n).alias("simple"), T.entity_token(n).alias("token"), T.truncate(n, 20).alias("short"), T.normalize_entity_name(n).alias("name"))


@query("""SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace(acc, '-', '') || '/doc-' || o_orderkey || '.htm' AS url, extract(year FROM o_orderdate) || '-Q' || extract(quarter FROM o_orderdate) AS quarter_,
  regexp_matches(substr(sha256(acc), 1, 16), '^[0-9a-f]{16}$') AS hex, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point
FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(acc)) AS h FROM (SELECT *, lpad(o_custkey::VARCHAR, 10, '0') || '-26-' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS acc FROM orders))""")
def filing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing addresses, quarter labels, point identifiers."""
    o = table(spark, sf_dir, "orders")
    cik = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    acc = F.concat(cik, F.lit("-26-"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    doc = F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string"), F.lit(".htm"))
    return o.select("o_orderkey", T.filing_url(cik, acc, doc).alias("url"), time.quarter_label(F.col("o_orderdate")).alias("quarter_"), T.is_hex_id(F.substring(F.sha2(acc.cast("binary"), 256), 1, 16)).alias("hex"), ids.uuid5(acc).alias("point"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'partial' WHEN 1 THEN CASE WHEN d = 0 THEN 'none' ELSE 'partial' END WHEN 2 THEN 'none' ELSE 'full' END AS coverage FROM (SELECT conv_id, turn, conv_id % 2 AS d FROM conversations)""")
def coverage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared coverage against wording, on made-up answers."""
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 4 == 0, "partial").when(F.col("turn") % 4 == 1, "full").when(F.col("turn") % 4 == 2, "").otherwise("full")
    plain = F.when(F.col("turn") % 4 == 1, F.when(F.col("conv_id") % 2 == 0, "The filing does not disclose it.").otherwise("It does not state this; however, sales rose.")).when(F.col("turn") % 4 == 2, "There is no information here.").otherwise("Sales rose.")
    return c.select("conv_id", "turn", T.coverage(said, plain).alias("coverage"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE 'a' || conv_id END AS answer, CASE turn % 4 WHEN 3 THEN NULL WHEN 2 THEN 'x,y' ELSE 'x' END AS ids FROM conversations")
def salvaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers out of whole, wrapped, cut-off and hopeless output."""
    c = table(spark, sf_dir, "conversations")
    a = F.col("conv_id").cast("string")
    whole = F.concat(F.lit('{"answer": "a'), a, F.lit('", "evidence_ids": ["x"], "confidence": 0.5}'))
    cut = F.concat(F.lit('{"answer": "a'), a, F.lit('", "evidence_ids": ["x", "y"], "confid'))
    raw = F.when(F.col("turn") % 4 == 0, whole).when(F.col("turn") % 4 == 1, F.concat(F.lit("Sure! "), whole, F.lit(" Done."))).when(F.col("turn") % 4 == 2, cut).otherwise("nothing")
    got = T.salvage_json(raw, "answer string, coverage string, confidence double, evidence_ids array<string>")
    return c.select("conv_id", "turn", got["answer"].alias("answer"), F.array_join(got["evidence_ids"], ",").alias("ids"))


# -- graph building -----------------------------------------------------------------------------

#: One chunk an order: customer, its clerk's part and supplier as entities; relations, some of them unsound.
_CHUNKS = """SELECT o_orderkey AS seq, 'doc' || (o_orderkey % 500) AS document_id, 'c' || o_orderkey AS chunk_id, CAST(o_orderkey AS INT) AS chunk_index, o_custkey AS k, CAST(o_orderdate AS STRING) AS available_time FROM orders"""


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, _CHUNKS).withColumn("seq", F.col("seq").cast("long"))
    entity = lambda i, kind, name: F.struct(i.alias("entity_id"), F.lit(kind).alias("entity_type"), name.alias("name"), F.lit(None).cast("string").alias("canonical_name"), F.lit(0.9).alias("confidence"))
    k = F.col("k")
    firm = F.concat(F.lit("Nation_"), (k % 25).cast("string"), F.lit(" Inc."))
    entities = F.array(entity(F.lit("e1"), "COMPANY", firm), entity(F.concat(F.lit("risk:"), (k % 40).cast("string")), "risk", F.concat(F.lit("Risk "), (k % 40).cast("string"))), entity(F.lit("e3"), "Planet", F.lit("Mars")))
    none = F.lit(None).cast("string")
    rel = lambda s, t, r, e=none: F.struct(s.alias("source_entity_id"), t.alias("target_entity_id"), F.lit(r).alias("relationship"), F.lit(0.8).alias("confidence"), e.alias("event_time"), none.alias("available_time"))
    late = F.when(F.col("seq") % 5 == 0, F.lit("2031-01-01"))
    own = F.concat(F.lit("risk:"), (k % 40).cast("string"))
    relations = F.array(rel(firm, own, "has_risk", late), rel(F.lit("e1"), F.lit("e1"), "SUPPLIES"), rel(F.lit("e1"), F.lit("e3"), "SUPPLIES"), rel(F.lit("e1"), own, "LOVES"), rel(own, F.concat(F.lit("nation_"), (k % 25).cast("string"), F.lit(" inc.")), "AFFECTED_BY"))
    return rows.select("seq", "document_id", "chunk_id", "chunk_index", entities.alias("entities"), relations.alias("relations"), "available_time")


_UNIVERSE = "SELECT 'N' || n_nationkey AS ticker, n_name AS company FROM nation WHERE n_nationkey < 20"
_FOUND = """WITH c AS (SELECT o_orderkey AS seq, 'doc' || (o_orderkey % 500) AS document_id, 'c' || o_orderkey AS chunk_id, o_custkey AS k, CAST(o_orderdate AS VARCHAR) AS t FROM orders),
e AS (SELECT seq, document_id, chunk_id, t, k, CASE WHEN k % 25 < 20 THEN 'company:N' || (k % 25) ELSE 'e1' END AS node_id, 'Company' AS node_type, 'Nation_' || (k % 25) || ' Inc.' AS name FROM c
  UNION ALL SELECT seq, document_id, chunk_id, t, k, 'risk:' || (k % 40), 'Risk', 'Risk ' || (k % 40) FROM c)"""


@query(f"{_FOUND} SELECT node_id, node_type, arg_min(name, seq) AS name, min(t) AS available_time, count(DISTINCT document_id) AS n_documents, count(DISTINCT chunk_id) AS n_chunks FROM e GROUP BY node_id, node_type")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph built from one extracted chunk an order."""
    found = build.entities(_extracted(spark, sf_dir), run(spark, sf_dir, _UNIVERSE))
    n = build.nodes(found)
    return n.select("node_id", "node_type", "name", "available_time", F.size("document_ids").cast("long").alias("n_documents"), F.size("chunk_ids").cast("long").alias("n_chunks"))


@query(f"""{_FOUND} SELECT source, relationship, target, count(*) AS n FROM (
  SELECT CASE WHEN k % 25 < 20 THEN 'company:N' || (k % 25) ELSE 'e1' END AS source, 'HAS_RISK' AS relationship, 'risk:' || (k % 40) AS target FROM c WHERE seq % 5 <> 0
  UNION ALL SELECT 'risk:' || (k % 40), 'AFFECTED_BY', CASE WHEN k % 25 < 20 THEN 'company:N' || (k % 25) ELSE 'e1' END FROM c) GROUP BY ALL""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its edges, counted by triple: loops, unknown ends and relationships, and times before the event are gone."""
    x = _extracted(spark, sf_dir)
    e = build.edges(x, build.entities(x, run(spark, sf_dir, _UNIVERSE)))
    return e.groupBy("source", "relationship", "target").agg(F.count("*").alias("n"))


_EVENTS = """SELECT CASE event_id % 4 WHEN 0 THEN 'market' WHEN 1 THEN 'sec_filing' WHEN 2 THEN 'macro' ELSE 'other' END AS event_type, 'N' || (user_id % 30) AS ticker, CAST(event_id % 700 AS {s}) AS key, CAST(CAST(ts AS DATE) AS {s}) AS event_time, CAST(ts AS {s}) AS available_time FROM events"""


@query(f"""WITH v AS ({_EVENTS.format(s='VARCHAR')}) SELECT source, relationship, count(*) AS n FROM (SELECT DISTINCT 'company:' || ticker AS source,
  CASE event_type WHEN 'market' THEN 'HAS_MARKET_EVENT' WHEN 'sec_filing' THEN 'FILED' WHEN 'macro' THEN 'AFFECTED_BY' END AS relationship, event_type, ticker, key FROM v WHERE event_type <> 'other' AND CAST(substr(ticker, 2) AS INT) < 20) GROUP BY ALL""")
def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the event graph by company and kind; unknown companies and kinds have none."""
    _, arcs = build.event_graph(run(spark, sf_dir, _EVENTS.format(s="STRING")), run(spark, sf_dir, _UNIVERSE))
    return arcs.groupBy("source", "relationship").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_type, CAST(row_number() OVER (ORDER BY r, c DESC, p_type, p_partkey) AS INTEGER) AS place FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_type) AS c FROM part) QUALIFY place <= 14""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each kind in turn, the largest first, fourteen in all."""
    from pyspark.sql.window import Window

    p = table(spark, sf_dir, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_size"), "p_partkey")))
    sizes = F.broadcast(p.groupBy("p_type").agg(F.count("*").alias("c")))
    first = p.where("r <= 14").join(sizes, "p_type").orderBy("r", F.desc("c"), "p_type", "p_partkey").limit(14)
    return first.withColumn("place", F.row_number().over(Window.orderBy("r", F.desc("c"), "p_type", "p_partkey"))).select("p_partkey", "p_type", "place")


# -- checks ---------------------------------------------------------------------------------------

_MACRO = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS series_id, 'n' AS series_name, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE '2024-01-05' END AS date,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'high' ELSE '1.5' END AS value, 's' AS source, 'u' AS source_url, '2024-01-06' AS ingested_at FROM events"""


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 11 = 0 THEN 'missing_series_id' END, CASE event_id % 7 WHEN 0 THEN 'missing_date' WHEN 1 THEN 'invalid_date' END, CASE event_id % 5 WHEN 0 THEN 'missing_value' WHEN 1 THEN 'invalid_value' END], lambda z: z IS NOT NULL), ',') AS errors FROM events""")
def macro_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _MACRO).select("event_id", F.array_join(validation.macro_errors(), ",").alias("errors"))


_FILINGS = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL ELSE '1996-02-0' || (1 + o_orderkey % 9) END AS filing_date, CASE o_orderkey % 4 WHEN 0 THEN '1996-03-01' WHEN 1 THEN '' ELSE '1995-12-31' END AS report_date, CASE o_orderkey % 5 WHEN 0 THEN 'x' ELSE '1996-02-10 10:00:00' END AS acceptance_datetime FROM orders"""


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 6 = 0 THEN 'missing_filing_date' END, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_acceptance_datetime' END, CASE WHEN o_orderkey % 4 = 1 THEN 'missing_report_date' END, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 6 <> 0 THEN 'report_date_after_filing_date' END], lambda z: z IS NOT NULL), ',') AS errors FROM orders""")
def filing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _FILINGS).select("o_orderkey", F.array_join(validation.filing_errors(), ",").alias("errors"))


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 9 = 0 THEN 'missing_title' END, CASE WHEN url IS NULL OR trim(url) = '' THEN 'missing_url' END, CASE WHEN page_id % 6 = 0 THEN 'invalid_ticker' END, CASE WHEN NOT coalesce(regexp_matches(url, '^https?://[^/?#]+'), false) THEN 'invalid_url' END, CASE WHEN page_id % 4 = 0 THEN 'published_after_ingestion' END], lambda z: z IS NOT NULL), ',') AS errors FROM pages""")
def news_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    p = F.col("page_id")
    rows = rows.select("page_id", "url", F.when(p % 9 == 0, " ").otherwise("t").alias("title"), F.when(p % 6 == 0, "NO/WAY").otherwise("BRK-B").alias("ticker"), F.lit("s").alias("source"), F.when(p % 4 == 0, "2024-05-02").otherwise("2024-04-30").alias("published_at"), F.lit("2024-05-01").alias("ingested_at"))
    return rows.select("page_id", F.array_join(validation.news_errors(), ",").alias("errors"))


@query("""WITH x AS (SELECT user_id, event_id AS seq, CAST(ts AS DATE) AS d, value, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS w FROM events), m AS (SELECT *, d < lag(d) OVER (PARTITION BY user_id ORDER BY seq) AS back, row_number() OVER (PARTITION BY user_id, d ORDER BY seq) > 1 AS again FROM x)
SELECT 'missing:value' AS rule, count(*) FILTER (WHERE value IS NULL) AS n FROM m UNION ALL SELECT 'missing:w', count(*) FILTER (WHERE w IS NULL) FROM m UNION ALL SELECT 'not_finite:value', count(*) FILTER (WHERE isnan(value) OR isinf(value)) FROM m UNION ALL SELECT 'not_finite:w', count(*) FILTER (WHERE isnan(w) OR isinf(w)) FROM m
UNION ALL SELECT 'duplicate_snapshots', count(*) FILTER (WHERE again) FROM m UNION ALL SELECT 'not_chronological', count(*) FILTER (WHERE back) FROM m""")
def feature_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT user_id, event_id AS seq, CAST(ts AS DATE) AS d, value, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS w FROM events")
    return validation.feature_errors(rows, ["value", "w"], "user_id", "d")


@query("""SELECT item_id, array_to_string(list_filter([CASE WHEN item_id % 5 = 0 THEN 'missing:hop_level' END, CASE WHEN item_id % 3 = 0 THEN 'category' END, CASE WHEN item_id % 4 = 0 THEN 'relevant_chunk_ids' END, CASE WHEN item_id % 7 = 0 THEN 'rationale' END], lambda z: z IS NOT NULL), ',') AS errors FROM benchmark""")
def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    i, s = F.col("item_id"), F.lit("s")
    fields = {k: s for k in validation.ITEM_KEYS if k not in ("hop_level", "category", "relevant_chunk_ids", "relevant_document_ids", "answerable")}
    fields |= {"hop_level": F.when(i % 5 != 0, s), "category": F.when(i % 3 == 0, "other").otherwise("factual_single_hop"), "answerable": i % 7 != 0}
    said = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()], F.array(s).alias("relevant_document_ids")))
    chunks = F.when(i % 4 == 0, F.lit('"x"')).otherwise('["x"]')
    raw = F.concat(F.expr("substring(r, 1, length(r) - 1)"), F.lit(', "relevant_chunk_ids": '), chunks, F.lit("}"))
    return b.select("item_id", said.alias("r")).select("item_id", raw.alias("raw")).select("item_id", F.array_join(validation.item_errors(), ",").alias("errors"))


@query("""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{6,}')[1:2] AS req, 'company:' || (item_id % 30) AS node FROM benchmark), c AS (SELECT doc_id, lower(text) AS t FROM documents),
m AS (SELECT item_id, count(*) AS n FROM i JOIN c ON len(list_filter(req, lambda z: NOT contains(t, z))) = 0 WHERE len(req) > 0 GROUP BY item_id)
SELECT i.item_id, coalesce(n, 0) AS n_chunks, item_id % 30 < 25 AND coalesce(n, 0) > 0 AS verified FROM i LEFT JOIN m USING (item_id) WHERE len(req) > 0""")
def verified_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the entities of each benchmark item are nodes and some document holds its first two long words."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)), 1, 2)
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("required"), F.array(F.concat(F.lit("company:"), (F.col("item_id") % 30).cast("string"))).alias("entities")).where(F.size("required") > 0)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text").where("text is not null")
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("company:"), F.col("n_nationkey").cast("string")).alias("node_id"))
    return validation.verify_candidates(items, docs, nodes).select("item_id", F.col("n_chunks").cast("long").alias("n_chunks"), "verified")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 7 < 2) AS n_10k, count(*) FILTER (WHERE o_orderkey % 7 IN (2, 3)) AS n_10q, count(*) FILTER (WHERE o_orderkey % 7 = 4) AS n_8k, count(*) FILTER (WHERE o_orderkey % 7 > 4) AS n_other, count(*) AS n FROM orders GROUP BY o_custkey")
def filings_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(k < 2, "10-K").when(k < 4, "10-Q").when(k == 4, "8-K").when(k == 5, "S-1").alias("form"))
    return records.counts_by_form(rows, "o_custkey")


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) * 10 + 0.5 AS v0, -CAST(p_size AS DOUBLE) AS v1, 2020 + p_partkey % 5 AS y0 FROM part""")
def statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of an income statement's row, with the years above them."""
    size = F.col("p_size").cast("string")
    year = F.lit(2020) + F.col("p_partkey") % 5
    text = F.concat(F.lit("Other 1,000\nCONSOLIDATED STATEMENTS OF INCOME (in millions)\nYear ended "), year.cast("string"), F.lit(" "), (year - 1).cast("string"), F.lit("\nCosts 7 8\nNet income $ "), size, F.lit("0.5 $ ("), size, F.lit(")\nTax 1 2"))
    got = validation.statement_facts(text, "CONSOLIDATED STATEMENTS OF INCOME", "Net income")
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("x")).select("p_partkey", F.get("x.values", F.lit(0)).alias("v0"), F.get("x.values", F.lit(1)).alias("v1"), F.get("x.years", F.lit(0)).cast("long").alias("y0"))


@query("""SELECT 'market' AS event_type, count(*) AS n FROM orders UNION ALL SELECT 'news', count(*) FROM pages UNION ALL SELECT 'sec_filing', count(*) FROM documents UNION ALL SELECT 'macro', count(*) FROM events""")
def unified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four sources as one table of events, counted by kind."""
    t = lambda n: table(spark, sf_dir, n)
    market = t("orders").select(F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("ticker"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("close"))
    news = t("pages").select(F.lit("X").alias("ticker"), F.lit("2024-01-01").alias("published_at"), F.lit("web").alias("source"), "url")
    filings = t("documents").select(F.col("source").alias("ticker"), F.lit("2023-12-31").alias("report_date"), F.lit("2024-01-02").alias("filing_date"), F.lit(None).cast("string").alias("acceptance_datetime"), "doc_id")
    macro = t("events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("string").alias("date"), F.col("ts").cast("string").alias("ingested_at"), F.lit("fred").alias("source"), "value")
    return records.unified(market, news, filings, macro).groupBy("event_type").agg(F.count("*").alias("n"))


# -- evaluation -----------------------------------------------------------------------------------

_RES = "SELECT label AS question_id, 'd' || (vec_id % 40) AS document_id, vec_id % 17 + vec_id % 5 AS rank FROM embeddings"
_REL = "SELECT label AS question_id, 'd' || (vec_id % 40) AS document_id FROM embeddings WHERE vec_id % 11 = 0 AND label < 8"
_DOC = f"""r AS (SELECT question_id, document_id, row_number() OVER (PARTITION BY question_id ORDER BY m, document_id) AS place FROM (SELECT question_id, document_id, min(rank) AS m FROM ({_RES}) GROUP BY question_id, document_id)), l AS (SELECT DISTINCT * FROM ({_REL})),
h AS (SELECT l.question_id, count(DISTINCT l.document_id) AS n, count(r.place) AS found, count(*) FILTER (WHERE place <= 1) AS h1, count(*) FILTER (WHERE place <= 5) AS h5 FROM l LEFT JOIN r USING (question_id, document_id) GROUP BY 1),
m AS (SELECT question_id, CAST(h1 > 0 AS INTEGER) AS doc_hit_1, ROUND(h1 / n::DOUBLE, 6) AS doc_recall_1, CAST(h5 > 0 AS INTEGER) AS doc_hit_5, ROUND(h5 / n::DOUBLE, 6) AS doc_recall_5, CASE WHEN n > 1 THEN ROUND(found / n::DOUBLE, 6) ELSE 0.0 END AS coverage FROM h)"""


def _doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.document_metrics(run(spark, sf_dir, _RES), run(spark, sf_dir, _REL), (1, 5))


@query(f"WITH {_DOC} SELECT * FROM m")
def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc(spark, sf_dir)


@query(f"WITH {_DOC} SELECT count(*) AS n, ROUND(avg(doc_hit_1), 6) AS mean_doc_hit_1, ROUND(avg(doc_recall_5), 6) AS mean_doc_recall_5, ROUND(coalesce(avg(coverage) FILTER (WHERE question_id % 3 = 0 OR coverage > 0), 0), 6) AS mean_coverage FROM m WHERE question_id % 4 <> 3")
def suite_macro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc(spark, sf_dir).withColumn("answerable", F.col("question_id") % 4 != 3)
    return evaluation.macro_averages(rows, ["doc_hit_1", "doc_recall_5", "coverage"], {"coverage": F.col("question_id") % 3 == 0})


@query("""WITH r AS (SELECT label AS question_id, vec_id, vec_id % 11 = 0 AS rel, row_number() OVER (PARTITION BY label ORDER BY vec_id % 13, vec_id) AS rank FROM embeddings)
SELECT question_id, ROUND(1.0::DOUBLE / min(rank) FILTER (WHERE rel), 6) AS mrr, ROUND(coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel AND rank <= 10), 0) / list_sum([1 / log2(i + 1) FOR i IN generate_series(1, least(10, count(*) FILTER (WHERE rel)))]), 6) AS ndcg_10 FROM r GROUP BY question_id HAVING count(*) FILTER (WHERE rel) > 0""")
def mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import metrics

    ranked = run(spark, sf_dir, "SELECT label AS question_id, vec_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id % 13, vec_id) AS INT) AS rank FROM embeddings")
    rel = run(spark, sf_dir, "SELECT label AS question_id, vec_id AS id FROM embeddings WHERE vec_id % 11 = 0")
    return metrics.retrieval(ranked, rel, (10,)).select("question_id", "mrr", F.col("ndcg").alias("ndcg_10"))


_CLASS = "p::DOUBLE AS p, r::DOUBLE AS r"


@query("""WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS tp, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS fp, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS fn, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS tn FROM labels),
x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS s FROM c)
SELECT tp, fp, fn, tn, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, ROUND((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 6) AS accuracy, ROUND((r + s) / 2, 6) AS balanced_accuracy FROM x""")
def refusal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("toxic") == 0).alias("answerable"), (F.col("quality") == 0).alias("refused"))
    return evaluation.refusal_metrics(rows)


_SCORES = "SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS label, ROUND(value, 0) AS score FROM events"


@query(f"""WITH s AS ({_SCORES}), r AS (SELECT event_type, label, rank() OVER (PARTITION BY event_type ORDER BY score) + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2.0 AS r FROM s)
SELECT event_type, ROUND((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0)::DOUBLE / (sum(label) * sum(1 - label)), 6) AS auc FROM r GROUP BY event_type""")
def auc_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_auc(run(spark, sf_dir, _SCORES), ["event_type"])


@query(f"""WITH s AS ({_SCORES}), t AS (SELECT unnest([1.0, 5.0, 20.0, 60.0])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn, count(*) FILTER (WHERE score < threshold AND label = 0) AS tn FROM s, t GROUP BY threshold)
SELECT threshold, tp, fp, fn, tn, ROUND(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, ROUND(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall FROM c""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluation.threshold_sweep(run(spark, sf_dir, _SCORES), [1.0, 5.0, 20.0, 60.0])
    return got.select("threshold", "tp", "fp", "fn", "tn", "precision", "recall")


@query("SELECT event_type, ROUND(avg(value), 4) AS mean, ROUND(median(value), 4) AS median, min(value) AS low, max(value) AS high, ROUND(stddev_samp(value), 4) AS sd FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 4)
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(r(F.avg(v)).alias("mean"), r(F.median(v)).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"), r(F.stddev_samp(v)).alias("sd"))


@query("WITH m AS (SELECT event_type, user_id % 5 AS fold, avg(value) AS v FROM events GROUP BY ALL) SELECT arg_max(event_type, (s, event_type)) AS best, ROUND(max(s), 4) AS mean, count(*) AS n FROM (SELECT event_type, avg(v) AS s FROM m GROUP BY event_type)")
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration of highest mean over the folds."""
    m = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("v"))
    s = m.groupBy("event_type").agg(F.avg("v").alias("s"))
    return s.agg(F.max_by("event_type", F.struct("s", "event_type")).alias("best"), F.round(F.max("s"), 4).alias("mean"), F.count("*").alias("n"))


@query("WITH t AS (SELECT p_partkey, p_size % 9 AS a, p_size % 7 + 1 AS b, p_size % 5 + 1 AS c, p_size % 11 AS d FROM part), r AS (SELECT *, a + b AS r1, c + d AS r2, a + c AS c1 FROM t), w AS (SELECT p_partkey, a, r1, r2, c1, unnest(generate_series(greatest(0, c1 - r2), least(r1, c1))) AS x FROM r),"
       " p AS (SELECT p_partkey, x, a, exp(lgamma(r1 + 1) - lgamma(x + 1) - lgamma(r1 - x + 1) + lgamma(r2 + 1) - lgamma(c1 - x + 1) - lgamma(r2 - c1 + x + 1) - lgamma(r1 + r2 + 1) + lgamma(c1 + 1) + lgamma(r1 + r2 - c1 + 1)) AS p FROM w),"
       " o AS (SELECT *, max(p) FILTER (WHERE x = a) OVER (PARTITION BY p_partkey) AS po FROM p) SELECT p_partkey, ROUND(least(1.0, sum(p) FILTER (WHERE p <= po * (1 + 1e-7))), 5) AS p FROM o GROUP BY p_partkey")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return rows.select("p_partkey", F.round(evaluation.fisher_exact(s % 9, s % 7 + 1, s % 5 + 1, s % 11), 5).alias("p"))


_FOLDS = "SELECT user_id % 12 AS fold, event_type AS config, ROUND(avg(value), 3) AS v FROM events GROUP BY user_id % 12, event_type"


@query(f"""WITH f AS ({_FOLDS}), k AS (SELECT count(DISTINCT config) AS k FROM f), g AS (SELECT f.* FROM f WHERE fold IN (SELECT fold FROM f GROUP BY fold HAVING count(DISTINCT config) = (SELECT k FROM k))),
r AS (SELECT fold, config, rank() OVER (PARTITION BY fold ORDER BY v) + (count(*) OVER (PARTITION BY fold, v) - 1) / 2.0 AS r FROM g), s AS (SELECT config, sum(r) AS s, count(*) AS n FROM r GROUP BY config)
SELECT ROUND((12.0 / (max(n) * max(k) * (max(k) + 1)) * sum(s * s) - 3 * max(n) * (max(k) + 1))::DOUBLE, 6) AS chi2, CAST(max(k) - 1 AS INTEGER) AS df, max(n) AS n_folds FROM s, k""")
def friedman_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.friedman(run(spark, sf_dir, _FOLDS), "fold", "config", "v")


_PAIRS = "SELECT event_type, CAST(event_id % 23 AS DOUBLE) AS x, CAST(user_id % 17 AS DOUBLE) AS y FROM events"


@query(f"""WITH d AS (SELECT event_type, x - y AS d FROM ({_PAIRS}) WHERE x <> y), r AS (SELECT event_type, d, rank() OVER (PARTITION BY event_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY event_type, abs(d)) - 1) / 2.0 AS r FROM d)
SELECT event_type, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0))::DOUBLE AS w, count(*) AS n FROM r GROUP BY event_type""")
def wilcoxon_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.wilcoxon(run(spark, sf_dir, _PAIRS), ["event_type"], "x", "y").select("event_type", F.col("w").cast("double").alias("w"), "n")


# an amount a hundred times too small or large is also tried as billions or single dollars
@query("""WITH x AS (SELECT p_partkey, p_retailprice AS t, CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice / 1000 WHEN 2 THEN p_retailprice * 1.008::DOUBLE ELSE p_retailprice * 1.5::DOUBLE END AS p FROM part),
y AS (SELECT p_partkey, t, CASE WHEN abs(p) * 100 < abs(t) THEN [p, p * 1000] WHEN abs(p) > abs(t) * 100 THEN [p, p / 1e6] ELSE [p] END AS c FROM x)
SELECT p_partkey, len(list_filter(c, lambda z: abs(z - t) <= 0.01::DOUBLE * abs(t))) > 0 AS within_1pct, len(list_filter(c, lambda z: abs(z - t) <= 0.005::DOUBLE * abs(t))) > 0 AS within_0_5pct FROM y""")
def numeric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted amounts: exact, in billions unsaid, off by 0.8 %, off by half."""
    k, t = F.col("p_partkey") % 4, F.col("p_retailprice")
    predicted = F.when(k == 0, t).when(k == 1, t / 1000).when(k == 2, t * 1.008).otherwise(t * 1.5)
    got = evaluation.numeric_score(predicted, F.lit(""), t, F.lit("revenue"))
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("x")).select("p_partkey", "x.within_1pct", "x.within_0_5pct")


@query("SELECT p_type, ROUND(avg(p_size), 6) AS size, ROUND(avg(p_retailprice), 4) AS price FROM part GROUP BY p_type")
def mean_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.round(F.avg("p_size"), 6).alias("size"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("SELECT 'p_nothing' AS name")
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that carry nothing."""
    rows = table(spark, sf_dir, "part").withColumn("p_nothing", F.lit(1))
    names = evaluation.constant_columns(rows, ["p_partkey", "p_brand", "p_size", "p_nothing"])
    return spark.createDataFrame([(n,) for n in names], "name string")


_DAYS = """SELECT d, v, n, lag(v, 1) OVER (ORDER BY d) AS v1, lag(v, 5) OVER (ORDER BY d) AS v5, lag(n, 1) OVER (ORDER BY d) AS n1, lead(v, 1) OVER (ORDER BY d) AS next_v
  FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, SUM(o_totalprice) AS v, COUNT(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE)) x"""


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators import features, models

    rows = run(spark, sf_dir, _DAYS).where("next_v is not null").selectExpr("d", "v / v1 - 1 AS r1", "v / v5 - 1 AS r5", "n / n1 - 1 AS dn", "cast(next_v > v as int) AS label")
    return models.compare(features.walk_forward(rows, "d", 400, 200), "label", {"momentum": ["r1", "r5"], "all": ["r1", "r5", "dn"]})


@query()
def walk_forward_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the next day's direction, fitted anew for every fold on what came before it: the rates of each model and fold."""
    return _models(spark, sf_dir)[0].select("model", "fold", "n_test", "accuracy", "precision", "recall", "f1")


@query()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models held against the prior over the same folds."""
    return _models(spark, sf_dir)[1]


@query()
def return_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of the next day's direction, fitted on the first 80 % of the days and scored on the rest."""
    from ..operators import features

    daily = run(spark, sf_dir, "SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, SUM(o_totalprice) AS v, COUNT(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE)")
    placed = features.chronological(daily, "d")
    after = daily.select(F.date_sub(F.col("d").cast("date"), 1).cast("string").alias("d"), F.col("v").alias("next_"))
    rows = placed.join(after, "d").withColumn("label", (F.col("next_") > F.col("v")).cast("double"))
    model = evaluation.logistic(rows.where("part = 'train'"), ["v", "n"], "label")
    got = model.transform(rows.where("part = 'test'"))
    n = got.agg(*[F.count_if((F.col("label") == a) & (F.col("predicted") == b)).alias(k) for k, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    return evaluation.rates(n)
