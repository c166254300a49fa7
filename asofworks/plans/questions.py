"""Question analysis, hybrid retrieval, judgement and answers over a table of questions, one for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as when
from ..operators import analysis, answers, hybrid, traversal
from ..sources.sinks import settle
from .base import QUERIES, SQL, query, run, table, trade

#: Both engines read this: twenty kinds of questions over the nations, with dates.
QUESTIONS = """SELECT c_custkey AS question_id, CASE c_custkey % 23
  WHEN 0 THEN 'What risks affected NATION_' || c_nationkey || ' as of June ' || (1 + c_custkey % 28) || ', ' || (1995 + c_custkey % 5) || '?'
  WHEN 1 THEN 'What companies did NATION_' || (c_custkey % 25) || ' supply before ' || (1995 + c_custkey % 4) || '-03-31?'
  WHEN 2 THEN 'What were the primary risks of NATION_' || c_nationkey || ' Group in ' || (1995 + c_custkey % 6) || '?'
  WHEN 3 THEN 'What companies does NATION_' || c_nationkey || ' depend on?'
  WHEN 4 THEN 'What company supplies NATION_' || c_nationkey || '?'
  WHEN 5 THEN 'What risks affect companies that supply NATION_' || c_nationkey || '?'
  WHEN 6 THEN 'Which company had higher revenue, NATION_' || c_nationkey || ' or NATION_' || (c_custkey % 25) || '?'
  WHEN 7 THEN 'Who are the partners and rivals of NATION_' || c_nationkey || ' by the end of ' || (1995 + c_custkey % 6) || '?'
  WHEN 8 THEN 'What happened in Q' || (1 + c_custkey % 4) || ' 1996 to the supply chain of NATION_' || c_nationkey || ' in ASIA?'
  WHEN 9 THEN 'How many products did NATION_' || c_nationkey || ' Holdings manufacture before ' || (1996 + c_custkey % 4) || '?'
  WHEN 10 THEN 'Tell me the fiscal year ' || (1995 + c_custkey % 4) || ' outlook of Zanzibar Traders, please'
  WHEN 11 THEN 'Is NATION_' || c_nationkey || ' indirectly connected through its supplier to NATION_' || (c_custkey % 25) || ' as of Sept ' || (1 + c_custkey % 28) || ', 1995?'
  WHEN 12 THEN 'Which path between NATION_' || c_nationkey || ' and a risk was known by Feb 3, 1995?'
  WHEN 13 THEN 'How do NATION_' || c_nationkey || ' and NATION_' || (c_custkey % 25) || ' connect?'
  WHEN 14 THEN 'What action did the European Commission or the FTC take on NATION_' || c_nationkey || ' by Feb 30, 1997?'
  WHEN 15 THEN 'What do the SEC filings of NATION_' || c_nationkey || ' say prior to Dec 31, ' || (1995 + c_custkey % 3) || '?'
  WHEN 16 THEN 'Revenue of NATION_' || c_nationkey || ' for the quarter ended September 30, 1996'
  WHEN 17 THEN 'Who owns most of NATION_' || c_nationkey || ' and what was the CEO pay?'
  WHEN 18 THEN 'What were the latest sales of NATION_' || c_nationkey || ' before 1997?'
  WHEN 19 THEN 'What risks affect the landlord of suppliers that NATION_' || c_nationkey || ' and NATION_' || (c_custkey % 25) || ' depend on?'
  ELSE 'Compare the margins of XYZ, landlord by landlord' END AS question FROM customer"""
NODES = """SELECT 'company:' || n_nationkey AS node_id, n_name AS name FROM nation UNION ALL SELECT 'country:' || r_regionkey, r_name FROM region"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, QUESTIONS)


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.node_terms(run(spark, sf_dir, NODES).withColumn("aliases", F.expr("cast(null as array<string>)")))


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.by_text(questions(spark, sf_dir), lambda q: analysis.analyse(q, terms(spark, sf_dir)))


_Q = f"q AS ({QUESTIONS})"
# written apart from the Spark form: names are looked for in the padded question, and one inside a longer one goes
_LINKED = f"""{_Q}, n AS (SELECT node_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS t FROM ({NODES})
  UNION ALL VALUES ('regulator:FTC', 'ftc'), ('regulator:FTC', 'federal trade commission'), ('regulator:DOJ', 'doj'), ('regulator:DOJ', 'department of justice'), ('regulator:DOJ', 'justice department'),
  ('regulator:EC', 'european commission'), ('regulator:EC', 'ec'), ('regulator:SAMR', 'samr'), ('regulator:SAMR', 'state administration for market regulation'), ('regulator:SEC', 'sec'), ('regulator:SEC', 'securities and exchange commission')),
p AS (SELECT question_id, question, ' ' || trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s FROM q),
ent AS (SELECT p.question_id, coalesce(list_sort(list_distinct(list(node_id) FILTER (WHERE node_id IS NOT NULL))), []) AS e
  FROM p LEFT JOIN n ON contains(s, ' ' || t || ' ') AND NOT (node_id = 'regulator:SEC' AND regexp_matches(lower(question), '\\bsec +(filings?|reports?|documents?|disclosures?)\\b')) GROUP BY p.question_id)"""


@query(f"WITH {_LINKED} SELECT question_id, array_to_string(e, ',') AS entities FROM ent")
def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every question, through the index of node terms and the longest runs of words."""
    return analysis.by_text(questions(spark, sf_dir), lambda q: analysis.link_entities(q, terms(spark, sf_dir))).select("question_id", F.array_join("entities", ",").alias("entities"))


_X = "regexp_extract(t, '{}', {})"
_LATE = "coalesce(strftime(TRY_CAST({} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), 'unreadable')"
_TIMES = f"""{_Q}, x AS (SELECT question_id, lower(question) AS t FROM q), y0 AS (SELECT *, {_X.format('([a-z]+) +([0-9]{1,2}),? +([0-9]{4})', 1)} AS word FROM x), y AS (SELECT question_id, t,
  CASE WHEN word IN ('january', 'jan') THEN 1 WHEN word IN ('february', 'feb') THEN 2 WHEN word IN ('march', 'mar') THEN 3 WHEN word IN ('april', 'apr') THEN 4 WHEN word = 'may' THEN 5 WHEN word IN ('june', 'jun') THEN 6 WHEN word IN ('july', 'jul') THEN 7
    WHEN word IN ('august', 'aug') THEN 8 WHEN word IN ('september', 'sep', 'sept') THEN 9 WHEN word IN ('october', 'oct') THEN 10 WHEN word IN ('november', 'nov') THEN 11 WHEN word IN ('december', 'dec') THEN 12 ELSE 0 END AS m,
  {_X.format('([a-z]+) +([0-9]{1,2}),? +([0-9]{4})', 2)} AS d, {_X.format('([a-z]+) +([0-9]{1,2}),? +([0-9]{4})', 3)} AS y1,
  {_X.format('([0-9]{4}-[0-9]{2}-[0-9]{2})', 1)} AS iso, {_X.format('q([1-4]) ([0-9]{4})', 1)} AS qn, {_X.format('q([1-4]) ([0-9]{4})', 2)} AS qy, {_X.format('end of ([0-9]{4})', 1)} AS eo,
  {_X.format('before ([0-9]{4})', 1)} AS bf, {_X.format('as of ([0-9]{4})', 1)} AS ao, {_X.format('(in|during) ([0-9]{4})', 2)} AS iy, {_X.format('(fy|fiscal year) *([0-9]{4})', 2)} AS fy FROM y0),
told AS (SELECT question_id, CASE WHEN m > 0 THEN {_LATE.format("y1 || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0')")} WHEN iso <> '' THEN {_LATE.format('iso')}
  WHEN qn <> '' THEN qy || CASE qn WHEN '1' THEN '-03-31' WHEN '2' THEN '-06-30' WHEN '3' THEN '-09-30' ELSE '-12-31' END || ' 23:59:59'
  WHEN eo <> '' THEN eo || '-12-31 23:59:59' WHEN bf <> '' THEN (bf::INT - 1)::VARCHAR || '-12-31 23:59:59' WHEN ao <> '' THEN ao || '-12-31 23:59:59'
  WHEN iy <> '' THEN iy || '-12-31 23:59:59' WHEN fy <> '' THEN fy || '-12-31 23:59:59' END AS told,
  CASE WHEN m > 0 THEN y1 WHEN iso <> '' THEN substr(iso, 1, 4) WHEN qn <> '' THEN qy WHEN eo <> '' THEN eo WHEN bf <> '' THEN '2000' WHEN ao <> '' THEN ao WHEN iy <> '' THEN iy WHEN fy <> '' THEN fy END || '-01-01 00:00:00' AS window_start FROM y),
times AS (SELECT question_id, nullif(told, 'unreadable') AS reference, window_start, coalesce(told = 'unreadable', false) AS unreadable FROM told)"""


@query(f"WITH {_TIMES} SELECT question_id, reference, window_start, unreadable FROM times")
def reference_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moment and the window that every question speaks of, and whether the moment is one the calendar lacks."""
    got = questions(spark, sf_dir).select("question_id", when.reference_time(F.col("question")).alias("t"))
    said = lambda c: F.date_format(f"t.{c}", "yyyy-MM-dd HH:mm:ss").alias(c)
    return got.select("question_id", said("reference"), said("window_start"), F.coalesce("t.unreadable", F.lit(False)).alias("unreadable"))


def _any(cues: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(t, '{c.replace(chr(39), chr(39) * 2)}')" for c in cues) + ")"


# the rules in their own words, not the operator's: cues of relationships, depth and type
_WANTED = f"""CASE WHEN {_any(('depend on', 'depends on', 'dependency', 'dependencies', 'dependent on', 'reliant on', 'relies on', 'supplier', 'supply', 'supplies', 'supplied by', 'vendor'))} THEN ['DEPENDS_ON', 'SUPPLIES'] ELSE [] END,
  CASE WHEN {_any(('compete', 'competitor', 'competition', 'rival'))} THEN ['COMPETES_WITH'] ELSE [] END, CASE WHEN {_any(('risk', 'threat', 'danger', 'vulnerability', 'vulnerabilities', 'hazard'))} THEN ['AFFECTED_BY', 'HAS_RISK'] ELSE [] END,
  CASE WHEN {_any(('partner', 'alliance', 'collaboration', 'collaborate'))} THEN ['PARTNERS_WITH'] ELSE [] END, CASE WHEN {_any(('acquired', 'acquisition', 'acquire', 'merger', 'merged with', 'buyout'))} THEN ['ACQUIRED'] ELSE [] END,
  CASE WHEN {_any(('invested', 'investment', 'investor', 'stake in'))} THEN ['INVESTED_IN'] ELSE [] END, CASE WHEN {_any(('manufacture', 'product', 'produce', 'makes'))} THEN ['MANUFACTURES'] ELSE [] END,
  CASE WHEN {_any(('located in', 'headquarters', 'headquartered in', 'facilities in', 'based in'))} THEN ['LOCATED_IN'] ELSE [] END"""
_DEPTH = f"""CASE WHEN {_any(('compare', 'versus', 'vs', 'differ', 'respective'))} AND NOT {_any(("supplier's supplier", 'chain of suppliers', '3-hop', 'three hops'))} THEN 10
  WHEN {_any(('3-hop', 'three hops', 'three steps', 'path from', 'path between', 'indirectly connected through its supplier', 'chain of suppliers'))} THEN 31
  WHEN {_any(('connected to', 'connection between', 'relationship between', 'indirect', 'through its', 'through their', "supplier's supplier", "customer's customer", 'supplier of a product', 'supplier does nvidia depend on for a product', 'supplier for a product', 'supplier that produces', 'connected through', 'intermediary', 'chain', 'both', 'compete with each other'))} THEN 21
  WHEN len(e) >= 2 AND {_any(('connect', 'relation', 'between', 'link', 'interact'))} THEN 21
  WHEN contains(t, 'supplier')::INT + contains(t, 'supply')::INT + contains(t, 'depend')::INT + contains(t, 'product')::INT + contains(t, 'manufacture')::INT + contains(t, 'risk')::INT + contains(t, 'affect')::INT + contains(t, 'compete')::INT + contains(t, 'partner')::INT >= 2
    AND {_any(('that', 'which', 'for a', 'for their', 'whose', 'of companies', 'companies that'))} THEN 21 ELSE 10 END"""
_ANALYSED = f"""{_LINKED}, {_TIMES.removeprefix(_Q + ', ')},
tickers AS (SELECT question_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(question, '\\b[A-Z]{{1,5}}\\b'), lambda z: z NOT IN ('A', 'I', 'IN', 'ON', 'AT', 'TO', 'OR', 'AND')), lambda z: 'company:' || z))) AS u FROM q),
a0 AS (SELECT question_id, t, CASE WHEN len(e) > 0 THEN e ELSE u END AS e, reference, unreadable FROM x JOIN ent USING (question_id) JOIN times USING (question_id) JOIN tickers USING (question_id)),
a AS (SELECT question_id, t, e, list_sort(list_distinct(flatten([{_WANTED}]))) AS w, {_DEPTH} AS k, reference, unreadable FROM a0),
h AS (SELECT *, list_filter([CASE WHEN {_any(('compare', 'higher', 'lower', 'more than', 'less than', 'versus', 'vs', 'better', 'greater', 'outperform'))} OR (len(e) >= 2 AND contains(t, ' or ')) THEN 'comparison' END,
  CASE WHEN {_any(('total', 'sum', 'average', 'how many', 'count of', 'overall revenue', 'aggregate'))} THEN 'aggregation' END, CASE WHEN k % 10 = 1 THEN 'multi-hop' END,
  CASE WHEN reference IS NOT NULL OR {_any(('when', 'year', 'quarter', 'timeline', 'date'))} THEN 'temporal' END,
  CASE WHEN len(w) > 0 OR {_any(('connect', 'supplier', 'depend', 'partner', 'compete', 'affect', 'manufacture', 'risk'))} THEN 'relationship' END], lambda z: z IS NOT NULL) AS h0 FROM a),
g AS (SELECT *, CASE WHEN len(h0) = 0 OR regexp_matches(t, '^(what|who|where|which)') THEN list_append(h0, 'factual') ELSE h0 END AS h1 FROM h),
f AS (SELECT *, CASE WHEN list_contains(h1, 'comparison') THEN 'comparison' WHEN list_contains(h1, 'multi-hop') THEN 'multi-hop' ELSE h1[1] END AS prim FROM g)"""


@query(f"""WITH {_ANALYSED} SELECT question_id, array_to_string(e, ',') AS entities, array_to_string(w, ',') AS intents, CAST(k // 10 AS INTEGER) AS hops, k % 10 = 1 AS multi_hop, prim AS primary_type,
  array_to_string(list_filter(h1, lambda z: z <> prim), ',') AS secondary_types, len(e) >= 2 OR k % 10 = 1 OR prim = 'comparison' AS cross_document FROM f""")
def question_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything the analyser says of every question."""
    a = analysed(spark, sf_dir)
    said = lambda c, name=None: F.array_join(c, ",").alias(name or c)
    return a.select("question_id", said("entities"), said("intents"), "hops", "multi_hop", F.col("primary").alias("primary_type"), said("secondary", "secondary_types"), "cross_document")


#: Every user turn, for the same analysis.
TURNS = "SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user'"


def _parts(name: str, rows) -> None:
    """The analysis part by part, over the questions of ``rows`` (as in :func:`questions`) or every user turn."""
    swap = lambda sql: sql if rows is questions else sql.replace(QUESTIONS, TURNS)
    whole = lambda spark, sf_dir: analysis.analyse(rows(spark, sf_dir), terms(spark, sf_dir))

    def keep(part: str, sql: str, show) -> None:
        QUERIES[part + name], SQL[part + name] = (lambda spark, sf_dir: show(spark, sf_dir)), swap(sql)

    keep("intent_detection", f"WITH {_Q}, x AS (SELECT question_id, lower(question) AS t FROM q) SELECT question_id, array_to_string(list_sort(list_distinct(flatten([{_WANTED}]))), ',') AS intents FROM x",
         lambda spark, sf_dir: rows(spark, sf_dir).select("question_id", F.array_join(analysis.intents(F.col("question")), ",").alias("intents")))
    keep("hop_depth", f"WITH {_ANALYSED} SELECT question_id, CAST(k // 10 AS INTEGER) AS hops, k % 10 = 1 AS multi_hop FROM f", lambda spark, sf_dir: whole(spark, sf_dir).select("question_id", "hops", "multi_hop"))
    keep("question_type", f"WITH {_ANALYSED} SELECT question_id, prim AS primary_type FROM f", lambda spark, sf_dir: whole(spark, sf_dir).select("question_id", F.col("primary").alias("primary_type")))
    keep("temporal_constraints", f"WITH {_TIMES} SELECT question_id, reference FROM times",
         lambda spark, sf_dir: rows(spark, sf_dir).select("question_id", F.date_format(when.reference_time(F.col("question"))["reference"], "yyyy-MM-dd HH:mm:ss").alias("reference")))
    keep("entity_linking", f"WITH {_LINKED} SELECT question_id, unnest(e) AS node FROM ent", lambda spark, sf_dir: analysis.link_entities(rows(spark, sf_dir), terms(spark, sf_dir)).select("question_id", F.explode("entities").alias("node")))


_parts("", questions)
_parts("_turns", lambda spark, sf_dir: run(spark, sf_dir, TURNS))

#: Edges of the trade graph with a relationship by direction and a chunk each.
_REL = "CASE (src + dst) % 4 WHEN 0 THEN 'SUPPLIES' WHEN 1 THEN 'HAS_RISK' WHEN 2 THEN 'PARTNERS_WITH' ELSE 'DEPENDS_ON' END"


#: Nodes of the trade graph: most are companies, some are known from a date on.
_NODES = """SELECT 'company:' || n_nationkey AS node_id, n_name AS name, CASE WHEN n_regionkey = 2 THEN 'product' ELSE 'company' END AS node_type,
  CASE WHEN n_nationkey % 7 = 0 THEN CAST('199' || (4 + n_nationkey % 3) || '-01-0' || (1 + n_nationkey % 9) || ' 00:00:00' AS {ts}) END AS available_ts FROM nation"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _NODES.format(ts="TIMESTAMP_NTZ"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade edges with what evidence needs of them; one in eleven is marked as not verified."""
    t = trade(spark, sf_dir)
    node = lambda c: F.concat(F.lit("company:"), F.col(c).cast("string"))
    chunk = F.pmod(F.col("src") * 31 + F.col("dst") * 7, F.lit(200))
    return t.select(
        F.concat_ws(">", "src", "dst").alias("edge_id"), node("src").alias("src"), node("dst").alias("dst"), F.expr(_REL).alias("relationship"), "available_ts", "event_ts", "confidence", chunk.cast("long").alias("chunk_id"),
        F.concat(F.lit("doc:"), (chunk % 50).cast("string")).alias("document_id"), F.col("src").cast("string").alias("source_company"), ((F.col("src") * 7 + F.col("dst")) % 11 != 0).alias("provenance_verified"),
    )


#: What a vector is of, by rule from its id and label: a time, a company, a period and a form.
_VECTORS = """SELECT vec_id, embedding, CAST('199' || (4 + vec_id % 5) || '-0' || (1 + vec_id % 9) || '-1' || (vec_id % 10) || ' 00:00:00' AS {ts}) AS available_ts, 'company:' || vec_id % 25 AS company,
  CASE vec_id % 6 WHEN 0 THEN '1995-03-31' WHEN 1 THEN '1995-06-30' WHEN 2 THEN '1995-12-31' WHEN 3 THEN '1996-06-30' WHEN 4 THEN '1996-09-30' END AS fiscal_period,
  CASE label % 4 WHEN 0 THEN 'DEF 14A' WHEN 1 THEN '10-K' WHEN 2 THEN '10-Q' ELSE '8-K' END AS document_type FROM embeddings"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _VECTORS.format(ts="TIMESTAMP_NTZ"))


def _encode(text: F.Column) -> F.Column:
    """A stand-in for an encoder that both engines can say: 64 sums over the words, by first and last letter and length."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    of = lambda w, i: ((F.ascii(w) * 31 + F.length(w) * 17 + F.ascii(F.right(w, F.lit(1))) * 7 + i * 13) % 11 - 5).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.aggregate(words, F.lit(0.0), lambda s, w: s + of(w, i)))


_ENCODED = "list_transform(range(64), lambda i: list_sum(list_transform(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda z: ((ascii(z) * 31 + length(z) * 17 + ascii(right(z, 1)) * 7 + i * 13) % 11 - 5)::DOUBLE)))"
_EDGE_SQL = """SELECT s_nationkey AS src, c_nationkey AS dst, MIN(l_shipdate) AS available_ts, ROUND(1 - AVG(l_discount), 6) AS confidence
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey"""
_COS = "ROUND(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) / sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))), 6)"
_STEP = "(ref IS NULL OR (bo.ts <= ref AND (bo.nt IS NULL OR bo.nt <= ref)))"


def _longer(k: int) -> str:
    return f"""p{k} AS (SELECT p{k - 1}.question_id, t, w, e, hops, ref, list_append(path, bo.b) AS path, list_append(ids, bo.edge_id) AS ids, list_append(rs, bo.r) AS rs, p{k - 1}.c * bo.c AS c, greatest(p{k - 1}.ts, bo.ts) AS ts, bo.chunk_id, bo.b AS en, bo.co, p{k - 1}.fw
  FROM p{k - 1} JOIN bo ON p{k - 1}.en = bo.a WHERE hops >= {k} AND {_STEP} AND NOT list_contains(path, bo.b))"""


# every path is listed and then ranked
_PATHS_SQL = f"""{_ANALYSED}, no AS ({_NODES.format(ts='TIMESTAMP')}),
ed AS (SELECT src || '>' || dst AS edge_id, 'company:' || src AS src, 'company:' || dst AS dst, {_REL} AS r, available_ts AS ts, confidence AS c, (src * 31 + dst * 7) % 200 AS chunk_id FROM ({_EDGE_SQL}) WHERE (src * 7 + dst) % 11 <> 0),
bo AS (SELECT z.*, node_type = 'company' AS co, available_ts AS nt FROM (SELECT src AS a, dst AS b, edge_id, r, ts, c, chunk_id, true AS fw FROM ed UNION ALL SELECT dst, src, edge_id, r, ts, c, chunk_id, false FROM ed) z JOIN no ON no.node_id = z.b),
s0 AS (SELECT question_id, t, w, e, k // 10 AS hops, TRY_CAST(reference AS TIMESTAMP) AS ref, unnest(e) AS a FROM f WHERE question_id % 20 = 0 AND NOT unreadable),
s1 AS (SELECT s0.* FROM s0 JOIN no ON no.node_id = s0.a WHERE no.available_ts IS NULL OR ref IS NULL OR no.available_ts <= ref),
p1 AS (SELECT s1.question_id, t, w, e, hops, ref, [s1.a, bo.b] AS path, [edge_id] AS ids, [r] AS rs, c, ts, chunk_id, bo.b AS en, co, fw FROM s1 JOIN bo ON s1.a = bo.a WHERE {_STEP}),
{_longer(2)}, {_longer(3)},
pa AS (SELECT *, CASE WHEN len(ids) = 1 THEN 'edge:' || ids[1] ELSE 'path:' || array_to_string(ids, ':') END AS evidence_id FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)),
po AS (SELECT * FROM pa QUALIFY row_number() OVER (PARTITION BY question_id, evidence_id ORDER BY path[1]) = 1),
ps AS (SELECT *, c / (1 + 0.5 * (len(ids) - 1)) * CASE WHEN len(w) = 0 THEN 1.0 WHEN len(list_filter(rs, lambda z: NOT list_contains(w, z))) = 0 THEN 8.0 WHEN len(list_intersect(rs, w)) > 0 THEN 5.0 ELSE 0.2 END
  * CASE WHEN regexp_matches(t, 'company|companies|firm|corporation') AND co AND len(w) > 0 THEN 1.5 ELSE 1.0 END
  * CASE WHEN contains(t, 'depend') AND len(w) > 0 AND len(ids) = 1 THEN
      CASE WHEN list_contains(e, CASE WHEN fw THEN path[1] ELSE path[2] END) THEN CASE rs[1] WHEN 'SUPPLIES' THEN 0.1 WHEN 'DEPENDS_ON' THEN 2.0 ELSE 1.0 END ELSE 1.0 END
      * CASE WHEN list_contains(e, CASE WHEN fw THEN path[2] ELSE path[1] END) AND rs[1] = 'SUPPLIES' THEN 2.0 ELSE 1.0 END ELSE 1.0 END AS score FROM po),
ranked AS (SELECT question_id, evidence_id, chunk_id, path, rs, ids, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, len(ids), ts IS NULL, evidence_id) AS rank FROM ps),
gr AS (SELECT question_id, evidence_id, chunk_id, rank FROM ranked WHERE rank <= 20)"""
_OWNS = "(?i)\\b(own|owns|owned|owner\\w*|ownership|stake\\w*|shareholder\\w*|stockholder\\w*|majority|largest holder\\w*|major holder\\w*|institutional|holds? (the )?most|share\\w* in)\\b"
_PAY = "(?i)\\b(ceo pay|compensation|salary|salaries|paid|pay package|bonus\\w*|stock awards?|executive pay)\\b"
_BOARD = "(?i)\\b(board of directors|directors?|board members?|independent director\\w*|chair\\w*)\\b"
# every search of a question beside every vector
_VECTOR_SQL = f"""ve0 AS ({_VECTORS.format(ts='TIMESTAMP')}),
aq AS (SELECT f.question_id, q.question, f.t, list_filter(f.e, lambda z: starts_with(z, 'company:'))[1:2] AS own, TRY_CAST(reference AS TIMESTAMP) AS ref,
  list_filter([CASE WHEN regexp_matches(f.t, '(january|february|march|april|may|june|july|august|september|october|november|december) +[0-9]{{1,2}},? +[0-9]{{4}}') THEN strftime(TRY_CAST(reference AS TIMESTAMP), '%Y-%m-%d') END, nullif(regexp_extract(q.question, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b'), '')], lambda z: z IS NOT NULL)[1:2] AS pe
  FROM f JOIN q USING (question_id) WHERE f.question_id % 20 = 0 AND NOT unreadable),
ac AS (SELECT question_id, question, t, ref, pe, unnest(range(len(own))) AS o2, unnest(own) AS company FROM aq),
topics AS (SELECT question_id, ref, o2, company, x.o3, x.said FROM ac, (VALUES (0, '{_OWNS}', 'Security Ownership of Certain Beneficial Owners and Management 5% stockholders beneficially owned percent of class shares outstanding'),
  (1, '{_PAY}', 'Summary Compensation Table named executive officers salary bonus stock awards total compensation'), (2, '{_BOARD}', 'Board of Directors nominees director independence committees')) x(o3, pattern, said) WHERE regexp_matches(question, x.pattern)),
fresh AS (SELECT ac.question_id, ac.company, v.fiscal_period, v.document_type IN ('10-Q', '10-K') AS periodic FROM ac JOIN ve0 v ON v.company = ac.company AND (ref IS NULL OR v.available_ts <= ref) AND v.fiscal_period IS NOT NULL
  WHERE len(pe) = 0 AND regexp_matches(t, '\\b(latest|most recent|current|recent quarter|last quarter|newest)\\b')),
newest AS (SELECT question_id, company, max(fiscal_period) FILTER (WHERE periodic) AS p1, max(fiscal_period) AS p2 FROM fresh GROUP BY ALL),
se AS (SELECT question_id, question AS said, ref, NULL AS company, NULL AS period, NULL AS form, 20 AS k, 2 AS o1, 0 AS o2, 0 AS o3 FROM aq
  UNION ALL SELECT question_id, question, ref, company, NULL, NULL, 8, 1, o2, 99 FROM ac
  UNION ALL SELECT question_id, question, ref, company, unnest(pe), NULL, 6, 1, o2, unnest(range(len(pe))) FROM ac
  UNION ALL SELECT ac.question_id, question, ref, ac.company, p1, NULL, 6, 1, o2, 0 FROM ac JOIN newest USING (question_id, company) WHERE p1 IS NOT NULL
  UNION ALL SELECT ac.question_id, question, ref, ac.company, p2, NULL, 6, 1, o2, 1 FROM ac JOIN newest USING (question_id, company) WHERE p2 IS NOT NULL AND p2 IS DISTINCT FROM p1
  UNION ALL SELECT question_id, said, ref, company, NULL, 'DEF 14A', 4, 0, o2, o3 FROM topics
  UNION ALL SELECT question_id, said, ref, company, NULL, NULL, 4, 0, o2, o3 FROM topics t
    WHERE NOT EXISTS (SELECT 1 FROM ve0 v WHERE v.company = t.company AND v.document_type = 'DEF 14A' AND (t.ref IS NULL OR v.available_ts <= t.ref))),
en AS (SELECT said, {_ENCODED.format('said')} AS qv FROM (SELECT DISTINCT said FROM se)),
hi AS (SELECT se.*, v.vec_id, row_number() OVER (PARTITION BY question_id, o1, o2, o3 ORDER BY {_COS.format(a='v.embedding', b='en.qv')} DESC, v.vec_id) AS rk FROM se JOIN en USING (said)
  JOIN ve0 v ON (se.ref IS NULL OR v.available_ts <= se.ref) AND (se.company IS NULL OR v.company = se.company) AND (se.period IS NULL OR v.fiscal_period = se.period) AND (se.form IS NULL OR v.document_type = se.form) QUALIFY rk <= k),
hn AS (SELECT *, count(*) FILTER (WHERE o1 < 2) OVER (PARTITION BY question_id) AS n FROM hi),
hf AS (SELECT * FROM hn QUALIFY row_number() OVER (PARTITION BY question_id, vec_id ORDER BY o1, o2, o3, rk) = 1),
ve AS (SELECT question_id, vec_id AS chunk_id, o1 = 0 AS topical, row_number() OVER (PARTITION BY question_id ORDER BY o1, o2, o3, rk, vec_id) AS rank, n FROM hf QUALIFY rank <= greatest(20, n))"""
_FUSED_SQL = f"""WITH {_PATHS_SQL}, {_VECTOR_SQL},
be AS (SELECT question_id, chunk_id, MIN(rank) AS g FROM gr GROUP BY ALL),
fu AS (SELECT ve.question_id, CASE WHEN g IS NULL THEN 'vector:' ELSE 'hybrid:' END || ve.chunk_id AS evidence_id, CASE WHEN g IS NULL THEN 'vector' ELSE 'hybrid' END AS source_type, 1.0::DOUBLE / (60 + rank) + coalesce(1.0::DOUBLE / (60 + g), 0) AS s FROM ve LEFT JOIN be USING (question_id, chunk_id)
  UNION ALL SELECT gr.question_id, 'graph:' || evidence_id, 'graph', 1.0::DOUBLE / (60 + rank) FROM gr ANTI JOIN ve USING (question_id, chunk_id))
SELECT question_id, evidence_id, source_type, ROUND(s, 6) AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY ROUND(s, 6) DESC, evidence_id) AS INTEGER) AS rank FROM fu QUALIFY rank <= 8"""


def _each(spark: SparkSession, sf_dir: str, work) -> DataFrame:
    """``work(analysed)`` for every twentieth question. Searches, walks and judgements hang on a question's text alone, so each text is searched, walked and judged once."""
    stated = questions(spark, sf_dir).where("question_id % 20 = 0")
    return analysis.by_text(stated, lambda q: _kept(work(_kept(analysis.analyse(q, terms(spark, sf_dir))))))


def _kept(df: DataFrame) -> DataFrame:
    return settle(df, "round")


@query(f"WITH {_ANALYSED}, {_VECTOR_SQL} SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank, topical FROM ve")
def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector side of every twentieth question: sections of its topics, its periods and companies first, then everything, each search at the question's own time."""
    return _each(spark, sf_dir, lambda asked: hybrid.vector_side(asked, _vectors(spark, sf_dir), _encode, 20, keep=_kept))


@query(_FUSED_SQL)
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search and graph paths of every twentieth question at its own time, fused and cut at eight."""
    edges = _edges(spark, sf_dir)

    def work(asked: DataFrame) -> DataFrame:
        graph = traversal.top_paths(asked, edges, 20, _nodes(spark, sf_dir), _kept).withColumn("edge_id", F.element_at("edge_ids", -1)).join(edges.select("edge_id", "chunk_id"), "edge_id")
        graph = graph.select("question_id", "evidence_id", "chunk_id", "rank")
        vector = hybrid.vector_side(asked, _vectors(spark, sf_dir), _encode, 20, keep=_kept)
        return hybrid.fuse(vector, graph, limit=8).select("question_id", "evidence_id", "source_type", "score", "rank")

    return _each(spark, sf_dir, work)


@query(f"WITH {_PATHS_SQL} SELECT question_id, evidence_id, array_to_string(path, ' > ') AS path, array_to_string(rs, ' -> ') AS relationship, CAST(len(ids) AS INTEGER) AS hop_count, ROUND(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def path_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best paths of up to three hops of every twentieth question under its intents and its time."""
    best = _each(spark, sf_dir, lambda asked: traversal.top_paths(asked, _edges(spark, sf_dir), 10, _nodes(spark, sf_dir), _kept))
    return best.select("question_id", "evidence_id", F.array_join("path", " > ").alias("path"), F.array_join("relationships", " -> ").alias("relationship"), "hop_count", "score", "rank")


def _retriever(spark: SparkSession, sf_dir: str):
    edges, nodes = _edges(spark, sf_dir), _nodes(spark, sf_dir)

    def retrieve(asked: DataFrame, fetch: int) -> DataFrame:
        best = traversal.top_paths(asked, edges, fetch, nodes, _kept)
        return hybrid.evidence_rows(best, edges, nodes).join(asked.select("question_id", "question", "intents"), "question_id")

    return retrieve


def _answered(spark: SparkSession, sf_dir: str, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    best, gated = hybrid.orchestrate(asked, _retriever(spark, sf_dir), top_k=8, rounds=2, keep=_kept)
    return asked, best, gated


@query()
def agent_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orchestration with two further rounds at most for what is insufficient: the judgement of every twentieth question."""
    return _each(spark, sf_dir, lambda asked: _answered(spark, sf_dir, asked)[2]).select("question_id", "sufficient", "reason", "n_evidence", "max_hops", "rounds")


@query()
def evidence_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would be given for every twentieth question."""
    said = ["question_id", "sufficient", F.size("evidence").alias("n_evidence"), F.array_join("sources", ",").alias("sources"), F.array_join("paths", ";").alias("paths")]
    return _each(spark, sf_dir, lambda asked: answers.package(*_answered(spark, sf_dir, asked)).select(*said))


_OUT = """SELECT question_id, CASE question_id % 8
  WHEN 0 THEN '{"answer": "A risk.", "confidence": 0.9, "evidence_ids": ["e1"]}'
  WHEN 1 THEN '{"answer": "Insufficient evidence in the retrieved corpus.", "confidence": 0.0, "evidence_ids": []}'
  WHEN 2 THEN '{"answer": "x", "confidence": 1.5, "evidence_ids": ["e1", "e9"]}'
  WHEN 3 THEN '{"answer": "", "evidence_ids": "e1"}'
  WHEN 4 THEN 'no json at all' WHEN 5 THEN '{"answer": "x", "confidence": 0.5, "evidence_ids": []}'
  WHEN 6 THEN '{"answer": "x", "confidence": 0.5, "evidence_ids": ["e2"]}' ELSE '{"answer": "x", "confidence": 0.5, "evidence_ids": ["e3"]}' END AS raw FROM q"""


@query(f"""WITH {_Q} SELECT question_id, CASE question_id % 8 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'confidence,unknown_ids' WHEN 3 THEN 'fields,answer,confidence,id_list,uncited' WHEN 4 THEN 'json' WHEN 5 THEN 'uncited' WHEN 6 THEN 'future' ELSE '' END
  || CASE WHEN question_id % 3 = 2 AND question_id % 8 NOT IN (1, 4) THEN '!' ELSE '' END
  || CASE WHEN contains(lower(question), 'depend') AND question_id % 8 IN (3, 5, 7) THEN '+alignment' ELSE '' END AS errors FROM q""")
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine checks of made-up outputs against made-up packages, two thirds of them sufficient."""
    q = questions(spark, sf_dir)
    out = run(spark, sf_dir, f"WITH q AS ({QUESTIONS}) {_OUT}")
    items = """array(named_struct('place', 1, 'evidence_id', 'e1', 'text', 'A --[DEPENDS_ON]--> B', 'document_id', 'd', 'chunk_id', 'c', 'available_time', '1995-01-01 00:00:00', 'route', ''),
      named_struct('place', 2, 'evidence_id', 'e2', 'text', 'B --[SUPPLIES]--> A', 'document_id', 'd', 'chunk_id', 'c', 'available_time', '1997-01-01 00:00:00', 'route', ''),
      named_struct('place', 3, 'evidence_id', 'e3', 'text', 'plain', 'document_id', 'd', 'chunk_id', CAST(NULL AS STRING), 'available_time', '1995-01-01 00:00:00', 'route', ''))"""
    packages = q.select("question_id", "question", F.lit(False).alias("multi_hop"), (F.col("question_id") % 3 != 2).alias("sufficient"), F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'").alias("reference"), F.expr(items).alias("evidence"))
    got = answers.validate(out, packages)
    rest = F.array_except("errors", F.array(F.lit("unrefused"), F.lit("alignment")))
    mark = F.concat(F.when(F.array_contains("errors", "unrefused"), "!").otherwise(""), F.when(F.array_contains("errors", "alignment"), "+alignment").otherwise(""))
    return got.select("question_id", F.concat(F.array_join(rest, ","), mark).alias("errors"))


@query(f"WITH {_Q}, x AS (SELECT question_id, lower(question) AS t FROM q) SELECT question_id, regexp_matches(t, '(as of|by|before|prior to) (june|sept|feb|dec|[0-9]{{4}}-)|(as of|before) [0-9]{{4}}') AS has_cutoff, regexp_extract(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS iso_days FROM x")
def explicit_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only explicit cut-offs restrict evidence in assist mode; ISO days are the period ends a question names."""
    q = questions(spark, sf_dir)
    iso = F.coalesce(F.get(F.filter(when.period_ends(F.col("question")), lambda d: F.col("question").contains(d)), F.lit(0)), F.lit(""))
    return q.select("question_id", when.cutoff_window(F.col("question")).isNotNull().alias("has_cutoff"), iso.alias("iso_days"))


@query("""SELECT conv_id, turn, NOT regexp_matches(lower(text), '(^|[^a-z0-9_])(sec|10-?k|10-?q|8-?k|filings?|disclos[a-z0-9_]*|annual report|quarterly|quarter|fiscal|revenue[a-z0-9_]*|sales|income|earnings|profit[a-z0-9_]*|margin[a-z0-9_]*|ebitda|eps|guidance|outlook|forecast|cash|debt|liabilit[a-z0-9_]*|assets?|capex|working capital|capital return[a-z0-9_]*|capital expenditure[a-z0-9_]*|expenditure[a-z0-9_]*|dividend[a-z0-9_]*|buyback[a-z0-9_]*|repurchase[a-z0-9_]*|share[a-z0-9_]*|stock[a-z0-9_]*|valuation|market|segment[a-z0-9_]*|customer[a-z0-9_]*|suppl[a-z0-9_]*|partner[a-z0-9_]*|compet[a-z0-9_]*|acqui[a-z0-9_]*|merger[a-z0-9_]*|invest[a-z0-9_]*|risk[a-z0-9_]*|lawsuit[a-z0-9_]*|litigation|regulat[a-z0-9_]*|antitrust|ceo|cfo|executive[a-z0-9_]*|board|employees?|headcount|company|companies|corporation|business|industry|sector|bank[a-z0-9_]*|loan[a-z0-9_]*|interest|inflation|tariff[a-z0-9_]*|export[a-z0-9_]*|chip[a-z0-9_]*|semiconductor[a-z0-9_]*|ai|cloud|subsidiar[a-z0-9_]*)([^a-z0-9_]|$)') AS off,
  regexp_matches(lower(text), 'insufficient evidence|insufficient information|not provided in the evidence|cannot be determined|no evidence') AS refused FROM conversations""")
def turn_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns off topic, and refusals. Word ends are those of ASCII words."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", analysis.off_topic(F.col("text"), F.lit(0)).alias("off"), T.is_refusal(F.col("text")).alias("refused"))


@query(f"WITH {_Q} SELECT question_id, CAST(len(list_filter([regexp_matches(lower(question), '(^|[^a-z0-9_])(own|owns|owned|owner[a-z]*|ownership|stake[a-z]*|shareholder[a-z]*|stockholder[a-z]*|majority|institutional)'), regexp_matches(lower(question), 'ceo pay|compensation|salary|salaries|pay package'), regexp_matches(lower(question), 'board of directors|directors?|board members?')], lambda z: z)) AS INTEGER) AS n_topics FROM q")
def topic_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", F.size(analysis.topic_sections(F.col("question"))).alias("n_topics"))
