"""Labels of edges by their text, the gate in its modes, expected paths, canonical ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import analysis, features, gate, hybrid, pathmatch, provenance
from ..sources.sinks import settle
from .base import QUERIES, SQL, query, run, table
from .questions import _ANALYSED, _VECTORS, NODES, analysed
from .questions import _vectors as vectors

# Edges as an extraction would leave them: an edge a line, read from a chunk, in a document of some issuer. Both engines read these.
_CLAIMS = """SELECT l_orderkey || '-' || l_linenumber AS edge_id, 'company:S' || l_suppkey AS src, CASE WHEN l_linenumber % 3 = 0 THEN 'risk:' || (l_partkey % 9) ELSE 'company:S' || (1 + l_partkey % 100) END AS dst,
  CASE l_linenumber WHEN 1 THEN 'SUPPLIES' WHEN 2 THEN 'PARTNERS_WITH' WHEN 3 THEN 'HAS_RISK' WHEN 4 THEN 'DEPENDS_ON' WHEN 5 THEN 'AFFECTED_BY' ELSE 'HAS_RISK' END AS relationship,
  CASE WHEN l_orderkey % 29 = 0 THEN NULL WHEN l_orderkey % 31 = 0 THEN 'doc_amd_10k_' || l_orderkey ELSE 'doc:sec:' || (l_orderkey % 1000) END AS document_id, l_orderkey % 1000 AS chunk_id,
  CASE WHEN l_orderkey % 37 = 0 THEN l_linenumber % 2 = 0 END AS provenance_verified, CASE WHEN l_orderkey % 74 = 0 THEN 'manual' END AS attribution_status,
  CASE WHEN l_orderkey % 41 = 0 THEN 'S' || l_suppkey END AS source_company FROM lineitem"""
_CHUNKS = """SELECT doc_id AS chunk_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE text || ' Delays from CO' || (doc_id % 100 + 1) || 'X and co' || (doc_id * 7 % 100 + 1) || 'x were seen; the Co' || (doc_id * 3 % 100 + 1) || 'x risk is known.' END AS text FROM documents"""
_ISSUERS = "SELECT 'doc:sec:' || doc_id AS document_id, CASE WHEN doc_id % 23 <> 0 THEN 'S' || (1 + doc_id % 100) END AS issuer FROM documents"
_SAYS = "contains(low, '{}' || st || '{}')"


@query(f"""WITH e AS ({_CLAIMS}), c AS ({_CHUNKS}), i AS ({_ISSUERS}),
x AS (SELECT e.*, coalesce(e.source_company, i.issuer) AS iss, coalesce(lower(c.text), '') AS low, 'co' || substr(src, 10) || 'x' AS st, CASE WHEN s_suppkey IS NOT NULL THEN 'co' || s_suppkey || 'x' ELSE lower(substr(dst, 9)) END AS dt FROM e LEFT JOIN i USING (document_id) LEFT JOIN c USING (chunk_id) LEFT JOIN supplier ON dst = 'company:S' || s_suppkey),
y AS (SELECT *, substr(src, 9) <> iss AS cross_src, starts_with(dst, 'company:') AND substr(dst, 9) <> iss AS cross_dst,
  {' OR '.join(_SAYS.format(a, b) for a, b in (('', ' risk'), ('risk to ', ''), ('risk for ', ''), ('', "''s risk"), ('', ' face'), ('', ' subject to'), ('disruptions at ', ''), ('delays from ', '')))} AS discussed FROM x),
z AS (SELECT *, CASE WHEN provenance_verified IS NOT NULL THEN coalesce(attribution_status, 'explicit') WHEN document_id IS NULL THEN 'missing_provenance' WHEN NOT starts_with(document_id, 'doc:sec:') THEN 'verified_mock_fixture' WHEN iss IS NULL THEN 'unknown_issuer'
  WHEN cross_src AND NOT contains(low, st) THEN 'unsupported_cross_company' WHEN cross_src AND relationship IN ('HAS_RISK', 'AFFECTED_BY') AND NOT discussed THEN 'unsupported_cross_company_risk'
  WHEN cross_dst AND low <> '' AND NOT contains(low, dt) THEN 'unsupported_cross_company' WHEN NOT cross_src THEN 'verified_issuer' ELSE 'verified_cross_company' END AS status FROM y)
SELECT edge_id, status, coalesce(provenance_verified, starts_with(status, 'verified')) AS verified,
  CASE WHEN provenance_verified IS NOT NULL THEN source_company WHEN status = 'verified_mock_fixture' THEN 'AMD' WHEN status IN ('missing_provenance', 'unknown_issuer') THEN NULL ELSE iss END AS company FROM z""")
def edge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every claimed edge: whether its chunk bears it out, and whose filing it is."""
    edges, chunks, issuers = (run(spark, sf_dir, x) for x in (_CLAIMS, _CHUNKS, _ISSUERS))
    terms = run(spark, sf_dir, "SELECT 'company:S' || s_suppkey AS node_id, array('co' || s_suppkey || 'x') AS terms FROM supplier")
    got = provenance.label_edges(edges, chunks, issuers, terms)
    return got.select("edge_id", F.col("attribution_status").alias("status"), F.col("provenance_verified").alias("verified"), F.col("source_company").alias("company"))


@query("SELECT conv_id, COUNT(*) AS n FROM conversations WHERE length(text) % 3 = 0 GROUP BY conv_id")
def verified_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows marked as verified (a mark by rule), counted by conversation."""
    rows = run(spark, sf_dir, "SELECT conv_id, CASE WHEN length(text) % 3 = 0 THEN true WHEN length(text) % 3 = 1 THEN false END AS verified FROM conversations")
    return provenance.verified_only(rows).groupBy("conv_id").agg(F.count("*").alias("n"))


# Evidence of every question: none to four pieces, by rule; both engines read it.
_EVIDENCE = """SELECT c_custkey AS question_id, r AS rank, 'e' || r AS evidence_id, CASE r WHEN 1 THEN 'NATION_' || ((a + 1) % 25) || ' supplies parts to NATION_' || a WHEN 2 THEN 'A threat of shortage at NATION_' || ((a + 1 + c_custkey % 2) % 25)
    WHEN 3 THEN 'The FTC opened an investigation of NATION_' || a ELSE 'NATION_' || a || ' and NATION_' || (c_custkey % 25) || ' signed a lease' END AS text,
  CASE WHEN c_custkey % 13 <> 0 THEN 'doc:' || a END AS document_id, 'c' || r AS chunk_id, CAST('199' || (4 + c_custkey % 4) || '-06-01 00:00:00' AS {ts}) AS available_ts, CASE r WHEN 4 THEN 2 + c_custkey % 2 ELSE 1 END AS hop_count,
  CASE r WHEN 1 THEN '' || a WHEN 2 THEN '' || ((a + 1) % 25) WHEN 4 THEN '' || a END AS source_company, CASE WHEN (c_custkey + r) % 17 = 0 THEN false WHEN r < 3 THEN true END AS provenance_verified,
  CASE WHEN (c_custkey + r) % 19 = 0 THEN 'conflicting_attribution' WHEN (c_custkey + r) % 23 = 0 THEN 'missing_provenance' ELSE 'verified_issuer' END AS attribution_status,
  CASE r WHEN 1 THEN 'company:' || ((a + 1) % 25) WHEN 2 THEN 'company:' || ((a + 1 + c_custkey % 2) % 25) WHEN 4 THEN 'company:' || ((a + 2) % 25) END AS s1, CASE r WHEN 1 THEN 'SUPPLIES' WHEN 2 THEN 'HAS_RISK' WHEN 4 THEN 'LEASES_TO' END AS r1,
  CASE r WHEN 1 THEN 'company:' || a WHEN 2 THEN 'risk:1' WHEN 4 THEN 'company:' || ((a + 3) % 25) END AS t1, CASE r WHEN 4 THEN 'company:' || ((a + 3) % 25) END AS s2, CASE r WHEN 4 THEN 'PARTNERS_WITH' END AS r2, CASE r WHEN 4 THEN 'company:' || a END AS t2
  FROM (SELECT c_custkey, c_nationkey AS a, r FROM customer, (SELECT 1 AS r UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k WHERE r <= c_custkey % 5) v"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = analysis.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    rows = spark.sql(_EVIDENCE.format(ts="TIMESTAMP_NTZ").replace("FROM customer,", "FROM {customer} AS customer,"), customer=asked)
    edge = lambda k: F.when(F.col(f"r{k}").isNotNull(), F.struct(F.col(f"s{k}").alias("source"), F.col(f"r{k}").alias("relationship"), F.col(f"t{k}").alias("target")))
    return rows.withColumns({"graph_edges": F.array_compact(F.array(edge(1), edge(2))), "path": F.array_compact(F.array("s1", "t1", "t2"))}).drop("s1", "r1", "t1", "s2", "r2", "t2")


_REG = """CASE en WHEN 'regulator:FTC' THEN ['regulator:ftc', 'ftc', 'federal trade commission', 'u.s. federal trade commission', 'united states federal trade commission'] WHEN 'regulator:EC' THEN ['regulator:ec', 'ec', 'european commission', 'the european commission']
  WHEN 'regulator:SEC' THEN ['regulator:sec', 'sec', 'securities and exchange commission'] ELSE list_filter([lower(en), split_part(lower(en), ':', 2), lower(name)], lambda z: z IS NOT NULL) END"""
_HAS = "regexp_matches({}, '{}')"


def _gate_sql(entity: str, relationship: str, hop: str) -> str:
    """The rules in SQL; nodes are alike only by id here, since names of nations are unique."""
    strict_chain = "(by_sup AND NOT sup) OR (by_land AND NOT land)"
    textual_chain = "(by_sup AND NOT (coalesce(says_sup, false) AND coalesce(says_risk, false))) OR (by_land AND NOT (coalesce(says_land, false) AND coalesce(text_risk, false)))"
    chain = {"strict": strict_chain, "textual": textual_chain, "disabled": "false"}[relationship]
    rel = "false" if relationship == "disabled" else "len(w) > 0 AND len(mr) = len(w)"
    ent = {"strict": "len(me) > 0", "partial": "len(e) > 0 AND (len(me) = len(e) OR (len(e) > 1 AND len(e) - len(me) < len(e) / 2.0))", "disabled": "false"}[entity]
    deep = "(NOT multi OR hops_seen >= hops)"
    direct = "CASE WHEN by_sup THEN sup WHEN by_land THEN land WHEN regexp_matches(t, 'supplier.s supplier|customer.s customer|chain of suppliers|indirectly|through its supplier|through a partner|3-hop|three hops') THEN false ELSE direct END"
    hops = {"strict": f"NOT {deep}", "adaptive": f"NOT ({deep} OR {direct})", "soft": "false"}[hop]
    words = """CASE z WHEN 'SUPPLIES' THEN 'suppl|vendor|provide|furnish|foundry|foundries|utilize|source' WHEN 'MANUFACTURES' THEN 'manufactur|produc|build|assembl|fabricat|operat|develop' WHEN 'HAS_RISK' THEN 'risk|advers|threat|hazard|vulnerab|has_risk'
      WHEN 'AFFECTED_BY' THEN 'affect|impact|subject to|disrupt|proceeding|enforcement|order|action|investigation' WHEN 'DEPENDS_ON' THEN 'depend|reli|subject to|utilize|foundry' WHEN 'PARTNERS_WITH' THEN 'partner|collaborat|joint venture|alliance'
      WHEN 'COMPETES_WITH' THEN 'compet|rival' ELSE 'acquir|merg|bought|acquisition' END"""
    by_text = f" OR regexp_matches(low, {words})" if relationship == "textual" else ""
    return f"""WITH {_ANALYSED}, v AS (SELECT *, lower(text) AS low, coalesce(provenance_verified, true) AND attribution_status NOT IN ('unsupported_cross_company', 'unsupported_cross_company_risk', 'conflicting_attribution', 'missing_provenance') AS ok FROM ({_EVIDENCE.format(ts='TIMESTAMP')})),
b AS (SELECT question_id, t, e, w, k // 10 AS hops, k % 10 = 1 AS multi, TRY_CAST(reference AS TIMESTAMP) AS ref, unreadable,
  k % 10 = 1 AND regexp_matches(t, 'risk|affect') AND regexp_matches(t, 'supply|supplie') AS by_sup, k % 10 = 1 AND regexp_matches(t, 'risk|affect') AND regexp_matches(t, 'landlord|leasing') AS by_land FROM f),
sums AS (SELECT v.question_id, count(*) AS n, bool_or(ref IS NOT NULL AND available_ts > ref) AS late, bool_or(document_id IS NOT NULL AND coalesce(provenance_verified, true) AND attribution_status <> 'conflicting_attribution') AS sourced, max(hop_count) AS hops_seen,
    list_distinct(flatten(list(CASE WHEN ok THEN list_filter(w, lambda z: contains(coalesce(r1, ''), z) OR contains(coalesce(r2, ''), z){by_text}) ELSE [] END))) AS held,
    bool_or(regexp_matches(low, 'suppl|vendor|foundry|manufactur') OR r1 = 'SUPPLIES') AS says_sup, bool_or(regexp_matches(low, 'risk|advers|threat|disrupt|shortage') OR r1 = 'HAS_RISK') AS says_risk,
    bool_or(regexp_matches(low, 'risk|advers|threat|disrupt|shortage')) AS text_risk, bool_or(regexp_matches(low, 'landlord|lease|leasing|datacenter|data center')) AS says_land FROM v JOIN b USING (question_id) GROUP BY v.question_id),
ed AS (SELECT v.question_id, s1 AS s, r1 AS r, t1 AS g, list_contains(e, s1) AS st, list_contains(e, t1) AS gt FROM v JOIN b USING (question_id) WHERE r1 IS NOT NULL UNION ALL SELECT v.question_id, s2, r2, t2, list_contains(e, s2), list_contains(e, t2) FROM v JOIN b USING (question_id) WHERE r2 IS NOT NULL),
su AS (SELECT DISTINCT x.question_id FROM ed x JOIN ed y ON x.question_id = y.question_id AND x.s = y.s WHERE x.r = 'SUPPLIES' AND x.gt AND NOT x.st AND y.r = 'HAS_RISK' AND NOT y.st),
la AS (SELECT DISTINCT x.question_id FROM ed x JOIN ed y ON x.question_id = y.question_id AND x.g = y.s JOIN ed z ON z.question_id = x.question_id AND z.s = x.s
  WHERE x.r IN ('LEASES_TO', 'LEASES', 'PARTNERS_WITH', 'SUPPLIES', 'DEPENDS_ON') AND NOT x.gt AND NOT x.st AND y.r IN ('PARTNERS_WITH', 'SUPPLIES', 'DEPENDS_ON') AND y.gt AND NOT y.st AND z.r = 'HAS_RISK' AND NOT z.st),
en AS (SELECT question_id, t, e, list_filter(e, lambda z: starts_with(z, 'company:') OR starts_with(z, 'regulator:')) AS corp, unnest(e) AS en FROM b),
tm AS (SELECT en.*, {_REG} AS tt FROM en LEFT JOIN ({NODES}) nn ON nn.node_id = en.en),
co AS (SELECT tm.question_id, tm.en, v.evidence_id, corp, upper(split_part(tm.en, ':', 2)) = upper(source_company) AS issuer, len(list_filter(tt, lambda z: contains(low, z))) > 0 AS said, t, low, source_company, s1, t1, t2 FROM tm JOIN v USING (question_id) WHERE ok),
cv AS (SELECT DISTINCT question_id, en FROM co WHERE ((coalesce(issuer, false) OR said) AND (NOT starts_with(en, 'regulator:') OR NOT regexp_matches(t, 'regulatory|action|investigation|inquiries|inquiry|proceeding|order|scrutiny|penalty|fine|settlement')
    OR regexp_matches(low, 'regulat|investigation|inquir|proceeding|action|consent order|litigation|penalt|fine|compliance|settlement|enforcement|order|dsa|gdpr|coppa')))
  OR (coalesce(en IN (s1, t1, t2), false) AND (coalesce(issuer, false) OR said OR source_company IS NULL))),
di AS (SELECT question_id, evidence_id FROM co WHERE list_position(corp, en) BETWEEN 1 AND 2 AND (said OR (coalesce(issuer, false) AND len(corp) >= 2)) GROUP BY question_id, evidence_id, corp HAVING count(*) >= least(len(corp), 2)),
mi AS (SELECT en.question_id, list_sort(list(en.en)) AS m FROM en ANTI JOIN cv ON cv.question_id = en.question_id AND cv.en = en.en GROUP BY en.question_id),
j AS (SELECT b.*, coalesce(n, 0) AS n, coalesce(late, false) AS late, coalesce(sourced, false) AS sourced, hops_seen, says_sup, says_risk, text_risk, says_land, list_filter(w, lambda z: NOT list_contains(coalesce(held, []), z)) AS mr,
  su.question_id IS NOT NULL AS sup, la.question_id IS NOT NULL AS land, b.question_id IN (SELECT question_id FROM di) AS direct, coalesce(m, []) AS m0 FROM b LEFT JOIN sums USING (question_id) LEFT JOIN su USING (question_id) LEFT JOIN la USING (question_id) LEFT JOIN mi USING (question_id)),
k AS (SELECT *, CASE WHEN len(list_filter(e, lambda z: starts_with(z, 'regulator:'))) >= 2 AND contains(t, ' or ') AND len(list_filter(e, lambda z: starts_with(z, 'regulator:') AND NOT list_contains(m0, z))) > 0 THEN list_filter(m0, lambda z: NOT starts_with(z, 'regulator:')) ELSE m0 END AS me FROM j)
SELECT question_id, CASE WHEN unreadable THEN 'temporal' WHEN n < 1 THEN 'count' WHEN late THEN 'temporal' WHEN NOT sourced THEN 'provenance' WHEN {ent} THEN 'entity' WHEN {chain} THEN 'chain' WHEN {rel} THEN 'relationship' WHEN {hops} THEN 'hops' ELSE 'sufficient' END AS reason,
  array_to_string(me, ',') AS missing, array_to_string(mr, ',') AS missing_relationships FROM k"""


MODES = {"gate_strict": ("strict", "strict", "strict"), "gate_partial": ("partial", "textual", "strict"), "gate_adaptive": ("strict", "textual", "adaptive"), "gate_soft": ("disabled", "strict", "soft"), "gate_hops_only": ("disabled", "disabled", "adaptive")}


def _gate(name: str) -> None:
    """The gate over every question in one combination of modes (entities, relationships, hops)."""
    entity, relationship, hop = MODES[name]

    def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = run(spark, sf_dir, NODES).withColumn("aliases", F.expr("cast(null as array<string>)"))
        got = gate.gate(settle(analysed(spark, sf_dir), "asked"), settle(_evidence(spark, sf_dir), "evidence"), gate.entity_terms(nodes), entity, relationship, hop, keep=lambda df: settle(df, "edges"))
        return got.select("question_id", "reason", F.array_join("missing_entities", ",").alias("missing"), F.array_join("missing_relationships", ",").alias("missing_relationships"))

    QUERIES[name], SQL[name] = judged, _gate_sql(entity, relationship, hop)


for _name in MODES:
    _gate(_name)


# Expected paths of two hops, one an order, and a retrieved path a line, some reversed, torn or of another name; both engines read these.
_WANTED = "SELECT l_orderkey AS question_id, 'supplier:' || l_suppkey AS s1, 'SUPPLIES' AS r1, 'part_' || l_partkey AS t1, 'part_' || l_partkey AS s2, 'HAS_RISK' AS r2, 'late-delivery' AS t2 FROM lineitem WHERE l_linenumber = 1"
_FOUND = """SELECT l_orderkey AS question_id, l_linenumber AS rank, CASE WHEN k = 0 THEN p ELSE s END AS s1, 'supplies' AS r1, CASE WHEN k = 0 THEN s ELSE p END AS t1, CASE WHEN k = 1 THEN 'PART 0' ELSE p END AS s2, 'has_risk' AS r2, 'Late Delivery' AS t2
  FROM (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 4 AS k, 'Supplier ' || l_suppkey AS s, 'Part ' || l_partkey || CASE WHEN l_orderkey % 3 = 0 THEN ' Inc' ELSE '' END AS p FROM lineitem) x"""


def _pathed(rows: DataFrame) -> DataFrame:
    edge = lambda k: F.struct(F.col(f"s{k}").alias("source"), F.col(f"r{k}").alias("relationship"), F.col(f"t{k}").alias("target"))
    return rows.withColumn("edges", F.array(edge(1), edge(2)))


_N = "regexp_replace(lower({}), '[_ :-]', '', 'g')"
_LIKE = f"(contains({_N.format('f.{0}')}, {_N.format('w.{1}')}) OR contains({_N.format('w.{1}')}, {_N.format('f.{0}')}))"
_BACK = f"(contains({_N.format('f.s{0}')}, {_N.format('w.t{1}')}) AND contains({_N.format('f.t{0}')}, {_N.format('w.s{1}')}))"


def _hit(f: int, w: int) -> str:
    return f"(upper(f.r{f}) = w.r{w} AND NOT {_BACK.format(f, w)} AND {_LIKE.format(f's{f}', f's{w}')} AND {_LIKE.format(f't{f}', f't{w}')})"


@query(f"""WITH w AS (SELECT DISTINCT * FROM ({_WANTED})), f AS ({_FOUND}), m AS (SELECT w.question_id, f.rank, {_hit(1, 1)} AND {_hit(2, 2)} AND (contains({_N.format('f.t1')}, {_N.format('f.s2')}) OR contains({_N.format('f.s2')}, {_N.format('f.t1')})) AS hit, w.s1, w.t1 FROM w JOIN f USING (question_id))
SELECT question_id, count(*) AS n_retrieved, bool_or(hit) AS matched, CAST(min(rank) FILTER (WHERE hit) AS BIGINT) AS first_rank FROM m GROUP BY question_id, s1, t1""")
def path_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a retrieved path holds the expected one of each order, and the first that does."""
    got = pathmatch.match_paths(_pathed(run(spark, sf_dir, _WANTED)), _pathed(run(spark, sf_dir, _FOUND)))
    return got.select("question_id", "n_retrieved", "matched", F.col("first_rank").cast("long").alias("first_rank"))


_J = "coalesce(to_json({})::VARCHAR, 'null')"


@query(f"""SELECT doc_id, 'doc:' || source || ':' || substr(sha256('{{"company": ' || {_J.format('lang')} || ', "document_type": "prose", "source": ' || {_J.format('source')} || ', "source_reference": ' || {_J.format('substr(text, 1, 80)')} || ', "source_url": null}}'), 1, 16) AS document_id,
  'd:' || doc_id || '->CITES->' || 'd:' || (doc_id + 1) || ':' || substr(sha256('{{"available_time":null,"event_time":"2024-01-01","properties":{{"n":' || n_chars || '}},"relationship":"CITES","source":"d:' || doc_id || '","target":"d:' || (doc_id + 1) || '"}}'), 1, 16) AS edge_id,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || doc_id)) AS h FROM documents)""")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents and edges by their canonical JSON, and the name-based UUID of a chunk's vector."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own, to = F.concat(F.lit("d:"), F.col("doc_id").cast("string")), F.concat(F.lit("d:"), (F.col("doc_id") + 1).cast("string"))
    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id", ids.document_id(F.col("source"), F.col("lang"), F.lit("prose"), F.substring("text", 1, 80), none).alias("document_id"),
        ids.edge_id(own, F.lit("CITES"), to, F.lit("2024-01-01"), none, ids.json_object({"n": ids.json_number(F.col("n_chars"))})).alias("edge_id"),
        ids.uuid5(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string"))).alias("point_id"),
    )


# the greedy choice one piece at a time: a piece goes to the first entity that speaks for it and has a place left
@query(f"""WITH RECURSIVE {_ANALYSED}, v AS (SELECT *, 1.0::DOUBLE / (60 + rank) AS score, lower(text) AS low FROM ({_EVIDENCE.format(ts='TIMESTAMP')})),
a2 AS (SELECT question_id, e, unnest(e) AS en, unnest(range(len(e))) AS o FROM f),
m AS (SELECT v.question_id, v.rank, o FROM v JOIN a2 USING (question_id) WHERE len(e) >= 2 AND (coalesce(upper(source_company) = upper(split_part(en, ':', 2)), false) OR coalesce(en IN (s1, t1, s2, t2), false)
  OR coalesce(upper(split_part(en, ':', 2)) IN (upper(s1), upper(t1), upper(s2), upper(t2)), false) OR (coalesce(provenance_verified, true) AND contains(low, lower(split_part(en, ':', 2)))))),
gr(o, taken) AS (SELECT 0, CAST([] AS STRUCT(q BIGINT, r INTEGER)[]) UNION ALL
  SELECT gr.o + 1, gr.taken || coalesce((SELECT list({{'q': question_id, 'r': rank}}) FROM (SELECT question_id, CAST(rank AS INTEGER) AS rank FROM m WHERE m.o = gr.o AND NOT list_contains(gr.taken, {{'q': m.question_id, 'r': CAST(m.rank AS INTEGER)}}) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank) <= 1) z), [])
  FROM gr WHERE gr.o < (SELECT max(o) + 1 FROM m)),
tk AS (SELECT DISTINCT x.q AS question_id, x.r AS rank FROM (SELECT unnest(taken) AS x FROM gr WHERE o = (SELECT max(o) FROM gr)) y),
nt AS (SELECT question_id, count(*) AS n FROM tk GROUP BY ALL),
rest AS (SELECT v.question_id, v.rank, row_number() OVER (PARTITION BY v.question_id ORDER BY v.rank) AS i FROM v ANTI JOIN tk USING (question_id, rank)),
al AS (SELECT question_id, rank FROM tk UNION ALL SELECT rest.question_id, rest.rank FROM rest LEFT JOIN nt USING (question_id) WHERE i <= greatest(0, 2 - coalesce(n, 0)))
SELECT question_id, evidence_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, v.rank, evidence_id) AS INTEGER) AS rank FROM al JOIN v USING (question_id, rank) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, v.rank, evidence_id) <= 2""")
def balanced_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pieces of every question, one at least of each entity that has any."""
    scored = _evidence(spark, sf_dir).withColumn("score", 1.0 / (60 + F.col("rank")))
    return hybrid.balance(scored, analysed(spark, sf_dir), 2, 1).select("question_id", "evidence_id", "rank")


_ORDERED = "SELECT 'event:' || event_id AS id, ts AS available_ts FROM events UNION ALL SELECT 'order:' || o_orderkey, o_orderdate FROM orders"


@query(f"SELECT id, row_number() OVER (ORDER BY coalesce(strftime(available_ts, '%Y-%m-%d %H:%M:%S.%f'), ''), id) - 1 AS place FROM (SELECT DISTINCT * FROM ({_ORDERED}))")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every event in the order of all by the time it became available, unknown times first."""
    rows = run(spark, sf_dir, _ORDERED).distinct().withColumn("at", F.concat_ws(" ", F.coalesce(F.date_format("available_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")), "id"))
    return features.positions(rows, "at", "place").select("id", "place")


@query(f"""WITH {_ANALYSED}, v AS ({_VECTORS.format(ts='TIMESTAMP')}), c AS (SELECT question_id, TRY_CAST(reference AS TIMESTAMP) AS ref, unnest(list_filter(e, lambda z: starts_with(z, 'company:'))) AS company FROM f WHERE NOT unreadable)
SELECT question_id, company, fiscal_period, CAST(row_number() OVER (PARTITION BY question_id, company ORDER BY fiscal_period DESC) AS INTEGER) AS place FROM (
  SELECT DISTINCT question_id, c.company, fiscal_period FROM c JOIN v ON v.company = c.company AND fiscal_period IS NOT NULL AND document_type IN ('10-Q', '10-K') AND (ref IS NULL OR available_ts <= ref))""")
def periods_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported periods of every company a question names, newest first, as known at the question's time."""
    asked = analysed(spark, sf_dir).where("not coalesce(unreadable, false)")
    each = asked.select("question_id", "reference", F.explode(F.filter("entities", lambda e: e.startswith("company:"))).alias("company"))
    return hybrid.periods_as_of(each, vectors(spark, sf_dir), hybrid.PERIODIC)
