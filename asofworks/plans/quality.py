"""Data quality, resolution, ids, text, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from ..operators import answers, metrics, temporal
from .base import both, query, run

both("dq_orders", "SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(CASE WHEN o_totalprice <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_price, COUNT(*) - COUNT(o_orderdate) AS no_date, CAST(SUM(CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS orphan FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderstatus")
both("dq_events", "SELECT event_id, CASE WHEN ts IS NULL THEN 'missing_time' WHEN value < 0 THEN 'negative' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown_type' ELSE 'ok' END AS code FROM events")
both("dq_duplicates", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate FROM documents",
     "SELECT doc_id, row_number() OVER (PARTITION BY sha2(text, 256) ORDER BY doc_id) > 1 AS duplicate FROM documents")
both("resolve_entities", """WITH d AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nk FROM supplier)
SELECT c_custkey, coalesce(a.id, b.id) AS entity_id, CASE WHEN a.id IS NOT NULL THEN 'id' WHEN b.id IS NOT NULL THEN 'nation' ELSE 'unresolved' END AS method, CASE WHEN a.id IS NOT NULL THEN 1.0 WHEN b.id IS NOT NULL THEN 0.95 ELSE 0.0 END AS confidence
FROM customer LEFT JOIN d a ON a.id = c_custkey LEFT JOIN (SELECT nk, MIN(id) AS id FROM d GROUP BY nk) b ON b.nk = c_nationkey""",
     """WITH d AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nk FROM supplier)
SELECT c_custkey, coalesce(a.id, b.id) AS entity_id, CASE WHEN a.id IS NOT NULL THEN 'id' WHEN b.id IS NOT NULL THEN 'nation' ELSE 'unresolved' END AS method, CASE WHEN a.id IS NOT NULL THEN 1.0D WHEN b.id IS NOT NULL THEN 0.95D ELSE 0.0D END AS confidence
FROM customer LEFT JOIN d a ON a.id = c_custkey LEFT JOIN (SELECT nk, MIN(id) AS id FROM d GROUP BY nk) b ON b.nk = c_nationkey""")
both("alias_resolution", "WITH a AS (SELECT lower(n_name) AS k, n_nationkey AS node, 0 AS p FROM nation UNION ALL SELECT 'n' || n_nationkey, n_nationkey, 1 FROM nation), r AS (SELECT s_suppkey, node, row_number() OVER (PARTITION BY s_suppkey ORDER BY p, node) AS i FROM supplier JOIN a ON a.k = 'n' || s_nationkey) SELECT s_suppkey, node FROM r WHERE i = 1")
both("dedup_merge_confidence", "SELECT l_suppkey, l_partkey, MAX(1 - l_discount) AS confidence, min_by(l_orderkey, (l_discount, l_orderkey, l_linenumber)) AS winner, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey",
     "SELECT l_suppkey, l_partkey, MAX(1 - l_discount) AS confidence, min_by(l_orderkey, struct(l_discount, l_orderkey, l_linenumber)) AS winner, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey")
both("node_merge", "SELECT l_suppkey, MIN(l_shipdate) AS available_ts, COUNT(DISTINCT l_orderkey) AS n_documents, COUNT(DISTINCT l_partkey) AS n_chunks FROM lineitem GROUP BY l_suppkey")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("SELECT n_nationkey, 'company:' || substr(sha256('company:' || lower(n_name)), 1, 16) AS id FROM nation")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", T.stable_id(F.lit("company"), F.lower("n_name")).alias("id"))


both("relation_ids", "SELECT s_suppkey, 'relation:' || substr(sha256('supplier:' || s_suppkey || ':LOCATED_IN:nation:' || s_nationkey), 1, 16) AS id FROM supplier", "SELECT s_suppkey, concat('relation:', substr(sha2(concat('supplier:', s_suppkey, ':LOCATED_IN:nation:', s_nationkey), 256), 1, 16)) AS id FROM supplier")
both("document_ids", "SELECT doc_id, 'doc:' || source || ':' || substr(sha256(source || '|' || lang || '|' || doc_id), 1, 16) AS id FROM documents", "SELECT doc_id, concat('doc:', source, ':', substr(sha2(concat(source, '|', lang, '|', doc_id), 256), 1, 16)) AS id FROM documents")
both("fingerprints", "SELECT doc_id, sha256(coalesce(source, '') || '|' || coalesce(text, '')) AS fp FROM documents", "SELECT doc_id, sha2(concat(coalesce(source, ''), '|', coalesce(text, '')), 256) AS fp FROM documents")


@query("SELECT doc_id, trim(regexp_replace(lower(trim(text)), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("t"))


_SFX = "|".join(T.SUFFIXES)


@query(f"WITH x AS (SELECT s_suppkey, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Holdings, Ltd' WHEN 2 THEN '' ELSE ' Group plc Class A' END AS n FROM supplier) SELECT s_suppkey, regexp_replace(trim(regexp_replace(lower(trim(n)), '[^a-z0-9]+', ' ', 'g')), '(^| )({_SFX})(( ({_SFX}))*)$', '') AS name FROM x")
def strip_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = run(spark, sf_dir, "SELECT s_suppkey, concat(s_name, CASE s_suppkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Holdings, Ltd' WHEN 2 THEN '' ELSE ' Group plc Class A' END) AS n FROM supplier")
    return x.select("s_suppkey", T.strip_suffix(F.col("n")).alias("name"))


both("verbalize_edges", "SELECT l_orderkey, l_linenumber, 'S' || l_suppkey || ' --[SUPPLIES]--> P' || l_partkey || ' (as of ' || strftime(l_shipdate, '%Y-%m-%d') || ')' AS t FROM lineitem", "SELECT l_orderkey, l_linenumber, concat('S', l_suppkey, ' --[SUPPLIES]--> P', l_partkey, ' (as of ', date_format(l_shipdate, 'yyyy-MM-dd'), ')') AS t FROM lineitem")
_BAG = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"


@query(f"SELECT d.doc_id, len(list_intersect({_BAG.format('d.text')}, {_BAG.format('e.text')})) AS n FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1")
def tokenize_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    e = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(e, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).cast("long").alias("n"))


_LEX = lambda v: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in v) + ")))"
_SENT = f"SELECT doc_id, source, CAST({_LEX(T.POSITIVE)} AS BIGINT) AS p, CAST({_LEX(T.NEGATIVE)} AS BIGINT) AS n FROM (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents)"
_VALUE = "CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / CAST(p + n AS DOUBLE) END"


def _sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _docs(spark, sf_dir).withColumn("w", T.tokens(F.col("text"))).select("doc_id", "source", T.count_in(F.col("w"), T.POSITIVE).alias("p"), T.count_in(F.col("w"), T.NEGATIVE).alias("n"))
    return x.withColumn("s", F.when(F.col("p") + F.col("n") == 0, 0.0).otherwise((F.col("p") - F.col("n")) / (F.col("p") + F.col("n"))))


@query(f"SELECT doc_id, ROUND({_VALUE}, 6) AS score, CASE WHEN {_VALUE} > 0.2 THEN 'positive' WHEN {_VALUE} < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM ({_SENT})")
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentiment(spark, sf_dir).select("doc_id", F.round("s", 6).alias("score"), F.when(F.col("s") > 0.2, "positive").when(F.col("s") < -0.2, "negative").otherwise("neutral").alias("label"))


@query(f"SELECT source, ROUND(AVG(s), 6) AS mean, ROUND(stddev_pop(s), 6) AS sd, COUNT(*) FILTER (WHERE s > 0.2) AS n_pos, ROUND(AVG(abs(s)), 6) AS mean_abs FROM (SELECT source, {_VALUE} AS s FROM ({_SENT})) GROUP BY source")
def sentiment_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentiment(spark, sf_dir).groupBy("source").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_pop("s"), 6).alias("sd"), F.count_if(F.col("s") > 0.2).alias("n_pos"), F.round(F.avg(F.abs("s")), 6).alias("mean_abs"))


both("top_sources", "SELECT source, COUNT(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
both("url_validity", "SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages", "SELECT page_id, regexp_like(url, '^https?://[^/?#]+') AS valid FROM pages")


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("SELECT doc_id, i + 1 AS part, substr(text, CAST(i * 1550 + 1 AS BIGINT), 1800) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN length(text) <= 1800 THEN 0 ELSE CAST(ceil((length(text) - 1800) / 1550.0) AS INTEGER) END)) AS i FROM documents WHERE text IS NOT NULL)")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("i", "chunk")).select("doc_id", (F.col("i") + 1).cast("long").alias("part"), "chunk")


both("numeric_tolerance_match", "SELECT p_partkey, abs(p_retailprice * (1 + (p_partkey % 5 - 2) * 0.004) - p_retailprice) <= 0.005 * abs(p_retailprice) AS within FROM part")
both("parse_numbers", "SELECT p_partkey, TRY_CAST(CASE WHEN t LIKE '(%' THEN '-' || regexp_replace(t, '[^0-9.]', '', 'g') ELSE regexp_replace(t, '[^0-9.]', '', 'g') END AS DOUBLE) AS v FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '(1,' || p_size || '.5)' ELSE '$' || p_size || ',000' END AS t FROM part)",
     "SELECT p_partkey, TRY_CAST(CASE WHEN t LIKE '(%' THEN concat('-', regexp_replace(t, '[^0-9.]', '')) ELSE regexp_replace(t, '[^0-9.]', '') END AS DOUBLE) AS v FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('(1,', p_size, '.5)') ELSE concat('$', p_size, ',000') END AS t FROM part)")

_REL = "SELECT label AS question_id, vec_id AS id FROM embeddings WHERE vec_id % 11 = 0"
_RES = "SELECT label AS question_id, vec_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id % 13, vec_id) AS INTEGER) AS rank FROM embeddings"


@query(f"""WITH rel AS ({_REL}), res AS (SELECT * FROM ({_RES}) WHERE rank <= 20), n AS (SELECT question_id, COUNT(*) AS n FROM rel GROUP BY question_id),
h AS (SELECT r.question_id, r.rank FROM res r JOIN rel ON r.question_id = rel.question_id AND r.id = rel.id),
a AS (SELECT n.question_id, n.n, COUNT(*) FILTER (WHERE rank <= 1) AS h1, COUNT(*) FILTER (WHERE rank <= 5) AS h5, COUNT(*) FILTER (WHERE rank <= 10) AS h10, coalesce(1.0::DOUBLE / MIN(rank), 0) AS rr, coalesce(SUM(1 / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS dcg FROM n LEFT JOIN h ON h.question_id = n.question_id GROUP BY n.question_id, n.n)
SELECT question_id, CAST(h1 > 0 AS INTEGER) AS hit_1, ROUND(h1 / 1.0::DOUBLE, 6) AS precision_1, ROUND(h1 / CAST(n AS DOUBLE), 6) AS recall_1, CAST(h5 > 0 AS INTEGER) AS hit_5, ROUND(h5 / 5.0::DOUBLE, 6) AS precision_5, ROUND(h5 / CAST(n AS DOUBLE), 6) AS recall_5, CAST(h10 > 0 AS INTEGER) AS hit_10, ROUND(h10 / 10.0::DOUBLE, 6) AS precision_10, ROUND(h10 / CAST(n AS DOUBLE), 6) AS recall_10, ROUND(rr, 6) AS mrr, ROUND(dcg / (SELECT SUM(1 / log2(i + 1)) FROM generate_series(1, least(n, 10)) t(i)), 6) AS ndcg FROM a""")
def retrieval_metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.retrieval(run(spark, sf_dir, f"SELECT * FROM ({_RES}) WHERE rank <= 20"), run(spark, sf_dir, _REL), (1, 5, 10))


both("exact_match", "SELECT a.conv_id, a.turn, CASE WHEN lower(trim(a.text)) = lower(trim(b.text)) THEN 1 ELSE 0 END AS em FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
both("token_f1", """WITH w AS (SELECT conv_id, turn, t, COUNT(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM conversations) GROUP BY ALL), s AS (SELECT conv_id, turn, SUM(n) AS n FROM w GROUP BY ALL),
o AS (SELECT a.conv_id, a.turn, SUM(least(a.n, b.n)) AS o FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.t = b.t GROUP BY ALL)
SELECT a.conv_id, a.turn, ROUND(CAST(2.0 * coalesce(o, 0) / (a.n + b.n) AS DOUBLE), 6) AS f1 FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN o ON o.conv_id = a.conv_id AND o.turn = a.turn""",
     """WITH w AS (SELECT conv_id, turn, t, COUNT(*) AS n FROM (SELECT conv_id, turn, explode(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS t FROM conversations) GROUP BY ALL), s AS (SELECT conv_id, turn, SUM(n) AS n FROM w GROUP BY ALL),
o AS (SELECT a.conv_id, a.turn, SUM(least(a.n, b.n)) AS o FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.t = b.t GROUP BY ALL)
SELECT a.conv_id, a.turn, ROUND(CAST(2.0 * coalesce(o, 0) / (a.n + b.n) AS DOUBLE), 6) AS f1 FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN o ON o.conv_id = a.conv_id AND o.turn = a.turn""")
both("refusal_confusion", "SELECT COUNT(*) FILTER (WHERE p AND toxic = 1) AS tp, COUNT(*) FILTER (WHERE p AND toxic = 0) AS fp, COUNT(*) FILTER (WHERE NOT p AND toxic = 1) AS fn, COUNT(*) FILTER (WHERE NOT p AND toxic = 0) AS tn FROM (SELECT toxic, quality = 0 AS p FROM labels) x")
both("citation_metrics", "WITH c AS (SELECT conv_id, conv_id * 3 + turn AS d FROM conversations WHERE role = 'assistant') SELECT conv_id, COUNT(*) AS total, COUNT(l.doc_id) AS valid, ROUND(CASE WHEN COUNT(*) = 0 THEN 1.0 ELSE COUNT(CASE WHEN quality = 1 THEN 1 END) / CAST(COUNT(*) AS DOUBLE) END, 6) AS precision_ FROM c LEFT JOIN labels l ON l.doc_id = d GROUP BY conv_id")
_OUTCOMES = """SELECT doc_id, quality = 1 OR doc_id % 3 = 0 AS answerable, toxic = 1 OR doc_id % 5 = 0 AS refused, (doc_id % 7) / CAST(10 AS DOUBLE) AS f1, CAST(CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS exact,
  doc_id % 4 <> 0 AS retrieved, doc_id % 6 <> 1 AS in_context, doc_id % 8 <> 4 AS linked, CAST(1 + doc_id % 3 AS INT) AS hops, CAST(doc_id % 2 AS DOUBLE) AS path_accuracy, CASE doc_id % 9 WHEN 5 THEN 'hops' WHEN 6 THEN 'entity' ELSE 'sufficient' END AS reason FROM labels"""


@query(f"""SELECT doc_id, CASE WHEN NOT answerable AND refused THEN 'CORRECT_REFUSAL' WHEN NOT answerable THEN 'UNGROUNDED_HALLUCINATION' WHEN NOT refused AND (f1 >= 0.2 OR exact > 0) THEN 'NONE_SUCCESS' WHEN NOT retrieved AND NOT linked THEN 'ENTITY_LINKING_FAILURE'
  WHEN NOT retrieved THEN 'EVIDENCE_NOT_RETRIEVED' WHEN NOT in_context THEN 'EVIDENCE_RANKED_TOO_LOW' WHEN hops > 1 AND path_accuracy = 0 AND reason = 'hops' THEN 'GRAPH_PATH_FAILURE' WHEN reason <> 'sufficient' THEN 'SUFFICIENCY_GATE_FALSE_REFUSAL' ELSE 'GENERATOR_FAILURE' END AS mode FROM ({_OUTCOMES})""")
def failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The principal failure of every labelled row's outcome (made by rule)."""
    names = ("answerable", "refused", "f1", "exact", "retrieved", "in_context", "linked", "hops", "path_accuracy", "reason")
    return run(spark, sf_dir, _OUTCOMES).select("doc_id", answers.failure_mode(*map(F.col, names), F.col("reason") == "sufficient").alias("mode"))


both("feir_by_stage", "SELECT event_type AS stage, ROUND(COUNT(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 00:00:00') / CAST(COUNT(*) AS DOUBLE), 6) AS feir FROM events GROUP BY event_type")
both("feir_ablation", "SELECT ROUND(COUNT(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 00:00:00') / CAST(COUNT(*) AS DOUBLE), 6) AS without_filter, ROUND(COUNT(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND ts > TIMESTAMP '2024-01-20 00:00:00') / CAST(COUNT(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') AS DOUBLE), 6) AS with_filter, COUNT(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 00:00:00') AS rejected FROM events")
# Questions by user and items by event, the stages by rule; both engines read these.
_REFS = "SELECT user_id AS question_id, CASE WHEN user_id % 4 <> 0 THEN CAST('2024-01-' || (10 + user_id % 20) || ' 00:00:00' AS {ts}) END AS reference FROM (SELECT DISTINCT user_id FROM events) u"
_ITEMS = "SELECT user_id AS question_id, CASE event_id % 6 WHEN 0 THEN 'post_filter' WHEN 1 THEN 'context' WHEN 2 THEN 'cited' ELSE 'pre_filter' END AS stage, ts AS available_ts FROM events WHERE event_id % 6 NOT IN (0, 1, 2) OR ts <= CAST('2024-01-' || (10 + user_id % 20 + CASE WHEN user_id % 9 = 0 THEN 1 ELSE 0 END) || ' 00:00:00' AS {ts})"
_STAGED = f"""r AS ({_REFS.format(ts='TIMESTAMP')}), i AS ({_ITEMS.format(ts='TIMESTAMP')}),
c AS (SELECT r.question_id, reference, {', '.join(f"count(*) FILTER (WHERE stage = '{s}') AS n_{s}, count(*) FILTER (WHERE stage = '{s}' AND available_ts > reference) AS l_{s}" for s in ('pre_filter', 'post_filter', 'context', 'cited'))} FROM r LEFT JOIN i USING (question_id) GROUP BY r.question_id, reference),
t AS (SELECT question_id, reference, {', '.join(f"CASE WHEN reference IS NOT NULL THEN l_{s}::DOUBLE / nullif(n_{s}, 0) END AS feir_{s}, n_{s}" for s in ('pre_filter', 'post_filter', 'context', 'cited'))}, l_pre_filter AS rejections,
  reference IS NULL OR (n_post_filter + n_context + n_cited > 0 AND l_post_filter + l_context + l_cited = 0) AS valid FROM c)"""


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.question_rows(run(spark, sf_dir, _REFS.format(ts="TIMESTAMP_NTZ")), run(spark, sf_dir, _ITEMS.format(ts="TIMESTAMP_NTZ")))


@query(f"WITH {_STAGED} SELECT question_id, ROUND(feir_pre_filter, 6) AS before, ROUND(feir_post_filter, 6) AS after, ROUND(feir_context, 6) AS context, ROUND(feir_cited, 6) AS cited, rejections, valid FROM t")
def temporal_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the future is in each stage of every question, what was rejected, and whether it holds its time."""
    r = lambda c, n: F.round(f"feir_{c}", 6).alias(n)
    return _staged(spark, sf_dir).select("question_id", r("pre_filter", "before"), r("post_filter", "after"), r("context", "context"), r("cited", "cited"), "rejections", "valid")


@query(f"""WITH {_STAGED} SELECT (SELECT count(*) FROM t) AS n_questions, count(*) AS n_temporal, {', '.join(f"ROUND(avg(feir_{s}), 6) AS feir_{s}, CAST(sum(n_{s}) AS BIGINT) AS n_{s}" for s in ('pre_filter', 'post_filter', 'context', 'cited'))},
  CAST(sum(rejections) AS BIGINT) AS rejections, ROUND(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS compliance FROM t WHERE reference IS NOT NULL""")
def temporal_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suite in one row."""
    return temporal.suite(_staged(spark, sf_dir))


@query(f"""WITH {_STAGED}, m AS (SELECT avg(feir_post_filter) AS a, avg(feir_pre_filter) AS b, CAST(sum(rejections) AS BIGINT) AS rejections FROM t WHERE reference IS NOT NULL)
SELECT ROUND(a, 6) AS with_filter, ROUND(b, 6) AS without_filter, ROUND(b - a, 6) AS absolute, ROUND(CASE WHEN b > 0 THEN 100 * (b - a) / b ELSE 0 END, 4) AS relative_pct, rejections FROM m""")
def temporal_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the time filter takes away."""
    return temporal.ablation(_staged(spark, sf_dir))


both("compliance_rate", "SELECT user_id, ROUND(COUNT(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') / CAST(nullif(COUNT(ts), 0) AS DOUBLE), 6) AS compliance FROM events GROUP BY user_id")
both("plr_summary", "SELECT quality, COUNT(*) AS n, CAST(SUM(toxic) AS BIGINT) AS leaked, ROUND(SUM(toxic) / CAST(COUNT(*) AS DOUBLE), 6) AS plr FROM labels GROUP BY quality")


@query("SELECT quality, n, ROUND((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low, ROUND((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM (SELECT quality, COUNT(*) AS n, SUM(toxic) / CAST(COUNT(*) AS DOUBLE) AS p FROM labels GROUP BY quality)")
def wilson_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = run(spark, sf_dir, "SELECT quality, COUNT(*) AS n, CAST(SUM(toxic) AS DOUBLE) AS h FROM labels GROUP BY quality")
    low, high = metrics.wilson(F.col("h"), F.col("n").cast("double"))
    return x.select("quality", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


both("upper_median", "SELECT c_nationkey, list_sort(list(c_acctbal))[CAST(COUNT(*) // 2 AS INTEGER) + 1] AS m FROM customer GROUP BY c_nationkey", """SELECT c_nationkey, m FROM (SELECT c_nationkey, c_acctbal AS m, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS i, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) x WHERE i = n div 2 + 1""")
both("holm_adjust", "WITH p AS (SELECT n_nationkey AS id, (n_nationkey + 1) / 500.0 AS p FROM nation), r AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS i, COUNT(*) OVER () AS n FROM p) SELECT id, ROUND(CAST(least(1, MAX(p * (n - i + 1)) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING)) AS DOUBLE), 6) AS adjusted FROM r")
both("correlation", "SELECT event_type, ROUND(corr(value, event_id % 97), 5) AS r FROM events GROUP BY event_type")
