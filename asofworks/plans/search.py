"""Vector search, fusion, quotas, reranking, gate and question analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import is_available
from ..operators import retrieval
from .base import both, query

_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_COS = "ROUND(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))), 6)"
_SCORE = _COS.format(a="embedding", b=_Q)
#: A vector's time, by rule from its id, and the time asked for; both engines read the first form.
_SEEN = "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(vec_id % 365 AS INTEGER)) <= TIMESTAMP '2024-06-29 00:00:00'"
_AVAILABLE, _CUT = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(vec_id % 365 AS INT))", "TIMESTAMP_NTZ '2024-06-29 00:00:00'"


def _top(spark: SparkSession, sf_dir: str, k: int, keep=None, query_id: int = 0) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return retrieval.top_k(e, list(map(float, e.where(f"vec_id = {query_id}").first().embedding)), k, keep)


@query(f"SELECT vec_id, {_SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 10).select("vec_id", "score")


@query(f"SELECT vec_id, label, {_SCORE} AS score FROM embeddings WHERE label = 3 AND {_SEEN} ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 10, (F.col("label") == 3) & is_available(F.expr(_AVAILABLE), F.expr(_CUT))).select("vec_id", "label", "score")


@query(f"SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5")
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return retrieval.batch_top_k(e.select("vec_id", "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)


_OTHER = _COS.format(a="embedding", b="(SELECT embedding FROM embeddings WHERE vec_id = 1)")
#: Two rankings of all vectors: nearest to vector 0 within three labels, and, as the graph's side, nearest to vector 1; each delivers its fetch size.
_POOL = f"v AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY {_SCORE} DESC, vec_id) AS rank FROM embeddings WHERE label IN (0, 1, 2) ORDER BY rank LIMIT 40), g AS (SELECT vec_id AS evidence_id, vec_id AS chunk_id, row_number() OVER (ORDER BY {_OTHER} DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 60)"


def _fuse_sql(wv: float, wg: float) -> str:
    return f"""WITH {_POOL}, b AS (SELECT chunk_id, MIN(rank) AS g FROM g GROUP BY chunk_id)
SELECT CASE WHEN b.g IS NULL THEN 'vector:' ELSE 'hybrid:' END || v.chunk_id AS evidence_id, CASE WHEN b.g IS NULL THEN 'vector' ELSE 'hybrid' END AS source_type, ROUND({wv}::DOUBLE / (60 + v.rank) + coalesce({wg}::DOUBLE / (60 + b.g), 0), 6) AS score FROM v LEFT JOIN b ON v.chunk_id = b.chunk_id
UNION ALL SELECT 'graph:' || evidence_id, 'graph', ROUND({wg}::DOUBLE / (60 + rank), 6) FROM g WHERE chunk_id NOT IN (SELECT chunk_id FROM v)"""


def _fuse(spark: SparkSession, sf_dir: str, wv: float, wg: float) -> DataFrame:
    v = _top(spark, sf_dir, 40, F.col("label").isin(0, 1, 2))
    v = retrieval.ranked(v, F.desc("score"), F.col("vec_id")).select(F.col("vec_id").alias("chunk_id"), "rank")
    g = retrieval.ranked(_top(spark, sf_dir, 60, query_id=1), F.desc("score"), F.col("vec_id")).select(F.col("vec_id").alias("evidence_id"), F.col("vec_id").alias("chunk_id"), "rank")
    return retrieval.rrf(v, g, 60, wv, wg).withColumn("score", F.round("score", 6))


@query(_fuse_sql(1.0, 1.0))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuse(spark, sf_dir, 1.0, 1.0)


@query(_fuse_sql(0.7, 1.3))
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuse(spark, sf_dir, 0.7, 1.3)


@query(f"""WITH c AS (SELECT vec_id AS id, label AS entity, {_SCORE} AS score FROM embeddings ORDER BY score DESC, id LIMIT 60), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM c),
m AS (SELECT *, entity IN (4, 5) AND row_number() OVER (PARTITION BY entity ORDER BY rank) <= 3 AS reserved FROM r), p AS (SELECT *, row_number() OVER (ORDER BY reserved DESC, rank) AS place FROM m)
SELECT id, entity, score FROM p WHERE place <= 12 OR reserved ORDER BY score DESC, rank LIMIT 12""")
def balanced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _top(spark, sf_dir, 60).select(F.col("vec_id").alias("id"), F.col("label").alias("entity"), "score")
    return retrieval.balanced_top_k(retrieval.ranked(pool, F.desc("score"), F.col("id")), [4, 5], 12, 3).select("id", "entity", "score")


@query("""WITH q AS (SELECT list_distinct(regexp_extract_all(lower('the and that with this from'), '[a-z0-9_]+')) AS q),
d AS (SELECT doc_id, source, n_chars AS s, lang, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents),
x AS (SELECT doc_id, source, lang, (s - MIN(s) OVER (PARTITION BY source)) / CASE WHEN MAX(s) OVER (PARTITION BY source) > MIN(s) OVER (PARTITION BY source) THEN CAST(MAX(s) OVER (PARTITION BY source) - MIN(s) OVER (PARTITION BY source) AS DOUBLE) ELSE 1.0 END AS norm, len(list_intersect(w, q)) / 6.0 AS o FROM d, q)
SELECT doc_id, ROUND(0.20 * norm + 0.25 * o + 0.35 * CASE lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 0.8 ELSE 0.1 END + 0.15 - 0.05 * (doc_id % 3), 5) AS rerank_score FROM x""")
def rerank_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.col("n_chars").cast("double"))
    q = F.array(*map(F.lit, ("the", "and", "that", "with", "this", "from")))
    overlap = F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))), q)) / 6
    relation = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "fr", 0.8).otherwise(0.1)
    return retrieval.rerank(docs, overlap, relation, F.lit(1.0), F.col("doc_id") % 3 + 1, ["source"]).select("doc_id", F.round("rerank_score", 5).alias("rerank_score"))


@query(f"""WITH s AS (SELECT vec_id, {_SCORE} AS score, 0 AS o FROM embeddings WHERE label = 2 ORDER BY score DESC, vec_id LIMIT 8), a AS (SELECT vec_id, {_SCORE} AS score, 1 AS o FROM embeddings ORDER BY score DESC, vec_id LIMIT 40),
f AS (SELECT vec_id, score, MIN(o) AS first_source FROM (SELECT * FROM s UNION ALL SELECT * FROM a) GROUP BY vec_id, score)
SELECT vec_id, first_source, score, CAST(row_number() OVER (ORDER BY first_source, score DESC, vec_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 40""")
def scoped_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 8 of one label, then the best of all vectors; a vector counts where it stands first; 40 at most."""
    scoped, everywhere = _top(spark, sf_dir, 8, F.col("label") == 2), _top(spark, sf_dir, 40)
    found = scoped.withColumn("o", F.lit(0)).unionByName(everywhere.withColumn("o", F.lit(1)))
    first = found.groupBy("vec_id", "score").agg(F.min("o").alias("first_source"))
    return retrieval.ranked(first, F.col("first_source"), F.desc("score"), F.col("vec_id")).where("rank <= 40").select("vec_id", "first_source", "score", "rank")


both("distinct_periods", "SELECT DISTINCT extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q FROM orders", "SELECT DISTINCT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS q FROM orders")

both("sufficiency_gate", """WITH e AS (SELECT c.conv_id AS q, d.doc_id, d.source, d.lang, d.doc_id % 365 AS day FROM conversations c JOIN documents d ON d.doc_id = c.conv_id * 3 + c.turn WHERE c.role = 'user'),
a AS (SELECT q, COUNT(*) AS n, SUM(CASE WHEN day > 300 THEN 1 ELSE 0 END) AS late, SUM(CASE WHEN source IS NOT NULL THEN 1 ELSE 0 END) AS sourced, COUNT(DISTINCT source) AS entities, SUM(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS rel FROM e GROUP BY q)
SELECT q, CASE WHEN n < 1 THEN 'count' WHEN late > 0 THEN 'temporal' WHEN sourced = 0 THEN 'provenance' WHEN entities < 2 THEN 'entity' WHEN rel = 0 THEN 'relationship' ELSE 'sufficient' END AS outcome FROM a""")
both("citation_validation", "WITH c AS (SELECT conv_id, turn, conv_id * 3 + turn AS cited FROM conversations WHERE role = 'assistant') SELECT conv_id, COUNT(*) AS n_cited, COUNT(doc_id) AS n_known, CAST(SUM(CASE WHEN doc_id % 365 <= 180 THEN 1 ELSE 0 END) AS BIGINT) AS n_visible FROM c LEFT JOIN documents ON doc_id = cited GROUP BY conv_id")
