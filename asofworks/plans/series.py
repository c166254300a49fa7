"""Time series, point-in-time features, events and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from .base import both, query, run

_DAILY = "SELECT c_nationkey AS k, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, ROUND(SUM(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(o_orderdate AS DATE)"
_DAY = f"WITH s AS ({_DAILY})"


@query(f"{_DAY} SELECT k, d, ROUND((v - lag(v) OVER w) / nullif(lag(v) OVER w, 0), 6) AS r FROM s WINDOW w AS (PARTITION BY k ORDER BY d)")
def daily_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _DAILY).select("k", "d", F.round(features.returns(None, "v", 1, ["k"], "d"), 6).alias("r"))


@query(f"{_DAY} SELECT k, d, ROUND((v - lag(v, 5) OVER w) / nullif(lag(v, 5) OVER w, 0), 6) AS r5, ROUND((v - lag(v, 20) OVER w) / nullif(lag(v, 20) OVER w, 0), 6) AS r20 FROM s WINDOW w AS (PARTITION BY k ORDER BY d)")
def return_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = run(spark, sf_dir, _DAILY)
    return s.select("k", "d", *[F.round(features.returns(s, "v", n, ["k"], "d"), 6).alias(f"r{n}") for n in (5, 20)])


@query(f"{_DAY} SELECT k, d, CASE WHEN row_number() OVER w >= 20 THEN ROUND(AVG(v) OVER (PARTITION BY k ORDER BY d ROWS 19 PRECEDING), 4) END AS sma_20, CASE WHEN row_number() OVER w >= 50 THEN ROUND(AVG(v) OVER (PARTITION BY k ORDER BY d ROWS 49 PRECEDING), 4) END AS sma_50 FROM s WINDOW w AS (PARTITION BY k ORDER BY d)")
def sma_20_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = run(spark, sf_dir, _DAILY)
    return s.select("k", "d", *[F.round(features.rolling(F.avg, "v", n, ["k"], "d"), 4).alias(f"sma_{n}") for n in (20, 50)])


def _volatility(fn: str) -> str:
    return f"{_DAY}, r AS (SELECT k, d, (v - lag(v) OVER w) / nullif(lag(v) OVER w, 0) AS r, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY k ORDER BY d)) SELECT k, d, CASE WHEN i > 20 THEN ROUND({fn}(r) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) END AS vol FROM r"


both("volatility_20d_sample", _volatility("stddev_samp"))
both("volatility_20d_pop", _volatility("stddev_pop"))
both("cumulative_return", f"{_DAY} SELECT k, ROUND(max_by(v, d) / min_by(v, d) - 1, 6) AS r FROM s GROUP BY k")

_POINTS = "SELECT c_custkey AS k, TIMESTAMP '1996-01-01 00:00:00' AS at FROM customer"


@query("SELECT c_custkey AS k, p AS price FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS p FROM (SELECT *, MAX(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01 00:00:00') GROUP BY o_custkey) ON o_custkey = c_custkey")
def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = run(spark, sf_dir, "SELECT o_custkey AS k, o_orderdate AS t, max_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey, o_orderdate")
    points = run(spark, sf_dir, _POINTS.replace("TIMESTAMP ", "TIMESTAMP_NTZ "))
    return features.last_before(points, orders, "k", "at", "t", "price").select("k", "price")


_PAIR = "SELECT o_custkey AS k, max_by(o_totalprice, {o}) FILTER (WHERE o_orderdate <= {a}) AS p0, max_by(o_totalprice, {o}) FILTER (WHERE o_orderdate > {a} AND o_orderdate <= {b}) AS p1 FROM orders GROUP BY o_custkey"
_A, _B = "TIMESTAMP '1996-01-01 00:00:00'", "TIMESTAMP '1997-01-01 00:00:00'"
_DUCK, _SPARK = (_PAIR.format(o=o, a=_A, b=_B) for o in ("(o_orderdate, o_orderkey)", "struct(o_orderdate, o_orderkey)"))
both("forward_return", f"SELECT k, ROUND((p1 - p0) / nullif(p0, 0), 6) AS r FROM ({_DUCK}) x WHERE p0 IS NOT NULL", f"SELECT k, ROUND((p1 - p0) / nullif(p0, 0), 6) AS r FROM ({_SPARK}) x WHERE p0 IS NOT NULL")
_T3 = "SELECT k, CASE WHEN p1 IS NULL THEN NULL WHEN (p1 - p0) / p0 > 0.02 THEN 'up' WHEN (p1 - p0) / p0 < -0.02 THEN 'down' ELSE 'flat' END AS target FROM ({}) x WHERE p0 > 0"
both("targets_3class", _T3.format(_DUCK), _T3.format(_SPARK))
both("pit_feature_rows", f"SELECT o_custkey AS k, COUNT(*) FILTER (WHERE o_orderdate <= {_A}) AS n, ROUND(SUM(o_totalprice) FILTER (WHERE o_orderdate <= {_A}), 2) AS total, ROUND(AVG(o_totalprice) FILTER (WHERE o_orderdate <= {_A}), 4) AS mean, COUNT(*) FILTER (WHERE o_orderdate <= {_A} AND o_orderstatus = 'F') AS n_f FROM orders GROUP BY o_custkey")
both("macro_latest", "SELECT event_type, MAX(ts) AS last_ts, max_by(value, (ts, event_id)) AS value FROM events GROUP BY event_type", "SELECT event_type, MAX(ts) AS last_ts, max_by(value, struct(ts, event_id)) AS value FROM events GROUP BY event_type")
both("interval_activity", "SELECT user_id, CAST(SUM(CASE WHEN ts > TIMESTAMP '2024-01-25 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS d5, CAST(SUM(CASE WHEN ts > TIMESTAMP '2024-01-10 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS d20, COUNT(*) AS d60 FROM events WHERE ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY user_id")
both("activity_dynamics", "WITH a AS (SELECT user_id, SUM(CASE WHEN ts > TIMESTAMP '2024-01-25 00:00:00' THEN 1 ELSE 0 END) / 5.0 AS v5, SUM(CASE WHEN ts > TIMESTAMP '2024-01-10 00:00:00' THEN 1 ELSE 0 END) / 20.0 AS v20 FROM events WHERE ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY user_id) SELECT user_id, ROUND(CAST(v5 - v20 AS DOUBLE), 6) AS acceleration, ROUND(CAST(CASE WHEN v20 > 0 THEN v5 / v20 END AS DOUBLE), 6) AS ratio FROM a")
both("recency_by_form", "SELECT user_id, date_diff('day', CAST(MAX(ts) AS DATE), DATE '2024-02-01') AS days_all, date_diff('day', CAST(MAX(CASE WHEN event_type = 'click' THEN ts END) AS DATE), DATE '2024-02-01') AS days_click FROM events GROUP BY user_id",
     "SELECT user_id, CAST(datediff(DATE '2024-02-01', CAST(MAX(ts) AS DATE)) AS BIGINT) AS days_all, CAST(datediff(DATE '2024-02-01', CAST(MAX(CASE WHEN event_type = 'click' THEN ts END) AS DATE)) AS BIGINT) AS days_click FROM events GROUP BY user_id")
_WF = "SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, ROUND(SUM(o_totalprice), 2) AS v FROM orders GROUP BY CAST(o_orderdate AS DATE)"


@query(f"WITH s AS ({_WF}), p AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos FROM s), f AS (SELECT unnest(generate_series(0, (SELECT greatest(0, CAST(ceil((count(*) - 140) / 30.0) AS INTEGER) - 1) FROM s))) AS fold) SELECT CAST(fold AS INTEGER) AS fold, COUNT(*) FILTER (WHERE pos < 140 + 30 * fold) AS n_train, COUNT(*) FILTER (WHERE pos >= 140 + 30 * fold AND pos < 170 + 30 * fold) AS n_test FROM p, f GROUP BY fold")
def walk_forward_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.fold_sizes(run(spark, sf_dir, _WF), 140, 30)


@query(f"WITH s AS ({_WF}), p AS (SELECT d, row_number() OVER (ORDER BY d) AS i, COUNT(*) OVER () AS n FROM s) SELECT d, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM p")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.chronological(run(spark, sf_dir, _WF), "d").select("d", "part")


both("stratified_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) x WHERE i <= 3")
both("unified_events", "SELECT 'event' AS kind, event_id AS id, ts AS available_ts FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders")
both("event_history", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS place FROM events", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS BIGINT) AS place FROM events")
both("event_type_counts", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'total', COUNT(*) FROM events")
both("activity_summary", "SELECT user_id, COUNT(*) AS n, MIN(ts) AS first_ts, MAX(ts) AS last_ts, COUNT(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
both("coverage_by_source", "SELECT source, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS chars, MIN(doc_id) AS first_id, MAX(doc_id) AS last_id, COUNT(*) FILTER (WHERE lang = 'en') AS en, COUNT(*) FILTER (WHERE lang = 'de') AS de FROM documents GROUP BY source")
both("coverage_rollup", "SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, COUNT(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
both("latest_per_form_limit", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS i FROM documents) x WHERE i <= CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 3 ELSE 1 END")
both("keyset_page", "SELECT doc_id, source FROM documents WHERE doc_id > 100 AND source = 'src3' ORDER BY doc_id LIMIT 20")
both("columnar_unpivot", "WITH a AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list(value ORDER BY event_id) AS vs FROM events GROUP BY user_id) SELECT user_id, unnest(ids) AS event_id, unnest(vs) AS value FROM a",
     "WITH a AS (SELECT user_id, transform(array_sort(collect_list(struct(event_id, value))), x -> x.event_id) AS ids, transform(array_sort(collect_list(struct(event_id, value))), x -> x.value) AS vs FROM events GROUP BY user_id) SELECT user_id, z.ids AS event_id, z.vs AS value FROM a LATERAL VIEW explode(arrays_zip(ids, vs)) t AS z")
