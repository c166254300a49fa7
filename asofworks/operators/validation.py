"""Checks of records: each gives an array of error codes, empty for a sound row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.time import parse_ts
from ..sources.sinks import settle

# Keys and categories of a benchmark item.
ITEM_KEYS = (
    "question_id", "question", "category", "hop_level", "entities", "reference_time", "expected_reasoning_hops", "relevant_chunk_ids", "relevant_document_ids",
    "expected_graph_path", "ground_truth_answer", "required_evidence", "answerable", "verification_status",
)
CATEGORIES = ("factual_single_hop", "relational_single_hop", "temporal_point_in_time", "relational_multi_hop", "cross_document_comparative")


def codes(*tests: tuple[str, Column]) -> Column:
    """The names of the tests that hold, in order; an unknown outcome does not."""
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def duplicates(keys: list[str], order: str) -> Column:
    """Whether a row repeats an earlier one of its key; keys are hashed, and rows with a null key are never repeats."""
    w = Window.partitionBy(F.xxhash64(*keys), *[F.length(F.col(k).cast("string")) for k in keys]).orderBy(order)
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    return there & (F.row_number().over(w) > 1)


def filing_errors(filing: str = "filing_date", report: str = "report_date", accepted: str = "acceptance_datetime") -> Column:
    f, r, a = (parse_ts(F.col(c)) for c in (filing, report, accepted))
    return codes(("missing_filing_date", f.isNull()), ("missing_acceptance_datetime", a.isNull()), ("missing_report_date", r.isNull()), ("report_date_after_filing_date", r > f))


def macro_errors() -> Column:
    """Of ``(series_id, series_name, date, value, source, source_url, ingested_at)``, all text."""
    date, done = parse_ts(F.col("date")), parse_ts(F.col("ingested_at"))
    return codes(
        ("missing_series_id", blank("series_id")), ("missing_series_name", blank("series_name")), ("missing_date", blank("date")), ("invalid_date", ~blank("date") & date.isNull()),
        ("missing_value", F.col("value").isNull()), ("invalid_value", F.col("value").isNotNull() & F.trim("value").try_cast("double").isNull()), ("missing_source", blank("source")),
        ("missing_source_url", blank("source_url")), ("missing_ingested_at", blank("ingested_at")), ("invalid_ingested_at", ~blank("ingested_at") & done.isNull()),
    )


def news_errors(required: tuple[str, ...] = ("ticker", "title", "url", "source", "published_at", "ingested_at")) -> Column:
    published, done = parse_ts(F.col("published_at")), parse_ts(F.col("ingested_at"))
    ticker = F.trim("ticker")
    return codes(
        *[(f"missing_{c}", blank(c)) for c in required],
        ("invalid_ticker", ~blank("ticker") & ((F.length(ticker) > 10) | ~F.replace(ticker, F.lit("-"), F.lit("")).rlike("^[A-Za-z0-9]+$"))),
        ("invalid_url", ~F.coalesce(F.col("url").rlike("^https?://[^/?#]+"), F.lit(False))), ("invalid_published_at", published.isNull()), ("invalid_ingested_at", done.isNull()), ("published_after_ingestion", published > done),
    )


def summary(rows: DataFrame, errors: str = "errors", duplicate: str | None = None) -> DataFrame:
    """Totals of checked rows: all, sound, faulty, repeated."""
    repeats = F.count_if(F.col(duplicate)) if duplicate else F.lit(0)
    return rows.agg(F.count("*").alias("total"), F.count_if(F.size(errors) == 0).alias("valid"), F.count_if(F.size(errors) > 0).alias("invalid"), repeats.alias("duplicates"))


def feature_errors(rows: DataFrame, features: list[str], entity: str, at: str) -> DataFrame:
    """One row a column or rule: missing and non-finite values, repeated snapshot dates of an entity, rows that go back in time in the stated order ``seq``."""
    w = Window.partitionBy(entity).orderBy("seq")
    marked = rows.withColumns({"back_": F.col(at) < F.lag(at).over(w), "again_": F.row_number().over(Window.partitionBy(entity, at).orderBy("seq")) > 1})
    parts = [F.struct(F.lit(f"missing:{c}").alias("rule"), F.count_if(F.col(c).isNull()).alias("n")) for c in features]
    parts += [F.struct(F.lit(f"not_finite:{c}").alias("rule"), F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias("n")) for c in features]
    parts += [F.struct(F.lit(n).alias("rule"), F.count_if(c).alias("n")) for n, c in (("duplicate_snapshots", "again_"), ("not_chronological", "back_"))]
    return marked.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def item_errors(raw: str = "raw") -> Column:
    """Of benchmark items as JSON text: keys that are missing (one code each), the category, lists, the rationale of unanswerable ones."""
    keys = F.coalesce(F.json_object_keys(raw), F.expr("cast(array() as array<string>)"))
    get = lambda k: F.get_json_object(raw, f"$.{k}")
    is_list = lambda k: F.coalesce(get(k).startswith("["), F.lit(False))
    return codes(
        *[(f"missing:{k}", ~F.array_contains(keys, k)) for k in ITEM_KEYS],
        ("category", ~F.coalesce(get("category").isin(*CATEGORIES), F.lit(False))), ("relevant_chunk_ids", ~is_list("relevant_chunk_ids")), ("relevant_document_ids", ~is_list("relevant_document_ids")),
        ("rationale", F.coalesce(get("answerable") == "false", F.lit(False)) & (F.coalesce(get("unanswerability_rationale"), F.lit("")) == "")),
    )


def _grams(text: Column) -> Column:
    """The distinct runs of one to three characters of a text, found in one pass each."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)]))


def verify_candidates(items: DataFrame, chunks: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """``(item_id, n_chunks, chunk_ids, verified)``: whether all entities of ``items(item_id, entities, required)`` are nodes and some chunk holds all required terms (letter case aside); at most ``most`` chunk ids are listed.

    Terms are looked for as parts of the text, through an index of runs of three characters: an item meets only the chunks that hold the
    rarest run of its terms (a shorter term is a run itself), and these are read whole. An item without terms is held by every chunk, one whose
    terms are null by none.
    """
    need = items.select("item_id", F.explode_outer("entities").alias("node_id")).join(nodes.select("node_id", F.lit(True).alias("there")), "node_id", "left")
    linked = need.groupBy("item_id").agg(F.min(F.coalesce("there", F.col("node_id").isNull())).alias("linked"))
    low = items.select("item_id", F.filter(F.transform("required", F.lower), lambda t: t != "").alias("required")).where("required is not null")
    texts = chunks.select("chunk_id", F.lower("text").alias("low_")).where("low_ is not null")
    own = low.select("item_id", F.explode("required").alias("t")).select("item_id", F.explode(_grams(F.col("t"))).alias("gram"), F.least(F.length("t"), F.lit(3)).alias("n"))
    own = own.where(F.length("gram") == F.col("n")).select("item_id", "gram").distinct()
    hits = settle(texts.select("chunk_id", F.explode(_grams(F.col("low_"))).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi"), "grams")
    often = own.join(hits.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left").na.fill(0, ["df"])
    key = often.groupBy("item_id").agg(F.min(F.struct("df", "gram")).alias("k")).select("item_id", F.col("k.gram").alias("gram"))
    met = key.join(hits, "gram").select("item_id", "chunk_id").join(texts, "chunk_id").join(low, "item_id")
    held = met.where(F.forall("required", lambda t: F.col("low_").contains(t))).select("item_id", "chunk_id")
    every = low.where(F.size("required") == 0).select("item_id")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("chunk_id"))
    first = held.withColumn("i_", place).groupBy("item_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("i_") <= most, F.col("chunk_id")))).alias("chunk_ids"))
    smallest = texts.orderBy("chunk_id").limit(most).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    whole = every.join(F.broadcast(texts.agg(F.count("*").alias("n")).join(smallest)))
    found = first.unionByName(whole.where("n > 0"))
    out = items.select("item_id").join(linked, "item_id", "left").join(found, "item_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("item_id", n.alias("n_chunks"), F.coalesce("chunk_ids", F.expr("cast(array() as array<string>)")).alias("chunk_ids"), (F.coalesce("linked", F.lit(True)) & (n > 0)).alias("verified"))


# Characters behind a heading that are taken for its statement.
STATEMENT_REACH = 9000


def statement_facts(text: Column, heading: str, label: str) -> Column:
    """``struct(years, values)`` of the first row ``label`` of an income statement behind ``heading``: the last run of years before it, and its numbers (in brackets: negative)."""
    behind = F.regexp_extract(text, rf"(?s){heading}(.{{0,{STATEMENT_REACH}}})", 1)
    row = F.regexp_extract(behind, rf"(?<![A-Za-z]){label}\s*((?:\$?\s*\(?[0-9][0-9,]*(?:\.[0-9]+)?\)?\s*){{2,8}})", 1)
    before = F.regexp_extract(behind, rf"(?s)^(.*?)(?<![A-Za-z]){label}", 1)
    runs = F.regexp_extract_all(before, F.lit(r"(?:\b20\d\d\b[^0-9A-Za-z]{0,40}){2,}"), F.lit(0))
    years = F.regexp_extract_all(F.coalesce(F.get(F.reverse(runs), F.lit(0)), F.lit("")), F.lit(r"20\d\d"), F.lit(0))
    said = F.regexp_extract_all(row, F.lit(r"\(?[0-9][0-9,]*(?:\.[0-9]+)?\)?"), F.lit(0))
    value = lambda v: F.regexp_replace(v, "[^0-9.]", "").try_cast("double") * F.when(v.startswith("("), -1.0).otherwise(1.0)
    return F.when(row != "", F.struct(F.transform(years, lambda y: y.cast("int")).alias("years"), F.transform(said, value).alias("values")))
