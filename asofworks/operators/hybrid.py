"""From questions to ranked evidence, for a whole table of questions in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.time import is_available, period_ends
from . import retrieval
from .analysis import topic_sections
from .gate import gate


def fetch_sizes(top_k: int, balanced: bool = False) -> tuple[int, int]:
    """(pool, fetch): how many candidates are reranked, and how many each side delivers."""
    pool = max(2 * top_k, 25 if balanced else 20)
    return pool, max(2 * pool, 40 if balanced else 20)


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A stand-in for an encoder: words hashed to signed buckets, counts normalised to length 1; zero without words."""
    words = F.transform(T.alpha_words(text), lambda w: F.xxhash64(w))
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.aggregate(words, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(width)) == i, F.when(F.shiftright(h, 32) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)),
    )
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(sums, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


#: What an edge may carry for its evidence; a column that the edges lack is null.
EDGE_FIELDS = {"event_ts": "timestamp_ntz", "chunk_id": "string", "document_id": "string", "source": "string", "source_url": "string", "source_reference": "string", "publication_date": "string", "fiscal_period": "string", "source_company": "string", "provenance_verified": "boolean", "attribution_status": "string"}


def evidence_rows(paths: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Paths of :func:`traversal.top_paths` with the fields of an evidence record, by a join of their edges alone.

    Document, chunk, source and period are those of the last edge, the source company of the first; event time
    is the latest there is; provenance holds if it holds for every edge (an edge without a label counts as verified). The text says each edge in
    its own direction, by ``names(node_id, name)`` where there are some, and of a single edge its period and day.
    """
    own = [F.col(c) if c in edges.columns else F.lit(None).cast(t).alias(c) for c, t in EDGE_FIELDS.items()]
    held = edges.select("edge_id", "src", "dst", "relationship", *own)
    for end in ("src", "dst"):
        said = held.withColumn(f"{end}_name", F.col(end)) if names is None else held.join(names.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_name")), end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
        held = said
    steps = paths.select("question_id", "evidence_id", F.posexplode("edge_ids").alias("pos", "edge_id")).join(held, "edge_id")
    fields = F.struct("pos", "src", "dst", "relationship", F.concat("src_name", F.lit(" --["), "relationship", F.lit("]--> "), "dst_name").alias("said"), *EDGE_FIELDS)
    whole = steps.groupBy("question_id", "evidence_id").agg(F.array_sort(F.collect_list(fields)).alias("e"))  # three at most
    last, first = F.element_at("e", -1), F.element_at("e", 1)
    verified = F.forall("e", lambda x: F.coalesce(x["provenance_verified"], F.lit(True)))
    day = F.date_format("available_ts", "yyyy-MM-dd")
    one = F.size("e") == 1
    extra = F.array_join(F.array_compact(F.array(F.when(last["fiscal_period"].isNotNull(), F.concat(F.lit("period: "), last["fiscal_period"])), F.when(day.isNotNull(), F.concat(F.lit("as of "), day)))), ", ")
    text = F.concat(F.array_join(F.transform("e", lambda x: x["said"]), " -> "), F.when(one & (extra != ""), F.concat(F.lit(" ("), extra, F.lit(")"))).otherwise(""))
    status = F.when(one, F.coalesce(last["attribution_status"], F.lit("verified"))).when(verified, "verified_path").otherwise("unverified_path_edge")
    kept = paths.join(whole, ["question_id", "evidence_id"])
    return kept.select(
        "question_id", "evidence_id", "rank", F.get("path", F.lit(0)).alias("source_node"), F.element_at("path", -1).alias("target_node"), F.array_join("relationships", " -> ").alias("relationship"),
        "relationships", "path", "edge_ids", "hop_count", text.alias("text"), "score", "confidence", "available_ts", F.array_max(F.transform("e", lambda x: x["event_ts"])).alias("event_ts"),
        *[last[c].alias(c) for c in ("document_id", "chunk_id", "source", "source_url", "source_reference", "publication_date", "fiscal_period")], first["source_company"].alias("source_company"),
        verified.alias("provenance_verified"), status.alias("attribution_status"),
        F.transform("e", lambda x: F.struct(x["src"].alias("source"), x["relationship"].alias("relationship"), x["dst"].alias("target"))).alias("graph_edges"),
    )


def fuse(vector: DataFrame, graph: DataFrame, k: int = 60, vector_weight: float = 1.0, graph_weight: float = 1.0, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of each question: ``(question_id, evidence_id, chunk_id, source_type, score, rank)``.

    ``vector(question_id, chunk_id, rank)``, ``graph(question_id, evidence_id, chunk_id, rank)``. A chunk fuses with its best graph
    row and consumes the others. Ordered by score, then evidence_id, and cut at ``limit``.
    """
    on = ["question_id", "chunk_id"]
    best = graph.groupBy(*on).agg(F.min("rank").alias("g"))
    v = vector.select(*on, F.col("rank").alias("v")).join(best, on, "left")
    kind = F.when(F.col("g").isNull(), "vector").otherwise("hybrid")
    score = F.lit(vector_weight) / (k + F.col("v")) + F.coalesce(F.lit(graph_weight) / (k + F.col("g")), F.lit(0.0))
    fused = v.select("question_id", F.concat(kind, F.lit(":"), F.col("chunk_id").cast("string")).alias("evidence_id"), "chunk_id", kind.alias("source_type"), score.alias("score"))
    rest = graph.join(vector.select(*on), on, "left_anti").select("question_id", F.concat(F.lit("graph:"), F.col("evidence_id")), "chunk_id", F.lit("graph"), F.lit(graph_weight) / (k + F.col("rank")))
    out = fused.union(rest).withColumn("score", F.round("score", 6))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "evidence_id")))
    return out if limit is None else out.where(F.col("rank") <= limit)


def identity_rerank(evidence: DataFrame, top_k: int) -> DataFrame:
    """What is available at the question's time, in the order it comes."""
    seen = F.col("reference").isNull() | is_available(F.col("available_ts"), F.col("reference"))
    kept = evidence.where(seen)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "evidence_id"))).where(F.col("rank") <= top_k)


def rerank(evidence: DataFrame, top_k: int, weights: tuple[float, float, float, float, float] = (0.20, 0.25, 0.35, 0.15, 0.05)) -> DataFrame:
    """Evidence of each question by normalised score, shared words, wanted relation, confidence and hops; ``rerank_score`` beside the former score.

    ``evidence(question_id, question, intents, evidence_id, text, relationships, confidence, hop_count, score, rank)``. Sorted by the
    unrounded score, the former rank and the id, cut at ``top_k``.
    """
    w = Window.partitionBy("question_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    norm = (F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0)
    q, t = F.array_distinct(T.tokens(F.col("question"))), F.array_distinct(T.tokens(F.col("text")))
    overlap = F.size(F.array_intersect(q, t)) / F.greatest(F.lit(1), F.size(q))
    said = F.exists("intents", lambda i: F.lower("text").contains(F.lower(i)))
    relation = F.when(F.size("intents") == 0, 0.5).when(F.arrays_overlap("relationships", "intents"), 1.0).when(said, 0.8).otherwise(0.1)
    a, b, c, d, e = weights
    score = a * norm + b * overlap + c * relation + d * F.coalesce("confidence", F.lit(1.0)) - e * F.greatest(F.lit(0), F.coalesce("hop_count", F.lit(1)) - 1)
    out = evidence.withColumn("full_", score)
    order = Window.partitionBy("question_id").orderBy(F.desc("full_"), "rank", "evidence_id")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k).withColumn("rerank_score", F.round("full_", 5)).drop("full_")


def next_action(analysed: DataFrame, gated: DataFrame, top_k: int) -> DataFrame:
    """What a further round changes for each insufficient question, one action each: relationship names added, one hop more (three at most), a missing entity added, or twice the results."""
    held = analysed.join(gated.where("not sufficient"), "question_id")
    missing = F.array_except("entities", "found")
    action = F.when(F.col("reason").isin("relationship", "chain"), "relationship").when(F.col("max_hops") < F.col("hops"), "hops").when(F.size(missing) > 0, "entity").otherwise("broaden")
    words = F.when(action == "relationship", F.array_join(F.transform("intents", lambda i: F.lower(F.replace(i, F.lit("_"), F.lit(" ")))), " ")).when(action == "entity", F.regexp_extract(missing[0], "([^:]*)$", 1))
    question = F.concat_ws(" ", "question", words)
    hops = F.when(action == "hops", F.least(F.lit(3), F.col("hops") + 1)).otherwise(F.col("hops"))
    size = F.when(action == "broaden", 2 * top_k).otherwise(top_k)
    return held.select("question_id", action.alias("action"), question.alias("question"), hops.alias("hops"), size.alias("top_k"))


def orchestrate(
    analysed: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], top_k: int = 8, rounds: int = 2, reranker: Callable[[DataFrame, int], DataFrame] = rerank,
    judge: Callable[[DataFrame, DataFrame], DataFrame] = gate, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """Retrieve, rerank and judge all questions, then again those that are insufficient, ``rounds`` times at most.

    ``retrieve(analysed, fetch)`` gives evidence as :func:`rerank` takes it. New evidence replaces what has its id;
    the pool is reranked as a whole. Retriever, reranker and judge are plain functions; ``keep`` settles a round's
    tables, so that a round does not run the ones before again. Returns the evidence and the last judgement.
    """
    _, fetch = fetch_sizes(top_k)
    asked = keep(analysed)
    ranked = lambda best: best.withColumn("rank", F.col("place")) if "place" in best.columns else best
    pool = keep(retrieve(asked, fetch).withColumn("round", F.lit(0)))
    best = keep(reranker(pool, top_k))
    gated = keep(judge(asked, ranked(best)).withColumn("rounds", F.lit(0)))
    for r in range(1, rounds + 1):
        change = keep(next_action(asked, gated, top_k))
        if change.isEmpty():
            break
        more = asked.drop("question", "hops").join(change.select("question_id", "question", "hops"), "question_id")
        new = retrieve(keep(more), 2 * fetch).withColumn("round", F.lit(r))
        both = pool.unionByName(new)
        last = Window.partitionBy("question_id", "evidence_id").orderBy(F.desc("round"))
        pool = keep(both.withColumn("n_", F.row_number().over(last)).where("n_ = 1").drop("n_"))
        best = keep(reranker(pool, top_k))
        again = judge(asked, ranked(best)).withColumn("rounds", F.lit(r))
        done = gated.where("sufficient")
        gated = keep(done.unionByName(again.join(done.select("question_id"), "question_id", "left_anti")))
    return best, gated


# Words that ask for the newest period, forms of periodic reports, and how many vectors each kind of search brings.
LATEST = r"\b(latest|most recent|current|recent quarter|last quarter|newest)\b"
PERIODIC = ("10-Q", "10-K")
TOPIC_K, PERIOD_K, COMPANY_K = 4, 6, 8


def periods_as_of(asked: DataFrame, vectors: DataFrame, forms: tuple[str, ...] | None = None) -> DataFrame:
    """``(question_id, company, fiscal_period, place)``: the periods of each asked company that were available at the question's time, newest first.

    ``asked(question_id, company, reference)``. Periods of a company are few, so the first moment of each is taken before the join.
    """
    rows = vectors.where(F.col("fiscal_period").isNotNull())
    if forms:
        rows = rows.where(F.col("document_type").isin(*forms))
    first = rows.groupBy("company", "fiscal_period").agg(F.min("available_ts").alias("since"), F.count_if(F.col("available_ts").isNull()).alias("open_"))
    seen = F.col("reference").isNull() | is_available(F.col("since"), F.col("reference"))
    held = asked.select("question_id", "company", "reference").distinct().join(first, "company").where(seen)
    order = Window.partitionBy("question_id", "company").orderBy(F.desc("fiscal_period"))
    return held.select("question_id", "company", "fiscal_period", F.row_number().over(order).alias("place"))


def vector_side(analysed: DataFrame, vectors: DataFrame, encode: Callable[[Column], Column], fetch: int, scoped: bool = True, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``(question_id, chunk_id, rank, topical)``: the vectors of every question, all its searches in one batch.

    ``vectors`` as :func:`retrieval.search` takes them; ``encode`` makes a vector of a text. Every search sees only what was available
    at its question's reference time; a question whose time cannot be read has none. With ``scoped`` the searches inside the
    filings of the (at most two) companies of a question go first: by the section of each topic it touches (in the topic's form, in any
    where that has none), by the (at most two) periods it names or, if it asks for the latest, by the newest periodic report and the newest filing,
    and by company alone; then the search over everything. A vector counts where it stands first. Cut at ``fetch``, or
    at the number of scoped hits if that is more. ``keep`` settles the list of searches, which several steps read.
    """
    asked = analysed.where(~F.coalesce(F.col("unreadable"), F.lit(False))) if "unreadable" in analysed.columns else analysed
    text = F.lit(None).cast("string")
    cols = ["question_id", "text", "reference", "company", "fiscal_period", "document_type", "k", "o1", "o2", "o3", "typed"]
    plan = asked.select("question_id", F.col("question").alias("text"), "reference", text.alias("company"), text.alias("fiscal_period"), text.alias("document_type"), F.lit(fetch).alias("k"), F.lit(2).alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("o3"), F.lit(False).alias("typed"))
    if scoped:
        own = F.slice(F.filter("entities", lambda e: e.startswith("company:")), 1, 2)
        each = asked.select("question_id", "question", "reference", F.posexplode(own).alias("o2", "company"))
        by = each.withColumns({"text": F.col("question"), "fiscal_period": text, "document_type": text, "typed": F.lit(False)})
        alone = by.withColumns({"k": F.lit(COMPANY_K), "o1": F.lit(1), "o3": F.lit(99)})
        named = each.select("*", F.posexplode(F.slice(period_ends(F.col("question")), 1, 2)).alias("o3", "fiscal_period"))
        newest = each.where(F.lower("question").rlike(LATEST) & (F.size(period_ends(F.col("question"))) == 0))
        first = periods_as_of(newest, vectors, PERIODIC).where("place = 1").withColumn("o3", F.lit(0))
        any_form = periods_as_of(newest, vectors).where("place = 1").withColumn("o3", F.lit(1))
        latest = first.unionByName(any_form.join(first.select("question_id", "company", "fiscal_period"), ["question_id", "company", "fiscal_period"], "left_anti"))
        timed = named.unionByName(newest.join(latest.drop("place"), ["question_id", "company"]).select(*named.columns))
        timed = timed.withColumns({"text": F.col("question"), "document_type": text, "typed": F.lit(False), "k": F.lit(PERIOD_K), "o1": F.lit(1)})
        topics = each.select("*", F.posexplode(topic_sections(F.col("question"))).alias("o3", "topic"))
        topical = topics.select("*", F.col("topic.query").alias("text"), F.explode(F.array(F.col("topic.form"), text)).alias("document_type"))
        topical = topical.withColumns({"fiscal_period": text, "k": F.lit(TOPIC_K), "o1": F.lit(0), "typed": F.col("document_type").isNotNull()})
        for part in (alone, timed, topical):
            plan = plan.unionByName(part.select(*cols))
    plan = keep(plan.withColumn("search_id", F.xxhash64("question_id", "o1", "o2", "o3", "typed")).withColumn("q", encode(F.col("text"))))
    found = retrieval.search(vectors, plan)
    hits = found.join(plan.select("search_id", "question_id", "o1", "o2", "o3", "typed"), "search_id")
    hits = hits.withColumn("typed_", F.max("typed").over(Window.partitionBy("question_id", "o1", "o2", "o3"))).where((F.col("o1") > 0) | (F.col("typed") == F.col("typed_")))
    hits = hits.withColumn("n_", F.count_if(F.col("o1") < 2).over(Window.partitionBy("question_id")))
    place = F.struct("o1", "o2", "o3", "rank")
    first = hits.groupBy("question_id", "vec_id").agg(F.min(place).alias("p"), F.first("n_").alias("n_"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("p", "vec_id")))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(fetch), F.col("n_"))).select("question_id", F.col("vec_id").alias("chunk_id"), "rank", (F.col("p.o1") == 0).alias("topical"))


def balance(evidence: DataFrame, analysed: DataFrame, top_k: int, least: int = 3) -> DataFrame:
    """The evidence of every question, shared out among the entities it names, with a new ``rank``.

    In the order of the question's entities each takes up to ``least`` of the pieces that are not taken yet and speak of it: of its filing, with
    it at an end of an edge, or naming it in a text whose origin is not doubted. Free places up to ``top_k`` go to the others in order of
    rank; the result is ordered by score, former rank and id, and cut. A question of fewer than two entities is only cut.
    ``evidence(question_id, rank, evidence_id, score, text)`` with the columns of :data:`gate.EVIDENCE` that are known; a question's pool is
    as bounded as what it fetches.
    """
    names = [c for c in ("source_company", "provenance_verified", "graph_edges") if c in evidence.columns]
    kinds = {"source_company": "string", "provenance_verified": "boolean", "graph_edges": "array<struct<source:string,relationship:string,target:string>>"}
    rows = evidence.select("question_id", "rank", "evidence_id", "score", "text", *names)
    for c, kind in kinds.items():
        rows = rows if c in names else rows.withColumn(c, F.lit(None).cast(kind))
    ends = F.flatten(F.transform(F.coalesce("graph_edges", F.expr(f"cast(array() as {kinds['graph_edges']})")), lambda e: F.array(e["source"], e["target"])))
    piece = F.struct("rank", "evidence_id", "score", F.upper("source_company").alias("company"), ends.alias("ends"), F.when(F.coalesce("provenance_verified", F.lit(True)), F.lower("text")).alias("low"))
    pools = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(piece)).alias("pool")).join(analysed.select("question_id", "entities"), "question_id")

    def speaks(p: Column, e: Column) -> Column:
        bare = F.regexp_extract(e, "^(?:[^:]*:)?(.*)$", 1)
        at_end = F.array_contains(p["ends"], e) | F.exists(p["ends"], lambda x: F.upper(x) == F.upper(bare))
        return F.coalesce((p["company"] == F.upper(bare)) & (p["company"] != ""), F.lit(False)) | F.coalesce(at_end, F.lit(False)) | F.coalesce(p["low"].contains(F.lower(bare)), F.lit(False))

    ids = lambda a: F.transform(a, lambda p: p["evidence_id"])
    take = lambda taken, e: F.concat(taken, F.slice(ids(F.filter("pool", lambda p: speaks(p, e) & ~F.array_contains(taken, p["evidence_id"]))), 1, least))
    shared = F.when(F.size("entities") < 2, F.expr("cast(array() as array<string>)")).otherwise(F.aggregate("entities", F.expr("cast(array() as array<string>)"), take))
    out = pools.withColumn("taken", shared)
    out = out.withColumn("rest", F.slice(ids(F.filter("pool", lambda p: ~F.array_contains("taken", p["evidence_id"]))), F.lit(1), F.greatest(F.lit(0), F.lit(top_k) - F.size("taken"))))
    kept = out.select("question_id", F.explode(F.filter("pool", lambda p: F.array_contains(F.concat("taken", "rest"), p["evidence_id"]))).alias("p"))
    order = Window.partitionBy("question_id").orderBy(F.desc("p.score"), "p.rank", "p.evidence_id")
    ranked = kept.select("question_id", F.col("p.evidence_id").alias("evidence_id"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= top_k)
    return evidence.drop("rank").join(ranked, ["question_id", "evidence_id"])
