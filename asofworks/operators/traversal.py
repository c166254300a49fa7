"""Bounded walks over an edge table for a whole table of questions.

All questions walk together, a level at a time. After a level the score of a question's
k-th best path is known, and a path goes on only if the best that could still become of it
is as good. Of the paths that end at one node, only those that can lead to one of the k
best are carried on; of a node's edges, the last step meets only those that can end one.
So a hub costs its edges once for each question that reaches it, not once for each pair of
them. Edges of a hub are dealt over as many parts as its degree asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.time import is_available

#: Edges of a node in one part of a join.
PART = 4096
#: Factors of a path's score: all its relationships wanted, some, none; an end that is a company where one is asked for.
ALL, SOME, NONE, COMPANY = 8.0, 5.0, 0.2, 1.5
#: Factors of a single edge where the question asks what something depends on: its supplier or what it depends on, and what it supplies itself.
TOWARDS, AWAY = 2.0, 0.1
# Words of a question that ask for a company.
COMPANY_WORDS = ("company", "companies", "firm", "firms", "corporation")


def two_way(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``edges`` once from each end, (a, b, salt, b_company, ...); unverified ones are left out.

    ``nodes(node_id, node_type, available_ts)``, where given, adds the time of ``b`` and says which ends are companies;
    without it the ids do (``company:``).
    """
    cols = ["edge_id", "relationship", F.col("available_ts").alias("ts"), F.col("confidence").cast("double").alias("c")]
    held = edges.where(F.coalesce(F.col("provenance_verified"), F.lit(True))) if "provenance_verified" in edges.columns else edges
    out = held.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("forward"), *cols).union(held.select("dst", "src", F.lit(False), *cols)).where("a <> b")
    if nodes is None:
        out = out.withColumn("b_ts", F.lit(None).cast("timestamp_ntz")).withColumn("b_company", F.col("b").startswith("company:"))
    else:
        own = nodes.select(F.col("node_id").alias("b"), F.col("available_ts").alias("b_ts"), (F.lower("node_type") == "company").alias("b_company"))
        out = out.join(own, "b", "left").withColumn("b_company", F.coalesce("b_company", F.lit(False)))
    size = out.groupBy("a").agg(F.count("*").alias("degree"), F.max("c").alias("best"))
    parts = size.select("a", F.ceil(F.col("degree") / PART).cast("int").alias("parts"), "best")
    return out.join(parts, "a").withColumn("salt", F.pmod(F.xxhash64("edge_id"), F.col("parts")).cast("int"))


def _asked(analysed: DataFrame) -> DataFrame:
    """What a walk needs of a question; one whose stated time cannot be read walks nowhere."""
    low = F.lower("question")
    wants = F.lit(False)
    for w in COMPANY_WORDS:
        wants = wants | low.contains(w)
    out = analysed.where(~F.coalesce(F.col("unreadable"), F.lit(False))) if "unreadable" in analysed.columns else analysed
    has = F.size("intents") > 0
    return out.select("question_id", "reference", "intents", F.least(F.greatest("hops", F.lit(1)), F.lit(3)).alias("hops"), "entities", (wants & has).alias("wants"), (low.contains("depend") & has).alias("directed"))


def _visible(time: str) -> Column:
    return F.col("reference").isNull() | is_available(F.col(time), F.col("reference"))


def _scored(paths: DataFrame) -> DataFrame:
    wanted = F.when(F.size("intents") == 0, 1.0).when(F.col("all_in"), ALL).when(F.col("some_in"), SOME).otherwise(NONE)
    src, dst = F.when(F.col("forward"), F.get("path", F.lit(0))).otherwise(F.get("path", F.lit(1))), F.when(F.col("forward"), F.get("path", F.lit(1))).otherwise(F.get("path", F.lit(0)))
    rel = F.get("relationships", F.lit(0))
    out_ = F.when(F.array_contains("entities", src), F.when(rel == "SUPPLIES", AWAY).when(rel == "DEPENDS_ON", TOWARDS).otherwise(1.0)).otherwise(1.0)
    in_ = F.when(F.array_contains("entities", dst) & (rel == "SUPPLIES"), TOWARDS).otherwise(1.0)
    direction = F.when(F.col("directed") & (F.size("edge_ids") == 1), out_ * in_).otherwise(1.0)
    company = F.when(F.col("wants") & F.col("end_company"), COMPANY).otherwise(1.0)
    return paths.withColumn("score", F.col("confidence") / (1 + 0.5 * (F.size("edge_ids") - 1)) * wanted * company * direction)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each question: score, fewer hops, a known time before none, evidence_id."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.size("edge_ids"), F.col("available_ts").isNull(), "evidence_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _prefixes(front: DataFrame, k: int) -> DataFrame:
    """Of the paths of a question that end at one node, those that can begin one of its ``k`` best.

    An edge goes on from paths that are alike (by seed, wanted relationships and known time) in the order of their confidence, unless
    it returns to one's nodes. Paths of one seed differ in one node before the last, so k through each of the best k + 1 do.
    """
    like = ["question_id", "node", F.get("path", F.lit(0)), "all_in", "some_in", F.col("available_ts").isNull()]
    order = (F.desc("confidence"), F.concat(F.array_join("edge_ids", ":"), F.lit(":")))
    before = F.element_at("path", -2)
    kept = front.withColumn("via_", before).withColumn("n_", F.row_number().over(Window.partitionBy(*like, "via_").orderBy(*order))).where(F.col("n_") <= k)
    leaders = kept.withColumn("lead_", F.sum((F.col("n_") == 1).cast("int")).over(Window.partitionBy(*like).orderBy(*order, "via_").rowsBetween(Window.unboundedPreceding, 0)))
    first = leaders.withColumn("lead_", F.min("lead_").over(Window.partitionBy(*like, "via_")))
    return first.where(F.col("lead_") <= k + 1).drop("via_", "n_", "lead_")


def _last_edges(reached: DataFrame, k: int) -> DataFrame:
    """Of the visible edges of a node that a question reached, those that can end one of its ``k`` best paths: k to each of the best k + 3 ends, since a path's three nodes are no ends."""
    like = ["question_id", "a", "in_", "b_company", F.col("ts").isNull()]
    order = (F.desc("c"), "edge_id")
    kept = reached.withColumn("n_", F.row_number().over(Window.partitionBy(*like, "b").orderBy(*order))).where(F.col("n_") <= k)
    led = kept.withColumn("lead_", F.sum((F.col("n_") == 1).cast("int")).over(Window.partitionBy(*like).orderBy(*order, "b").rowsBetween(Window.unboundedPreceding, 0)))
    return led.withColumn("lead_", F.min("lead_").over(Window.partitionBy(*like, "b"))).where(F.col("lead_") <= k + 3).drop("n_", "lead_")


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows(a, ...)`` once for each part of its node's edges."""
    return rows.join(sizes, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def top_paths(analysed: DataFrame, edges: DataFrame, k: int, nodes: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The ``k`` best paths of one to three edges from the entities of each analysed question, with ``rank``.

    ``edges(edge_id, src, dst, relationship, available_ts, confidence)`` with confidences from 0 to 1, and ``provenance_verified``
    where it is known. Walked both ways, never back to a node of the path. A question with a reference time sees only
    edges available then, and no node that is later (one without a time always); a question whose time
    cannot be read sees nothing. Depth is the question's ``hops``, 1 to 3.

    Rows: question_id, evidence_id (``edge:`` or ``path:`` and the edges' ids), path, edge_ids, relationships, hop_count,
    confidence (product), available_ts (latest), score (rounded; the order is by the exact one), rank. The result is that of listing all paths;
    there is no cap on candidates. ``keep`` settles what several steps read.
    """
    asked = keep(_asked(analysed))
    both = keep(two_way(edges, nodes))
    sizes = both.select("a", "parts", "best").distinct()
    deepest = asked.agg(F.max("hops")).first()[0] or 1
    info = ["question_id", "reference", "intents", "hops", "entities", "wants", "directed"]
    seeds = asked.select(*info, F.explode("entities").alias("a"))
    if nodes is not None:
        own = nodes.select(F.col("node_id").alias("a"), F.col("available_ts").alias("seed_ts"))
        seeds = seeds.join(own, "a").where(F.col("seed_ts").isNull() | _visible("seed_ts")).drop("seed_ts")
    seen = (F.col("b_ts").isNull() | _visible("b_ts")) & _visible("ts")
    in_ = F.array_contains("intents", F.col("relationship"))
    front = (
        _dealt(seeds, sizes).join(both.drop("parts", "best"), ["a", "salt"]).where(seen)
        .select(*info, F.array("a", "b").alias("path"), F.array("edge_id").alias("edge_ids"), F.array("relationship").alias("relationships"), F.col("c").alias("confidence"), F.col("ts").alias("available_ts"),
                F.col("b").alias("node"), F.col("b_company").alias("end_company"), in_.alias("all_in"), in_.alias("some_in"), "forward")
    )
    front = keep(front)
    once = Window.partitionBy("question_id", F.get("edge_ids", F.lit(0))).orderBy(F.get("path", F.lit(0)))  # an edge between two entities counts once
    single = front.withColumn("n_", F.row_number().over(once)).where("n_ = 1").drop("n_")
    best = keep(_best(_scored(single).withColumn("evidence_id", F.concat(F.lit("edge:"), F.get("edge_ids", F.lit(0)))), k))
    for level in range(2, deepest + 1):
        full = best.groupBy("question_id").agg(F.count("*").alias("n_"), F.min("score").alias("least_"))
        could = F.when(F.size("intents") == 0, 1.0).when(F.col("all_in"), ALL).otherwise(SOME) * F.when(F.col("wants"), COMPANY).otherwise(1.0)
        bound = F.col("confidence") * F.col("best") / (1 + 0.5 * (level - 1)) * could
        going = front.where(F.col("hops") >= level).withColumn("a", F.col("node")).join(sizes, "a").join(full, "question_id", "left")
        going = going.where(F.col("n_").isNull() | (F.col("n_") < k) | (bound * (1 + 1e-12) >= F.col("least_"))).drop("n_", "least_", "parts", "best")
        going = keep(_prefixes(going, k))
        reached = _dealt(going.select("question_id", "reference", "intents", "hops", "a").distinct(), sizes).join(both.drop("parts", "best"), ["a", "salt"]).where(seen).withColumn("in_", in_)
        last = F.col("hops") == level
        steps = _last_edges(reached.where(last), k)
        if level < deepest:
            steps = steps.unionByName(reached.where(~last))
        step = going.join(steps.select("question_id", "a", "b", "edge_id", "relationship", "ts", "c", "b_company", "in_"), ["question_id", "a"]).where(~F.array_contains("path", F.col("b")))
        front = step.select(
            *info, F.concat("path", F.array("b")).alias("path"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), F.concat("relationships", F.array("relationship")).alias("relationships"),
            (F.col("confidence") * F.col("c")).alias("confidence"), F.greatest("available_ts", "ts").alias("available_ts"), F.col("b").alias("node"), F.col("b_company").alias("end_company"),
            (F.col("all_in") & F.col("in_")).alias("all_in"), (F.col("some_in") | F.col("in_")).alias("some_in"), "forward",
        )
        if level < deepest:
            front = keep(front)
        found = _scored(front).withColumn("evidence_id", F.concat(F.lit("path:"), F.array_join("edge_ids", ":")))
        best = keep(_best(best.drop("rank").unionByName(found), k))
    return best.select("question_id", "evidence_id", "path", "edge_ids", "relationships", F.size("edge_ids").alias("hop_count"), "confidence", "available_ts", F.round("score", 6).alias("score"), "rank")
