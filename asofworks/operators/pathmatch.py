"""Expected paths against retrieved ones: directed edges, names that contain each other, connected hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = "array<struct<source:string,relationship:string,target:string>>"


def token(c: Column) -> Column:
    """A node's name or id for comparison: lower-case, without underlines, spaces, colons and hyphens."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), "[_ :-]", "")


def _alike(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def edge_matches(got: Column, wanted: Column) -> Column:
    """Whether a retrieved edge is a wanted one, in its direction.

    Relationships are equal but for case (a wanted edge without one takes any). An edge whose source holds the wanted target and whose target
    holds the wanted source is the reverse and matches nothing; else both ends must be alike (one name within the other). A
    wanted edge without target takes any.
    """
    s, t, ws, wt = token(got["source"]), token(got["target"]), token(wanted["source"]), token(wanted["target"])
    open_ = wanted["target"].isNull()
    rel = (F.coalesce(wanted["relationship"], F.lit("")) == "") | (F.upper(got["relationship"]) == F.upper(wanted["relationship"]))
    reverse = ~open_ & (s != "") & (t != "") & (ws != "") & (wt != "") & s.contains(wt) & t.contains(ws)
    return F.coalesce(rel & ~reverse & _alike(s, ws) & (open_ | _alike(t, wt)), F.lit(False))


def path_matches(got: Column, wanted: Column) -> Column:
    """Whether a retrieved path (an array of edges) holds the wanted one.

    Each wanted edge takes the first edge that matches it; of several, the target of each must be alike to the source of the next.
    """
    firsts = F.transform(wanted, lambda w: F.get(F.filter(got, lambda g: edge_matches(g, w)), F.lit(0)))
    linked = F.forall(F.sequence(F.lit(1), F.size(wanted) - 1), lambda i: _linked(F.get(firsts, i - 1)["target"], F.get(firsts, i)["source"]))
    found = F.forall(firsts, lambda e: e.isNotNull())
    return (F.size(got) > 0) & (F.size(wanted) > 0) & F.coalesce(found, F.lit(False)) & (F.when(F.size(wanted) > 1, F.coalesce(linked, F.lit(False))).otherwise(True))


def _linked(a: Column, b: Column) -> Column:
    x, y = token(a), token(b)
    return x.contains(y) | y.contains(x)


def match_paths(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``(question_id, n_wanted, n_retrieved, matched, first_rank)`` for every expected path.

    ``expected(question_id, edges)`` and ``retrieved(question_id, rank, edges)`` meet by question; a path matches if any retrieved one holds it. A
    question without retrieved paths has none. Repeated expected paths of a question count once.
    """
    wanted = expected.groupBy("question_id", "edges").count().drop("count").withColumnRenamed("edges", "wanted")
    joined = wanted.join(retrieved.select("question_id", "rank", F.col("edges").alias("got")), "question_id", "left")
    hit = F.coalesce(path_matches(F.col("got"), F.col("wanted")), F.lit(False))
    out = joined.withColumn("hit", hit).groupBy("question_id", "wanted").agg(F.count("got").alias("n_retrieved"), F.max("hit").alias("matched"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"))
    return out.select("question_id", F.size("wanted").alias("n_wanted"), "n_retrieved", "matched", "first_rank")


def path_accuracy(matches: DataFrame) -> DataFrame:
    """Questions, and the share of them of which any expected path is matched."""
    per = matches.groupBy("question_id").agg(F.max("matched").alias("m"))
    return per.agg(F.count("*").alias("n_questions"), F.round(F.coalesce(F.avg(F.col("m").cast("double")), F.lit(0.0)), 6).alias("accuracy"))
