"""Work is dealt out and grows with the tables."""

import pytest
from pyspark.sql import functions as F

from asofworks.functions import text as T
from asofworks.operators import analysis, asof, provenance
from asofworks.plans import catalogue, evidence, graph, questions
from asofworks.streaming import ingest

SF = "/root/testdata/sf0.001"


def tasks(rows):
    """In how many parts a result is worked out."""
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("name", ["entity_linking", "link_entities", "question_analysis", "hop_depth", "question_type", "balanced_evidence", "periods_as_of", "fisher_exact"])
def test_questions_of_one_file_are_dealt_out(spark, name):
    """One small file of short rows is no reason to analyse them all in one task."""
    assert tasks(catalogue.QUERIES[name](spark, SF)) > 2


def test_gates_judge_questions_dealt_out(spark):
    assert tasks(evidence.analysed(spark, SF)) > 2


def test_linking_reads_questions_once(spark):
    """Pieces of a question come together in one grouping, not in joins of tables of all questions."""
    q = spark.createDataFrame([(1, "Does NVIDIA Corp supply TSMC?"), (2, None), (3, "Nothing")], "question_id int, question string")
    terms = spark.createDataFrame([("nvidia", "company:NVDA"), ("tsmc", "company:TSM")], "term string, node_id string")
    linked = analysis.link_entities(q, terms)
    assert {r.question_id: r.entities for r in linked.collect()} == {1: ["company:NVDA", "company:TSM"], 2: [], 3: []}
    assert linked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_paragraphs_keep_their_digits(spark):
    """A paragraph is trimmed of blanks, not of the digits of its place."""
    rows = spark.createDataFrame([("0997 | a 0\n 1219 b1 \n\n 2",)], "t string")
    got = rows.select(T.paragraphs(F.col("t"), "\n").alias("p"), T.pack_paragraphs(F.col("t"), pattern="\n").alias("c")).first()
    assert got.p == ["0997 | a 0", "1219 b1", "2"] and got.c == ["0997 | a 0\n\n1219 b1\n\n2"]


def test_phrases_are_looked_for_only_where_their_term_is(spark):
    """A text is not searched for eight phrases of a term that it lacks."""
    edges = spark.createDataFrame([("e", "company:A", "company:B", "HAS_RISK", "doc:sec:1", "1")], "edge_id string, src string, dst string, relationship string, document_id string, chunk_id string")
    chunks, issuers = spark.createDataFrame([("1", "alpha risk, beta")], "chunk_id string, text string"), spark.createDataFrame([("doc:sec:1", "C")], "document_id string, issuer string")
    terms = spark.createDataFrame([("company:A", ["alpha"]), ("company:B", ["beta"])], "node_id string, terms array<string>")
    got = provenance.label_edges(edges, chunks, issuers, terms)
    assert got.first().attribution_status == "verified_cross_company"
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN Contains(low_" in plan


def test_equal_questions_are_worked_out_once(spark):
    """Customers ask few different questions: each text is analysed once, and every question gets what is said of its text."""
    rows = [(1, "Does NVIDIA Corp supply TSMC?"), (2, None), (3, "="), (4, "Does NVIDIA Corp supply TSMC?"), (5, None), (6, "")]
    q = spark.createDataFrame(rows, "question_id long, question string")
    terms = spark.createDataFrame([("nvidia", "company:NVDA"), ("tsmc", "company:TSM")], "term string, node_id string")
    seen = []
    got = analysis.by_text(q, lambda texts: seen.append(texts) or analysis.analyse(texts, terms))
    assert seen[0].count() == 4
    assert {str(r) for r in got.collect()} == {str(r) for r in analysis.analyse(q, terms).select(got.columns).collect()}


def test_evidence_of_one_file_is_dealt_out(spark):
    assert tasks(evidence._evidence(spark, SF)) > 2


def test_equal_questions_are_searched_and_walked_once(spark):
    """Work on the stated questions gets each text once, and its rows come back for every question."""
    stated, seen = questions.questions(spark, SF).where("question_id % 20 = 0"), []
    got = questions._each(spark, SF, lambda asked: seen.append(asked.count()) or asked.select("question_id", "entities"))
    assert seen == [stated.select("question").distinct().count()]
    assert sorted(r[0] for r in got.select("question_id").collect()) == sorted(r[0] for r in stated.select("question_id").collect())


def test_degrees_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    """Short rows are not gathered by their bytes, and both ends of an edge are taken in one pass."""
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "c")], "src string, dst string")
    got = asof.degrees(edges)
    assert {tuple(r) for r in got.collect()} == {("a", 2, 0, 2), ("b", 0, 1, 1), ("c", 1, 2, 3)}
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(graph, "LINES", 100)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    assert f"], {n}" in catalogue.QUERIES["node_degree"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def through_driver(rows):
    """The joins of a result, as it was run, that sent one side whole through the driver."""
    rows.collect()
    return [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def test_questions_are_not_sent_through_the_driver(spark):
    """Small files of many short rows look small; only the terms of nodes may be sent whole."""
    q = spark.createDataFrame([(1, "Does NVIDIA Corp supply TSMC?"), (2, None), (3, "Does NVIDIA Corp supply TSMC?")], "question_id long, question string")
    assert through_driver(analysis.by_text(q, lambda texts: texts)) == []
    for name in ("gate_hops_only", "gate_strict"):
        sent = through_driver(catalogue.QUERIES[name](spark, SF))
        assert not [line for line in sent if "[node_" not in line]


def test_edges_of_chains_are_worked_out_once(spark):
    """Eight steps read them: what they are made of is not in the judgement's plan."""
    plan = catalogue.QUERIES["gate_hops_only"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def shuffled(spark):
    """Bytes that all tasks so far wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    held = sc.statusStore().executorList(False)
    return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))


def ingested(spark, batch, folder):
    ingest.ingest_batch(batch, 0, folder)
    return {r.doc_id: (r.status, r.n_chunks) for r in ingest.manifest(spark, folder).collect()}


def test_ingested_texts_stay_where_they_lie(spark, tmp_path):
    """Only ids are shuffled, and the texts of repeated ids; not the texts that come once."""
    noise = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.sha2(F.concat_ws("-", "id", i).cast("binary"), 256)), "")
    spark.range(400, numPartitions=8).select(F.col("id").alias("doc_id"), noise.alias("text")).write.parquet(str(tmp_path / "in"))
    docs = spark.read.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    batch = docs.union(docs.where("doc_id in (3, 4, 5)").withColumn("text", F.when(F.col("doc_id") < 5, F.substring("text", 1, 9))))
    before = shuffled(spark)
    assert ingested(spark, batch, str(tmp_path / "out")) == {i: ("completed", 1 if i in (3, 4) else 4) for i in range(400)}
    assert shuffled(spark) - before < 400 * 6400 / 10


@pytest.mark.parametrize("apart", [0, 2**20])
def test_ingestion_takes_the_least_text_that_is_there(spark, tmp_path, monkeypatch, apart):
    """As in SQL, a null is no text; the same whether few ids are repeated or too many to be sent around."""
    monkeypatch.setattr(ingest, "APART", apart)
    rows = [(1, None), (1, "b" * 2000), (1, "c"), (2, None), (2, None), (3, ""), (3, "x"), (4, "y"), (None, "z"), (5, None), (6, "k"), (6, "k")]
    batch = spark.createDataFrame(rows, "doc_id long, text string")
    assert ingested(spark, batch, str(tmp_path)) == {1: ("completed", 2), 2: ("failed", 0), 3: ("failed", 0), 4: ("completed", 1), 5: ("failed", 0), 6: ("completed", 1)}
    ingest.ingest_batch(spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (4, "w"), (4, "v"), (7, None)], "doc_id long, text string"), 1, str(tmp_path))
    assert sorted((r.doc_id, r.chunk_index, r.text[0], len(r.text)) for r in ingest.chunks(spark, str(tmp_path)).collect()) == [(1, 0, "b", 1800), (1, 1, "b", 450), (2, 0, "a", 1), (4, 0, "y", 1), (6, 0, "k", 1)]
    assert {r.doc_id: r.status for r in ingest.manifest(spark, str(tmp_path)).collect()} == {1: "completed", 2: "completed", 3: "failed", 4: "completed", 5: "failed", 6: "completed", 7: "failed"}


def test_texts_of_one_part_are_dealt_out(spark, tmp_path):
    """A file with one large row group is read by one task, but not cut by one."""
    batch = spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few texts would be put together again
    try:
        ingest.ingest_batch(batch, 0, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "chunks" / "batch_id=0").glob("part-*"))) > 2
    assert ingest.chunks(spark, str(tmp_path)).count() == 40 * 4
