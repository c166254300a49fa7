"""Answers: packages of evidence, checks of what a model returned, outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.time import is_available

ANSWER = "answer string, confidence double, evidence_ids array<string>, insufficient_evidence boolean, coverage string"
#: Keys an answer must have.
REQUIRED = ("answer", "confidence", "evidence_ids")


def package(analysed: DataFrame, evidence: DataFrame, gated: DataFrame) -> DataFrame:
    """One row a question: its ranked evidence as an array, sources and paths each once in order of rank, and the judgement. Evidence from after the question's time is left out."""
    seen = F.col("reference").isNull() | is_available(F.col("available_ts"), F.col("reference"))
    own = evidence.drop("reference").join(analysed.select("question_id", "reference"), "question_id").where(seen)
    item = F.struct("place", "evidence_id", "text", "document_id", "chunk_id", F.date_format("available_ts", "yyyy-MM-dd HH:mm:ss").alias("available_time"), F.array_join(F.coalesce("path", F.expr("cast(array() as array<string>)")), " > ").alias("route"))
    grouped = own.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    listed = lambda f: F.array_distinct(F.filter(F.transform("evidence", lambda e: e[f]), lambda x: F.coalesce(x != "", F.lit(False))))
    out = analysed.join(gated.select("question_id", "sufficient", "reason"), "question_id", "left").join(grouped, "question_id", "left")
    return out.withColumns({"sources": listed("document_id"), "paths": listed("route")})


def aligned(question: Column, multi_hop: Column, texts: Column) -> Column:
    """Whether cited texts speak of what is asked: a risk where the risks of suppliers are, a dependency in the right direction where one is."""
    low = F.lower(question)
    supplier_risk = multi_hop & low.rlike("suppl(y|ies|iers?)") & low.rlike("risks?|affect")
    held = lambda p: F.exists(texts, lambda t: F.coalesce(F.lower(t).rlike(p), F.lit(False)))
    return (~supplier_risk | held(r"has_risk|affected_by|risk")) & (~low.contains("depend") | held(r"--\[(depends_on|supplies)\]-->"))


def validate(outputs: DataFrame, packages: DataFrame) -> DataFrame:
    """``(question_id, is_valid, errors, cited, temporal_valid, provenance_complete)`` of ``outputs(question_id, raw)``.

    Checks in order: a JSON object; the required keys; a refusal where evidence is insufficient; an answer; a
    confidence from 0 to 1; ids as a list; known ids; an id for every answer that is no refusal; no cited
    evidence from the future; alignment. Missing origins only lower ``provenance_complete``.
    """
    rows = outputs.join(packages, "question_id")
    is_object = F.coalesce(F.trim("raw").rlike(r"(?s)^\{.*\}$") & (F.get_json_object("raw", "$") != ""), F.lit(False))
    got = F.from_json("raw", ANSWER)
    rows = rows.withColumns({"object_": is_object, "a": F.when(is_object, got), "keys_": F.coalesce(F.json_object_keys(F.when(is_object, F.col("raw"))), F.expr("cast(array() as array<string>)"))})
    none = F.expr("cast(array() as array<string>)")
    cited = F.coalesce("a.evidence_ids", none)
    items = F.coalesce("evidence", F.expr("cast(array() as array<struct<place:int,evidence_id:string,text:string,document_id:string,chunk_id:string,available_time:string,route:string>>)"))
    known = F.transform(items, lambda e: e["evidence_id"])
    refusal = F.coalesce("a.insufficient_evidence", F.lit(False)) | T.is_refusal(F.col("a.answer"))
    used = F.filter(items, lambda e: F.array_contains(cited, e["evidence_id"]))
    future = F.exists(used, lambda e: F.col("reference").isNotNull() & ~is_available(e["available_time"].try_cast("timestamp_ntz"), F.col("reference")))
    ids_listed = F.coalesce(F.get_json_object("raw", "$.evidence_ids").startswith("["), F.lit(True))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("keys_"))
    tests = (
        ("fields", F.size(missing) > 0),
        ("unrefused", ~F.coalesce("sufficient", F.lit(False)) & ~refusal),
        ("answer", (F.coalesce(F.trim("a.answer"), F.lit("")) == "") & ~refusal),
        ("confidence", ~F.coalesce(F.col("a.confidence").between(0, 1), F.lit(False))),
        ("id_list", ~ids_listed),
        ("unknown_ids", F.size(F.array_except(cited, known)) > 0),
        ("uncited", ~refusal & (F.size(cited) == 0)),
        ("future", future),
        ("alignment", ~refusal & ~F.coalesce(aligned(F.col("question"), F.col("multi_hop"), F.transform(used, lambda e: e["text"])), F.lit(False))),
    )
    errors = F.when(~F.col("object_"), F.array(F.lit("json"))).otherwise(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])))
    whole = F.forall(used, lambda e: e["document_id"].isNotNull() & e["chunk_id"].isNotNull() & e["available_time"].isNotNull())
    return rows.select("question_id", (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), cited.alias("cited"), (~future).alias("temporal_valid"), whole.alias("provenance_complete"))


def failure_mode(answerable: Column, refused: Column, f1: Column, exact: Column, retrieved: Column, in_context: Column, linked: Column, hops: Column, path_accuracy: Column, reason: Column, sufficient: Column) -> Column:
    """The principal failure of a question; the two outcomes of unanswerable ones."""
    return (
        F.when(~answerable, F.when(refused, "CORRECT_REFUSAL").otherwise("UNGROUNDED_HALLUCINATION"))
        .when(~refused & ((f1 >= 0.20) | (exact > 0)), "NONE_SUCCESS")
        .when(~retrieved, F.when(linked, "EVIDENCE_NOT_RETRIEVED").otherwise("ENTITY_LINKING_FAILURE"))
        .when(~in_context, "EVIDENCE_RANKED_TOO_LOW")
        .when((hops > 1) & (path_accuracy == 0) & (reason == "hops"), "GRAPH_PATH_FAILURE")
        .when(~sufficient, "SUFFICIENCY_GATE_FALSE_REFUSAL")
        .otherwise("GENERATOR_FAILURE")
    )


def prompt(packages: DataFrame, limit: int = 8) -> DataFrame:
    """``(question_id, system, user)``: what a model is given, with at most ``limit`` items of 700 characters."""
    system = "Answer from the evidence only. Reply with a JSON object of answer, confidence, evidence_ids, coverage."
    lines = F.transform(F.slice(F.coalesce("evidence", F.expr("cast(array() as array<struct<place:int,evidence_id:string,text:string,document_id:string,chunk_id:string,available_time:string,route:string>>)")), 1, limit), lambda e: F.concat(F.lit("["), e["evidence_id"], F.lit("] "), T.truncate(F.coalesce(e["text"], F.lit("")), 700)))
    return packages.select("question_id", F.lit(system).alias("system"), F.concat_ws("\n", F.concat(F.lit("Question: "), F.col("question")), F.array_join(lines, "\n")).alias("user"))


def generate(prompts: DataFrame, client: Callable[[str, str], str]) -> DataFrame:
    """``(question_id, raw)``: a client ``(system, user) -> text`` called for each row on the workers; an error becomes a refusal, so one bad call loses no batch."""
    key = prompts.schema["question_id"].dataType.simpleString()

    def run(batches):
        import json

        import pyarrow as pa

        for b in batches:
            out = []
            for system, user in zip(b.column("system").to_pylist(), b.column("user").to_pylist(), strict=True):
                try:
                    out.append(client(system, user))
                except Exception as e:  # noqa: BLE001  whatever a client raises
                    out.append(json.dumps({"answer": "Insufficient evidence", "confidence": 0.0, "evidence_ids": [], "insufficient_evidence": True, "error": str(e)}))
            yield pa.RecordBatch.from_arrays([b.column("question_id"), pa.array(out, pa.string())], names=["question_id", "raw"])

    return prompts.select("question_id", "system", "user").mapInArrow(run, f"question_id {key}, raw string")
