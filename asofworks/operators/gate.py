"""The sufficiency gate: whether a question's evidence covers what it asks for, over whole tables.

Checks run in a fixed order and the first that fails is the reason: number, times, origin, entities,
relationships (with chains for questions about the risks of suppliers or landlords), depth.
Chains are joins of a question's evidence edges on the terms of their nodes, so names and aliases
connect, and no list of edges is searched pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.time import is_available
from .analysis import REGULATORS, any_of, large, names_documents

# Labels of an attribution that supports nothing, words of names that say nothing, kinds of nodes that may be missing beside companies.
UNSUPPORTED = ("unsupported_cross_company", "unsupported_cross_company_risk", "conflicting_attribution", "missing_provenance")
NAME_STOP = ("the", "and", "inc", "corp", "corporation", "ltd", "company", "co", "llc", "group", "holdings")
CONCEPTS = ("risk:", "financialmetric:", "product:", "document:", "event:")
# Words for relationships in texts.
SAID = {
    "SUPPLIES": ("suppl", "vendor", "provide", "furnish", "foundry", "foundries", "utilize", "source"),
    "MANUFACTURES": ("manufactur", "produc", "build", "assembl", "fabricat", "operat", "develop"),
    "HAS_RISK": ("risk", "advers", "threat", "hazard", "vulnerab"),
    "AFFECTED_BY": ("affect", "impact", "subject to", "disrupt", "proceeding", "enforcement", "order", "action", "investigation"),
    "DEPENDS_ON": ("depend", "reli", "subject to", "utilize", "foundry"),
    "PARTNERS_WITH": ("partner", "collaborat", "joint venture", "alliance"),
    "COMPETES_WITH": ("compet", "rival"),
    "ACQUIRED": ("acquir", "merg", "bought", "acquisition"),
    "LOCATED_IN": ("headquarter", "locat", "operat in", "facility"),
}
# Relationships of the chains, and the words that ask for them or speak of them.
RISKS, PARTNERS = ("HAS_RISK", "AFFECTED_BY"), ("PARTNERS_WITH", "SUPPLIES", "DEPENDS_ON")
LEASES = ("LEASES_TO", "LEASES", "PARTNERS_WITH", "SUPPLIES", "DEPENDS_ON")
ASKS_SUPPLIER, ASKS_RISK, ASKS_LANDLORD = ("supply", "supplies", "supplier", "suppliers"), ("risk", "risks", "affect", "affects", "affected"), ("landlord", "leasing")
SAYS_SUPPLIER, SAYS_RISK, SAYS_LANDLORD = ("suppl", "vendor", "foundry", "manufactur"), ("risk", "advers", "threat", "disrupt", "shortage"), ("landlord", "lease", "leasing", "datacenter", "data center")
COMPOUND = ("supplier's supplier", "customer's customer", "chain of suppliers", "indirectly", "through its supplier", "through a partner", "3-hop", "three hops", "indirectly connected")
# Words by which a question asks for a regulator's action, and a text speaks of one.
ASKS_ACTION = ("regulatory", "action", "investigation", "inquiries", "inquiry", "proceeding", "order", "scrutiny", "penalty", "fine", "settlement")
SAYS_ACTION = (
    "regulatory", "regulation", "regulator", "investigation", "inquiry", "inquiries", "proceeding", "proceedings", "action", "actions", "consent order", "litigation", "penalty",
    "penalties", "fine", "fines", "compliance", "settlement", "enforcement", "order", "dsa", "gdpr", "coppa",
)
ENTITY_MODES, RELATIONSHIP_MODES, HOP_MODES = ("strict", "partial", "disabled"), ("strict", "textual", "disabled"), ("strict", "adaptive", "soft", "disabled")
#: Evidence of a question that chains, and that texts of chains, are looked for in.
CHAIN_RANK, TEXT_RANK = 10, 5
#: Columns of evidence that may be missing.
EVIDENCE = {
    "text": "string", "document_id": "string", "chunk_id": "string", "available_ts": "timestamp_ntz", "hop_count": "int", "path": "array<string>", "relationships": "array<string>", "source_company": "string",
    "provenance_verified": "boolean", "attribution_status": "string", "graph_edges": "array<struct<source:string,relationship:string,target:string>>",
}

_none = lambda kind="string": F.expr(f"cast(array() as array<{kind}>)")


def _bare(node: Column) -> Column:
    return F.regexp_extract(F.lower(node), "^(?:[^:]*:)?(.*)$", 1)


def entity_terms(nodes: DataFrame) -> DataFrame:
    """``(node_id, terms, parts)`` of ``nodes(node_id, name, aliases)``: what a node is called, and the words of its name that say something."""
    name = F.lower(F.trim("name"))
    bare = F.regexp_replace(name, r"[ ,]+(" + "|".join(T.SUFFIXES) + r")\.?$", "")
    called = F.concat(F.array(F.lower("node_id"), _bare(F.col("node_id")), name, bare), F.transform(F.coalesce("aliases", _none()), F.lower))
    words = F.filter(F.split(name, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*NAME_STOP))
    clean = lambda a: F.filter(F.array_distinct(F.array_compact(a)), lambda t: t != "")
    return nodes.select(F.lower("node_id").alias("node_id"), clean(called).alias("terms"), clean(words).alias("parts"))


def _with_terms(rows: DataFrame, terms: DataFrame, node: str, out: str, parts: bool = False) -> DataFrame:
    """``rows`` with the terms of a node column: its own id and bare id, the table's, and those of a regulator."""
    held = terms.select(F.col("node_id").alias("node_"), F.col("terms").alias("t_"), F.col("parts").alias("p_"))
    joined = rows.withColumn("node_", F.lower(node)).join(held, "node_", "left")
    official = F.create_map(*[x for r, names in REGULATORS.items() for x in (F.lit(r.lower()), F.array(*map(F.lit, names)))])
    own = F.concat(F.array("node_", _bare(F.col("node_"))), F.coalesce("t_", _none()), F.coalesce(F.try_element_at(official, F.col("node_")), _none()))
    if parts:
        own = F.concat(own, F.coalesce("p_", _none()))
    return joined.withColumn(out, F.array_distinct(own)).drop("node_", "t_", "p_")


def _filled(evidence: DataFrame) -> DataFrame:
    out = evidence
    for c, kind in EVIDENCE.items():
        out = out.withColumn(c, F.col(c).cast(kind) if c in evidence.columns else F.lit(None).cast(kind))
    for c in ("path", "relationships"):
        out = out.withColumn(c, F.coalesce(c, _none()))
    out = out.withColumn("graph_edges", F.coalesce("graph_edges", _none("struct<source:string,relationship:string,target:string>")))
    usable = F.coalesce("provenance_verified", F.lit(True)) & ~F.coalesce(F.col("attribution_status").isin(*UNSUPPORTED), F.lit(False))
    return out.withColumn("low", F.lower(F.coalesce("text", F.lit("")))).withColumn("usable", usable)


def _says(low: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: low.contains(t))


def chain_edges(asked: DataFrame, evidence: DataFrame, terms: DataFrame) -> DataFrame:
    """The edges of each question's first evidence with the terms of both ends, and which ends are what the question is about."""
    target = _with_terms(asked.select("question_id", F.explode("entities").alias("e")), terms, "e", "own")
    target = target.groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("target"))  # a question's few entities
    rows = evidence.where(F.col("rank") <= CHAIN_RANK).select("question_id", "evidence_id", F.posexplode("graph_edges").alias("pos", "g")).select("question_id", "evidence_id", "pos", F.col("g.source").alias("src"), F.upper("g.relationship").alias("rel"), F.col("g.target").alias("dst"))
    rows = rows.where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "") & (F.coalesce("rel", F.lit("")) != ""))
    rows = _with_terms(_with_terms(rows, terms, "src", "src_terms"), terms, "dst", "dst_terms").join(large(target), "question_id")
    is_target = lambda c: F.arrays_overlap(F.array(F.lower(F.trim(c)), _bare(F.trim(c))), "target")
    return rows.withColumns({"src_target": is_target("src"), "dst_target": is_target("dst")}).drop("target")


def _meet(left: DataFrame, right: DataFrame, by: list[str], ends: tuple[str, str]) -> DataFrame:
    """Pairs of edges whose given ends share a term: an equi-join on the terms."""
    one = left.withColumn("term_", F.explode(ends[0]))
    two = right.select(*by, F.col("evidence_id").alias("evidence_2"), F.col("pos").alias("pos_2"), F.explode(ends[1]).alias("term_"))
    return one.join(large(two), [*by, "term_"]).drop("term_")


def supplier_risk_chains(edges: DataFrame) -> DataFrame:
    """``(question_id, chain, n_supply, n_risk)``: whether a supplier of what the question is about has a risk of its own, within one path or across all edges."""
    supply = edges.where((F.col("rel") == "SUPPLIES") & F.col("dst_target") & ~F.col("src_target"))
    any_risk = edges.where(F.col("rel").isin(*RISKS))
    risk = any_risk.where(~F.col("src_target"))
    ends = ("src_terms", "src_terms")
    within = _meet(supply, any_risk, ["question_id"], ends).where((F.col("evidence_id") == F.col("evidence_2")) & (F.col("pos") != F.col("pos_2")))
    found = _meet(supply, risk, ["question_id"], ends).select("question_id").union(within.select("question_id")).distinct().withColumn("chain", F.lit(True))
    is_supply = (F.col("rel") == "SUPPLIES") & F.col("dst_target") & ~F.col("src_target")
    counts = edges.groupBy("question_id").agg(F.count_if(is_supply).alias("n_supply"), F.count_if(F.col("rel").isin(*RISKS) & ~F.col("src_target")).alias("n_risk"))
    return counts.join(large(found), "question_id", "left").withColumn("chain", F.coalesce("chain", F.lit(False)))


def landlord_chains(edges: DataFrame) -> DataFrame:
    """Questions with a chain of three: one that has a risk, its partner, and the partner's link to what the question is about; in one path or across all edges."""
    partner_here = F.col("rel").isin(*PARTNERS) & F.col("dst_target") & ~F.col("src_target")
    partner = edges.where(partner_here)
    lease = edges.where(~partner_here & F.col("rel").isin(*LEASES) & ~F.col("dst_target") & ~F.col("src_target"))
    any_risk = edges.where(F.col("rel").isin(*RISKS))
    linked = _meet(lease, partner, ["question_id"], ("dst_terms", "src_terms")).drop("evidence_2", "pos_2").distinct()
    across = _meet(linked, any_risk.where(~F.col("src_target")), ["question_id"], ("src_terms", "src_terms")).select("question_id")
    by = ["question_id", "evidence_id"]
    at = lambda k: edges.where(F.col("pos") == k).select(*by, *[F.col(c).alias(f"{c}_{k}") for c in ("pos", "src_terms", "dst_terms", "dst_target")])
    path = at(0).join(large(at(1)), by).join(large(at(2)), by).where(F.arrays_overlap("dst_terms_0", "src_terms_1") & F.arrays_overlap("dst_terms_1", "src_terms_2") & F.col("dst_target_2"))
    path = path.select(*by, F.col("pos_0").alias("pos"), F.col("src_terms_0").alias("src_terms"))
    within = _meet(path, any_risk, ["question_id"], ("src_terms", "src_terms")).select("question_id")
    return across.union(within).distinct()


def _coverage(asked: DataFrame, evidence: DataFrame, terms: DataFrame) -> DataFrame:
    """``(question_id, found, missing, direct)``: entities that some usable evidence speaks of, and whether one piece speaks of the first two companies (of the one, where there is one)."""
    corporate = F.filter("entities", lambda e: e.startswith("company:") | e.startswith("regulator:"))
    each = asked.select("question_id", F.lower("question").alias("q_"), F.size(corporate).alias("n_corporate"), corporate.alias("corporate"), F.explode("entities").alias("entity"))
    each = _with_terms(_with_terms(each, terms, "entity", "wide", parts=True), terms, "entity", "own")
    own = evidence.where("usable").select("question_id", "evidence_id", "low", F.upper("source_company").alias("company"), "path")
    rows = each.join(large(own), "question_id", "left")
    bare = _bare(F.col("entity"))
    issuer = F.coalesce((F.col("company") == F.upper(bare)) & (F.col("company") != ""), F.lit(False))
    mentioned = F.coalesce(_says(F.col("low"), F.col("wide")), F.lit(False))
    acts = ~F.col("entity").startswith("regulator:") | ~any_of(F.col("q_"), ASKS_ACTION) | any_of(F.coalesce("low", F.lit("")), SAYS_ACTION)
    on_path = F.coalesce(F.array_contains("path", F.col("entity")) | F.exists("path", lambda p: F.lower(p) == bare), F.lit(False)) & (issuer | mentioned | (F.coalesce("company", F.lit("")) == ""))
    covered = ((issuer | mentioned) & acts) | on_path
    place = F.array_position("corporate", F.col("entity"))
    spoken = F.coalesce(_says(F.col("low"), F.col("own")), F.lit(False)) | (issuer & (F.col("n_corporate") >= 2))
    rows = rows.withColumns({"covered": covered, "direct_": spoken & (place >= 1) & (place <= 2)})
    per = rows.groupBy("question_id", "entity").agg(F.max("covered").alias("covered")).groupBy("question_id")
    per = per.agg(F.array_sort(F.collect_list(F.when(F.col("covered"), F.col("entity")))).alias("found"), F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("entity")))).alias("missing"))
    pieces = rows.where("direct_").groupBy("question_id", "evidence_id", "n_corporate").agg(F.count("*").alias("n_")).where(F.col("n_") >= F.least(F.col("n_corporate"), F.lit(2)))
    return per.join(large(pieces.select("question_id").distinct().withColumn("direct", F.lit(True))), "question_id", "left")


def gate(analysed: DataFrame, evidence: DataFrame, terms: DataFrame | None = None, entity_mode: str = "strict", relationship_mode: str = "strict", hop_mode: str = "strict", enabled: bool = True, least: int = 1, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row a question: (question_id, sufficient, reason, missing_entities, missing_relationships, required_hops, max_hops, n_evidence, found).

    ``analysed`` is the analysis of :mod:`analysis`; ``evidence`` has question_id, rank, evidence_id and what is known of
    :data:`EVIDENCE`; ``terms`` comes from :func:`entity_terms`. Reasons, in order: ``count``, ``temporal`` (evidence from after the
    question's time, or a stated time that cannot be read), ``provenance``, then with ``enabled`` off ``disabled`` (sufficient), ``entity``,
    ``chain``, ``relationship``, ``hops``, ``sufficient``.

    Entities: ``strict`` wants all, ``partial`` one and half of several. Relationships: ``strict`` wants edges (one of the wanted kinds,
    and whole chains where a question of several hops asks for the risks of suppliers or landlords), ``textual`` is content with words.
    Hops: ``strict`` wants the depth, ``adaptive`` a chain or a direct statement instead, unless the question asks for an indirect
    link in so many words; ``soft`` wants nothing. ``keep`` settles the edges that chains are made of, which eight steps read.
    """
    for mode, known in ((entity_mode, ENTITY_MODES), (relationship_mode, RELATIONSHIP_MODES), (hop_mode, HOP_MODES)):
        if mode not in known:
            raise ValueError(f"{mode!r} is none of {known}")
    if terms is None:
        terms = analysed.sparkSession.createDataFrame([], "node_id string, terms array<string>, parts array<string>")
    unreadable = F.coalesce(F.col("unreadable"), F.lit(False)) if "unreadable" in analysed.columns else F.lit(False)
    asked = analysed.select("question_id", "question", "entities", "intents", "reference", "hops", "multi_hop", unreadable.alias("unreadable"))
    names = [c for c in ("question_id", "rank", "evidence_id", *EVIDENCE) if c in evidence.columns]
    ev = _filled(evidence.select(*names))
    joined = ev.join(large(asked.select("question_id", "intents", "reference")), "question_id")
    late = F.col("reference").isNotNull() & ~is_available(F.col("available_ts"), F.col("reference"))
    sourced = (F.coalesce("document_id", F.lit("")) != "") & ((F.coalesce("chunk_id", F.lit("")) != "") | F.col("available_ts").isNotNull())
    sourced = sourced & F.coalesce("provenance_verified", F.lit(True)) & (F.coalesce("attribution_status", F.lit("")) != "conflicting_attribution")
    rels = F.transform(F.concat("relationships", F.transform("graph_edges", lambda g: g["relationship"])), F.upper)
    said = F.create_map(*[x for r, words in SAID.items() for x in (F.lit(r), F.array(*map(F.lit, words)))])

    def has(rel: Column) -> Column:
        formal = F.exists(rels, lambda r: r.contains(F.upper(rel)))
        if relationship_mode != "textual":
            return formal
        return formal | _says(F.col("low"), F.concat(F.coalesce(F.try_element_at(said, F.upper(rel)), _none()), F.array(F.lower(rel))))

    early = F.col("rank") <= TEXT_RANK
    of = lambda *names: F.exists(rels, lambda r: reduce(Column.__or__, [r.contains(n) for n in names]))
    sums = joined.groupBy("question_id").agg(
        F.count("*").alias("n_evidence"), F.max(late).alias("late"), F.max(sourced).alias("sourced"), F.max(F.greatest(F.coalesce("hop_count", F.lit(1)), F.lit(1))).alias("max_hops"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("usable"), F.filter("intents", has))))).alias("held"),
        F.max(early & (any_of(F.col("low"), SAYS_SUPPLIER) | of("SUPPLIES"))).alias("says_supplier"), F.max(early & (any_of(F.col("low"), SAYS_RISK) | of(*RISKS))).alias("says_risk"),
        F.max(early & any_of(F.col("low"), SAYS_RISK)).alias("text_risk"), F.max(early & any_of(F.col("low"), SAYS_LANDLORD)).alias("says_landlord"),
    )
    low = F.lower("question")
    risky = F.col("multi_hop") & any_of(low, ASKS_RISK)
    asked = asked.withColumns({"by_supplier": risky & any_of(low, ASKS_SUPPLIER), "by_landlord": risky & any_of(low, ASKS_LANDLORD)})
    edges = keep(chain_edges(asked.where("by_supplier or by_landlord"), ev, terms))
    supplier = supplier_risk_chains(edges).select("question_id", F.col("chain").alias("supplier_chain"))
    landlord = landlord_chains(edges).withColumn("landlord_chain", F.lit(True))
    out = asked
    for part in (sums, _coverage(asked, ev, terms), supplier, landlord):
        out = out.join(large(part), "question_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    corporate = F.exists("entities", lambda e: e.startswith("company:"))
    concept = lambda e: reduce(Column.__or__, [e.startswith(c) for c in CONCEPTS])
    absent = F.filter(F.coalesce("missing", _none()), lambda e: ~(concept(e) & corporate))
    of_regulators = F.filter("entities", lambda e: e.startswith("regulator:"))
    one_will_do = (F.size(of_regulators) >= 2) & low.contains(" or ") & F.exists(of_regulators, lambda r: ~F.array_contains(F.coalesce("missing", _none()), r))
    absent = F.when(one_will_do, F.filter(absent, lambda e: ~e.startswith("regulator:"))).otherwise(absent)
    absent = F.when(names_documents(F.col("question")), F.filter(absent, lambda e: e != "regulator:SEC")).otherwise(absent)
    out = out.withColumns({"missing_entities": absent, "missing_relationships": F.array_except("intents", F.coalesce("held", _none()))})
    n, gone = F.size("entities"), F.size("missing_entities")
    entity = {"strict": gone > 0, "partial": (n > 0) & ((n == gone) | ((n > 1) & ((n - gone) < n / 2))), "disabled": F.lit(False)}[entity_mode]
    chain = {
        "strict": (F.col("by_supplier") & ~flag("supplier_chain")) | (F.col("by_landlord") & ~flag("landlord_chain")),
        "textual": (F.col("by_supplier") & ~(flag("says_supplier") & flag("says_risk"))) | (F.col("by_landlord") & ~(flag("says_landlord") & flag("text_risk"))),
        "disabled": F.lit(False),
    }[relationship_mode]
    relationship = (F.size("intents") > 0) & (F.size("missing_relationships") == F.size("intents")) if relationship_mode != "disabled" else F.lit(False)
    deep = ~F.col("multi_hop") | (F.col("max_hops") >= F.col("hops"))
    direct = F.when(F.col("by_supplier"), flag("supplier_chain")).when(F.col("by_landlord"), flag("landlord_chain")).when(any_of(low, COMPOUND), False).otherwise(flag("direct"))
    hops = {"strict": ~deep, "adaptive": ~(deep | direct), "soft": F.lit(False), "disabled": F.lit(False)}[hop_mode]
    count = F.coalesce("n_evidence", F.lit(0))
    reason = F.when(F.col("unreadable"), "temporal").when(count < least, "count").when(flag("late"), "temporal").when(~flag("sourced"), "provenance")
    reason = reason.when(F.lit(not enabled), "disabled").when(entity, "entity").when(chain, "chain").when(relationship, "relationship").when(hops, "hops").otherwise("sufficient")
    return out.select(
        "question_id", reason.isin("sufficient", "disabled").alias("sufficient"), reason.alias("reason"), "missing_entities", "missing_relationships", F.col("hops").alias("required_hops"),
        F.coalesce("max_hops", F.lit(0)).alias("max_hops"), count.alias("n_evidence"), F.coalesce("found", _none()).alias("found"),
    )
