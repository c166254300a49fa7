"""Building a knowledge graph from extracted records, events and companies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids
from ..functions import text as T

# The vocabularies of the graph.
NODE_TYPES = ("Company", "Person", "Product", "Supplier", "Competitor", "Event", "Risk", "Country", "FinancialMetric", "Document", "NewsArticle")
RELATIONSHIPS = ("SUPPLIES", "MANUFACTURES", "DEPENDS_ON", "COMPETES_WITH", "PARTNERS_WITH", "INVESTED_IN", "ACQUIRED", "LOCATED_IN", "AFFECTED_BY", "CAUSED", "ANNOUNCED", "HAS_RISK", "MENTIONED_IN")
EVENT_RELATIONSHIPS = {"market": "HAS_MARKET_EVENT", "news": "HAS_NEWS", "sec_filing": "FILED", "macro": "AFFECTED_BY"}

EXTRACTION = (
    "document_id string, chunk_id string, chunk_index int, "
    "entities array<struct<entity_id: string, entity_type: string, name: string, canonical_name: string, confidence: double>>, "
    "relations array<struct<source_entity_id: string, target_entity_id: string, relationship: string, confidence: double, event_time: string, available_time: string>>, "
    "available_time string"
)


def node_type(c: Column) -> Column:
    """The vocabulary's spelling of a type; null if it has none."""
    table = F.create_map(*[F.lit(x) for t in NODE_TYPES for x in (t.lower(), t)])
    return F.try_element_at(table, F.lower(F.trim(c)))


def node_type_or_fail(c: Column) -> Column:
    """The vocabulary's spelling of a type; a type it lacks fails the query."""
    return F.coalesce(node_type(c), F.raise_error(F.concat(F.lit("Unknown node type: "), F.coalesce(c, F.lit("null")))).cast("string"))


def is_relationship(c: Column) -> Column:
    return F.coalesce(c.isin(*RELATIONSHIPS), F.lit(False))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order (which ends in something unique)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def semantic_node_id(kind: Column, name: Column, given: Column | None = None, ticker: Column | None = None) -> Column:
    """``company:TICKER`` of a company of the universe, else the given id, else a hash of type and normalised name."""
    low = F.lower(kind)
    own = T.stable_id(low, T.normalize_entity_name(name))
    given = F.nullif(F.trim(given), F.lit("")) if given is not None else F.lit(None).cast("string")
    ticker = ticker if ticker is not None else F.lit(None).cast("string")
    return F.coalesce(F.when((low == "company") & ticker.isNotNull(), F.concat(F.lit("company:"), ticker)), given, own)


def entities(extracted: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """``(seq, chunk_id, document_id, available_time, raw_id, node_id, node_type, name, canonical_name, confidence)`` of all extracted entities.

    ``extracted`` has the columns of :data:`EXTRACTION` and ``seq``, the order of the chunks. Entities of unknown type or
    without name are dropped. ``universe(ticker, company)`` gives companies their tickers, by name or name without legal suffix.
    """
    rows = extracted.select("seq", "chunk_id", "document_id", "available_time", F.posexplode("entities").alias("pos", "e"))
    name = F.coalesce(F.nullif(F.trim("e.canonical_name"), F.lit("")), F.trim("e.name"))
    rows = rows.select("seq", "pos", "chunk_id", "document_id", "available_time", F.col("e.entity_id").alias("raw_id"), node_type(F.col("e.entity_type")).alias("node_type"), F.trim("e.name").alias("name"), name.alias("canonical_name"), F.col("e.confidence").alias("confidence"))
    rows = rows.where("node_type is not null and coalesce(canonical_name, '') <> ''")
    if universe is None:
        rows = rows.withColumn("ticker", F.lit(None).cast("string"))
    else:
        keys = universe.select("ticker", F.explode(F.array_distinct(F.array(T.normalize_text(F.col("company")), T.strip_suffix(F.col("company")), F.lower("ticker")))).alias("key_"))
        keys = keys.where("key_ <> ''").groupBy("key_").agg(F.min("ticker").alias("ticker"))
        rows = rows.withColumn("key_", T.strip_suffix(F.col("canonical_name"))).join(keys, "key_", "left").drop("key_")
    return rows.withColumn("node_id", semantic_node_id(F.col("node_type"), F.col("canonical_name"), F.col("raw_id"), F.col("ticker"))).drop("ticker")


def nodes(found: DataFrame) -> DataFrame:
    """One row a node: the first name and type, the earliest time, documents and chunks each once in order."""
    listed = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pos", F.col(c).alias("x")))), lambda s: s["x"]))
    first = F.min(F.struct("seq", "pos", "node_type", "canonical_name")).alias("f")
    out = found.groupBy("node_id").agg(first, F.min("available_time").alias("available_time"), listed("document_id").alias("document_ids"), listed("chunk_id").alias("chunk_ids"))
    return out.select("node_id", F.col("f.node_type").alias("node_type"), F.col("f.canonical_name").alias("name"), "available_time", "document_ids", "chunk_ids")


def aliases(found: DataFrame) -> DataFrame:
    """``(chunk_id, key, node_id, seq, pos)``: the words by which relations of a chunk may name an entity."""
    said = F.array_distinct(F.array_compact(F.array("raw_id", "node_id", "canonical_name", "name", F.lower("canonical_name"), F.lower("name"))))
    return found.select("chunk_id", F.explode(said).alias("key"), "node_id", "seq", "pos")


def edges(extracted: DataFrame, found: DataFrame, ordered: bool = True) -> DataFrame:
    """``(edge_id, source, target, relationship, confidence, event_time, available_time, document_id, chunk_id)``.

    Both ends are looked up among the entities of the relation's chunk, then among all; with ``ordered`` only those of the
    same or earlier chunks count. Relations with an unknown end or relationship, self loops and
    times before the event's are dropped; of equal ids the first stays.
    """
    rows = extracted.select("seq", "chunk_id", "document_id", F.col("available_time").alias("chunk_time"), F.posexplode("relations").alias("pos", "r"))
    rows = rows.select("seq", "pos", "chunk_id", "document_id", "chunk_time", F.trim("r.source_entity_id").alias("s"), F.trim("r.target_entity_id").alias("t"), F.upper(F.trim("r.relationship")).alias("relationship"), F.col("r.confidence").alias("confidence"), F.col("r.event_time").alias("event_time"), F.coalesce("r.available_time", "chunk_time").alias("available_time"))
    rows = rows.where(is_relationship(F.col("relationship")) & write_time_valid(F.col("event_time"), F.col("available_time")))
    known = aliases(found)
    near = known.groupBy("chunk_id", "key").agg(F.min(F.struct("pos", "node_id")).alias("n")).select("chunk_id", "key", F.col("n.node_id").alias("near"))
    far = known.groupBy("key").agg(F.min(F.struct("seq", "pos", "node_id")).alias("n")).select("key", F.col("n.seq").alias("since"), F.col("n.node_id").alias("far"))
    for end in ("s", "t"):
        for key in (F.col(end), F.lower(end)):
            rows = rows.withColumn("key", key).join(near, ["chunk_id", "key"], "left").join(far, "key", "left").drop("key")
            hit = F.coalesce("near", F.when(F.lit(not ordered) | (F.col("since") <= F.col("seq")), F.col("far")))
            rows = rows.withColumn(f"{end}_node", F.coalesce(F.col(f"{end}_node"), hit) if f"{end}_node" in rows.columns else hit).drop("near", "far", "since")
    sound = rows.where("s_node is not null and t_node is not null and s_node <> t_node")
    properties = ids.json_object({"document_id": ids.json_string(F.col("document_id")), "chunk_id": ids.json_string(F.col("chunk_id"))})  # one triple from two chunks is two edges
    named = sound.withColumn("edge_id", ids.edge_id(F.col("s_node"), F.col("relationship"), F.col("t_node"), F.col("event_time"), F.col("available_time"), properties))
    one = first_per_key(named, ["edge_id"], ["seq", "pos"])
    return one.select("edge_id", F.col("s_node").alias("source"), F.col("t_node").alias("target"), "relationship", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "event_time", "available_time", "document_id", "chunk_id")


def write_time_valid(event: Column, available: Column) -> Column:
    """Nothing is available before it happens; unknown times are no fault."""
    from ..functions.time import parse_flexible

    return ~F.coalesce(parse_flexible(available) < parse_flexible(event), F.lit(False))


def unified_graph(extracted: DataFrame, universe: DataFrame | None = None, ordered: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all extracted chunks, with their documents and chunks."""
    found = entities(extracted, universe)
    return nodes(found), edges(extracted, found, ordered)


def event_graph(events: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Company nodes, event nodes and typed edges company to event.

    ``events(event_type, ticker, key, event_time, available_time)``, ``companies(ticker, company)``. All companies are nodes;
    an event of no known company stays without edge; repeated events are one.
    """
    named = events.withColumn("node_id", T.event_id(F.col("event_type"), F.col("ticker"), F.col("key"), F.col("event_time")))
    one = first_per_key(named, ["node_id"], ["available_time", "event_time"])
    firms = companies.select(F.concat(F.lit("company:"), F.col("ticker")).alias("node_id"), F.lit("Company").alias("node_type"), F.col("company").alias("name"), F.lit(None).cast("string").alias("available_time"))
    happened = one.select("node_id", F.lit("Event").alias("node_type"), F.col("event_type").alias("name"), "available_time")
    table = F.create_map(*[F.lit(x) for pair in EVENT_RELATIONSHIPS.items() for x in pair])
    linked = one.join(companies.select("ticker"), "ticker").withColumn("relationship", F.try_element_at(table, F.col("event_type"))).where("relationship is not null")
    arcs = linked.select(F.concat_ws("->", F.concat(F.lit("company:"), F.col("ticker")), "relationship", "node_id").alias("edge_id"), F.concat(F.lit("company:"), F.col("ticker")).alias("source"), F.col("node_id").alias("target"), "relationship", "event_time", "available_time")
    return firms.union(happened), arcs


def extract(chunks: DataFrame, client: Callable[[str], str], tries: int = 3, wait: float = 0.5) -> DataFrame:
    """``(chunk_id, raw, error)``: a client ``text -> JSON`` called on the workers, tried again with doubled waits; a chunk that fails keeps its error and stops nothing."""

    def run(batches):
        import time

        import pyarrow as pa

        for b in batches:
            raw, errors = [], []
            for text in b.column("text").to_pylist():
                got = error = None
                for k in range(tries):
                    try:
                        got, error = client(text), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a client raises
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < tries:
                            time.sleep(wait * 2**k)
                raw.append(got)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(raw, pa.string()), pa.array(errors, pa.string())], names=["chunk_id", "raw", "error"])

    return chunks.select("chunk_id", "text").mapInArrow(run, "chunk_id string, raw string, error string")


def parse_extraction(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records of :data:`EXTRACTION` from ``raw(chunk_id, raw)``: entities of known types; relations whose ends are named in the same answer, of known relationships, no loops."""
    schema = (
        "entities array<struct<entity_id: string, entity_type: string, name: string, canonical_name: string, confidence: double>>, "
        "relations array<struct<source: string, target: string, source_entity_id: string, target_entity_id: string, relationship: string, confidence: double, event_time: string, available_time: string>>"
    )
    text = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    got = raw.select("chunk_id", F.from_json(F.nullif(text, F.lit("")), schema).alias("x")).join(chunks, "chunk_id")
    held = F.filter(F.coalesce("x.entities", F.expr("cast(array() as array<struct<entity_id:string,entity_type:string,name:string,canonical_name:string,confidence:double>>)")), lambda e: node_type(e["entity_type"]).isNotNull() & (F.coalesce(F.trim(e["name"]), F.lit("")) != ""))
    ends = F.flatten(F.transform(held, lambda e: F.array_compact(F.array(F.lower(e["entity_id"]), T.normalize_entity_name(e["name"]), T.normalize_entity_name(e["canonical_name"])))))
    end = lambda r, k: F.coalesce(r[f"{k}_entity_id"], r[k])
    sound = lambda r: is_relationship(F.upper(F.trim(r["relationship"]))) & F.array_contains(ends, T.normalize_entity_name(end(r, "source"))) & F.array_contains(ends, T.normalize_entity_name(end(r, "target"))) & (T.normalize_entity_name(end(r, "source")) != T.normalize_entity_name(end(r, "target")))
    shaped = lambda r: F.struct(end(r, "source").alias("source_entity_id"), end(r, "target").alias("target_entity_id"), F.upper(F.trim(r["relationship"])).alias("relationship"), r["confidence"].alias("confidence"), r["event_time"].alias("event_time"), r["available_time"].alias("available_time"))
    kept = F.transform(F.filter("x.relations", lambda r: F.coalesce(sound(r), F.lit(False))), shaped)
    return got.select("document_id", "chunk_id", "chunk_index", held.alias("entities"), kept.alias("relations"), "available_time")


def merge_by_confidence(rows: DataFrame, keys: list[str], order: list[str], properties: str = "properties") -> DataFrame:
    """One row a key: that of highest confidence (the first on ties), its properties laid over those of the others."""
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence"), *order)
    ranked = rows.withColumn("n_", F.row_number().over(w))
    entry = F.explode(F.map_entries(properties)).alias("e")
    merged = ranked.select(*keys, "n_", entry).groupBy(*keys, F.col("e.key").alias("k")).agg(F.min_by("e.value", "n_").alias("v")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(properties))
    return ranked.where("n_ = 1").drop("n_", properties).join(merged, keys, "left")
