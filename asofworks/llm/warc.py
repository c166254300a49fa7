"""Merkle fixity audit of WARC replicas.

A WARC file is a sequence of records at byte offsets. Records are hashed to leaves; runs
of sixteen neighbours are hashed to nodes, up to one root a file, and runs of sixteen
neighbouring files further up, to one root of the replica. The hash of a node inside a
file covers, in order, the offset ranges (from the node's own start) and hashes of its
children, so a record that grew changes the nodes above it but none beside it.

An audit compares the replicas' roots. If they differ it joins only the children of nodes
that differ, level by level, down to the records. The levels are settled in the shared
folder; a record's bytes are read once, to hash them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

#: Children of a node, records of a file (FAN ** LEVELS), levels of a file above the leaves.
FAN, FILE_RECORDS, LEVELS = 16, 256, 2


def record_bytes(pages: DataFrame) -> Column:
    """One response record of a page: header lines, an empty line, the body, two line ends. A null url or html is empty."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def _floor_div(c: str, n: int) -> Column:
    """Whole division towards minus infinity, so that negative numbers do not meet the positive ones in 0."""
    return F.expr(f"({c} - pmod({c}, {n}L)) div {n}")


def leaves(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """``(file, slot, page_id, offset, length, hash)``: the records of each file, by page_id.

    A file holds the pages of one range of ids (negative ones too), a slot is a page's place
    in that range, so replicas agree on places even where one lacks a record; offsets are sums
    of lengths. Rows without page_id are in no file. Repeated ids are one record: that of
    smallest hash. An empty table has no files; extra columns are not read, and a record is
    hashed whole, however long.
    """
    raw = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), record_bytes(pages).alias("record"))
    hashed = raw.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    one = hashed.groupBy("page_id").agg(F.min(F.struct("hash", "length")).alias("r")).select("page_id", "r.length", "r.hash")
    placed = one.select(_floor_div("page_id", file_records).alias("file"), F.pmod("page_id", F.lit(file_records)).alias("slot"), "page_id", "length", "hash")
    order = Window.partitionBy("file").orderBy("slot")  # at most file_records rows
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length")).select("file", "slot", "page_id", "offset", "length", "hash")


def _joined(kids: Column, *fields: str) -> Column:
    said = F.transform(kids, lambda k: F.concat_ws(":", *[k[f].cast("string") for f in fields]))
    return F.sha2(F.array_join(said, ",").cast("binary"), 256)


class MerkleTree:
    """All levels of a replica: ``levels[0]`` are the records, ``levels[LEVELS]`` one root a file, ``tops`` what stands above the files."""

    def __init__(self, records: DataFrame, fan: int = FAN, levels: int = LEVELS):
        self.fan = fan
        self.leaves = settle(records, "leaves")
        self.levels = [self.leaves.select("file", "slot", "offset", "length", "hash")]
        for _ in range(levels):
            up = self.levels[-1].groupBy("file", _floor_div("slot", fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("slot", "offset", "length", "hash"))).alias("kids"))
            start = F.col("kids")[0]["offset"]
            own = F.transform("kids", lambda k: F.struct(k["slot"].alias("slot"), (k["offset"] - F.col("start")).alias("offset"), k["length"].alias("length"), k["hash"].alias("hash")))
            last = F.element_at("kids", -1)
            up = up.withColumn("start", start).select("file", F.col("up").alias("slot"), F.col("start").alias("offset"), (last["offset"] + last["length"] - F.col("start")).alias("length"), _joined(own, "slot", "offset", "length", "hash").alias("hash"))
            self.levels.append(settle(up, "tree"))
        #: Nodes over runs of files, as (node, length, hash), until the numbers left are -1 (files of negative ids) and 0.
        self.tops = [self.levels[-1].select(F.col("file").alias("node"), "length", "hash")]
        while self.tops[-1].where("node not in (-1, 0)").limit(1).count():
            up = self.tops[-1].groupBy(_floor_div("node", fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "length", "hash"))).alias("kids"), F.sum("length").alias("length"))
            self.tops.append(settle(up.select(F.col("up").alias("node"), "length", _joined(F.col("kids"), "node", "length", "hash").alias("hash")), "tree"))
        self.root = ",".join(f"{r.node}:{r.length}:{r.hash}" for r in self.tops[-1].orderBy("node").collect())  # two rows at most

    @property
    def roots(self) -> DataFrame:
        """One root a file."""
        return self.levels[-1].select("file", F.col("hash").alias("root"))


def _differ(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Nodes whose hashes differ, or that one side lacks."""
    met = a.select(*on, F.col("hash").alias("h1")).join(b.select(*on, F.col("hash").alias("h2")), on, "full_outer")
    return settle(met.where("not (h1 <=> h2)"), "differ")


def audit(one: MerkleTree, two: MerkleTree) -> tuple[DataFrame, list[DataFrame]]:
    """The records that differ, and the differing nodes of each level of the files, from the files' roots down.

    ``(file, slot, page_id, state, offset, length)``: state is ``changed``, ``missing`` (from the
    second replica) or ``extra``; place and length are the first replica's, of an extra record the
    second's. Replicas of equal root are not compared any further.
    """
    depth = min(len(one.tops), len(two.tops))
    mark = None
    for k in reversed(range(depth)):
        a, b = one.tops[k], two.tops[k]
        if one.root == two.root:
            a, b = a.limit(0), b.limit(0)
        if mark is not None:
            up = mark.select(F.col("node").alias("up"))
            a, b = (x.withColumn("up", _floor_div("node", one.fan)).join(up, "up", "left_semi") for x in (a, b))
        mark = _differ(a, b, ["node"])
    marks = [mark.select(F.col("node").alias("file"), F.lit(0).cast("long").alias("slot"), "h1", "h2")]
    for a, b in zip(reversed(one.levels[:-1]), reversed(two.levels[:-1]), strict=True):  # only the children of nodes that differ
        up = marks[-1].select("file", F.col("slot").alias("up"))
        a, b = (x.withColumn("up", _floor_div("slot", one.fan)).join(up, ["file", "up"], "left_semi") for x in (a, b))
        marks.append(_differ(a, b, ["file", "slot"]))
    places = [x.leaves.select("file", "slot", F.col("page_id").alias(f"p{i}"), F.col("offset").alias(f"o{i}"), F.col("length").alias(f"l{i}")) for i, x in enumerate((one, two))]
    state = F.when(F.col("h1").isNull(), "extra").when(F.col("h2").isNull(), "missing").otherwise("changed")
    found = marks[-1].join(places[0], ["file", "slot"], "left").join(places[1], ["file", "slot"], "left")
    return found.select("file", "slot", F.coalesce("p0", "p1").alias("page_id"), state.alias("state"), F.coalesce("o0", "o1").alias("offset"), F.coalesce("l0", "l1").alias("length")), marks


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage for the query: one character appended, a record lost."""
    hurt = F.when(F.col("page_id") % 97 == 5, F.concat(F.coalesce("html", F.lit("")), F.lit("\x01"))).otherwise(F.col("html"))
    return pages.where("page_id is null or page_id % 211 <> 17").withColumn("html", hurt)


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a file: size, both roots, how many nodes the descent opened, and the damage found."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    one, two = MerkleTree(leaves(pages)), MerkleTree(leaves(damaged(pages)))
    bad, marks = audit(one, two)
    sizes = one.leaves.groupBy("file").agg(F.count("*").alias("n_records"), F.sum("length").alias("n_bytes"))
    opened = reduce(DataFrame.union, [m.select("file") for m in marks]).groupBy("file").agg(F.count("*").alias("n_opened"))
    said = F.concat_ws(":", "page_id", "state", "offset", "length")
    listed = F.array_sort(F.collect_list(F.struct("page_id", said.alias("s"))))  # at most the records of one file
    found = bad.groupBy("file").agg(F.count("*").alias("n_bad"), F.array_join(F.transform(listed, lambda x: x["s"]), ",").alias("bad"))
    out = sizes.join(one.roots.withColumnRenamed("root", "root_one"), "file", "left").join(two.roots.withColumnRenamed("root", "root_two"), "file", "left")
    out = out.join(opened, "file", "left").join(found, "file", "left")
    zero = F.lit(0)
    return out.select("file", "n_records", "n_bytes", "root_one", "root_two", F.coalesce("n_opened", zero).alias("n_opened"), F.coalesce("n_bad", zero).alias("n_bad"), F.coalesce("bad", F.lit("")).alias("bad"))


def _record_sql(html: str) -> str:
    end = "chr(13) || chr(10)"
    return (
        f"encode('WARC/1.1' || {end} || 'WARC-Type: response' || {end} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {end}"
        f" || 'WARC-Target-URI: ' || coalesce(url, '') || {end} || 'Content-Length: ' || octet_length(encode({html})) || {end} || {end}"
        f" || {html} || {end} || {end})"
    )


def _tree_sql(x: str) -> str:
    """Levels 1 and 2 over ``{x}0(file, slot, o, length, hash)``."""
    out = []
    for k in (1, 2):
        out.append(f"""{x}{k} AS (SELECT file, slot // {FAN} AS slot, min(o) AS o, CAST(sum(length) AS BIGINT) AS length,
  sha256(string_agg(slot || ':' || (o - base) || ':' || length || ':' || hash, ',' ORDER BY slot)) AS hash
  FROM (SELECT *, min(o) OVER (PARTITION BY file, slot // {FAN}) AS base FROM {x}{k - 1}) GROUP BY file, slot // {FAN})""")
    return ",\n".join(out)


def _sql() -> str:
    hurt = "(coalesce(html, '') || CASE WHEN page_id % 97 = 5 THEN chr(1) ELSE '' END)"
    leaf = f"SELECT page_id // {FILE_RECORDS} AS file, page_id % {FILE_RECORDS} AS slot, page_id, octet_length(r) AS length, sha256(r) AS hash"
    offset = "SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY slot) - length AS BIGINT) AS o"
    return f"""
WITH ra AS (SELECT page_id, {_record_sql("coalesce(html, '')")} AS r FROM pages WHERE page_id IS NOT NULL),
rb AS (SELECT page_id, {_record_sql(hurt)} AS r FROM pages WHERE page_id IS NOT NULL AND page_id % 211 <> 17),
a0 AS ({offset} FROM ({leaf} FROM ra)), b0 AS ({offset} FROM ({leaf} FROM rb)),
{_tree_sql("a")},
{_tree_sql("b")},
d0 AS (SELECT file, a0.slot, a0.page_id, CASE WHEN b0.hash IS NULL THEN 'missing' ELSE 'changed' END AS state, a0.o, a0.length
  FROM a0 LEFT JOIN b0 USING (file, slot) WHERE a0.hash IS DISTINCT FROM b0.hash),
found AS (SELECT file, count(*) AS n_bad, string_agg(page_id || ':' || state || ':' || o || ':' || length, ',' ORDER BY page_id) AS bad FROM d0 GROUP BY file),
opened AS (SELECT file, count(DISTINCT slot) + count(DISTINCT slot // {FAN}) + count(DISTINCT slot // {FAN * FAN}) AS n FROM d0 GROUP BY file)
SELECT s.file, s.n_records, s.n_bytes, a2.hash AS root_one, b2.hash AS root_two, coalesce(o.n, 0) AS n_opened, coalesce(f.n_bad, 0) AS n_bad, coalesce(f.bad, '') AS bad
FROM (SELECT file, count(*) AS n_records, CAST(sum(length) AS BIGINT) AS n_bytes FROM a0 GROUP BY file) s
LEFT JOIN a2 ON a2.file = s.file LEFT JOIN b2 ON b2.file = s.file LEFT JOIN opened o ON o.file = s.file LEFT JOIN found f ON f.file = s.file
"""


OP4_SQL = _sql()
