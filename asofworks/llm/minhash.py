"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of one universe make all signature coordinates: the first spreads
the shingles, the second is shifted circularly by one place for each coordinate
(h_k(x) = second[(first[x] + k) mod D]), so the coordinates of a shingle are one
contiguous slice of the doubled second permutation.

Documents with equal shingle sets are one class from the start. Within a band's
bucket no pairs are listed. First every class is compared with one centre of the bucket,
the class with the most company over all its buckets; what those links join needs no
comparison. Classes of a bucket that are still apart (far copies in a large group) meet
through an exact prefix filter: two sets of the wanted similarity must share one of the
rarest shingles of each, and far copies differ in just those. Where a rare shingle is
held by few sets its pairs are joined; where many sets hold it (a template's pages, all just
below the threshold), they are cut into blocks, and a task compares two blocks whole
and gives back no more than a tree of the links between them, never the pairs. All links
are confirmed on full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, arrow_map, column, discard, fresh, held, salted, settle, texts
from .components import connected_components

WORDS, PERCENT = 3, 85
#: The chance that a pair at the threshold shares no band, coordinates of a signature and rows of a band at most.
MISS, COORDINATES, ROWS = 3.3e-7, 320, 6
#: Sets that a rare shingle's pairs are joined for; sets of a block, and shingles of one, expected.
JOINED, BLOCK, BLOCK_SHINGLES = 64, 256, 1 << 20
#: Places of the table of shingle counts that orders shingles by rarity (broadcast, two megabytes).
COUNTERS = 1 << 18
UNIVERSE, SEED = 1 << 21, 20240601
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for a threshold: a pair at it is missed with probability (1 - s**rows)**bands, at most MISS; the most rows that COORDINATES allow."""
    s = percent / 100
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(s**rows)))
        if bands * rows <= COORDINATES or rows == 1:
            return bands, rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; fewer words are one shingle, none are none."""
    w = (text or "").encode().translate(ASCII_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    code = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        code = _mix(code * _M1 + h[i : len(h) - n + 1 + i])
    return np.unique(code)


class CirculantMinHash:
    """Signatures of ``bands * rows`` coordinates from two permutations, folded to band hashes."""

    def __init__(self, bands: int, rows: int, universe: int = UNIVERSE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.universe = bands, rows, universe
        self.first = rng.permutation(universe).astype(np.int32)
        second = rng.permutation(universe).astype(np.int32)
        k = bands * rows
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:k]]), k)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        at = self.first[(grams & np.uint64(self.universe - 1)).astype(np.int64)]
        out = self.slices[at[:1024]].min(0)
        for i in range(1024, len(at), 1024):
            np.minimum(out, self.slices[at[i : i + 1024]].min(0), out)
        return out

    def fold(self, signatures: np.ndarray) -> np.ndarray:
        """Signed 64-bit band hashes, shape (documents, bands); the band's number is part of its hash."""
        s = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), s.shape[:2])
        for r in range(self.rows):
            h = _mix(h * _M1 + s[:, :, r])
        return h.view(np.int64)


def _hasher(*key) -> CirculantMinHash:
    return held(("minhash", *key), lambda: CirculantMinHash(*key))


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, n_shingles, c1, c2, bands)``: c1 and c2 name the shingle set; bands is empty for an empty set."""

    def make():
        hasher = _hasher(bands, rows)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, words) for t in texts(batch)]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
            full = [i for i, s in enumerate(sets) if len(s)]
            folded = hasher.fold(np.stack([hasher.signature(sets[i]) for i in full])) if full else np.zeros((0, bands), np.int64)
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:][full] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(folded.ravel()))
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), lists], names=["doc_id", "n_shingles", "c1", "c2", "bands"])

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>")


def _sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """``(id, grams)`` of the documents whose ids are in ``need(id)``."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, words) for t in texts(batch)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([column(batch, "id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "grams"])

        return work

    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(need, "id", "left_semi")
    return arrow_map(own, make, "id long, grams array<long>")


def verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose sets have a Jaccard similarity of at least ``percent`` in a hundred, settled."""
    n = sets.select("id", F.size("grams").alias("n"))
    sized = pairs.join(n.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u").join(n.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v")
    sized = settle(sized.where(f"100L * least(nu, nv) >= {percent}L * greatest(nu, nv)").select("u", "v"), "pairs")
    one = sets.select(F.col("id").alias("u"), F.col("grams").alias("a"))
    two = sets.select(F.col("id").alias("v"), F.col("grams").alias("b"))
    both = sized.join(one, "u").join(two, "v").select("u", "v", (F.size("a") + F.size("b")).alias("total"), F.size(F.array_intersect("a", "b")).alias("shared"))
    links = settle(both.where(f"100L * shared >= {percent}L * (total - shared)").select("u", "v").distinct(), "verified")
    discard(sized)
    return links


def _commonness(sets: DataFrame) -> np.ndarray:
    """Counts of shingles folded to COUNTERS places; only an order is taken from them, so folding cannot lose a pair."""

    def run(batches):
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            n += np.bincount(column(batch, "grams").flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["place", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for r in sets.select("grams").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.place] = r.n
    return out


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``(id, n, pos, gram)``: the rarest shingles of each set in order, one more than a similar set may lack."""
    sent = sets.sparkSession.sparkContext.broadcast(_commonness(sets))

    def make():
        common = sent.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rare = []
            for grams in column(batch, "grams"):
                g = grams.values.to_numpy()
                order = np.lexsort((g, common[g & (COUNTERS - 1)]))
                rare.append(g[order[: len(g) + (-percent * len(g)) // 100 + 1]])
            sizes = [len(g) for g in column(batch, "grams")]
            ends = np.cumsum([0, *map(len, rare)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rare)))], names=["id", "n", "rare"])

        return work

    found = arrow_map(sets.select("id", "grams"), make, "id long, n long, rare array<long>")
    return found.select("id", "n", F.posexplode("rare").alias("pos", "gram"))


def _step(size, nudge: float = 1e-9):
    """The size's step on a scale of one in a hundred."""
    return F.floor(F.log(size) / math.log(1.01) + nudge)


def _meetings(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``rare(id, part, minor, n, pos, gram)``, one side minor, parts different, that share a rare shingle and may still be similar.

    If the shingle is the first that both share, they share at most what stands from it on in
    either order. A true pair passes at its first shared shingle; and a minor set whose own
    rare shingles come before a common one is sent to no size of which it could share enough.
    """
    least = F.col("n") * (percent / 100)
    most = (F.col("n") - F.col("pos")) * ((100 + percent) / percent) - F.col("n")
    sent = rare.where("minor").withColumn("most", most).where(F.col("most") >= least - 1e-6)
    near = sent.select("gram", F.explode(F.sequence(_step(least, -1e-6), _step(F.greatest("most", least), 1e-6))).alias("step"), F.col("id").alias("a"), F.col("part").alias("pa"), F.col("n").alias("na"), F.col("pos").alias("oa"))
    there = rare.select("gram", _step(F.col("n")).alias("step"), F.col("id").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("pos").alias("ob"))
    enough = f"{100 + percent}L * least(na - oa, nb - ob) >= {percent}L * (na + nb)"
    met = near.join(there, ["gram", "step"]).where(f"pa <> pb and {enough}")
    return met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _tree(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """A forest with the components of the links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((min(a, b), max(a, b)))
    return out


def intersections(one: list[np.ndarray], two: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one block with all of the other, as products of 0/1 matrices over ``chunk`` common shingles at a time."""
    out = np.zeros((len(one), len(two)), np.float32)
    grams = [np.concatenate(x) for x in (one, two)]
    common = np.intersect1d(*map(np.unique, grams))
    sides = []
    for sets, g in zip((one, two), grams, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, g)
        at[at == len(common)] = 0
        hit = common[at] == g if len(common) else np.zeros(len(g), bool)
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        sides.append((row[order], at[order], len(sets)))
    for start in range(0, len(common), chunk):
        m = []
        for row, at, n in sides:
            a, b = np.searchsorted(at, (start, start + chunk))
            x = np.zeros((n, chunk), np.float32)
            x[row[a:b], at[a:b] - start] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _compare(percent: int):
    """Links between two blocks of sets that hold one rare shingle, as a tree."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key[1:])
        rows = rows.combine_chunks()
        block, ids, part, minor, n, pos = (rows.column(c).to_numpy() for c in ("blk", "id", "part", "minor", "n", "pos"))
        a = np.flatnonzero(block == i)
        b = a if i == j else np.flatnonzero(block == j)
        left, size = np.minimum((n - pos)[a][:, None], (n - pos)[b][None, :]), n[a][:, None] + n[b][None, :]
        wanted = (part[a][:, None] != part[b][None, :]) & (minor[a][:, None] | minor[b][None, :]) & ((100 + percent) * left >= percent * size)
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        one, two = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        if len(one):
            grams = rows.column("grams").chunk(0)
            sets = lambda at: [grams[int(k)].values.to_numpy() for k in at]
            shared = intersections(sets(a[one]), sets(b[two])).astype(np.int64)
            x, y = np.nonzero(wanted[np.ix_(one, two)] & (100 * shared >= percent * (size[np.ix_(one, two)] - shared)))
            u, v = ids[a[one[x]]], ids[b[two[y]]]
        tree = _tree(u, v)
        return pa.table({"u": pa.array([x for x, _ in tree], pa.int64()), "v": pa.array([y for _, y in tree], pa.int64())})

    return run


def _crowded(rare: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of ``rare(id, part, minor, n, pos, gram, many, mass)``, compared block by block; ``many`` sets with ``mass`` shingles hold the row's shingle."""
    m = F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("mass") / BLOCK_SHINGLES)).cast("int")
    dealt = rare.withColumn("m", m).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = pairs.select("id", "part", "minor", "n", "pos", "gram", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk")
    spark = rare.sparkSession
    full = pairs.join(sets, "id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gram", "i", "j")
    return full.groupBy("gram", "i", "j").applyInArrow(_compare(percent), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All rows of ``docs`` as ``(doc_id, c1, c2, n_shingles, component_id, kept)``.

    Documents whose shingle sets have a similarity of at least ``percent`` in a hundred are
    linked (bands are derived from it, see :func:`banding`); component_id is the smallest
    doc_id reachable. A document without words (null, empty or white space) has an empty set
    and is its own component. Rows of one doc_id share a component. A row without doc_id
    links with nothing: its component_id is null and it is kept. Whole texts are compared,
    however long; an empty table gives none. Extra columns are not read.
    """
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    table = settle(sketch(docs, words, *banding(percent)), "sketch")
    there = table.where("n_shingles > 0 and doc_id is not null")
    classes = settle(there.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = there.join(classes.withColumnRenamed("rep", "doc_id"), ["c1", "c2", "doc_id"]).select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    spread = firsts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = settle(salted(firsts, spread, ["key"], "rep"), "buckets")
    company = settle(buckets.groupBy("rep").agg(F.sum("n").alias("company")), "company")
    centres = buckets.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("r"))).alias("c")).select("key", (-F.col("c.r")).alias("centre"))
    stars = salted(buckets, centres, ["key"], "rep").where("rep <> centre").select(F.least("rep", "centre").alias("u"), F.greatest("rep", "centre").alias("v")).distinct()
    stars = settle(stars, "stars")
    sets = settle(_sets(docs, company.select(F.col("rep").alias("id")), words), "sets")
    links = verify(sets, stars, percent)
    parts = settle(connected_components(links), "parts")
    named = settle(buckets.select("key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("part")), "named")
    counts = named.groupBy("key", "part").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("m"), F.count("*").alias("k")).where("k > 1").select("key", F.col("m.part").alias("main"))
    # a class is minor if it is outside the largest part of some bucket; a pair that is still apart has a minor side
    apart = settle(salted(named, mixed, ["key"], "rep").groupBy(F.col("rep").alias("id"), "part").agg(F.max(F.col("part") != F.col("main")).alias("minor")), "apart")
    rare = settle(_prefixes(sets.join(apart.select("id"), "id", "left_semi"), percent).join(apart, "id"), "prefixes")
    often = rare.groupBy("gram").agg(F.count("*").alias("many"), F.sum("n").alias("mass"), F.max("minor").alias("some"), F.min("part").alias("p0"), F.max("part").alias("p1"))
    often = settle(often.where("some and p0 <> p1"), "grams")  # the others have no pair
    few = rare.join(often.where(f"many <= {JOINED}").select("gram"), "gram", "left_semi")
    rest = _meetings(few, percent).join(stars, ["u", "v"], "left_anti")
    more = verify(sets, rest, percent)
    many = settle(_crowded(salted(rare, often.where(f"many > {JOINED}").select("gram", "many", "mass"), ["gram"], "id"), sets, percent), "crowded")
    known = parts.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = settle(connected_components(known.union(more).union(many).union(_same_id(classes, there))), "components")
    discard(buckets, company, stars, sets, links, parts, named, apart, rare, often, more, many)
    kept = classes.join(final, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("component", "rep").alias("part"))
    out = table.drop("bands").join(kept, ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("part")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "c1", "c2", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _same_id(classes: DataFrame, there: DataFrame) -> DataFrame:
    """Links between the classes of one doc_id: its rows may hold different texts."""
    several = there.groupBy("doc_id").agg(F.min("c1").alias("l1"), F.max("c1").alias("h1"), F.min("c2").alias("l2"), F.max("c2").alias("h2")).where("l1 <> h1 or l2 <> h2").select("doc_id")
    return there.join(several, "doc_id", "left_semi").join(classes, ["c1", "c2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents whose doc_id names their component, and those without doc_id, with their own columns, whatever these are named."""
    name = fresh(docs, "gone")
    gone = near_duplicates(docs.select("doc_id", "text"), **settings).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
