"""Repeated passages by distributed prefix doubling.

Strings of 1, 2, 4, ... bytes have names; the name of a string of twice the length is the
pair of names of its halves, at a position and at the offset of the first half's length.
Doubling goes on inside a task up to half the threshold, since a table of all positions
would be many times the input. There Spark sorts positions of the whole corpus by their
name pairs, in two steps:

1. Of the strings of ``width`` bytes, those that begin in one stretch share the same smallest
   half-length name within their window. Equal strings share it too, wherever they lie, so it
   suffices to sort the stretches by that name (some 4 % of the positions). A stretch whose
   name is unique drops out: nothing in it occurs twice. Stretches equal in every byte that
   their strings cover are ranked once, by the first of them; all others repeat it.
2. What is left of a name with unlike stretches goes on position by position: at the offset
   of half the threshold the two names make the pair of the full length, the pairs are
   sorted with their positions, and every position behind another of its pair is a repeat.

Both sorts are range sorts over (names, position), so a passage that a third of all
documents holds is cut over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, carried, column, forget, restore_columns, settle, ship

WIDTH = 100
#: Positions of a text that are named at once.
CHUNK = 1 << 16
#: Odd multipliers of the names.
LEFT, RIGHT, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of each pair of names."""
    h = a * LEFT + (b ^ (b >> np.uint64(29))) * RIGHT
    h ^= h >> np.uint64(32)
    h *= SPREAD
    h ^= h >> np.uint64(29)
    return h


def names(data: np.ndarray, length: int) -> np.ndarray:
    """The name of the string of ``length`` bytes at each position: doubling, with one more byte where a length is odd."""
    single = data.astype(np.uint64) + np.uint64(1)
    out, size = single, 1
    for bit in bin(length)[3:]:
        out = _pair(out[:-size], out[size:])
        size *= 2
        if bit == "1":
            out = _pair(out[:-1], single[size : size + len(out) - 1])
            size += 1
    return out


def _lowest(values: np.ndarray, span: int, pick=np.minimum) -> np.ndarray:
    """The smallest (or largest) of each ``span`` neighbours."""
    out, size = values, 1
    while size * 2 <= span:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(out) - (span - size)], out[span - size :]) if span > size else out


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column one behind the other, and where each row begins (and the last ends)."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def stretches(data: np.ndarray, begins: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts of (row, start, end, name, whole, several) over texts that lie one behind the other, ``begins`` as :func:`_joined` gives it.

    The positions of a row from start to end have ``name`` as smallest half-length name of their window, and no string from them
    leaves the row. ``whole`` names all bytes that the strings cover, by the names of the three half-lengths that lie over
    them; ``several``: the smallest is at more than one place.
    """
    half = width // 2
    span, longest = width - half + 1, 3 * half - width + 1  # positions of a window; of a stretch that three half-lengths cover
    for at in range(0, len(data) - width + 1, CHUNK):
        named = names(data[at : at + CHUNK + width - 1], half)
        low = _lowest(named, span)
        first = np.concatenate(([True], low[1:] != low[:-1]))
        edge = np.zeros(span - 1, np.uint64)
        places = named[_lowest(np.concatenate((edge, low, edge)), span, np.maximum) == named]  # the smallest of some window, in their order
        runs = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))  # as many as stretches: one after the other has another name
        more = np.diff(np.append(runs, len(places))) > 1
        numbers = np.cumsum(first) - 1
        first[(begins[np.searchsorted(begins, at) : np.searchsorted(begins, at + len(low))] - at)] = True
        start = np.flatnonzero(first)
        end, several = np.append(start[1:], len(low)), more[numbers[start]]
        row = np.searchsorted(begins, at + start, "right") - 1
        end = np.minimum(end, begins[row + 1] - width + 1 - at)
        kept = end > start
        start, end, several, row = start[kept], end[kept], several[kept], row[kept]
        if (end - start > longest).any():
            cuts = -(-(end - start) // longest)
            step = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start, end, several, row = np.repeat(start, cuts) + step * longest, np.repeat(end, cuts), np.repeat(several, cuts), np.repeat(row, cuts)
            end = np.minimum(end, start + longest)
        whole = _pair(_pair(named[start], named[start + half]), _pair(named[end - 1 + width - half], (end - start).astype(np.uint64)))
        yield row, at + start - begins[row], at + end - begins[row], low[start], whole, several


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, raw): the tag is a checksum of the text, so rows of one id and text share a place in the order."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.shiftright(F.crc32(raw), 1).alias("tag"), raw.alias("raw"))


def _batched(parts: Iterator[list[np.ndarray]], names: list[str], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Record batches of some thousands of rows from many short lists of columns."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)


def _columns(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[dict[str, np.ndarray]]:
    """The columns of some thousands of rows at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield {c: np.concatenate([column(b, c).to_numpy(zero_copy_only=False) for b in held]) for c in batch.schema.names}
            held, n = [], 0
    if n:
        yield {c: np.concatenate([column(b, c).to_numpy(zero_copy_only=False) for b in held]) for c in held[0].schema.names}


def _shifted(values: np.ndarray, before) -> np.ndarray:
    """Each row's predecessor; ``before`` is that of the first."""
    return np.concatenate((np.array([before], values.dtype), values[:-1]))


def _sampled(keyed: DataFrame, width: int) -> DataFrame:
    """Rows (name, digest, doc_id, at, n, several) of all stretches: ``at`` is the tag above the start, ``digest`` names all bytes that the strings cover."""
    ship(keyed.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            doc_id, tag = (column(batch, c).to_numpy() for c in ("doc_id", "tag"))
            for row, start, end, name, whole, several in stretches(*_joined(column(batch, "raw")), width):
                yield [name.view(np.int64), whole.view(np.int64), doc_id[row], (tag[row] << 32) + start, (end - start).astype(np.int32), several]

    return keyed.mapInArrow(lambda batches: _batched(parts(batches), ["name", "digest", "doc_id", "at", "n", "several"]), "name long, digest long, doc_id long, at long, n int, several boolean")


def _rank_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """(doc_id, at, n, open) from rows sorted by name, digest and position: repeats of an earlier equal stretch, and stretches to be ranked by position.

    The first stretch of a name is open once an unlike one comes. The task's first and last
    name may reach into other tasks, so their first stretches are open in any case.
    """

    def out(doc_id, at, n, is_open: bool) -> list[np.ndarray]:
        return [np.asarray(doc_id, np.int64), np.asarray(at, np.int64), np.asarray(n, np.int32), np.full(len(doc_id), is_open)]

    last = None  # the row before
    first = None  # the first stretch of a name that has no unlike one so far
    at_edge = True
    for x in _columns(batches):
        name, digest, doc_id, at, n = (x[c] for c in ("name", "digest", "doc_id", "at", "n"))
        before = last or (name[0], digest[0], doc_id[0], at[0])
        new = name != _shifted(name, before[0])
        again = ~new & (digest == _shifted(digest, before[1]))
        same_place = (doc_id == _shifted(doc_id, before[2])) & (at == _shifted(at, before[3]))  # repeated rows are one
        if last is None:
            new[0], again[0] = True, False
        reps = np.flatnonzero(~again)
        is_open = np.zeros(len(name), bool)
        is_open[reps] = ~new[reps] | x["several"][reps]
        unlike = np.flatnonzero(~new[reps])
        is_open[reps[unlike[unlike > 0] - 1]] = True
        if first is not None and len(unlike) and unlike[0] == 0:
            yield out(*([v] for v in first), True)
        if at_edge:
            changes = np.flatnonzero(new)[last is None :]
            is_open[reps[reps < (changes[0] if len(changes) else len(name))]] = True
            at_edge = not len(changes)
        if len(reps):
            j = reps[-1]
            first = None if is_open[j] else (doc_id[j], at[j], n[j])
        yield out(doc_id[is_open], at[is_open], n[is_open], True)
        again &= ~same_place
        yield out(doc_id[again], at[again], n[again], False)
        last = (name[-1], digest[-1], doc_id[-1], at[-1])
    if first is not None:
        yield out(*([v] for v in first), True)


def _first_ranking(sampled: DataFrame) -> DataFrame:
    ranked = sampled.sort("name", "digest", "doc_id", "at")
    return ranked.mapInArrow(lambda batches: _batched(_rank_stretches(batches), ["doc_id", "at", "n", "open"]), "doc_id long, at long, n int, open boolean")


def _by_text(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, tag, name): the places of a text as one list."""
    return rows.groupBy("doc_id", F.shiftright("at", 32).alias("tag")).agg(F.collect_list(F.struct(F.expr("cast(at & 4294967295 as int) as s"), "n")).alias(name))


def _places(batch: pa.RecordBatch, name: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of positions of a row's list, sorted."""
    held = column(batch, name)[row].values
    if held is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, n = (held.field(c).to_numpy().astype(np.int64) for c in ("s", "n"))
    order = np.argsort(start, kind="stable")
    return start[order], n[order]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges joined where they touch or overlap."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(start[1:] > reach[:-1])
    return start[np.concatenate(([0], cut + 1))], reach[np.concatenate((cut, [len(end) - 1]))]


def _name_pairs(keyed: DataFrame, opened: DataFrame, width: int) -> DataFrame:
    """Rows (a, b, doc_id, at) of every open position: the names of half the width at it and at that offset."""
    ship(keyed.sparkSession)
    half = width // 2

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            doc_id, tag = (column(batch, c).to_numpy() for c in ("doc_id", "tag"))
            data, begins = _joined(column(batch, "raw"))
            lists = column(batch, "open")
            sizes, places = np.diff(lists.offsets.to_numpy()), lists.flatten()
            start = places.field("s").to_numpy() + np.repeat(begins[:-1], sizes)
            order = np.argsort(start, kind="stable")
            wanted, ends = _merged(start[order], (start + places.field("n").to_numpy())[order])
            for at in range(0, len(data) - width + 1, CHUNK):
                to = min(at + CHUNK, len(data) - width + 1)
                i, j = np.searchsorted(ends, at, "right"), np.searchsorted(wanted, to)
                if i == j:
                    continue
                low, n = np.maximum(wanted[i:j], at), np.minimum(ends[i:j], to) - np.maximum(wanted[i:j], at)
                own = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                named = names(data[at : to + width - 1], width - half)
                row = np.searchsorted(begins, own, "right") - 1
                yield [named[own - at].view(np.int64), named[own - at + half].view(np.int64), doc_id[row], (tag[row] << 32) + own - begins[row]]

    held = _by_text(opened, "open").join(keyed, ["doc_id", "tag"]).select("doc_id", "tag", "raw", "open")
    return held.mapInArrow(lambda batches: _batched(parts(batches), ["a", "b", "doc_id", "at"]), "a long, b long, doc_id long, at long")


def _rank_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The positions that follow another of their pair, and one row (with ``task``) of the first row and the last."""
    task = TaskContext.get().partitionId()
    first = last = None
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6]
    cols = ["doc_id", "at", "task", "a", "b", "last_a", "last_b", "last_doc", "last_at"]
    for x in _columns(batches):
        here = [x[c] for c in ("a", "b", "doc_id", "at")]
        before = last or [v[0] for v in here]
        first = first or before
        a, b, doc_id, at = (v == _shifted(v, w) for v, w in zip(here, before, strict=True))
        again = a & b & ~(doc_id & at)  # repeated rows are one
        last = [v[-1] for v in here]
        found = [here[2][again], here[3][again]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, found), *[pa.nulls(len(found[0]), t) for t in kinds[2:]]], names=cols)
    if first:
        row = [first[2], first[3], task, *first[:2], *last]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=cols)


def _second_ranking(pairs: DataFrame) -> DataFrame:
    """Rows (doc_id, at, n) of positions that are not the first of their pair.

    The first row of a task is held against the last of the task before, in a table of one row a task.
    """
    ranked = settle(pairs.sort("a", "b", "doc_id", "at").mapInArrow(_rank_pairs, "doc_id long, at long, task int, a long, b long, last_a long, last_b long, last_doc long, last_at long"), "ranked")
    forget(pairs.sparkSession)  # the sorted pairs
    before = Window.orderBy("task")
    edges = ranked.where("task is not null").select("*", *[F.lag(c).over(before).alias(f"was_{c}") for c in ("last_a", "last_b", "last_doc", "last_at")])
    over = edges.where("a = was_last_a and b = was_last_b and not (doc_id = was_last_doc and at = was_last_at)")
    return ranked.where("task is null").select("doc_id", "at").union(over.select("doc_id", "at")).withColumn("n", F.lit(1))


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, at, n): runs of ``n`` positions at each of which a string of ``width`` bytes begins that also begins earlier.

    Earlier is in a smaller doc_id, or at a smaller start of the same document; ``at`` holds
    the start in its lower 32 bits and a tag of the text above them. Rows without doc_id are left out.
    """
    keyed = _keyed(docs.where("doc_id is not null"))
    ranked = settle(_first_ranking(_sampled(keyed, width)), "stretches")
    forget(docs.sparkSession)  # the sorted stretches
    positions = _second_ranking(_name_pairs(keyed, ranked.where("open").select("doc_id", "at", "n"), width))
    return ranked.where("not open").select("doc_id", "at", "n").union(positions)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of ``docs`` and ``n_bytes``, ``spans`` (maximal removed byte ranges, end exclusive) and ``kept`` (the remaining bytes).

    Every byte goes that is covered by a string of ``width`` bytes (4 at least) which also
    starts earlier: in a document of smaller doc_id, or before in the same one. Strings are
    judged on the input, overlaps count, and no string crosses documents.

    A null text is an empty one; texts shorter than ``width`` stay whole. Repeated rows of one
    id and text are one document; rows of one id with different texts are documents in the
    order of a checksum. Rows without doc_id lose nothing and nothing is lost to them. Extra
    columns stay; columns of the three names are replaced. An empty table gives no rows.
    """
    if width < 4:
        raise ValueError("a string has 4 bytes at least")
    rest = docs.drop("n_bytes", "spans", "kept")
    own = carried(rest, "doc_id", "text")
    tag = F.shiftright(F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1)
    lists = _by_text(repeats(docs, width), "places").select(F.col("doc_id").alias("id_"), F.col("tag").alias("tag_"), "places")
    held = own.join(lists, (F.col("doc_id").cast("long") == F.col("id_")) & (tag == F.col("tag_")), "left").drop("id_", "tag_")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, spans, kept = [], [], []
            for row, raw in enumerate(column(batch, "text").cast(pa.binary()).to_pylist()):
                raw = raw or b""
                start, n = _places(batch, "places", row)
                low, high = _merged(start, start + n - 1 + width)
                cuts = list(zip(low.tolist(), high.tolist(), strict=True))
                sizes.append(len(raw))
                spans.append(cuts)
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(raw)], strict=True)))
            added = [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.binary())]
            names_ = [c for c in batch.schema.names if c != "places"]
            return pa.RecordBatch.from_arrays([*(column(batch, c) for c in names_), *added], names=[*names_, "n_bytes", "spans", "kept"])

        return work

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema]
    out = arrow_map(held, make, ", ".join([*schema, "n_bytes long", "spans array<array<int>>", "kept binary"]))
    return out.select(*restore_columns(rest, "doc_id", "text"), "n_bytes", "spans", "kept")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x[1] - x[0]).cast("long"))
    return got.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (
  SELECT doc_id, p, md5_number(x[2 * p + 1 : 2 * p + 200]) AS h
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS p FROM d WHERE len(x) >= 200)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM s) WHERE k > 1),
ends AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM again),
runs AS (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM ends),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY ALL),
gaps AS (
  SELECT s.doc_id, s.a, s.b, lag(s.b, 1, 0) OVER w AS since, row_number() OVER w AS k FROM spans s WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.a)),
cut AS (
  SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(d.x[2 * since + 1 : 2 * a], '' ORDER BY a) || any_value(d.x)[2 * max(b) + 1 :] AS x
  FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(coalesce(c.x, d.x))) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""
