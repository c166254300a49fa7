"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Four machines are compiled from a model file and composed with each input:

* N, the normaliser: rewrites single characters (spaces and meta symbols become one symbol)
  and puts one of it in front;
* L, the lexicon: a trie whose paths spell pieces and emit their ids, at weight 1 each;
* B, byte fallback: a character that starts no piece emits its byte ids, at weight 1 each;
* G, the grammar: piece b may follow piece a only if merging the two pieces' characters
  by the model's rules gives exactly (a, b) again; its states are the last pieces.

The states of the composition with an input are (place, last piece). They are relaxed in
the tropical semiring in the order of their places: each keeps its least weight and
the arc it came by, and the lightest final state gives the path.

The model merges greedily, so the lightest path by piece scores alone would be a
different segmentation. A sequence is the merge result exactly if all its neighbours
agree (G), so among the paths that G admits the lightest is the model's.

No piece holds the meta symbol behind another character (checked when compiling), so
paths factor at every word start, and the shortest path of a repeated word is kept.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carried, held, restore_columns, texts

META = "▁"
#: Words whose path one worker keeps.
CACHE = 150_000
#: Arcs of the grammar that one worker keeps.
AGREES = 150_000
#: Columns that encoding adds.
ADDED = ("n_pieces", "n_fallback", "ids_sha256", "decoded_sha256", "round_trip")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of one protocol-buffer message; nested ones stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], dict]:
    """Pieces (text, score, type) and the settings that matter of a model file."""
    pieces, spec = [], {"model_type": 1, "byte_fallback": 0, "charsmap": b"", "dummy_prefix": 1, "squeeze": 1, "escape": 1, "suffix": 0}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            spec |= {"model_type": f.get(3, 1), "byte_fallback": f.get(35, 0), "suffix": f.get(24, 0)}
        elif number == 3:
            f = dict(_fields(value))
            spec |= {"charsmap": f.get(2, b""), "dummy_prefix": f.get(3, 1), "squeeze": f.get(4, 1), "escape": f.get(5, 1)}
    return pieces, spec


def _apart(a: int, b: int, size: int, joint: dict[int, int], rank: list[int], left: list[int], right: list[int]) -> bool:
    """Whether two pieces side by side stay two; see ``PieceTransducer._follows``."""
    limit = size
    while True:
        j = joint.get(a * size + b)
        if j is not None and j < limit:
            return False
        r1, r2 = rank[a], rank[b]
        if r1 > r2:  # the left part was made last: before, its right half stood at the border
            limit, a = r1, right[a]
        elif r2 >= 0:  # of equal merges the left one comes first, so the border's merge must not have come before this one either
            limit, b = r2 + 1, left[b]
        else:
            return True


class PieceTransducer:
    """The compiled machines of one model."""

    def __init__(self, data: bytes, cache: int = CACHE):
        pieces, spec = read_model(data)
        if spec["model_type"] != 2 or not spec["byte_fallback"] or spec["charsmap"] or not spec["escape"] or spec["suffix"] or spec["squeeze"]:
            raise ValueError("a merge model with byte fallback and an identity normaliser is needed")
        if any(t in (USER, UNUSED) for _, _, t in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        #: N: what it puts in front, and the characters it rewrites.
        self.prefix = " " if spec["dummy_prefix"] else ""
        self.normal = {ord(META): " "}
        #: Inside, a space stands for the meta symbol; so plain texts stay one byte a character.
        self.names = [p.replace(META, " ") for p, _, _ in pieces]
        self.ids = {self.names[i]: i for i, (_, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = {self.names[i]: s for i, (_, s, t) in enumerate(pieces) if t == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        if any(" " in p.lstrip(" ") or p[:2] == "  " and p.strip(" ") for p in self.ids):
            raise ValueError("a piece crosses a word start")
        missing = {c for p in self.ids for c in p} - set(self.ids)
        if missing:
            raise ValueError("a character of a piece is no piece")
        #: The place of each piece in the order of merges (-1: a single character), and the two parts it is merged from.
        made = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p])
        tied = Counter(self.score[p] for p in made)
        if any(tied[self.score[p]] > 1 and p.strip(" ") for p in made):
            raise ValueError("two merges of one score")  # runs of spaces apart, which are merged by the rule itself
        self.size = len(pieces)
        self.rank, self.left, self.right = [-1] * self.size, list(range(self.size)), list(range(self.size))
        #: Arcs of G found so far, by a * pieces + b.
        self.agrees: dict[int, bool] = {}
        #: The merge that joins two pieces, by left * size + right.
        self.joint: dict[int, int] = {}
        self.runs = {i for p, i in self.ids.items() if not p.strip(" ") and len(p) > 1}
        for k, p in enumerate(made):
            i = self.ids[p]
            self.rank[i] = k
            one, two = self._split(p)
            self.left[i], self.right[i] = self.ids.get(one, i), self.ids.get(two, i)
            for at in range(1, len(p)):
                one, two = self.ids.get(p[:at]), self.ids.get(p[at:])
                if one is not None and two is not None:
                    self.joint[one * self.size + two] = k
        #: A trie node maps a character to (node below, id of the piece that ends there or -1).
        self.trie: dict = {}
        for p, i in self.ids.items():
            if self._merged(p) != [p]:  # no merge makes this piece, so no path may hold it
                continue
            node = self.trie
            for c in p[:-1]:
                node = node.setdefault(c, [{}, -1])[0]
            node.setdefault(p[-1], [{}, -1])[1] = i
        self.out = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(META, " ").encode() for p, _, t in pieces]
        self.paths: dict[str, bytes] = {}
        self.room = cache

    def _merged(self, text: str) -> list[str]:
        """Merge a short string by the model's rule: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _split(self, p: str) -> tuple[str, str]:
        """The two parts that the model merges last to make a piece; a single character is its own."""
        parts = list(p)
        while len(parts) > 2:
            at = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], float("-inf")), -i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[-1]) if len(p) > 1 else (p, p)

    def _follows(self, a: int, b: int) -> bool:
        """Is there an arc of G from piece a to piece b?

        Walks back through the merges that made the two pieces, last merge first; the pair
        is no merge result if, at some time, the parts at the border would have merged with each other
        before the merges that came after.
        """
        key = a * self.size + b
        if (found := self.agrees.get(key)) is None:
            if a in self.runs or b in self.runs:  # runs of spaces have one score: the leftmost merge comes first
                one, two = self.names[a], self.names[b]
                found = self._merged(one + two) == [one, two]
            else:
                found = _apart(a, b, self.size, self.joint, self.rank, self.left, self.right)
            if len(self.agrees) < AGREES:
                self.agrees[key] = found
        return found

    def shortest(self, word: str) -> bytes:
        """Ids (little-endian 32-bit) of the shortest path through the composition with one word.

        G admits one last piece at most at each place (the model's own for the text so far; none
        behind fallback bytes), so a place is one state: its least weight, the piece and the place
        it was reached by. An arc that cannot make a state lighter is not followed.
        """
        n, trie, follows, far = len(word), self.trie, self._follows, 1 << 30
        known, size = self.agrees.get, self.size
        weight, last, came = [far] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0
        for at in range(n):
            if weight[at] == far:
                continue
            cost, prev, node, end, lone = weight[at] + 1, last[at], trie, at, True
            while end < n:
                hit = node.get(word[end])
                if hit is None:
                    break
                node, piece = hit
                end += 1
                if piece >= 0:
                    lone = False
                    if cost < weight[end]:
                        if prev >= 0:
                            ok = known(prev * size + piece)
                            if ok is None:
                                ok = follows(prev, piece)
                            if not ok:
                                continue
                        weight[end], last[end], came[end] = cost, piece, at
            if lone:
                cost = weight[at] + len(word[at].encode())
                if cost < weight[at + 1]:
                    weight[at + 1], last[at + 1], came[at + 1] = cost, -1, at
        out: list[int] = []
        at = n
        while at:
            if last[at] < 0:
                out.extend(self.byte_ids[b] for b in reversed(word[came[at]].encode()))
            else:
                out.append(last[at])
            at = came[at]
        out.reverse()
        return struct.pack(f"<{len(out)}i", *out)

    def _path(self, word: str) -> bytes:
        ids = self.shortest(word)
        if len(self.paths) < self.room and len(word) < 64:
            self.paths[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; null is empty, empty has none."""
        if not text:
            return b""
        words = WORD.findall(self.prefix + text.translate(self.normal))
        known, path = self.paths.get, self._path
        return b"".join([known(w) or path(w) for w in words])

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that the normaliser put in front is taken off, bytes that are no UTF-8 become U+FFFD."""
        out = self.out
        raw = b"".join([out[i] for i in memoryview(ids).cast("i")])
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


WORD = re.compile(" *[^ ]+| +")


def transducer(data: bytes) -> PieceTransducer:
    """One transducer, with its kept paths, for all tasks of a worker."""
    return held(("pieces", hashlib.sha256(data).hexdigest()), lambda: PieceTransducer(data))


def encode(docs: DataFrame, path: str, ids: str | None = "piece_ids") -> DataFrame:
    """All columns of ``docs`` and the encoding of ``text``.

    ``n_pieces``, ``n_fallback`` (byte pieces), ``ids_sha256`` (lowercase hex of the ids as
    little-endian 32-bit integers), ``decoded_sha256`` (of the decoded text in UTF-8),
    ``round_trip`` (decoding gives the text again; U+2581 in a text decodes to a space),
    and the ids themselves in a column named ``ids`` unless that is None. A null text is
    empty: no pieces, round trip true. Each row is encoded whole and by itself; an empty
    table gives none. Extra columns stay; columns of these names are replaced.
    """
    with open(path, "rb") as f:
        model = f.read()
    rest = docs.drop(*ADDED, *([ids] if ids else []))
    kept = carried(rest, "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        t = transducer(sent.value)
        low, high = min(t.byte_ids.values()), max(t.byte_ids.values())

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts(batch):
                code = t.encode(text)
                back = t.decode(code)
                view = memoryview(code).cast("i")
                rows.append((len(view), sum(1 for i in view if low <= i <= high), hashlib.sha256(code).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or ""), code))
            n, fallback, sha, decoded, same, code = zip(*rows, strict=True)
            arrays = [pa.array(n, pa.int64()), pa.array(fallback, pa.int64()), pa.array(sha), pa.array(decoded), pa.array(same)]
            names = ["n_pieces", "n_fallback", "ids_sha256", "decoded_sha256", "round_trip"]
            if ids:
                arrays.append(pa.array([memoryview(c).cast("i").tolist() for c in code], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

        return work

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_pieces long", "n_fallback long", "ids_sha256 string", "decoded_sha256 string", "round_trip boolean"] + ["ids array<int>"] * bool(ids))
    out = arrow_map(kept, make, schema)
    return out.select(*restore_columns(rest, "text"), *ADDED, *([F.col("ids").alias(ids)] if ids else []))


def decode(coded: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """All columns of ``coded`` and the text of its ids; null ids give null."""
    with open(path, "rb") as f:
        model = f.read()
    rest = coded.drop(text)
    kept = carried(rest, ids)
    sent = coded.sparkSession.sparkContext.broadcast(model)

    def make():
        t = transducer(sent.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [None if x is None else t.decode(struct.pack(f"<{len(x)}i", *x)) for x in texts(batch, ids)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded_"])

        return work

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["decoded_ string"])
    return arrow_map(kept, make, schema).select(*restore_columns(rest, ids), F.col("decoded_").alias(text))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=None).select("doc_id", "n_pieces", "n_fallback", "ids_sha256", "decoded_sha256", "round_trip")
