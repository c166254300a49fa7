"""Text functions: names, ids, tokens, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes of company names.
SUFFIXES = (
    "corporation", "corp", "incorporated", "inc", "company", "co", "limited", "ltd", "plc", "llc", "holdings", "group", "class a", "class b", "class c", "n a",
)
# Sentiment words.
POSITIVE = (
    "beat", "beats", "growth", "strong", "surge", "surges", "profit", "profits", "positive", "gain", "gains", "upgrade", "upgraded", "bullish", "record",
    "revenue", "success", "outperform", "outperformed", "higher", "increase", "increased", "expansion", "optimistic",
)
NEGATIVE = (
    "fall", "falls", "drop", "drops", "decline", "declines", "loss", "losses", "negative", "weak", "downgrade", "downgraded", "bearish", "risk", "risks",
    "warning", "warns", "miss", "misses", "lower", "decrease", "decreased", "cut", "cuts", "lawsuit", "investigation", "uncertainty",
)
# Phrases of a refusal.
REFUSALS = ("insufficient evidence", "insufficient information", "not provided in the evidence", "cannot be determined", "no evidence")


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", " "))


def strip_suffix(c: Column) -> Column:
    """Normalised name without trailing legal suffixes, however many."""
    return F.regexp_replace(normalize_text(c), "(^| )(" + "|".join(SUFFIXES) + ")(( (" + "|".join(SUFFIXES) + "))*)$", "")


def normalize_cik(c: Column) -> Column:
    """Digits padded to ten; longer ones stay, none is empty."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) == 0, "").when(F.length(d) >= 10, d).otherwise(F.lpad(d, 10, "0"))


def stable_id(kind: Column, *parts: Column) -> Column:
    """``kind:`` and sixteen hex digits of the SHA-256 of kind and parts joined by colons."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", kind, *parts).cast("binary"), 256), 1, 16))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def count_in(words: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*vocabulary)))


def paragraphs(c: Column, pattern: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(c, pattern), lambda p: F.trim(p)), lambda p: p != "")  # trim as it stands would take the place as the characters to trim


def windows(c: Column, size: int = 1800, overlap: int = 250) -> Column:
    """Character windows of ``size``, each starting ``size - overlap`` after the last, until the end is covered."""
    step = size - overlap
    last = F.when(F.length(c) <= size, F.lit(0)).otherwise(F.ceil((F.length(c) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))


def alpha_words(c: Column) -> Column:
    """Runs of ASCII letters, lower-cased: the words sentiment is counted on."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def sentiment(c: Column) -> Column:
    """(positive - negative) / (positive + negative) words; 0 without any."""
    w = alpha_words(c)
    p, n = count_in(w, POSITIVE), count_in(w, NEGATIVE)
    return F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n))


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")


def normalize_entity_name(c: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normalize_answer(c: Column) -> Column:
    """Lower case, without articles and ASCII punctuation, white space collapsed. Words are runs of letters, digits and underlines of any script."""
    x = F.regexp_replace(F.lower(c), r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    x = F.regexp_replace(x, "[!-/:-@\\[-`{-~]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def entity_token(c: Column) -> Column:
    """Lower case without underlines, colons, hyphens and spaces, for loose comparison of entity names."""
    return F.translate(F.lower(c), "_:- ", "")


def normalize_whitespace(c: Column) -> Column:
    """Line ends unified, runs of blanks one blank, three or more line ends two; trimmed."""
    x = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


# Legal words of registrants' names, as patterns.
REGISTRANT_WORDS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "holdings?", "group", r"n\.?v", r"s\.?a", "ag", "llc", "lp", "the")


def simplify_registrant(c: Column) -> Column:
    """A registrant's name as questions say it: and for &, no .com, no legal words (with the comma or stop beside them), letters and digits only."""
    plain = F.replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), F.lit(".com"), F.lit(""))
    bare = F.regexp_replace(plain, r"[,.]?\s*\b(" + "|".join(REGISTRANT_WORDS) + r")\b\.?", " ")
    return F.array_join(F.regexp_extract_all(F.regexp_replace(bare, "[^a-z0-9 ]+", " "), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def truncate(c: Column, width: int) -> Column:
    """At most ``width`` characters, with an ellipsis behind what was cut."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def is_hex_id(c: Column) -> Column:
    """Sixteen hex digits, perhaps behind a type."""
    return F.coalesce(c.rlike(r"^(?:[a-z_]+:)?[0-9a-f]{16}$"), F.lit(False))


def is_refusal(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | low.contains(phrase)
    return out


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    """Where a filing's document lies: the CIK as a number, the accession number without hyphens."""
    number = F.regexp_replace(cik, r"\D", "").try_cast("bigint")
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), number.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def stable_hash(*parts: Column) -> Column:
    """Sixteen hex digits over parts in their order; nulls and empty parts differ, and no two lists of parts give one text."""
    said = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in (x.cast("string") for x in parts)]
    return F.substring(F.sha2(F.concat_ws(",", *said).cast("binary"), 256), 1, 16)


def event_id(kind: Column, ticker: Column, key: Column, *rest: Column) -> Column:
    """Identifiers of events: filings by accession, market and macro by series and date, news and others by hash."""
    short = F.when(kind == "sec_filing", "sec").otherwise(kind)
    keyed = kind.isin("sec_filing", "market", "macro") & key.isNotNull()
    return F.concat_ws(":", short, F.coalesce(ticker, F.lit("")), F.when(keyed, key).otherwise(stable_hash(kind, ticker, key, *rest)))


def company_terms(node_id: Column, *names: Column) -> Column:
    """Lower-case terms that name a node: its names, these without legal suffixes (three letters at least), or else its id behind the type unless that is a hash."""
    low = F.array_compact(F.array(*[F.nullif(F.lower(F.trim(n)), F.lit("")) for n in names]))
    bare = F.filter(F.array(*[strip_suffix(n) for n in names]), lambda t: F.length(t) >= 3)
    own = F.lower(F.regexp_extract(node_id, "([^:]*)$", 1))
    found = F.array_sort(F.array_distinct(F.concat(low, bare)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(own))


# What a text does not do, has none of, or is not, where something is missing; and words that turn to what is there.
LACKS = ("contain", "provide", "include", "state", "mention", "list", "identify", "report", "specify", "disclose")
NONE_OF = ("information", "data", "figures?", "mention", "evidence")
NOT_IN = ("available", "found", "present")
TURNS = ("however", "but", "only", "instead", "although", "while")


def coverage(declared: Column, answer: Column) -> Column:
    """full, partial or none: what an answer declares, unless its wording says that something is missing."""
    said = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    one = lambda words: "(" + "|".join(words) + ")"
    signs = (rf"(do|does|did)\s+not\s+(explicitly\s+)?{one(LACKS)}", rf"no\s+{one(NONE_OF)}\b", rf"not\s+{one(NOT_IN)}\s+in\b")
    lacks = F.lit(False)
    for sign in signs:
        lacks = lacks | F.coalesce(answer.rlike(r"(?i)\b" + sign), F.lit(False))
    some = F.when(answer.rlike(rf"(?i)\b{one(TURNS)}\b"), "partial").otherwise("none")
    return F.when(said.isin("partial", "none"), said).otherwise(F.when(lacks, some).otherwise("full"))


def best_window(text: Column, terms: Column, width: int, step: int = 80) -> Column:
    """The first ``width`` characters, among windows ``step`` apart, that hold the most occurrences of the terms; ellipses mark what is cut."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.length(text) - width), F.lit(step))
    times = lambda w, t: F.floor((F.length(w) - F.length(F.replace(w, t, F.lit("")))) / F.length(t)).cast("int")
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  a value named in a lambda is computed once

    def count(window: Column) -> Column:
        return F.aggregate(terms, F.lit(0), lambda s, t: s + times(window, t))

    def score(low: Column, at: Column) -> Column:
        return F.struct(bound(F.substring(low, at + 1, F.lit(width)), count).alias("n"), (-at).alias("back"))

    first = bound(F.lower(text), lambda low: -F.array_max(F.transform(starts, lambda at: score(low, at)))["back"])
    best = F.when(F.size(terms) > 0, first).otherwise(F.lit(0))
    cut = lambda at: F.regexp_replace(F.substring(text, at + 1, F.lit(width)), r"^\s+|\s+$", "")
    marked = lambda at: F.concat(F.when(at > 0, "...").otherwise(""), cut(at), F.when(at + width < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= width, text).otherwise(bound(best, marked))


def pack_paragraphs(text: Column, size: int = 1800, overlap: int = 250, pattern: str = r"\n\s*\n") -> Column:
    """Chunks of whole paragraphs, greedily packed.

    A paragraph longer than ``size`` ends the chunk and is cut into windows. Otherwise it
    is appended where it fits (two characters for the blank line); where not, the chunk ends and its last
    ``overlap`` characters open the next one, or are a chunk of their own if they leave no room.
    """
    none = F.expr("cast(array() as array<string>)")

    def step(acc: Column, p: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        closed = F.when(cur == "", out).otherwise(F.concat(out, F.array(cur)))
        joined = F.concat(cur, F.lit("\n\n"), p)
        tail = F.trim(F.substring(cur, F.greatest(F.lit(1), F.length(cur) - overlap + 1), F.lit(overlap)))
        opened = F.concat(tail, F.lit("\n\n"), p)
        new = F.when(F.length(p) > size, F.lit("")).when(cur == "", p).when(F.length(joined) <= size, joined).when(F.length(opened) <= size, opened).otherwise(p)
        done = F.when(F.length(p) > size, F.concat(closed, windows(p, size, overlap))).when((cur == "") | (F.length(joined) <= size), out)
        done = done.when(F.length(opened) <= size, closed).otherwise(F.concat(closed, F.array(tail)))
        return F.struct(new.alias("cur"), done.alias("out"))

    end = lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))
    return F.aggregate(paragraphs(normalize_whitespace(text), pattern), F.struct(F.lit("").alias("cur"), none.alias("out")), step, end)


def salvage_json(raw: Column, schema: str) -> Column:
    """A model's output as a struct: the text itself, else its outermost braces, else its answer, coverage, confidence and ids one by one; null without an answer."""
    whole = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    answer = F.regexp_extract(raw, r'"answer"\s*:\s*"((?:[^"\\]|\\.)*+)"', 1)
    ids = F.regexp_extract_all(F.regexp_extract(raw, r'(?s)"evidence_ids"\s*:\s*\[(.*?)\]', 1), F.lit('"([^"]+)"'), F.lit(1))
    parts = {
        "answer": answer,
        "coverage": F.nullif(F.regexp_extract(raw, r'"coverage"\s*:\s*"(full|partial|none)"', 1), F.lit("")),
        "confidence": F.nullif(F.regexp_extract(raw, r'"confidence"\s*:\s*([0-9.]+)', 1), F.lit("")).try_cast("double"),
        "evidence_ids": ids,
    }
    names = [f.split(" ")[0] for f in schema.split(", ")]
    piecewise = F.when(answer != "", F.struct(*[parts.get(n, F.lit(None)).alias(n) for n in names]))
    parsed = lambda t: F.from_json(t, schema, {"mode": "PERMISSIVE"})
    sound = lambda t: F.when(F.coalesce(F.get_json_object(t, "$.answer"), F.lit("")) != "", parsed(t))
    return F.coalesce(sound(raw), sound(F.nullif(whole, F.lit(""))), piecewise)
