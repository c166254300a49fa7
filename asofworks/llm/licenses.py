"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance along directories.

Everything on the path is DataFrame operations. What is compared with the templates are a
file's units: its lines, the sentences in them, its blocks (lines up to one without letter or
digit, joined), the comment it opens with, and, of a licence file, the whole text. A unit's
weights are term counts times inverse document frequencies, which are counted over all
files; a term that no template holds weighs as the mean of those that one does. A
unit matches a template if the cosine reaches the threshold and they share two terms.

Only units that can match are weighed, and no match is lost: a unit must hold a lead term
(the rarest terms of each template, as many as leave the rest a norm below the threshold), and
the terms it shares with some template must have a norm of the threshold at least. Both
are decided within the unit's row, so what is shuffled is little beyond the matches.

A file's own licence is that of its best unit. Files named like a licence file also
declare it for their directory; every other file inherits from its nearest ancestor
directory that has a declaration, found by joining directories to the ancestors of
the distinct directories of all files.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle
from .licence_texts import forms

THRESHOLD = 0.75
#: Terms that a unit and a template share at least.
SHARED = 2
LICENCE_FILE = r"(^|/)(LICENSE|LICENCE|COPYING|NOTICE)[^/]*$"
#: A term: letters and digits, with dots and hyphens inside; for Spark it never looks back, so a long one costs no stack.
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_SPARK_TERM = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"
SENTENCE = r"[.;:!?][ \t]+|\n"
BLOCK = r"\n[^\p{L}\p{N}\n]*\n"
COMMENT = r"^[ \t]*(#|//|/[*]|[*]|--|;|%|<!--)"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def vocabulary() -> list[str]:
    return sorted({t for _, text, _ in forms() for t in terms(text)})


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_SPARK_TERM), F.lit(0))


def idf(files: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms over all files with a text, and the mean of them.

    Counted before the shuffle; as many rows as the templates have terms reach the driver.
    """
    known = vocabulary()
    there = files.where("text is not null")
    found = there.select(F.explode(F.array_distinct(F.filter(_terms(_lower(F.col("text"))), lambda t: t.isin(*known)))).alias("term"))
    df = {r.term: r.n for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}
    n = there.count()
    weights = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in known}
    return weights, sum(weights.values()) / len(weights)


def template_rows(weights: dict[str, float]) -> list[list[tuple]]:
    """For each form the rows (form, licence, rank, size, term, unit weight)."""
    out = []
    for i, (name, text, rank) in enumerate(forms()):
        w = {t: k * weights[t] for t, k in Counter(terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append([(i, name, rank, len(w), t, x / norm) for t, x in sorted(w.items())])
    return out


def lead_terms(templates: list[list[tuple]], weights: dict[str, float], threshold: float = THRESHOLD) -> list[str]:
    """Of each template its rarest terms, as many as leave the rest a norm below the threshold."""
    lead = set()
    for rows in templates:
        rest = 1.0
        for *_, term, w in sorted(rows, key=lambda x: (-weights[x[4]], -x[5], x[4])):
            if math.sqrt(max(rest, 0)) < threshold - 1e-6:  # cosines are rounded to six digits
                break
            lead.add(term)
            rest -= w * w
    return sorted(lead)


def any_word(words: list[str]) -> str:
    """A regular expression for any of the words between non-alphanumerics, with common beginnings factored out, so that few branches are tried at a word's start."""

    def tree(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            heads.setdefault(w[:1], []).append(w[1:])
        parts = [re.escape(c) + tree(tails) for c, tails in sorted(heads.items()) if c]
        inner = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
        return f"(?:{inner})?+" if "" in heads and inner else inner

    return f"(?<![a-z0-9]){tree(sorted(set(words)))}(?![a-z0-9])"


def _may_match(held: Column, templates: list[list[tuple]], threshold: float) -> Column:
    """Whether distinct terms can reach the threshold for some template: for each, 10 and its squared weight a shared term."""
    parts: dict[str, list[float]] = {}
    for rows in templates:
        for i, _, _, _, term, w in rows:
            parts.setdefault(term, [0.0] * len(templates))[i] = 10 + w * w
    table = F.from_json(F.lit(json.dumps(parts)), "map<string,array<double>>")
    none = F.array_repeat(F.lit(0.0), len(templates))
    sums = F.aggregate(held, none, lambda s, t: F.zip_with(s, F.coalesce(F.try_element_at(table, t), none), lambda x, y: x + y))
    return F.exists(sums, lambda x: (x >= 10 * SHARED) & (x - 10 * F.floor(x / 10) >= (threshold - 1e-6) ** 2))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed small table as one literal."""
    names = [x.split(": ")[0] for x in schema.split(", ")]
    said = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(said), f"array<struct<{schema}>>")))


def units(path: Column, text: Column) -> Column:
    """All units of a file, lower-cased, each once."""
    low = _lower(text)
    lines = F.split(low, "\n")
    body = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), False)
    opening = F.when(body == 0, low).otherwise(F.array_join(F.slice(lines, F.lit(1), F.greatest(body - 1, F.lit(0)).cast("int")), "\n"))
    whole = F.when(path.rlike(LICENCE_FILE), F.array(low)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.concat(lines, F.split(low, SENTENCE), F.split(low, BLOCK), F.array(opening), whole))


def own_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(path, licence, cosine)``: the best template of any unit of each file that reaches the threshold.

    A unit is of the template of highest cosine, then most terms, then first name; among the
    units of a file, one that names a version goes before a family's name, then the same order
    holds. Rows without path or text have none.
    """
    spark = files.sparkSession
    weights, other = idf(files)
    templates = template_rows(weights)
    lead = any_word(lead_terms(templates, weights, threshold))
    there = files.where("path is not null and text is not null").where(_lower(F.col("text")).rlike(lead))
    found = there.select("path", F.explode(units(F.col("path"), F.col("text"))).alias("unit")).where(F.col("unit").rlike(lead))
    known = F.broadcast(_table(spark, sorted(weights.items()), "term: string, idf: double"))
    cut = found.select("path", F.xxhash64("unit").alias("u"), _terms(F.col("unit")).alias("terms"))
    cut = cut.where(_may_match(F.array_distinct(F.filter("terms", lambda t: t.isin(*sorted(weights)))), templates, threshold))
    counts = cut.select("path", "u", F.explode("terms").alias("term")).groupBy("path", "u", "term").agg(F.count("*").alias("n"))
    w = F.col("n") * F.coalesce("idf", F.lit(other))
    weighed = counts.join(known, "term", "left").groupBy("path", "u").agg(
        F.sqrt(F.sum(w * w)).alias("norm"),
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", w.alias("w")))).alias("held"),  # the templates' terms only
    )
    table = F.broadcast(_table(spark, [r for rows in templates for r in rows], "form: int, licence: string, rank: int, size: int, term: string, weight: double"))
    held = weighed.where(F.size("held") >= SHARED).select("path", "u", "norm", F.inline("held"))
    dots = held.join(table, "term").groupBy("path", "u", "norm", "form", "licence", "rank", "size").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count("*").alias("n"))
    near = dots.where(f"n >= {SHARED}").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= threshold)
    named = near.groupBy("path", "u").agg(F.min(F.struct((-F.col("cosine")).alias("c"), (-F.col("size")).alias("s"), "licence", "rank")).alias("b")).select("path", "b.*")
    best = named.groupBy("path").agg(F.min(F.struct("rank", "c", "s", "licence")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def _folder(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(path, own_licence, cosine, licence, from_dir)`` for each row of ``files(path, text)``.

    own_licence and cosine: the file's best unit (null if none). licence: that, or the
    declaration of the nearest ancestor directory (from_dir), or null. In a directory with
    several licence files the highest cosine declares, then the first path. A null path
    inherits nothing and a null or empty text has no licence. Rows of one path share the best
    licence of all of them. An empty table gives none. Extra columns are not read.
    """
    rows = files.select("path", "text")
    own = settle(own_licences(rows, threshold), "licences")
    declared = own.where(F.col("path").rlike(LICENCE_FILE)).select(_folder(F.col("path")).alias("dir"), "path", "licence", "cosine")
    declared = declared.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("d")).select("dir", F.col("d.licence").alias("licence"))
    paths = rows.select("path", _folder(F.col("path")).alias("dir"))
    dirs = paths.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ups = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), above))).alias("up"))
    near = ups.join(declared.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "licence"), F.length("up")).alias("n"))
    joined = paths.join(own.withColumnRenamed("licence", "own_licence"), "path", "left").join(near, "dir", "left")
    return joined.select("path", "own_licence", "cosine", F.coalesce("own_licence", "n.licence").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("n.up")).alias("from_dir"))


#: How the query lays documents out as files: every eighth is a licence file of its source, of the source's language or of one of sixteen folders below.
PATH_SQL = """concat(source, case when doc_id % 8 = 0 and (doc_id div 8) % 3 = 0 then '' else concat('/', coalesce(lang, 'other')) end,
  case when doc_id % 8 = 0 and (doc_id div 8) % 3 < 2 then '' else concat('/d', cast((doc_id div 64) % 16 as string)) end,
  '/', case when doc_id % 8 = 0 then 'LICENSE-' else 'doc-' end, cast(doc_id as string), '.txt')"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr(PATH_SQL).alias("path"), "text")
    return scan(docs)


def _sql() -> str:
    rows = ", ".join(f"({i}, '{name}', {rank}, '{t}', {n})" for i, (name, text, rank) in enumerate(forms()) for t, n in sorted(Counter(terms(text)).items()))
    path = PATH_SQL.replace(" div ", " // ").replace("as string", "as varchar")
    sentence, block = SENTENCE.replace("\\t", "\t").replace("\\n", "\n"), BLOCK.replace("\\n", "\n")
    return f"""
WITH raw(form, licence, rank, term, tf) AS (VALUES {rows}),
files AS (SELECT {path} AS path, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
total AS (SELECT count(text) AS n FROM files),
held AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(low, '{TERM}'))) AS term FROM files) GROUP BY term),
k AS (SELECT term, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM raw) LEFT JOIN held USING (term), total),
other AS (SELECT avg(idf) AS idf FROM k),
t AS (SELECT form, licence, rank, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY form)) AS weight, count(*) OVER (PARTITION BY form) AS size FROM raw JOIN k USING (term)),
cut AS (SELECT path, low, string_split(low, chr(10)) AS lines, regexp_matches(path, '{LICENCE_FILE}') AS lic FROM files WHERE path IS NOT NULL AND low IS NOT NULL),
opened AS (SELECT *, list_position([regexp_matches(x, '{COMMENT}') FOR x IN lines], false) AS body FROM cut),
units AS (SELECT DISTINCT path, unnest(list_concat(lines, regexp_split_to_array(low, '{sentence}'), regexp_split_to_array(low, '{block}'),
  [CASE WHEN body IS NULL OR body = 0 THEN low ELSE array_to_string(lines[1 : body - 1], chr(10)) END], CASE WHEN lic THEN [low] ELSE [] END)) AS unit FROM opened),
counts AS (SELECT path, unit, term, count(*) AS n FROM (SELECT path, unit, unnest(regexp_extract_all(unit, '{TERM}')) AS term FROM units) GROUP BY ALL),
w AS (SELECT c.*, n * coalesce(k.idf, other.idf) AS w FROM counts c LEFT JOIN k USING (term), other),
norms AS (SELECT path, unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dots AS (SELECT w.path, w.unit, t.form, t.licence, t.rank, t.size, sum(w.w * t.weight) AS dot, count(*) AS n FROM w JOIN t ON w.term = t.term GROUP BY ALL),
near AS (SELECT d.*, round(dot / norm, 6) AS cosine FROM dots d JOIN norms USING (path, unit) WHERE n >= {SHARED} AND round(dot / norm, 6) >= {THRESHOLD}),
named AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY path, unit ORDER BY cosine DESC, size DESC, licence, rank) = 1),
own AS (SELECT path, licence, cosine FROM named QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank, cosine DESC, size DESC, licence) = 1),
declared AS (SELECT dir, licence FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, * FROM own WHERE regexp_matches(path, '{LICENCE_FILE}')) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) = 1),
paths AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
near_dir AS (SELECT p.dir, d.dir AS up, d.licence FROM (SELECT DISTINCT dir FROM paths WHERE dir IS NOT NULL) p JOIN declared d ON d.dir = '' OR p.dir = d.dir OR starts_with(p.dir, d.dir || '/')
         QUALIFY row_number() OVER (PARTITION BY p.dir ORDER BY length(d.dir) DESC) = 1)
SELECT p.path, o.licence AS own_licence, o.cosine, coalesce(o.licence, n.licence) AS licence, CASE WHEN o.licence IS NULL THEN n.up END AS from_dir
FROM paths p LEFT JOIN own o ON p.path = o.path LEFT JOIN near_dir n ON p.dir = n.dir
"""


OP1_SQL = _sql()
