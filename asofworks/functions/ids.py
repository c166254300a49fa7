"""Identifiers from canonical JSON and name-based UUIDs, as expressions.

Canonical JSON has its keys sorted and nulls written out; strings escape the quote, the
backslash and control characters, and with ``ascii`` every character beyond ASCII (as
UTF-16 units), so equal values have one text in any engine that follows the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespace of URLs for name-based UUIDs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
# Short escapes of JSON.
SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def json_string(c: Column, ascii: bool = True) -> Column:
    """A string as JSON text, ``null`` for null."""
    plain = r"^[ !#-\[\]-~]*\z" if ascii else r'^[^"\\\x00-\x1f]*\z'
    short = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])

    def escaped(ch: Column) -> Column:
        code = F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("int")
        wide = F.concat(_unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), _unit(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))))
        out = F.when(F.try_element_at(short, ch).isNotNull(), F.try_element_at(short, ch)).when(code < 0x20, _unit(code))
        if ascii:
            out = out.when(code > 0xFFFF, wide).when(code > 0x7E, _unit(code))
        return out.otherwise(ch)

    whole = F.array_join(F.transform(F.split(c, ""), escaped), "")
    return F.coalesce(F.concat(F.lit('"'), F.when(c.rlike(plain), c).otherwise(whole), F.lit('"')), F.lit("null"))


def json_number(c: Column) -> Column:
    """A whole number or a double as JSON text; doubles as the shortest digits that give them back, for magnitudes from 1e-3 to 1e7."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def json_object(members: dict[str, Column], compact: bool = True) -> Column:
    """An object of JSON texts with sorted keys; ``compact`` leaves out the blanks behind commas and colons. Keys are plain ASCII words."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    said = [F.concat(F.lit(f'"{k}"{colon}'), members[k]) for k in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(comma, *said), F.lit("}"))


def short_hash(json: Column) -> Column:
    """The first sixteen hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(json.cast("binary"), 256), 1, 16)


def edge_id(source: Column, relationship: Column, target: Column, event_time: Column, available_time: Column, properties: Column) -> Column:
    """``source->REL->target:hash`` over the edge's identity; ``properties`` is a JSON text, the others are strings."""
    text = json_string
    own = json_object({"source": text(source), "target": text(target), "relationship": text(relationship), "event_time": text(event_time), "available_time": text(available_time), "properties": properties})
    return F.concat(source, F.lit("->"), relationship, F.lit("->"), target, F.lit(":"), short_hash(own))


def document_id(source: Column, company: Column, document_type: Column, source_reference: Column, source_url: Column) -> Column:
    """``doc:source:hash`` over the five fields, with blanks and without ASCII escapes."""
    said = {"source": source, "company": company, "document_type": document_type, "source_reference": source_reference, "source_url": source_url}
    return F.concat(F.lit("doc:"), source, F.lit(":"), short_hash(json_object({k: json_string(v, ascii=False) for k, v in said.items()}, compact=False)))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The name-based UUID (version 5) of a text: SHA-1 over the namespace's bytes and the name's."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
