"""What a reader sees of a page: one pass over its tags with a count of the hidden elements that are open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without visible content, and those that never have an end tag.
INVISIBLE = ("script", "style", "noscript", "svg", "head", "ix:header", "ix:hidden", "ix:references", "ix:resources")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def _reader():
    """The function of one page, made of nothing but the standard library, so that it can be sent to workers as it is."""
    import re
    from collections import Counter
    from html.parser import HTMLParser

    invisible, void = frozenset(INVISIBLE), frozenset(VOID)

    def hides(tag: str, attrs: dict) -> bool:
        style = (attrs.get("style") or "").replace(" ", "").lower()
        return tag in invisible or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.named, self.hidden = [], Counter(), 0
            self.parts, self.held = [], []

        def flush(self):
            said = "".join(self.held).strip()
            self.held.clear()
            if said:
                self.parts.append(said)

        def handle_starttag(self, tag, attrs):
            self.flush()
            if tag in void:
                return
            gone = hides(tag, dict(attrs))
            self.open.append((tag, gone))
            self.named[tag] += 1
            self.hidden += gone

        def handle_startendtag(self, tag, attrs):
            self.flush()  # an element of its own, without content

        def handle_endtag(self, tag):
            self.flush()
            while self.named[tag]:  # what is open within an element ends with it
                last, gone = self.open.pop()
                self.named[last] -= 1
                self.hidden -= gone
                if last == tag:
                    break

        def handle_data(self, data):
            if not self.hidden:
                self.held.append(data)

        def handle_comment(self, data):
            self.flush()

    def read(page: str | None) -> str | None:
        if page is None:
            return None
        reader = Reader()
        reader.feed(page)
        reader.close()
        reader.flush()
        text = " ".join(reader.parts).replace("\xa0", " ").replace("\r\n", "\n").replace("\r", "\n")
        return re.sub(r"\n[ \t]*\n+", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()

    return read


def visible_text(html: Column) -> Column:
    """The visible text of a page; null for null.

    Scripts, styles, heads, drawings, inline XBRL headers and resources, and elements hidden by an attribute or their own style go with all
    they hold, however deep. The texts between tags are stripped and joined by blanks; entities are decoded, runs of blanks
    become one, empty lines at most one. An end tag closes the latest element of its name and what is open in it; one that closes
    nothing is ignored. Time is linear in the page.
    """
    read = _reader()

    def run(pages):
        return pages.map(read)

    return F.pandas_udf(run, "string")(html)
