"""Links of pages whose markup may be broken, read in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa

#: Elements whose text may name the section of the links below them; a heading ends where the next begins.
HEADINGS = {"h1", "h2", "h3", "h4"}
LEVELS = HEADINGS | {"h5", "h6"}
#: Characters from which on a heading names no section.
LONG = 120


class Walk(HTMLParser):
    """Links and headings in page order.

    Standard tokens: comments, scripts and styles hold no tags, attributes may lack quotes, character references
    are decoded.  A link ends at its end tag or where the next begins, a heading at its end tag or at the next
    heading, ``strong`` at its end tag or where a heading begins or ends; at the end of the page all do.
    Text is kept once, and an element is two places in it, so nesting costs nothing.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.sizes = [0]
        #: kind, href, first part, part behind the last
        self.found: list[list] = []
        self.open: dict[str, list[list]] = {"a": [], "heading": [], "strong": []}

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self._end("a")
            href = next((v for k, v in attrs if k == "href"), None)
            self._begin("a", href)
        elif tag in LEVELS:
            self._end("heading")
            self._end("strong")
            if tag in HEADINGS:
                self._begin("heading", None)
        elif tag == "strong":
            self._begin("strong", None)

    def handle_endtag(self, tag):
        if tag == "a":
            self._end("a")
        elif tag in LEVELS:
            self._end("heading")
            self._end("strong")
        elif tag == "strong" and self.open["strong"]:
            self.open["strong"].pop()[3] = len(self.parts)

    def handle_data(self, data):
        said = "" if self.cdata_elem else " ".join(data.split())
        if said:
            self.parts.append(said)
            self.sizes.append(self.sizes[-1] + len(said) + 1)

    def _begin(self, kind: str, href: str | None) -> None:
        element = [kind, href, len(self.parts), None]
        self.found.append(element)
        self.open[kind].append(element)

    def _end(self, kind: str) -> None:
        for element in self.open[kind]:
            element[3] = len(self.parts)
        self.open[kind].clear()

    def elements(self) -> Iterator[tuple[str, str | None, str | None]]:
        """Kind, target and text of each element; no text for headings that are too long."""
        for kind, href, first, last in self.found:
            last = len(self.parts) if last is None else last
            size = max(self.sizes[last] - self.sizes[first] - 1, 0)
            yield kind, href, " ".join(self.parts[first:last]) if kind == "a" or size < LONG else None


def page_links(html: str | None, section_words: re.Pattern | None) -> list[tuple[int, str | None, str, str]]:
    """``pos, section, label, href`` of the links of a page that have a target, the first of each target."""
    walk = Walk()
    walk.feed(html or "")
    walk.close()
    section, seen, out = None, set(), []
    for pos, (kind, href, said) in enumerate(walk.elements()):
        if kind != "a":
            if said and (section_words is None or section_words.search(said)):
                section = said
        elif href and href not in seen:
            seen.add(href)
            out.append((pos, section, said or "", href))
    return out


def read_links(section_words: str | None):
    """A task function from batches of (id, html) to batches of (id, pos, section, label, href)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(section_words) if section_words else None
        for b in batches:
            for k, html in enumerate(b.column(1)):
                rows = page_links(html.as_py(), words)
                if rows:
                    pos, section, label, href = zip(*rows, strict=True)
                    ids = b.column(0).take(pa.array([k] * len(rows)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int32()), pa.array(section, pa.string()), pa.array(label, pa.string()), pa.array(href, pa.string())], ["id", "pos", "section", "label", "href"])

    return run
