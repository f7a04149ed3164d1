"""Main text of HTML pages by two-pass block rules.

A linear scan cuts a page into blocks (text between block-level tags) and notes for
each its link share, its stop-word share and the containers around it.  Pass one
decides blocks that are clearly text or clearly not; short or odd blocks stay open.
Pass two gives an open block the label of its nearest decided neighbours.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

#: Blocks of at least so many characters can be decided by their stop words alone.
LONG_CHARS = 70
#: Share of stop words from which a long block is text.
STOP_SHARE = 0.10
#: Share of stop words in a page's long blocks from which the stop words are of its language.
FIT_SHARE = 0.20
#: Share of link characters above which a block is not decided as text by itself, and from which it is no text.
LINK_SHARE, ALL_LINKS = 0.5, 0.9

STOP_WORDS = frozenset(
    # English, French, German, Spanish function words
    """the a an and or but of to in on at by for from with as is are was were be been it its this that these those he she they we you i not no
    have has had do does did will would can could there their his her our your which who what when where how if than then so such into over under out up about
    le la les un une des du de et ou mais dans sur pour par avec est sont ce cette ces il elle ils elles nous vous je ne pas que qui se son sa ses au aux en y plus
    der die das ein eine einer eines dem den des und oder aber in im an am auf mit von zu zum zur ist sind war nicht sich es er sie wir ihr auch als wie aus bei nach für
    el la los las un una unos unas de del y o pero en con por para es son era no se su sus lo al que como más este esta estos estas""".split()
)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style noscript template textarea title iframe noembed noframes svg select video audio xmp plaintext".split()}
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OUT_TAGS = frozenset("head nav aside footer menu dialog button".split())
#: Forms are furniture unless they hold most of a page, as a form around the whole page does.
_FORM_TAGS, _FORM_ROLES = frozenset("form fieldset".split()), frozenset("form search".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary menu menubar dialog alert alertdialog toolbar".split())
_OUT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner sponsor sponsored promo promos promotion
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer footnav masthead topbar toolbar cookie cookies consent gdpr
    notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup login signin paywall
    comment comments commentlist disqus reply replies respond social share sharing sharebar related recommended recommendations widget widgets
    pagination pager skip skiplink copyright disclaimer adsbygoogle outbrain taboola topnav subnav sitenav""".split()
)
#: Parts that end a name without saying what the element holds.
_PLAIN_PARTS = frozenset("container wrapper wrap box block area inner list item items links buttons posts".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
_HEADER_WORDS = frozenset("header site-header page-header siteheader pageheader top-header global-header".split())
_EXCUSED = frozenset("has no with without is".split())
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"=\s*([\"'])|>")
#: An attribute, its name and then its value, in quotes or not.
_ATTRIBUTE = re.compile(r"([^\s\"'/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    out: bool  # inside a menu, header, footer, advert, form, comment ...
    region: int  # number of the enclosing article or main element, 0 for none
    label: str = ""  # good, bad, or "" while open
    named: int = 0  # number of the innermost element around it that is furniture by its name, 0 for none


def _outside(name: str, attrs: str, region: int) -> str:
    """Whether an element is furniture: "sure" by its tag, role or style; "named" or "comments" by its
    class or id, which what it holds can refute; or "".

    A name counts as a whole or by its last part that says anything.  Headings have no such
    names, ids inside an article are made from its headings, and ids inside a line mark places."""
    if name in _OUT_TAGS or (name == "header" and not region):
        return "sure"
    found = "named" if name in _FORM_TAGS else ""
    if not attrs or name in ("html", "body", "main"):
        return found
    for m in _ATTRIBUTE.finditer(attrs):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "sure"
        if key == "role":
            if value.lower() in _OUT_ROLES:
                return "sure"
            if value.lower() in _FORM_ROLES:
                found = found or "named"
        elif key == "style":
            if re.search(r"display\s*:\s*none", value, re.I):
                return "sure"
        elif key in ("class", "id") and name not in _HEADINGS and not (key == "id" and (region or name not in _BLOCK)):
            for word in value.split():
                word = _CAMEL.sub("-", word).lower()
                if word in _COMMENT_WORDS:
                    found = "comments"
                elif word in _OUT_WORDS or (word in _HEADER_WORDS and not region):
                    found = found or "named"
                parts = re.split(r"[-_:]+", word)
                if not _EXCUSED.isdisjoint(parts):
                    continue
                if name == "article" and not region:
                    if parts[0] in ("comment", "reply"):
                        found = found or "named"
                    continue
                while len(parts) > 1 and parts[-1].rstrip("0123456789") in _PLAIN_PARTS | {""}:
                    parts.pop()
                if parts[-1].rstrip("0123456789") in _OUT_WORDS:
                    found = found or "named"
    return found


def _weights(found: list[Block]) -> tuple[list[int], bool]:
    """What each long block with few links weighs, and whether the stop words fit the page:
    its stop words if they do, its characters outside links if not."""
    long = [(i, _WORD.findall(b.text.lower())) for i, b in enumerate(found) if not b.out and len(b.text) >= LONG_CHARS and b.link_chars <= LINK_SHARE * len(b.text.replace(" ", ""))]
    stops = {i: sum(w in STOP_WORDS for w in words) for i, words in long}
    fit = sum(stops.values()) >= FIT_SHARE * sum(len(words) for _, words in long)
    out = [0] * len(found)
    for i, words in long:
        out[i] = stops[i] if fit else len(found[i].text) - found[i].link_chars
    return out, fit


def _judge_names(found: list[Block], named: list[tuple[int, str, int]]) -> None:
    """Settle which elements named like furniture are furniture, and mark their blocks.

    ``named``: by number, the named element around it, the kind of its name, and the region
    it opened in.  A name is refuted by most of the page's text, or most of the text in
    articles if the element opened outside them; comments may be longer than what
    they comment on, if that is there."""
    weights, _ = _weights(found)
    texts = weights
    if not any(weights):  # without a long block, all text outside links says where the articles are
        texts = [0 if b.out else len(b.text.replace(" ", "")) - b.link_chars for b in found]
    all_, inside = [0] * len(named), [0] * len(named)
    for b, w, t in zip(found, weights, texts, strict=True):
        all_[b.named] += w
        inside[b.named] += t if b.region else 0
    free = all_[0]
    for k in range(len(named) - 1, 0, -1):
        all_[named[k][0]] += all_[k]
        inside[named[k][0]] += inside[k]
    out = [False] * len(named)
    for k in range(1, len(named)):
        outer, kind, region = named[k]
        refuted = 2 * all_[k] > all_[0] and not (kind == "comments" and free) or not region and 2 * inside[k] > inside[0] and kind != "comments"
        out[k] = out[outer] or not refuted
    for b in found:
        b.out = b.out or out[b.named]


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, white space collapsed and references decoded; empty blocks are left out."""
    h = page or ""
    low_quotes = {'"': True, "'": True}  # whether a closing quote can still be found
    found: list[Block] = []
    # name, out, region, in a link, named element, and the text before an inline element that is set apart
    stack: list[tuple[str, bool, int, bool, int, tuple | None]] = []
    named: list[tuple[int, str, int]] = [(0, "", 0)]
    buf: list[str] = []
    linked: list[str] = []
    out, region, link, regions, inmost = False, 0, False, 0, 0
    heading = False
    at, n = 0, len(h)

    def text(s: str) -> None:
        if "&" in s:
            s = _html.unescape(s)
        buf.append(s)
        if link:
            linked.append(s)

    def flush() -> None:
        nonlocal heading
        if buf:
            words = "".join(buf).split()
            if words:
                found.append(Block(" ".join(words), sum(len(x) for x in "".join(linked).split()), heading, out, region, "", inmost))
            buf.clear()
            linked.clear()
        heading = False

    def restore() -> None:
        nonlocal out, region, link, inmost
        _, out, region, link, inmost, _ = stack[-1] if stack else ("", False, 0, False, 0, None)

    def leave(k: int) -> None:
        """Close the elements from the k-th on; text goes on where an inline element set apart began."""
        nonlocal heading, buf, linked
        while len(stack) > k:
            before = stack.pop()[5]
            if before is not None:
                flush()
                buf, linked, heading = before
        restore()

    def enter(kind: str) -> None:
        nonlocal out, inmost
        if kind == "sure":
            out = True
        elif kind:
            named.append((inmost, kind, region))
            inmost = len(named) - 1

    while at < n:
        lt = h.find("<", at)
        if lt < 0:
            text(h[at:])
            break
        if lt > at:
            text(h[at:lt])
        c = h[lt + 1 : lt + 2]
        if c == "!" or c == "?":
            if h.startswith("<!--", lt):
                end = h.find("-->", lt + 4) if not h.startswith("<!-->", lt) else lt + 2
                at = end + 3 if end >= 0 else n
            else:
                end = h.find(">", lt)
                at = end + 1 if end >= 0 else n
            continue
        closing = c == "/"
        m = _OPEN.match(h, lt + 1 + closing)
        if m is None:
            if closing:  # a bogus comment
                end = h.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                text("<")
                at = lt + 1
            continue
        name = m[0].lower()
        first = end = h.find(">", m.end())
        if end < 0:
            at = n
            break
        if h.find('"', m.end(), end) >= 0 or h.find("'", m.end(), end) >= 0:
            pos = m.end()
            while True:
                q = _QUOTE.search(h, pos)
                if q is None:
                    end = first
                    break
                if q[1] is None:
                    end = q.start()
                    break
                close = h.find(q[1], q.end()) if low_quotes[q[1]] else -1
                if close < 0:
                    low_quotes[q[1]] = False
                    end = first
                    break
                pos = close + 1
        attrs = h[m.end() : end]
        at = end + 1
        if closing:
            if name in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in _BLOCK or all(x[0] not in _BLOCK for x in stack[k + 1 :]):
                        leave(k)
                        if name in _BLOCK:
                            flush()
                    break
            continue
        if name in _RAW:
            if attrs.endswith("/") and name == "svg":
                continue
            stop = _RAW[name].search(h, at)
            if name == "xmp":  # an example, shown as it is
                flush()
                buf.append(h[at : stop.start() if stop else n])
                flush()
            if stop is None:
                at = n
            else:
                end = h.find(">", stop.end())
                at = end + 1 if end >= 0 else n
            buf.append(" ")
            continue
        if name == "br" or name in _VOID and name != "hr":
            if name == "br":
                buf.append(" ")
            continue
        if name in _BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
                if stack[k][0] == "p" or (stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    leave(k)
                    flush()
                    break
                if stack[k][0] in _BLOCK:
                    break
            if name == "hr":
                continue
            inner = region
            if name in ("article", "main") and not out:
                regions += 1
                inner = regions
            if not out:
                enter(_outside(name, attrs, region))
            region = inner
            heading = name in _HEADINGS
            if name == "body":
                out = False
            stack.append((name, out, region, link, inmost, None))
        else:
            apart = None
            if attrs and not out and (kind := _outside(name, attrs, region)):
                apart = buf, linked, heading
                buf, linked, heading = [], [], False
                enter(kind)
            link = link or name == "a"
            stack.append((name, out, region, link, inmost, apart))
    flush()
    leave(0)
    flush()
    if len(named) > 1:
        _judge_names(found, named)
    return found


def classify(found: list[Block]) -> list[Block]:
    """Label blocks good or bad.

    Pass one.  Bad: furniture by its containers; nearly all link text outside articles; outside every
    article or main element where such elements hold most of the text outside links and no two
    blocks outside them are text by themselves, but for headings right above an article.  Good: at least ``LONG_CHARS`` characters, half of them or more outside links, with stop words, or without
    where the stop words are not of the page's language.  All else stays open.
    Pass two.  An open block looks for the nearest decided block (furniture aside) on
    either side in its own region.  Link text in an article is good only between two good blocks, or as a heading
    above one.  For all else, with two different answers a heading follows the block after it and
    any other block the nearer one (good on a tie).  A region without a decided block is
    good if it is an article or main element, or if the page has no good block at all.
    """
    _, fit = _weights(found)
    plain = [0 if b.out else len(b.text.replace(" ", "")) - b.link_chars for b in found]
    inside = 2 * sum(n for b, n in zip(found, plain, strict=True) if b.region) > sum(plain)
    solid = [len(b.text.replace(" ", "")) for b in found]
    links = [b.link_chars >= ALL_LINKS * size for b, size in zip(found, solid, strict=True)]
    for b, size, link in zip(found, solid, links, strict=True):
        if b.out or (link and not b.region):
            b.label = "bad"
        elif not link and len(b.text) >= LONG_CHARS and b.link_chars <= LINK_SHARE * size:
            words = _WORD.findall(b.text.lower())
            if words and (not fit or sum(w in STOP_WORDS for w in words) >= STOP_SHARE * len(words)):
                b.label = "good"
    if inside and sum(b.label == "good" and not b.region for b in found) < 2:
        above = False  # whether the block below is an article's, or a heading above one
        for b in reversed(found):
            if b.region:
                above = True
            elif not b.out:
                above = above and b.heading
                b.label = "good" if above else "bad"
    any_good = any(b.label == "good" for b in found)
    n = len(found)
    before: list[tuple[int, str] | None] = [None] * n
    after: list[tuple[int, str] | None] = [None] * n
    seen: dict[int, tuple[int, str]] = {}
    # furniture, and a link list inside an article, say nothing about the text next to them
    for i, b in enumerate(found):
        before[i] = seen.get(b.region)
        if b.label and not b.out and not (b.region and b.label == "bad"):
            seen[b.region] = (i, b.label)
    seen = {}
    for i in range(n - 1, -1, -1):
        b = found[i]
        after[i] = seen.get(b.region)
        if b.label and not b.out and not (b.region and b.label == "bad"):
            seen[b.region] = (i, b.label)
    for i, b in enumerate(found):
        if b.label:
            continue
        p, q = before[i], after[i]
        if links[i]:
            b.label = "good" if q is not None and q[1] == "good" and (b.heading or p is not None and p[1] == "good") else "bad"
        elif p is None and q is None:
            b.label = "good" if b.region or not any_good else "bad"
        elif p is None or q is None:
            b.label = (p or q)[1]
        elif p[1] == q[1]:
            b.label = p[1]
        elif b.heading:
            b.label = q[1]
        elif i - p[0] != q[0] - i:
            b.label = p[1] if i - p[0] < q[0] - i else q[1]
        else:
            b.label = "good"
    return found


def main_text(page: str | None) -> str:
    """Good blocks in page order, joined by a blank line; empty for a null or empty page."""
    return "\n\n".join(b.text for b in classify(blocks(page)) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; ids and urls, null or repeated, pass through.

    A null or empty page has the empty text; repeated rows give repeated results; an empty table gives no
    rows; other columns, whatever their names, are not read.  Ties between neighbours are settled
    as ``classify`` says.  Pages are independent, so this is one pass without a shuffle; memory
    follows the longest page.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(cell.as_py()) for cell in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select("page_id", "url", "html")
    return picked.mapInArrow(run, f"page_id {dict(picked.dtypes)['page_id']}, url string, text string, n_chars long")
