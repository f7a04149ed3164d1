"""Masked page text against plain loops, and links of broken pages against the standard parser's events."""

import random
from html.parser import HTMLParser

from foliospark.sources import layout, readers, soup

PIECES = "page string, x0 double, x1 double, top double, bottom double, text string"
BOXES = "page string, x0 double, top double, x1 double, bottom double, markdown string"


def test_outside_equals_every_pair(spark):
    rng = random.Random(1)
    pieces = [(p, x, x + rng.randrange(1, 40), y, y + 9.5, str(k)) for k in range(800) for p in [rng.choice(["a", "a", "b", "c"])] for x, y in [(rng.randrange(-60, 612) + rng.choice([0.0, 0.5]), float(rng.randrange(-20, 792)))]]
    pieces += [(None, 1.0, 2.0, 1.0, 2.0, "n"), ("a", None, 2.0, 1.0, 2.0, "m")]
    boxes = [(rng.choice(["a", "b", None]), x, y, x + rng.randrange(-5, 300), y + rng.randrange(-5, 200), "t") for _ in range(25) for x, y in [(float(rng.randrange(-50, 500)), float(rng.randrange(-50, 700)))]] + [("a", 0.0, 0.0, 10.0, 10.0, "t"), ("a", None, 0.0, 10.0, 10.0, "t")]
    inside = lambda c, b: c[0] == b[0] and None not in (*c[:5], *b[:5]) and b[1] <= b[3] and b[2] <= b[4] and c[1] >= b[1] - 1 and c[2] <= b[3] + 1 and c[3] >= b[2] - 1 and c[4] <= b[4] + 1
    want = sorted(c[5] for c in pieces if not any(inside(c, b) for b in boxes))
    out = layout.outside(spark.createDataFrame(pieces, PIECES), spark.createDataFrame(boxes, BOXES))
    assert sorted(r["text"] for r in out.collect()) == want and len(want) < len(pieces) - 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def word(page, x, y, text):
    return (page, float(x), float(x + 5 * len(text)), float(y), float(y + 8), text)


def test_tables_first_then_columns(spark):
    one = [word("one", 50, 100, "Before"), word("one", 83, 101.5, "it"), word("one", 50, 200, "cell"), word("one", 49, 212, "wide"), word("one", 50, 300, "after"), word("one", 20, 300, "and")]
    two = [word("two", x + k % 3 * 30, 20 + 12 * (k // 3), f"{side}{k}") for side, x in (("l", 40), ("r", 340)) for k in range(120)]
    boxes = [("one", 50.0, 200.0, 200.0, 220.0, "| cell |"), ("one", 50.0, 20.0, 60.0, 30.0, ""), ("two", 300.0, 0.0, 612.0, 50.0, "| r |")]
    pages = [("one", None), ("two", 612.0), ("bare", None)]
    got = {r["page"]: (r["columns"], r["text"]) for r in layout.page_texts(spark.createDataFrame(one + two, PIECES), spark.createDataFrame(boxes, BOXES), spark.createDataFrame(pages, "page string, width double")).collect()}
    assert got["one"] == (1, "| cell |\n\nBefore it\nand after") and got["bare"] == (1, "")
    columns, said = got["two"]
    assert columns == 2 and said.startswith("| r |\n\nl0 l1 l2\nl3 l4 l5\n") and "l117 l118 l119\nr6 r7 r8\n" in said and not {"r0", "r5"} & set(said.split())


BROKEN = {
    "unclosed": "<a href=/olr/a.pdf>One<a href='/olr/b.pdf'>Two <b>deep<i>er</a> rest <a href=\"/olr/c.pdf\">Three",
    "comments": "<!-- <a href=/olr/no.pdf>no</a> --><script>var x = '<a href=/olr/no.pdf>no</a>';</script><style>a{}</style><a href=/olr/d.pdf>Four</a><!-- open <a href=/olr/no.pdf>",
    "attributes": "<A data-href=/olr/no.pdf HREF = /olr/e.pdf class='x>y' title=\"a > b\">Fi&amp;ve &eacute;</A><a name=top>none</a><a href>none</a><a href=''>none</a><a href='/olr/e.pdf'>again</a>",
    "headings": "<h2>Uniformed <b>agreements</b><p><a href=/olr/f.pdf></a><h3>Other<h5>Education board</h5><a href=/olr/g.pdf>G</a><strong>Welfare <a href=/olr/h.pdf>H</a></strong><a href=/olr/i.pdf>I</a><h1>" + "trade " * 30 + "</h1><a href=/olr/j.pdf>J</a>",
    "stray": "</a></h2></strong><<a href=/olr/k.pdf>K</a>< a href=/olr/no.pdf>x</a><a href=/olr/l.pdf<b>L</b></a>&#0;&bogus;",
    "empty": "",
}


def test_links_of_broken_pages(spark):
    df = spark.createDataFrame([*BROKEN.items(), ("null", None)], "id string, html string")
    got = {}
    for r in readers.links(df, "id", "html", keep=".").orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["section"], r["label"], r["href"]))
    assert got["unclosed"] == [(None, "One", "/olr/a.pdf"), (None, "Two deep er", "/olr/b.pdf"), (None, "Three", "/olr/c.pdf")]
    assert got["comments"] == [(None, "Four", "/olr/d.pdf")]
    assert got["attributes"] == [(None, "Fi&ve é", "/olr/e.pdf")]
    assert got["headings"] == [("Uniformed agreements", "F", "/olr/f.pdf"), ("Uniformed agreements", "G", "/olr/g.pdf"), ("Welfare H", "H", "/olr/h.pdf"), ("Welfare H", "I", "/olr/i.pdf"), ("Welfare H", "J", "/olr/j.pdf")]
    assert [h for _, _, h in got["stray"]] == ["/olr/k.pdf", "/olr/l.pdf<b"]
    assert "empty" not in got and "null" not in got


class Events(HTMLParser):
    def __init__(self):
        super().__init__()
        self.hrefs = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.hrefs.append(dict(reversed(attrs)).get("href"))


def test_random_markup_has_the_parsers_links():
    rng = random.Random(8)
    bits = ["<a href=x1>", "<a href='x 2'>", '<a title="<a href=no>" href=x3>', "</a>", "<h2>", "</h3>", "<strong>", "</strong>", "board ", "<!--", "-->", "<script>", "</script>", "<", ">", "&lt;", "<a", " href=", "'", '"', "<p>", "text "]
    for _ in range(400):
        html = "".join(rng.choice(bits) for _ in range(30))
        events = Events()
        events.feed(html)
        events.close()
        assert [h for _, _, _, h in soup.page_links(html, None)] == list(dict.fromkeys(h for h in events.hrefs if h))


def test_deep_nesting_is_linear():
    html = "<strong>x" * 20_000 + "<a href=y>z" * 20_000 + "<h2>" * 20_000
    assert len(soup.page_links(html, None)) == 1
