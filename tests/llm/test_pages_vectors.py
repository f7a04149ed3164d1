"""HTML extraction, WARC archives, embeddings and the pipeline."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from foliospark.llm import embedding_dup, html_text, packing, warc
from foliospark.llm.common import Scratch
from foliospark.llm.queries import ORACLES, QUERIES
from tests.conftest import same_as_sql
from tests.llm.helpers import SCHEMA, corpus, documents

FOLDER = "/root/testdata/sf0.001"

# HTML

LONG = "The text of the article is here and it has a lot of the words that are needed for this."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain only", "plain only"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<nav><a href=1>x</a></nav><div><p>one<p>two</div>", "one\n\ntwo"),
        ("<article><h1>T &amp; U</h1><p>a&nbsp; b\n c<br>d</p></article>", "T & U\n\na b c d"),
        ("<script>var a='</p><p>no';</script><style>p{}</style><p>yes", "yes"),
        ("<script>never closed <p>no", ""),
        ("<p title='a>b' class=\"x\">t</p>", "t"),
        ("<p title='open>t</p><p>u</p>", "t\n\nu"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no", "yes"),
        (f"<header><h1>Site</h1></header><main><p>{LONG}</p></main><aside>{LONG}</aside><footer>{LONG}</footer>", LONG),
        (f"<div id='cookieNotice'>{LONG}</div><article><header><h1>Title</h1></header><p>{LONG}<div class='ad'>{LONG}</div><p>Short.<form>{LONG}</form></article>", f"Title\n\n{LONG}\n\nShort."),
        (f"<article><p>{LONG}</p><section id='comments'><article class='comment'><p>{LONG}</p></article></section></article>", LONG),
        (f"<ul class='sidebar-menu'><li>{LONG}</li></ul><p>{LONG}</p><p><a href='x'>{LONG}</a></p><p>end</p>", LONG),
        (f"<div hidden>{LONG}</div><div style='display: none'>{LONG}</div><p>{LONG}</p>", LONG),
        (f"<body class='has-sidebar'><div class='content'><p>{LONG}</p></div></body>", LONG),
        ("<p>" + "x" * 200_000 + "</p>", "x" * 200_000),
        ("<p>" + "<b>" * 3000 + "deep" + "</b>" * 3000 + "</p>", "deep"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><h2 id='related-work'>Related work</h2><p>{LONG}</p><section id='social-history'><p>{LONG}</p></section><p class='comment-on-law'>{LONG}</p></article>", f"Related work\n\n{LONG}\n\n{LONG}\n\n{LONG}"),
        (f"<h2 class='notice'>Notice period</h2><p>{LONG}</p>", f"Notice period\n\n{LONG}"),
        (f"<div class='content-with-sidebar'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div id='layout-sidebar-right'><main><p>{LONG}</p></main><div class='sidebar'><p>{LONG}</p></div></div>", LONG),
        (f"<div class='sidebar'><article><p>{LONG}</p></article></div><p>{LONG[:80]}</p>", LONG),
        (f"<div class='page-overlay'><p>{LONG}</p><p>{LONG}</p></div><div class='share-buttons'>{LONG}</div>", f"{LONG}\n\n{LONG}"),
        (f"<p>{LONG}</p><div class='ad-container'>{LONG}</div><div class='comments'><p>{LONG}</p><p>{LONG}</p></div>", LONG),
    ],
)
def test_names_are_evidence(page, want):
    assert html_text.main_text(page) == want


ITALIAN = "Gli uomini nascono liberi ed eguali, perciò ogni persona gode degli stessi diritti davanti alla legge."
RUSSIAN = "Все люди рождаются свободными и равными в своем достоинстве и правах, они наделены разумом и совестью."
LINKS = "<ul><li><a href='a'>uno</a></li><li><a href='b'>due</a></li></ul>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><h3>{LONG}</h3></article>", f"{LONG}\n\n{LONG}\n\n{LONG}"),
        (f"<p>{LONG}</p><p>{LONG}</p><article><a href='x'>A teaser</a></article>", f"{LONG}\n\n{LONG}"),
        (f"<p>{ITALIAN}</p>{LINKS}<p>{ITALIAN}</p>", f"{ITALIAN}\n\n{ITALIAN}"),
        (f"<p>{RUSSIAN}</p>{LINKS}<p>{RUSSIAN}</p>", f"{RUSSIAN}\n\n{RUSSIAN}"),
        (f"<p>{LONG}</p>{LINKS}<p>{'key word list ' * 8}</p>", LONG),
    ],
)
def test_articles_and_languages_do_not_decide_alone(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>L<span class='share-price'>42</span> end</p></article>", "L42 end"),
        ("<article><p>A long <span class=ad>Buy now</span> way</p><p>to go</p></article>", "A long way\n\nto go"),
        ("<article><p>one <em>two <span hidden>no</span> three</em> four</p></article>", "one two three four"),
        ("<div id='main-widget'><article><p>Body of the article here</p></article></div>", "Body of the article here"),
        ("<div class='post-share-content'><article><p>Body text</p></article></div>", "Body text"),
        ("<main><p>See <a>the whole long report of the committee</a> now</p></main>", "See the whole long report of the committee now"),
        ("<article><p>text</p><ul><li><a>Another page of ours</a></li></ul></article>", "text"),
        ("<p>A <span class=ad>x<p>the rest", "A\n\nthe rest"),
    ],
)
def test_inline_furniture_wrappers_and_links(page, want):
    assert html_text.main_text(page) == want


P = [f"{LONG} {x}." for x in "abcdefghi"]
PS = "".join(f"<p>{x}</p>" for x in P)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><form id='aspnetForm'><div class='content'>{PS}</div></form></body>", P),
        (f"<main><div role='form'>{PS}</div></main>", P),
        (f"<main>{PS}<fieldset><p>{LONG}</p></fieldset><form><p>{LONG}</p></form><div role='search'>{LONG}</div></main>", P),
        (f"{PS}<p>See <a href='/x' title='A hidden gem'>this place</a>, <a href='/search?role=search'>that</a> and <a href='/x.php?id=promo'>those</a> for the more of it.</p>", [*P, "See this place, that and those for the more of it."]),
        (f"{PS}<div data-hidden='false'><p>{LONG}</p></div><p data-role='search' data-class='ad'>{LONG}</p>", [*P, LONG, LONG]),
        (f"{PS}<p>Energy is <math><mi>E</mi> = mc</math> in the law, <object><b>drawn</b></object> and <canvas>shown</canvas>.</p><xmp><p>raw</p></xmp>", [*P, "Energy is E = mc in the law, drawn and shown.", "<p>raw</p>"]),
        (f"<article><h2><a href='#a'>Part one</a></h2><p>{P[0]}</p><ul><li><a href='/i'>item one</a></li><li><a href='/j'>item two</a></li></ul><p>{P[1]}</p><ul><li><a href='/k'>Next page</a></li></ul></article>", ["Part one", P[0], "item one", "item two", P[1]]),
        (f"<h1>The title</h1><div><p>{P[0]}</p></div><article><p>{P[1]}</p><p>{P[2]}</p><p>{P[3]}</p><p>{P[4]}</p><p>{P[5]}</p></article><div><p>{P[6]}</p><p>{P[7]}</p><p>{P[8]}</p></div>", ["The title", P[0], *P[1:]]),
        (f"<h1>The title</h1><h2>Below</h2><article>{PS}</article><p>Site line</p>", ["The title", "Below", *P]),
        (f"{PS}<p>The <span id='related'>thing</span> is in here.</p>", [*P, "The thing is in here."]),
    ],
)
def test_whole_articles(page, want):
    assert html_text.main_text(page) == "\n\n".join(want)


def build_page(rng):
    """A page and its text: an article in wrappers and forms, odd attributes, links, formulas and furniture."""
    said, want = [], []
    for k in range(rng.randrange(3, 9)):
        kind = rng.choice(["p", "p", "p", "link", "math", "heading", "list", "odd"]) if said else "p"
        body = f"{LONG} {k}"
        if kind == "heading":
            said.append(f"<h2 id='related'><a href='#{k}'>Head {k}</a></h2>")
            want.append(f"Head {k}")
        elif kind == "list":
            said.append(f"<ul><li><a href='/{k}'>entry {k}</a></ul>")
            want.append(f"entry {k}")
        else:
            inner = {"p": "", "link": f" <a title='hidden ad' href='?class=menu&id={k}'>see {k}</a>", "math": f" <math><mi>x</mi></math>={k}", "odd": ""}[kind]
            said.append(f"<p{rng.choice([' data-role=search', ' data-hidden=true']) if kind == 'odd' else ''}>{body}{inner}</p>")
            want.append(body + {"p": "", "link": f" see {k}", "math": f" x={k}", "odd": ""}[kind])
    said.append(f"<p>{LONG} end</p>")
    want.append(f"{LONG} end")
    whole = "".join(said)
    for _ in range(rng.randrange(3)):
        whole = rng.choice(["<div>{}</div>", "<form action=/x>{}</form>", "<div class='page-wrapper'>{}</div>", "<section role='form'>{}</section>"]).format(whole)
    whole = rng.choice(["<article>{}</article>", "<main>{}</main>"]).format(whole)
    furniture = ["<nav><a href=/>Home</a></nav>", f"<div class='ad'>{LONG}</div>", "<form><input name=q><button>Go</button></form>", "<footer>Imprint</footer>", "<script>var a = '<p>no</p>';</script>"]
    return "".join(rng.sample(furniture, 2)) + whole + "".join(rng.sample(furniture, 2)), "\n\n".join(want)


@pytest.mark.parametrize("seed", range(150))
def test_built_pages(seed):
    page, want = build_page(random.Random(seed))
    assert html_text.main_text(page) == want


def test_extract_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = "<article><p>" + "word of the text " * 60_000 + "</p></article>"
    rows = [(None, None, "<p>x", "t", "n"), (1, "u", None, "t", "n"), (2, "u", "", "t", "n"), (3, "u", page, "t", "n"), (3, "u", page, "t", "n")]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(None, None, 1), (1, "u", 0), (2, "u", 0), (3, "u", 1_019_999), (3, "u", 1_019_999)]
    assert got[3] == got[4] and html_text.extract(spark.createDataFrame([], schema)).collect() == []


def test_open_blocks_follow_their_neighbours():
    blocks = [html_text.Block("good", 0, False, False, 0, "good"), html_text.Block("s1", 0, False, False, 0), html_text.Block("l" * 100, 100, False, False, 0), html_text.Block("s2", 0, False, False, 0)]
    blocks[0].text = LONG
    labels = [b.label for b in html_text.classify(blocks)]
    assert labels == ["good", "good", "bad", "bad"]


def test_articles_of_the_tables(spark):
    import html
    import re

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


# WARC


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, record_type string, payload_bytes long")


def archive(spark, rows, **index):
    scratch = Scratch(spark, "t")
    path = warc.write(pages_of(spark, rows), scratch)
    return path, warc.build_index(spark, path, scratch, **index)


PAGES = [
    (5, "http://www.B.example.com:80/x?y=1#z", "é" * 60), (3, "https://b.example.com/x?y=1", "é" * 60), (9, None, "é" * 60), (1, "http://a.example.org", "small"), (2, "http://a.example.org/", "small"), (4, "http://a.example.org/p q\r\nX: y", None),
    (6, "http://c/", "x" * 99), (7, "http://c/", "x" * 99), (8, "http://c/", "y" * 100), (10, "http://c/", "y" * 100), (11, "bad url [", "WARC/1.1\r\n\r\n\r\n\r\n" * 30), (12, "http://long/", "z" * 400_000),
]


def test_url_keys():
    assert warc.url_key("http://www.B.example.com:80/x?y=1#z") == warc.url_key("https://b.example.com/x?y=1") == "com,example,b)/x?y=1"
    assert warc.url_key("https://h.org:8443") == "org,h:8443)/" and warc.url_key(None) == "" and warc.url_key("http://[") == "http://["


def test_members_and_records():
    data = warc.gzip_member(b"a" * 200_000) + warc.RECORD_END + warc.gzip_member(b"") + warc.gzip_member(b"tail")
    got = list(warc.members(io.BytesIO(data)))
    assert [x for _, _, x in got] == [b"a" * 200_000, b"\r\n\r\n", b"", b"tail"] and sum(n for _, n, _ in got) == len(data)
    r = warc.record(1, "http://x/", b"body", hashlib.sha256(b"body").hexdigest(), None, None)
    assert warc.parse(r)["payload"] == b"body"
    with pytest.raises(ValueError):
        warc.parse(r[:-1] + b"z")
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-3])))


def test_archives_come_back(spark):
    path, index = archive(spark, PAGES, block_rows=3)
    got = {r["page_id"]: r for r in warc.read_back(spark, pages_of(spark, PAGES), index).collect()}
    first = {}
    for i, _, h in sorted(PAGES):
        body = (h or "").encode()
        to = first.setdefault(body, i) if len(body) >= 100 else i
        want = ("response", None) if to == i else ("revisit", to)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(body), hashlib.sha256(body).hexdigest(), *want)
    assert len(got) == len(PAGES)
    raw = b"".join(gzip.decompress(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    assert raw.count(b"WARC-Type: revisit") == 3 and raw.endswith(b"\r\n\r\n") and raw.startswith(b"WARC/1.1\r\n")


def test_lookups(spark):
    _, index = archive(spark, PAGES, block_rows=2)
    found = warc.CaptureIndex(spark, index)
    by_key = Counter(warc.url_key(u) for _, u, _ in PAGES)
    for i, u, h in PAGES:
        caps = found.captures(u)
        if u is None:
            continue
        assert len(caps) == by_key[warc.url_key(u)] and i in {c["page_id"] for c in caps}
        mine = next(c for c in caps if c["page_id"] == i)
        r = found.fetch(mine)
        assert r["page_id"] == i and r["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest()
    assert found.captures("http://nowhere/") == [] and found.captures("http://zzz.zzz/") == []


def test_empty_archive(spark):
    _, index = archive(spark, [])
    assert warc.read_back(spark, pages_of(spark, []), index).collect() == [] and warc.CaptureIndex(spark, index).captures("http://x/") == []


def test_repeated_rows(spark):
    rows = [(1, "http://a/", "q" * 200)] * 2 + [(2, "http://a/", "q" * 200)] * 2
    _, index = archive(spark, rows)
    assert Counter((r["page_id"], r["record_type"]) for r in warc.read_back(spark, pages_of(spark, rows), index).collect()) == {(1, "response"): 2, (2, "revisit"): 2}


def test_many_captures_of_one_url_over_many_files(spark):
    rows = [(i, "http://a/", f"text {i} " * (1 + i % 40)) for i in range(300)] + [(None, "http://a/", "no id")] + [(i, f"http://h{i % 7}/{i}", "p") for i in range(300, 340)]
    _, index = archive(spark, rows, block_rows=4, file_captures=40)
    assert spark.read.parquet(f"{index}/directory").select("file").distinct().count() > 3
    got = warc.read_back(spark, pages_of(spark, rows), index).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    some = pages_of(spark, rows).where("page_id % 50 = 0").selectExpr("url", "page_id", f"'{warc._DATE}' AS date")
    assert sorted(r["page_id"] for r in warc.read_records(warc.find(spark, index, some)).collect()) == list(range(0, 340, 50))
    plan = warc.read_back(spark, pages_of(spark, rows), index)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_a_lookup_reads_its_block_only(spark, monkeypatch):
    rows = [(i, f"http://h{i:03}/", "p" * 200 + str(i)) for i in range(100)]
    _, index = archive(spark, rows, block_rows=10)
    found, ranges, real = warc.CaptureIndex(spark, index), [], warc.read_range
    monkeypatch.setattr(warc, "read_range", lambda s, path, at, size: ranges.append((path, at, size)) or real(s, path, at, size))
    assert [c["page_id"] for c in found.captures("http://h042/")] == [42] and len(ranges) == 1


def test_warc_same_as_sql(spark):
    same_as_sql(spark, FOLDER, QUERIES["op10_warc"], ORACLES["op10_warc"])


# embeddings


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, True, 3) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, kept boolean, n_links long")


def brute(rows, least=0.93):
    good = {}
    for i, v, lab in rows:
        if lab is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, "f4").astype(float)
        good[i] = (lab, len(v), x / np.linalg.norm(x))
    ids = sorted(good)
    near = {i: {j for j in ids if j != i and good[i][:2] == good[j][:2] and good[i][2] @ good[j][2] >= least} for i in ids}
    comp = {i: i for i, _, _ in rows}
    for i in ids:
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        comp[i] = min(seen)
    return {i: (len(near.get(i, ())), comp[i], comp[i] == i) for i, _, _ in rows}


def clusters(seed=3, n=260, dims=24, group=40):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dims))
    rows = []
    for i in range(n):
        c = base[i % len(base)] if i >= group else base[0]
        v = c + rng.standard_normal(dims) * (0.02 if i % 3 else 0.25)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3 == 0)))
    return rows


def check_vectors(spark, rows, **k):
    out = embedding_dup.near_duplicates(vectors(spark, rows), Scratch(spark, "t"), **k).collect()
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}


def test_vectors_same_as_all_pairs(spark):
    rows = clusters()
    want = brute(rows)
    for k in ({}, {"leaf": 16}, {"leaf": 40, "block": 8}):
        got = check_vectors(spark, rows, **k)
        right = sum(got[i] == want[i] for i in want)
        assert right >= 0.99 * len(want), k


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-30, 0.0], 1), (13, [0.93, 0.36755951], 1)]
    assert check_vectors(spark, rows) == brute(rows)
    twice = embedding_dup.near_duplicates(vectors(spark, [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]), Scratch(spark, "t")).collect()
    assert sorted((tuple(r) for r in twice), key=repr) == [(0, 1, 0, True), (0, 1, 0, True), (None, 0, None, True)]
    assert embedding_dup.near_duplicates(vectors(spark, []), Scratch(spark, "t")).collect() == []


@pytest.mark.parametrize("dims", [8, 64, 768])
def test_recall_of_the_forest(spark, dims):
    """Pairs at the threshold of one label, many splits deep; entries do not grow with the dimensions."""
    rng = np.random.default_rng(9)
    rows, pairs = [], 300
    for i in range(pairs):
        a = rng.standard_normal(dims)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(dims)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, [float(x) for x in a], 1), (2 * i + 1, [float(x) for x in 0.931 * a + np.sqrt(1 - 0.931**2) * b], 1)]
    want, got = brute(rows), check_vectors(spark, rows, leaf=8)
    assert sum(got[i][0] for i in want) >= 0.99 * sum(want[i][0] for i in want)
    x = embedding_dup.unit([v for _, v, _ in rows])
    entries = sum(len(hit) for _, hit in embedding_dup.Tree(0, x, 6).leaves(x, 6))
    assert entries < 2.2 * len(rows)


def test_vectors_same_as_sql(spark):
    same_as_sql(spark, FOLDER, QUERIES["op9_embedding_dup"], ORACLES["op9_embedding_dup"])


# pipeline


def bad_hosts(rows):
    """Hosts whose failure rate, shrunken to an empirical beta prior, is above a half."""
    hosts = {}
    for host, failed in rows:
        if host is not None:
            n, k = hosts.get(host, (0, 0))
            hosts[host] = n + 1, k + failed
    docs = sum(n for n, _ in hosts.values())
    mean = sum(k for _, k in hosts.values()) / docs
    var = sum(n * (k / n - mean) ** 2 for n, k in hosts.values()) / docs - mean * (1 - mean) * len(hosts) / docs
    strength = docs if len(hosts) < 2 or not 0 < mean < 1 else max(1.0, min(docs, mean * (1 - mean) / max(var, 1e-9) - 1))
    return {h for h, (n, k) in hosts.items() if (k + mean * strength) / (n + strength) > 0.5}


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.llm.test_near_dup import brute as near_brute
    from tests.llm.test_text_models import plain_counts

    # enough junk of each kind to be told from chance
    rows = corpus(n=50) + [(300 + 3 * k + j, t * (80 + k), "s0") for k in range(12) for j, t in enumerate(("BUY NOW!! ", "cheap### pills$$$ ", "same "))]
    docs = documents(spark, rows)
    kept = [sorted((r["doc_id"], r["text"]) for r in docs.where("text IS NOT NULL").collect())]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, FOLDER)
        assert now.columns == docs.columns, name
        kept.append(sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=repr))
    assert {i for i, _ in kept[1]} == {i for i, _, _ in rows if i < 300}
    host = {i: s for i, _, s in rows}
    failed = [(i, t, n < 50 or 100 * rep > 50 * n) for i, t in kept[1] for n, _, _, _, rep in [plain_counts(t)]]
    rejected = bad_hosts([(host[i], f) for i, _, f in failed])
    base = [(i, t) for i, t, f in failed if not f and host[i] not in rejected]
    assert kept[2] == base
    near = near_brute([(i, t, "") for i, t in base])
    assert kept[3] == [(i, t) for i, t in base if near[i][2]]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, FOLDER).collect()
    library = Tokenizer.from_file(packing.vocabulary_path())
    pieces, filled = {}, {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == {i for i, _ in kept[3]}
    for i, t in dict(kept[3]).items():
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 1], 0
        copies = sum(j == i for j, _ in kept[3])
        for r in sorted(pieces[i], key=lambda r: r["start"])[::copies]:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert copies > 1 or (r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids))
            at += r["length"]
        assert copies > 1 or at == len(ids)
    for some in filled.values():
        some.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in some] == [sum(x["length"] for x in some[:k]) for k in range(len(some))] and sum(r["length"] for r in some) <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "minhash_near_dedup", "packing"]


def test_pipeline_stages_on_empty_tables_and_rows_without_id(spark):
    import corpus_pipeline

    none = spark.createDataFrame([], SCHEMA)
    odd = documents(spark, [(None, "a text of some words without id " * 5, "s"), (None, None, None), (1, None, None), (2, "", "s"), (2, "", "s"), (3, "word " * 300_000, "s")])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).collect() == [], name
        out = stage(spark, odd, FOLDER)
        assert out.count() >= 2 and (name == "packing" or out.columns == odd.columns), name


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_crc_of_held_out_ids(spark):
    got = spark.range(20).selectExpr("id", "crc32(cast(id as string)) % 7 = 2 AS h").collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 7 == 2) for r in got)


def test_shuffled_input_gives_the_same(spark):
    rows = clusters(n=80)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    assert check_vectors(spark, rows) == check_vectors(spark, mixed)
