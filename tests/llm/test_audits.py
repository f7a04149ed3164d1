"""Change points, divergence audit and language identification against brute force and SQL."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
import regex

from foliospark.llm import change_points, divergence, language_id
from foliospark.llm.common import Scratch
from foliospark.llm.queries import ORACLES, QUERIES
from tests.conftest import same_as_sql
from tests.llm.helpers import SCHEMA

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_change_points", "op12_source_divergence"])
def test_same_as_sql(spark, name):
    same_as_sql(spark, FOLDER, QUERIES[name], ORACLES[name])


# change points


def plain_segments(x, least, penalty):
    """Best cost and starts, by every start of every prefix."""
    n, s, q = len(x), [0], [0]
    for v in x:
        s.append(s[-1] + v)
        q.append(q[-1] + v * v)

    def cost(a, b):
        m, S, Q = b - a, s[b] - s[a], q[b] - q[a]
        return m * math.floor(1000 * math.log(1 + (m * Q - S * S) // (m * m)))

    if n < 2 * least:
        return cost(0, n), [0]
    best = {0: (-penalty, 0, None)}
    for t in range(least, n + 1):
        best[t] = min((best[a][0] + cost(a, t) + penalty, best[a][1] + 1, a) for a in best if t - a >= least)
    starts, t = [], n
    while t:
        t = best[t][2]
        starts.append(t)
    return best[n][0], starts[::-1]


def series(rng, n, large=False):
    level, scale, out = rng.choice([0, 3, 100]), rng.choice([0, 1, 5, 50]), []
    for _ in range(n):
        if rng.random() < 0.05:
            level, scale = rng.choice([0, 3, 100]), rng.choice([0, 1, 5, 50])
        out.append((level + rng.randint(-scale, scale) if rng.random() < 0.9 else 0) * (10**12 if large else 1))
    return out


@pytest.mark.parametrize("least, penalty", [(1, 0), (1, 2000), (2, 0), (3, 500), (5, 3000), (14, 40_000)])
def test_pruned_search_equals_all_starts(least, penalty):
    """Ties, flat stretches, negative and huge numbers; several series at once."""
    rng = random.Random(least + penalty)
    for turn in range(25):
        many = [series(rng, rng.randint(1, 90), large=turn % 6 == 0) for _ in range(rng.randint(1, 5))]
        who, start, best = change_points.solve(np.array(sum(many, [])), np.array([len(x) for x in many]), least, penalty)
        for k, x in enumerate(many):
            assert (best[who == k][0], start[who == k].tolist()) == plain_segments(x, least, penalty), (turn, k)


def test_pruning_forgets_starts(monkeypatch):
    """Where levels shift the candidates stay few; the costs that are computed tell."""
    seen, costs = [], change_points.costs
    monkeypatch.setattr(change_points, "costs", lambda n, v: seen.append(len(n)) or costs(n, v))
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 400, 100) + 5000 * k for k in range(10)])
    change_points.solve(x, np.array([len(x)]))
    assert max(seen) < 250 and sum(seen) < 1000 * 1000 / 2 / 3


def test_segments_of_rows(spark):
    """Repeated rows, nulls, a null key, gaps, one day, and columns named like results."""
    rng, rows, sums = random.Random(3), [], defaultdict(Counter)
    start = datetime(2024, 1, 1)
    for key, days in ((1, 120), (2, 27), (3, 28), (None, 60), (4, 1), (5, 70)):
        for d in range(days):
            for _ in range(rng.choice([0, 1, 3])):
                n = rng.randrange(50) + (300 if d > 60 else 0)
                rows += [(key, start + timedelta(days=d, hours=rng.randrange(24)), n, 7, "x")] * rng.choice([1, 1, 2])
    rows += [(6, None, 5, 0, "x"), (6, start, None, 0, "x"), (1, start, None, 0, "x")]
    for key, at, n, _, _ in rows:
        if at is not None and n is not None:
            sums[key][(at - datetime(1970, 1, 1)).days] += n
    df = spark.createDataFrame(rows, "vendor int, at timestamp_ntz, n int, cost long, total string").repartition(7)
    got = defaultdict(list)
    for r in change_points.change_points(df, "vendor", "at", "n").collect():
        got[r["vendor"]].append(r)
    assert set(got) == set(sums)
    for key, days in sums.items():
        lo = min(days)
        x = [days[d] for d in range(lo, max(days) + 1)]
        best, starts = plain_segments(x, 14, 40_000)
        mine = sorted(got[key], key=lambda r: r["segment_no"])
        assert [r["segment_no"] for r in mine] == list(range(1, len(starts) + 1)) and {(r["best_cost"], r["n_segments"]) for r in mine} == {(best, len(starts))}
        assert [r["first_day"] - lo for r in mine] == starts and sum(r["total"] for r in mine) == sum(x) and sum(r["n_days"] for r in mine) == len(x)
        assert sum(r["cost"] for r in mine) + 40_000 * (len(starts) - 1) == best
    assert change_points.change_points(df.where("false"), "vendor", "at", "n").collect() == []


def test_series_over_batches(spark, monkeypatch):
    """Series that Arrow batches cut, solved a few days at a time, are the same."""
    df = spark.range(4000).selectExpr("id % 9 AS k", "date_add(DATE'2024-01-01', cast(id / 9 % 200 AS int)) AS d", "id * id % 83 AS n")
    want = sorted(change_points.change_points(df, "k", "d", "n").collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    monkeypatch.setattr(change_points, "TOGETHER", 90)
    try:
        assert sorted(change_points.change_points(df, "k", "d", "n").collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


# divergence


def plain_audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang or "", source or "", term.findall((text or "").translate(lower))) for lang, source, text in rows]
    out = []
    for lang in {x for x, _, _ in found}:
        docs = Counter(t for x, _, ts in found if x == lang for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= least)
        groups = sorted({s for x, s, _ in found if x == lang})
        counts = {s: Counter(t for x, y, ts in found if (x, y) == (lang, s) for t in ts if t in set(kept)) for s in groups}
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted(((o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out += [(lang, s, "pair", i, v, k) for k, (i, v) in enumerate(pairs, 1)] + [(lang, s, "term", i, v, k) for k, (i, v) in enumerate(terms, 1)]
    return sorted(out)


AUDIT_SCHEMA = "doc_id long, text string, lang string, source string, value string, n long, term int, rank long"


def audit_rows(seed=4, n=150):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "BETA", "été", "ÉTÉ", "straße", "x", "一二", "don't", "a1b", "𝒳y", "zz"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", "S2", "é", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for _ in range(n)]
    rows += [("lone", "one", "rare words here")] * 2 + [("bare", s, t) for s, t in (("a", None), ("b", "123 !"), ("c", ""))] + [("en", "empty", None), ("de", "only", "gut gut")] + [("de", "only", "gut")] * 12
    return rows + rows[:5]


@pytest.mark.parametrize("limit", [50_000, 0])
def test_audit_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", limit)
    rows = audit_rows()
    df = spark.createDataFrame([(k, text, lang, source, "v", 1, 2, 3) for k, (lang, source, text) in enumerate(rows)], AUDIT_SCHEMA)
    got = divergence.audit(df, Scratch(spark, "t"), top_terms=3)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 10, 3)


def test_audit_of_nothing_and_long_texts(spark):
    empty = spark.createDataFrame([], AUDIT_SCHEMA)
    assert divergence.audit(empty, Scratch(spark, "t")).collect() == []
    rows = [("en", s, "word other " * 60_000) for s in "abc" for _ in range(4)]
    df = spark.createDataFrame([(k, t, lang, s, "v", 1, 2, 3) for k, (lang, s, t) in enumerate(rows)], AUDIT_SCHEMA)
    assert sorted(map(tuple, divergence.audit(df, Scratch(spark, "t")).collect())) == plain_audit(rows, 10, 10)


def test_shares_beyond_a_long(spark):
    """Counts of a corpus of 10^13 words."""
    df = spark.createDataFrame([(9 * 10**12, 4 * 10**13, 10**6), (0, 4 * 10**13, 10**6)], "n long, total long, kinds long")
    got = [r[0] for r in df.select(divergence.share("n", "total", "kinds")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (4 * 10**13 + 2 * 10**6) for n in (9 * 10**12, 0)]


# language


def plain_language(train, texts):
    """The same model held in dictionaries: words and n-grams counted text by text, nothing cut."""
    word = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    levels = {n: defaultdict(Counter) for n in (0, *language_id.GRAMS)}
    for lang, text in train:
        for w in word.findall(text.lower()):
            levels[0][lang][w] += 1
            for n in language_id.GRAMS:
                levels[n][lang].update(language_id.grams(w, n))
    langs = sorted(levels[0], key=lambda x: (-sum(levels[0][x].values()), x))
    out = []
    for text in texts:
        words = word.findall((text or "").lower())
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(langs)
        for w in words:
            for n in (0, *language_id.GRAMS):
                items = [w] if n == 0 else language_id.grams(w, n)
                items = [i for i in items if any(i in levels[n][x] for x in langs)]
                if items:
                    sums = {x: sum(levels[n][x].values()) for x in langs}
                    floor = 0.5 / max(sums.values())
                    for k, x in enumerate(langs):
                        total[k] += sum(math.log(max(levels[n][x][i] / sums[x] if sums[x] else 0.0, floor)) for i in items) / len(items)
                    break
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        out.append((langs[best], 1 / sum(math.exp(t - total[best]) for t in total)))
    return out


LANG_SCHEMA = "doc_id long, text string, lang string, source string, score string, item int, n int, level long"


def language_rows(seed=2, n=120):
    rng = random.Random(seed)
    stock = {"en": "the quick house over wood and thing ring".split(), "de": "der schnelle haus über wald und ding schön".split(), "tlh": "qapla batlh jup".split()}
    rows = []
    for k in range(n):
        lang = rng.choice(list(stock))
        words = [rng.choice(stock[lang]) if rng.random() < 0.8 else "".join(rng.sample(rng.choice(stock[lang]), 3)) for _ in range(rng.randrange(1, 15))]
        rows.append((k, rng.choice([" ", ", ", "\n1 "]).join(words).capitalize(), lang))
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 34 ½ _", "de"), (303, "the house", None), (304, "ÜBER", "de"), (305, "日本 語", "xx"), (None, "the wood", "en"), (306, "þþþ", None), (307, "!!", "none")]
    return rows + [rows[0], rows[0]]


def test_language_equals_brute_force(spark):
    rows = language_rows()
    df = spark.createDataFrame([(i, t, x, "s", "z", 1, 2, 3) for i, t, x in rows], LANG_SCHEMA)
    held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    want = plain_language([(x, t) for (_, t, x), h in zip(rows, held, strict=True) if not h and t is not None and x is not None], [t for _, t, _ in rows])
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(df, Scratch(spark, "t")).collect())
    assert got == Counter((i, h, x, round(p, 9)) for (i, _, _), h, (x, p) in zip(rows, held, want, strict=True))


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "some words", None, "s", "z", 1, 2, 3), (2, None, "en", "s", "z", 1, 2, 3)], LANG_SCHEMA)
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(df, Scratch(spark, "t")).collect()} == {("und", 0.0)}
    assert language_id.identify(df.where("false"), Scratch(spark, "t")).collect() == []
    # ids 0 and 1 are learned from; a word of a million letters and many distinct words are read whole
    long = [(0, "alpha beta " * 1000, "a"), (1, "gamma delta " * 1000, "b"), (5, "z" * 1_000_000, "a"), (6, " ".join(f"{chr(97 + k % 26)}{'xyz'[k % 3] * (k % 50)}gamma" for k in range(30_000)), "a")]
    df = spark.createDataFrame([(i, t, x, "s", "z", 1, 2, 3) for i, t, x in long], LANG_SCHEMA)
    out = {r["doc_id"]: r for r in language_id.identify(df, Scratch(spark, "t")).collect()}
    assert out[0]["lang_pred"] == "a" and out[1]["lang_pred"] == "b" and all(0 <= r["score"] <= 1 for r in out.values())


def test_model_is_bounded(spark, monkeypatch):
    """Only so many entries, the most frequent; a language whose list is cut gets a floor from its least entry."""
    rows = [(k, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(400) for _ in range(1 + j % 7)), x) for k, x in enumerate("aabb")]
    df = spark.createDataFrame([(i, t, x, "s", "z", 1, 2, 3) for i, t, x in rows], LANG_SCHEMA)
    model = language_id.fit(df, Scratch(spark, "t"), entries=800)
    sizes = list(map(len, model.slot))
    assert 0 < sizes[0] < 200 and max(sizes[1:]) <= 80 and len(model.above) <= 800
    whole = model.read(pa.array(TEXTS := ["wba wca wda wba", "wea xx", "wfa \u0301wga e\u0301e", "", None, "\u0301 1"]))
    monkeypatch.setattr(language_id, "CELLS", 2)
    assert model.read(pa.array(TEXTS)) == whole == [model.read(pa.array([t], pa.string()))[0] for t in TEXTS] and [x for x, _ in whole[3:]] == ["und"] * 3


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    said = {r["doc_id"]: r for r in QUERIES["op13_language_id"](spark, folder).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if said[r["doc_id"]]["held_out"]]
    assert len(held) > 250 and sum(said[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.99 * len(held)
