from datetime import date

from pyspark.sql import functions as F

from foliospark.operators import lineage, relations as r, reports


def rows(df, *cols):
    return sorted((tuple(x) for x in (df.select(*cols) if cols else df).collect()), key=repr)


def test_overlay_keeps_curated_nulls(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, headcount int, note string")
    cur = spark.createDataFrame([("a", None)], "id string, headcount int")
    assert rows(r.overlay(base, cur, "id"), "id", "headcount", "note", "curated") == [("a", None, "x", True), ("b", 2, "y", False)]


def test_last_duplicate_wins_and_first_link(spark):
    dim = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "id string, v string, n int")
    left = spark.createDataFrame([("a",), ("z",)], "id string")
    assert rows(r.lookup(left, dim, "id", "n"), "id", "v") == [("a", "new"), ("z", None)]
    assert r.lookup(left, dim.select("id", "v"), "id").count() == left.count() and r.lookup(left, dim.select("id"), "id").columns == left.columns
    assert rows(r.first_link(dim, "id", ["n"]), "v") == [("old",)]


def test_links(spark):
    docs = spark.createDataFrame([("a", ["c", "none", "b"]), ("b", []), ("c", None)], "id string, links array<string>")
    assert rows(r.follow(docs, "id", "links", "to"), "id", "to") == [("a", ["c", "b"]), ("b", []), ("c", [])]
    assert rows(r.overlapping(docs, "id", "links", spark.createDataFrame([("b",)], "id string")), "id") == [("a",)]


def test_ingest_twice_is_once(spark):
    a = spark.createDataFrame([("a", 1)], "id string, n int")
    b = spark.createDataFrame([("a",), ("b",)], "id string")
    once = r.add_new(a, b, "id")
    assert rows(once) == rows(r.add_new(once, b, "id")) == [("a", 1), ("b", None)]


def test_replace_needs_a_replacement(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert rows(r.replace_partition(a, spark.createDataFrame([("a", 9)], "k string, n int"), "k")) == [("a", 9), ("b", 2)]
    assert rows(r.replace_partition(a, a.limit(0), "k")) == rows(a)


def test_as_of_and_within_against_all_pairs(spark):
    import random

    random.seed(3)
    ev = [(random.choice("xy"), random.randrange(50), i) for i in range(60)]
    mk = [(random.choice("xy"), random.randrange(50), 100 + i) for i in range(12)]
    e = spark.createDataFrame(ev, "k string, at int, id int")
    m = spark.createDataFrame(mk, "k string, at int, v int")
    got = {x["id"]: x["v2"] for x in r.as_of(e, m, "k", "at", "v", "v2").collect()}
    for k, at, i in ev:
        past = [(t, v) for kk, t, v in mk if kk == k and t <= at]
        best = {v for t, v in past if t == max(p[0] for p in past)} if past else {None}
        assert got[i] in best
    pairs = rows(r.within(e, e, "k", "at", 3), "id", "id_other")
    want = sorted(((a[2], b[2]) for a in ev for b in ev if a[0] == b[0] and abs(a[1] - b[1]) <= 3), key=repr)
    assert pairs == want


def test_numbering(spark):
    d = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "id string, n int")
    assert rows(r.number_duplicates(d, "id", ["n"])) == [("s-1", 1), ("s-2", 2), ("t", 3)]
    assert rows(r.number_duplicates(d, "id", ["n"], every=False)) == [("s", 1), ("s-2", 2), ("t", 3)]


def test_prefer_keeps_first_place(spark):
    d = spark.createDataFrame([("u", 1, "x", "a"), ("u", 2, "recent", "b"), ("u", 3, "recent", "c"), ("v", 4, "x", "d"), ("v", 5, "y", "e")], "url string, n int, source string, label string")
    assert rows(r.prefer(d, "url", "n", F.col("source") == "recent"), "url", "n", "label") == [("u", 1, "b"), ("v", 4, "e")]


def test_longest_takes_the_earliest(spark):
    d = spark.createDataFrame([("k", "aaa", 2), ("k", "bbb", 1), ("k", "c", 0)], "k string, t string, n int")
    assert rows(r.longest(d, "k", "t", "n"), "t") == [("bbb",)]


LINK = "struct<url:string,title:string,term_start:string,term_end:string,complete:boolean,gap_note:string>"


def test_chains(spark):
    def link(url, title="T", note=None):
        return (url, title, "2001-01-01", "2005-12-31", False, note)

    contracts = spark.createDataFrame([("a", "http://x/a"), ("b", "http://x/b"), ("s", "http://x/s")], "id string, url string")
    lin = spark.createDataFrame(
        [("a", False, [link("http://y/one.pdf"), link("http://x/b"), link(None), link("http://y/never.pdf")]), ("b", False, [link("http://z/One.pdf", "Other"), link("http://y/one.pdf", "Late", "gap")]), ("s", True, [link("http://y/no.pdf")]), ("unknown", False, [link("http://y/no.pdf")])],
        f"contract_id string, self_complete boolean, chain array<{LINK}>",
    )
    links = lineage.chain_links(lin, contracts)
    docs = lineage.earlier_documents(links, contracts)
    assert rows(docs, "url", "id", "later_ids", "gap_note", "label") == [("http://y/one.pdf", "earlier-one", ["a", "b"], "gap", "T"), ("http://z/One.pdf", "earlier-one-2", ["b"], None, "Other")]
    assert rows(lineage.chains(links, docs, contracts)) == [("a", ["earlier-one", "b"]), ("b", ["earlier-one-2", "earlier-one"])]
    shown = lineage.render(lineage.chains(links, docs, contracts).withColumnRenamed("contract_id", "id"), docs.select("id", "label"))
    assert rows(shown, "id", "chain") == [("a", "T"), ("b", "Other → T")]
    assert rows(lineage.ends_incomplete(shown, docs), "id", "incomplete") == [("a", True), ("b", True)]


def test_amendment_groups(spark):
    d = spark.createDataFrame([("a", None, True, None, None, ["e"]), ("b", None, True, None, None, ["x"]), ("c", None, True, "p", None, []), ("d", None, False, "p", None, []), ("e", "earlier", False, None, None, [])], "id string, era string, amends_predecessor boolean, predecessor string, companion string, lineage array<string>")
    assert rows(lineage.amendment_groups(d), "id", "lacks_base", "linked_only") == [("a", False, False), ("b", True, False), ("c", False, True), ("d", False, False), ("e", False, False)]
    assert rows(lineage.amendment_groups(d, exporter=True), "id", "lacks_base", "linked_only") == [("a", True, False), ("b", True, False), ("c", False, True), ("d", False, True), ("e", False, False)]


def test_status_days(spark):
    day = date(2026, 1, 10)
    d = spark.createDataFrame(
        [("m1", "2026-01-09", None), ("z", "2026-01-10", None), ("p183", "2026-07-12", None), ("p184", "2026-07-13", None), ("y1", None, 2025), ("y2", None, 2026), ("y3", None, 2027), ("none", None, None), ("gap", "2030-01-01", None), ("next", "2030-01-01", None)],
        "id string, end_date string, term_end int",
    ).withColumn("term_start", F.lit(2020))
    gaps = spark.createDataFrame([("gap", 1, "Later", "x"), ("gap", 0, "Gone", None)], "contract_id string, pos int, status string, status_key string")
    cont = spark.createDataFrame([("next", "y3"), ("z", "missing")], "id string, next_id string")
    got = {x["id"]: (x["status_key"], x["status"]) for x in reports.status(d, day, gaps, cont).collect()}
    assert {k: v[0] for k, v in got.items()} == {"m1": "expired", "z": "expiring", "p183": "expiring", "p184": "current", "y1": "expired", "y2": "expiring", "y3": "current", "none": "unknown", "gap": "continued", "next": "continued"}
    assert got["gap"][1] == "Gone" and got["next"][1] == "Expired; continued, as changed by the 2020-2027 agreement"
    assert got["m1"][1] == "Expired Jan. 9, 2026; terms continue until a successor is reached"


def test_verify_reach(spark):
    gap = lambda n: "July 1, 2024" + "x" * n + " 3.25%"
    texts = spark.createDataFrame([("near", gap(100)), ("far", gap(300)), ("before", "3.250 %" + "y" * 200 + "Jul. 1,\n2024"), ("wrong", gap(3).replace("3.25", "13.25")), ("month", "the 13th month 3.25%"), ("edge", "July 1, 2024" + "x" * 245 + "3.25%"), ("over", "July 1, 2024" + "x" * 246 + "3.25%")], "contract_id string, text string")
    steps = [(i, "2024-07-01", 3.25) for i in ("near", "far", "before", "wrong", "edge", "over")] + [("month", "month-13", 3.25), ("gone", "2024-07-01", 1.0)]
    got = {x["contract_id"]: x["verified"] for x in reports.verify_steps(spark.createDataFrame(steps, "contract_id string, effective string, pct double"), texts).collect()}
    assert got == {"near": True, "far": False, "before": True, "wrong": False, "edge": True, "over": False, "month": True, "gone": False}


def test_headcounts_and_units(spark):
    u = spark.createDataFrame([("a", "Teachers", 10, True, None, "x"), ("b", "Teachers too", 10, True, "a", "x"), ("c", "Fire", 5, True, None, "y"), ("d", "Law", 3, False, None, "y")], "contract_id string, label string, headcount int, headcount_verified boolean, headcount_duplicate_of string, sector string")
    assert rows(reports.headcount_total(u)) == [(2, 15)]
    assert rows(reports.find_units(u, "cop", {"cops?": ["d"]}, ["label"]), "contract_id") == [("d",)]
    assert rows(reports.find_units(u, "teach", {}, ["label"], "x"), "contract_id") == [("a",), ("b",)]
    assert rows(reports.find_units(u, "zzz", {}, ["label"])) == []


def test_coverage_rounds_half_to_even(spark):
    pairs = spark.createDataFrame([(f"c{i}", "t", "m") for i in range(1)] + [("x", "t", "n")], "c string, topic string, type string")
    totals = spark.createDataFrame([(f"c{i}", "m") for i in range(8)] + [("x", "n")], "c string, type string")

    got = reports.coverage_matrix(pairs.withColumnRenamed("type", "k"), totals.withColumnRenamed("type", "k").withColumn("topic", F.lit("t")), "topic", "k", "c", ["m", "n"])
    assert rows(got) == [("t", 12, 100)]
