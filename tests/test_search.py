from pyspark.sql import functions as F

from foliospark.functions import rules, text
from foliospark.functions.query import Families, QuerySpec, compile_query, literal, split_phrases
from foliospark.operators import search

FAMILIES = Families.of({"DC37": "District Council 37", "DC 37": "District Council 37", "UFT": "United Federation of Teachers (Local 2)", "DEA": "Detectives"})


def clauses(spark, rows):
    return spark.createDataFrame(rows, "id string, contract_id string, clause_no int, heading string, text string, topics array<string>, earlier boolean")


def ids(df):
    return [r["id"] for r in df.collect()]


def found(spark, query, *texts):
    q = compile_query(query, FAMILIES)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(search.matches(q, F.col("t"))).collect()]


def test_compiler_shapes():
    assert compile_query("  ") is None
    assert split_phrases("a “b c” d") == (["b c"], "a   d")
    q = compile_query('overtime "rate of pay"')
    assert [t.weight for t in q.terms] == [2, 1]
    assert compile_query("$ 1,000").terms[0].sources == (literal("$1,000"),)
    assert compile_query("§ 220").terms[0].sources == (literal("§ 220"),)
    assert literal("per-session").count("[-\\s]?") == 1


def test_words_and_literals(spark):
    assert found(spark, "per-session", "per session pay", "persession", "per-session", "superb session") == [True, True, True, False]
    assert found(spark, "tea", "tea time", "teas", "team", "Tea.") == [True, True, False, True]
    assert found(spark, "overt", "overtime", "covert") == [True, False]
    assert found(spark, "$1,000", "pay $1,000 now", "pay 1,000") == [True, False]
    assert found(spark, "worker's", "workers", "worker’s") == [True, True]
    assert found(spark, '"sick leave"', "sick\nleave", "sick leave", "sick  day leave") == [True, True, False]


def test_families(spark):
    assert found(spark, "UFT", "the United Federation of Teachers", "UFTs said", "uftx") == [True, True, False]
    q = compile_query("dc 37 pay", FAMILIES)
    assert q.terms[0].weight == 2 and len(q.terms) == 2
    assert found(spark, "dc 37", "District Council 37 members", "DC37") == [True, True]


def test_score_order_and_groups(spark):
    long = "x" * 400
    df = clauses(
        spark,
        [
            ("a1", "a", 1, "Pay", "overtime " + long, [], False),
            ("a2", "a", 2, "Overtime", "overtime overtime " + long, [], False),
            ("b1", "b", 3, "Pay", "overtime " + long, [], True),
            ("b2", "b", 4, "Pay", "nothing", [], True),
        ],
    )
    out = search.results(df, QuerySpec("overtime"))
    assert ids(out) == ["a2", "a1", "b1"]
    rows = {r["id"]: r for r in out.collect()}
    assert abs(rows["b1"]["score"] - 0.6 * rows["a1"]["score"]) < 1e-9
    assert abs(rows["a1"]["score"] - 1 / (1 + 409 / 12000)) < 1e-9
    assert rows["a2"]["total"] == 2
    assert ids(search.results(df, QuerySpec(""))) == ["a1", "a2", "b1", "b2"]
    assert ids(search.results(df, QuerySpec("overtime", earlier=False))) == ["a2", "a1"]
    assert search.results(df.limit(0), QuerySpec("overtime")).count() == 0


def test_ties_keep_corpus_order(spark):
    df = clauses(spark, [(f"c{i}", "a", i, None, "wage", [], False) for i in (3, 1, 2)])
    assert ids(search.results(df, QuerySpec("wage"))) == ["c1", "c2", "c3"]


def test_links_round_trip():
    spec = QuerySpec.parse("#/?q=a+b&topic=wages&compare=x,,y&earlier=0", {"wages"})
    assert spec == QuerySpec("a b", "wages", compare=("x", "y"), earlier=False)
    assert QuerySpec.parse("?" + spec.link(), {"wages"}) == spec
    assert QuerySpec.parse("?topic=none", {"wages"}).topic == ""
    assert QuerySpec().link() == ""
    assert len(QuerySpec.parse("?compare=a,b,c,d,e").compare) == 4


def test_zero_hits_and_menus(spark):
    assert search.zero_hit_topics("about holiday pay", {"holidays": "Holidays", "pay": "Pay"}) == ["holidays"]
    df = clauses(spark, [("a", "x", 1, "H", "t", ["p", "q"], False), ("b", "y", 2, "H", "t", ["p"], False)])
    assert [tuple(r) for r in search.topic_menu(df).collect()] == [("p", 2, 2), ("q", 1, 1)]
    assert [r["topic"] for r in search.shared_topics(df, ["x", "y"]).collect()] == ["p", "q"]
    assert ids(search.compare(df, QuerySpec(topic="p", compare=("x",)))) == ["a"]
    assert search.random_clause(df, QuerySpec(), 3).count() == 1


def test_contents_skip_repeats(spark):
    df = spark.createDataFrame([("c", 1, "A", None), ("c", 2, "A", None), ("c", 3, "B", "continued"), ("c", 4, "A", None), ("c", 5, "C", None)], "contract_id string, clause_no int, heading string, heading_kind string")
    assert [r["clause_no"] for r in search.table_of_contents(df).orderBy("clause_no").collect()] == [1, 5]


def test_tagger_cap_and_order(spark):
    df = spark.createDataFrame([("Overtime", "sick leave and wages"), ("", "x" * 4999 + " overtime"), (None, None), ("", "telecommuting")], "heading string, text string")
    got = [r["topics"] for r in rules.clause_topics(df).collect()]
    assert got == [["wages", "overtime", "sick-leave"], [], [], []]


def test_topics_of_whole_texts(spark, tmp_path):
    """What stands behind the tagger's cut counts where all of a text is asked for, in the query and in its SQL."""
    from foliospark.plans import catalog

    late = "x" * 20_000 + " overtime, with pay " + "y " * 20_000 + "TELEWORK"
    spark.createDataFrame([(1, late, "en"), (2, "", "wage"), (3, None, "en"), (4, "no topic", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["topics"] for r in rules.clause_topics(df.withColumnRenamed("lang", "heading"), most=None).collect()}
    assert got == {1: ["overtime", "telework"], 2: ["wages"], 3: [], 4: []}
    found = sorted(map(tuple, catalog.QUERIES["cas03_all_topics"](spark, str(tmp_path)).collect()))
    assert found == [(1, "longevity"), (1, "overtime"), (1, "telework"), (2, "wages")]
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.sql(catalog.ORACLES["cas03_all_topics"]).fetchall()) == found


def test_highlight_and_snippet(spark):
    df = spark.createDataFrame([("a <b> pay & pay", "x" * 100 + " " + "y" * 80 + " " + "z" * 90 + " pay end")], "a string, b string")
    r = df.select(text.highlight("a", "pay").alias("h"), text.snippet("b", "pay").alias("s"), text.snippet("a", "pay").alias("t")).first()
    assert r["h"] == "a &lt;b&gt; <mark>pay</mark> &amp; <mark>pay</mark>"
    assert r["s"].startswith("&hellip;") and r["s"].endswith("<mark>pay</mark> end") and "x" not in r["s"]
    assert r["t"] == r["h"]


def test_items_that_documents_hold(spark):
    """Whole words or parts of them at an item's ends, short items, repeated rows and nulls."""
    docs = [(1, "xalpha beta gamma delta epsilon zeta etay"), (2, "alpha  beta gamma delta epsilon zeta eta"), (3, "one two"), (4, "sometwothree"), (5, None), (6, ""), (7, "a b c d e f g a b c d e f g")]
    items = [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "two"), (3, "one two"), (4, "beta gamma delta"), (5, "wothr"), (6, None), (7, ""), (8, "c d e f g a b c"), (9, "nowhere to be found at all in any")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((a, b) for a, x in docs for b, y in items if x and y and y in x)
    assert sorted(map(tuple, search.containing(d, i, "doc_id", "item_id").collect())) == want
    assert search.containing(d, i.where("item_id < 0"), "doc_id", "item_id").collect() == []


def test_many_short_items(spark, monkeypatch):
    """More short items than are swept at once are found all the same."""
    d = spark.createDataFrame([(k, t) for k, t in enumerate(["one two three", "xone twox", "é b", "ab", None, "", "a", "one  two"])], "doc_id int, text string")
    i = spark.createDataFrame([(k, t) for k, t in enumerate(["one two", "e t", "é", "a", "ab", " b", "zz", "one two three four", "b"])], "item_id int, text string")
    want = sorted(map(tuple, search.containing(d, i, "doc_id", "item_id").collect()))
    monkeypatch.setattr(search, "SHORT_ITEMS", 2)
    assert sorted(map(tuple, search.containing(d, i, "doc_id", "item_id").collect())) == want and (1, 0) in want and (7, 1) not in want
