from pyspark.sql import functions as F

from foliospark.operators import segment


def cut(spark, *docs, pages=None):
    df = spark.createDataFrame([(i, "Label " + i, t) for i, t in docs], "contract_id string, label string, text string")
    return [(r["id"], r["article"], r["section"], r["heading"], r["text"], r["page"], r["ocr"]) for r in segment.segment(df, pages).orderBy("contract_id", "clause_no").collect()]


def test_whole_and_empty(spark):
    assert cut(spark, ("a", " just text\n"), ("b", ""), ("c", None)) == [("a__whole", None, None, "Label a", "just text", 1, False), ("b__whole", None, None, "Label b", "", 1, False), ("c__whole", None, None, "Label c", "", 1, False)]


def test_preamble_edge(spark):
    head = "\nARTICLE I\n" + "body " * 100
    assert [r[0] for r in cut(spark, ("a", "p" * 80 + head), ("b", "p" * 79 + head))] == ["a__preamble", "a__0", "b__0"]


def test_carry_gaps_and_toc(spark):
    text = "ARTICLE I - PAY\nfirst body text here\nARTICLE II\nSection 1. Scope\nsecond body text here\n2. OTHER RULES\nthird body\nARTICLE IX ....... 4\nGRIEVANCES AND DISPUTES\nlast body"
    got = cut(spark, ("a", text))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [("a__0", "I", None, "Article I — PAY"), ("a__2", "II", "1", "Section 1 — Scope"), ("a__3", "II", "2", "Section 2 — OTHER RULES"), ("a__4", "II", None, "GRIEVANCES AND DISPUTES")]
    assert got[2][4] == "third body\nARTICLE IX ....... 4"


def test_page_fallback_and_ocr(spark):
    text = "\n".join(["SOME HEADING LINE"] * 30) + "\nshort\f\fthird page text"
    pages = spark.createDataFrame([("a", 3, True), ("b", 2, True)], "contract_id string, page int, ocr boolean")
    got = cut(spark, ("a", text), ("b", "x\fy"), pages=pages)
    assert [(r[0], r[5], r[6]) for r in got] == [("a__page1", 1, False), ("a__page3", 3, True), ("b__whole", 1, True)]


def test_coverage_property(spark):
    texts = [("d%d" % i, ("word " * (i * 13 % 50) + "\nARTICLE %d\n" % i) * (i % 5) + "tail " * i) for i in range(1, 25)]
    df = spark.createDataFrame([(i, i, t) for i, t in texts], "contract_id string, label string, text string")
    share = segment.coverage(segment.segment(df), df).where("solid > 200").agg(F.min("share")).first()[0]
    assert share >= 0.70


def test_page_of_offset(spark):
    offsets = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("a", 20, 3)], "contract_id string, start int, page int")
    ask = spark.createDataFrame([("a", 1, 0), ("a", 2, 9), ("a", 3, 10), ("a", 4, 99), ("b", 5, 7)], "contract_id string, lookup int, offset int")
    got = {r["lookup"]: r["page"] for r in segment.page_of_offset(offsets, ask).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 1}


RULES = dict(signers=["JANE DOE"], signatures=r"^(AGREED AND ACCEPTED.*)$", letterheads=r"^(OFFICE OF LABOR)$", captions=r"^(NOTICE)$", fragments=r"^(HOURLY|TITLES)$")


def test_relabel_is_idempotent(spark):
    body = "x" * 50
    rows = [("a", 1, "HOURLY", body), ("a", 2, "Pay", body), ("a", 3, "TITLES", body), ("a", 4, "JANE DOE JANE DOE", body), ("a", 5, "OFFICE OF LABOR", "Re: Sick leave.\n" + body), ("a", 6, "OFFICE OF LABOR", "Dear Sir " + body), ("a", 7, "NOTICE", body), ("a", 8, "2021", "tiny"), ("b", 1, "TITLES", body)]
    df = spark.createDataFrame(rows, "contract_id string, clause_no int, heading string, text string")
    once = segment.relabel(df, **RULES)
    got = [r["heading"] for r in once.orderBy("contract_id", "clause_no").collect()]
    assert got == ["Rate and leave tables", "Pay", "Pay (continued)", "Signatures", "Letter: Sick leave", "Side letter", "Caption", "Pay (continued)", "Untitled section"]
    cols = ["contract_id", "clause_no", "heading", "heading_raw", "heading_kind"]
    twice = segment.relabel(once, **RULES)
    assert sorted(map(tuple, twice.select(cols).collect()), key=repr) == sorted(map(tuple, once.select(cols).collect()), key=repr)
    assert once.where("heading = 'Pay'").first()["heading_raw"] is None


def test_spans_are_written_once_and_read_by_every_kind_of_clause(spark):
    docs = spark.createDataFrame([("a", "L", "ARTICLE I - PAY\nText of pay.")], "contract_id string, label string, text string")
    plan = segment.segment(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate posexplode(split(text") <= 1
