import random

from pyspark.sql import functions as F

from foliospark.functions import rules, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_slugs_and_terms(spark):
    r = one(spark, text.slugify(F.lit("Café — L’Été 2023–2028 / DC 37")), text.slug_of_url(F.lit("http://x/a/My%20File-2.PDF")), text.slugify(F.lit("a" * 79 + " b")), *text.term_anywhere(F.lit("x 2021 – 2026 y 2000-2001")), *text.term_at_end(F.lit("x 2021 to 2026 ")), *text.term_anywhere(F.lit("none")))
    assert r[0] == "cafe-lete-20232028-dc-37"
    assert r[1] == "earlier-my-file-2"
    assert r[2] == "a" * 79 + "-"
    assert tuple(r[3:]) == (2021, 2026, 2021, 2026, None, None)


def test_dates(spark):
    r = one(spark, text.ap_date(F.lit("2024-09-05")), text.ap_date(F.lit(None).cast("string")), text.step_date(F.lit("month-1")), text.step_date(F.lit("month-13")), text.step_date(F.lit("on-ratification")), text.step_date(F.lit("2024-05-01")), text.step_date(F.lit("2024-05")), text.step_date(F.lit("x-on-ratification")), text.step_date(F.lit(None).cast("string")), text.facts_date(F.lit("month-1")), text.facts_date(F.lit("month-2")), text.facts_date(F.lit("2024-03-09")))
    assert list(r) == ["Sept. 5, 2024", "", "Day 1 of unit agreement", "Month 13", "On ratification", "May 1, 2024", "May 2024", "x on ratification", "", "First day of the term", "First day of month 2", "March 9, 2024"]


def test_compounded_goldens(spark):
    a = lambda *x: text.compounded(F.array(*map(lambda v: F.lit(float(v)), x)))
    r = one(spark, a(3, 3, 3, 3, 3.25), a(3.25, 3.25, 3.5, 3.5, 4), a(2.25, 2.5, 3, 3.25, 3.25, 3.5, 3.5, 4), a(3, 3, 3, 3.25, 3.5), text.compounded(F.array().cast("array<double>")))
    assert list(r) == [16.21, 18.77, 28.21, 16.77, None]


def test_medians_and_ratios(spark):
    m = lambda *x: text.upper_median(F.array(*map(F.lit, x)))
    r = one(spark, m(7, 1, 5, 3), m(2, 1, 3), text.letters_share(F.lit("")), text.letters_share(F.lit("ab##")), text.page_needs_recognition(F.lit("#" * 50), F.lit(30)), text.page_needs_recognition(F.lit(""), F.lit(30)), text.page_needs_recognition(F.lit("fine"), F.lit(19)))
    assert list(r) == [5, 2, 0.0, 0.5, True, False, True]


def test_extraction(spark):
    t = F.lit("rates of 3.25 % and 9.50% and 0.25%; $1,000 lump sum, $100 bonus, $ 2500 payment")
    late = F.lit("x" * 8000 + " 3.25%")
    r = one(spark, text.percents(t), text.lump_sums(t), text.percents(late))
    assert list(r) == [[3.25], [1000, 2500], []]


def test_small_functions(spark):
    r = one(
        spark, text.first_sentence(F.lit("The union is recognized as the agent. More.")), text.first_sentence(F.lit("Short. x")), text.after_mark(F.lit("a Caveat: b ")), text.after_mark(F.lit(None).cast("string")), text.short_label(F.lit("Union — MOA 2021")),
        text.chip_label(F.lit("Teachers (UFT)"), F.lit("U — MOA")), text.chip_label(F.lit("Guild, Local 3"), F.lit("MOA")), text.escape_html(F.lit("<'&\">"), True), text.context(F.lit("a" * 100 + "MID\n" + "b" * 100), F.lit(100), F.lit(103), 5),
    )
    assert list(r) == ["The union is recognized as the agent.", None, "b", "", "MOA 2021", "UFT: MOA", "Guild: MOA", "&lt;&#39;&amp;&quot;&gt;", "…aaaaaMID bbbb…"]


def test_citation_leaves_out_what_is_missing(spark):
    lit = F.lit
    r = one(spark, text.citation(lit(" T "), lit("L"), lit("L"), lit(3), lit(None).cast("string"), lit("k"), lit(True), "S"))
    assert r[0].split("\n") == ["T", "— L, p. 3.", "Via S: k", "Note: this page was transcribed via OCR — verify wording against the source PDF before publication."]


def test_reflow(spark):
    wrapped = "This line of prose is surely long enough to be\nwrapped and it goes on until it has a hyphen-\nated word that ends the sentence somewhere here.\nNext"
    table = "a 1\nb 2\nc 3"
    label = "This line is long enough but ends in a label:\nvalue"
    df = spark.createDataFrame([(wrapped,), (table,), (wrapped + "\n\n" + table,), (label,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.reflow("t")).collect()]
    joined = "This line of prose is surely long enough to be wrapped and it goes on until it has a hyphenated word that ends the sentence somewhere here.\nNext"
    assert got == [joined, table, joined + "\n\n" + table, label, "", None]


def test_table_markdown(spark):
    r = one(spark, text.table_markdown(F.array(F.array(F.lit("a"), F.lit("b\n c")), F.array(F.lit("1"), F.lit(None).cast("string")))), text.table_markdown(F.array().cast("array<array<string>>")))
    assert r[0] == "| a | b c |\n| --- | --- |\n| 1 |  |" and r[1] == ""


def test_corrections_orders(spark):
    df = spark.createDataFrame([("x", "a b ab"), ("y", "a"), ("z", None)], "contract_id string, text string")
    listed = [("a", "b", ["x"]), ("b", "c", [])]
    out = {r["contract_id"]: (r["text"], r["n_corrections"]) for r in rules.correct(df, listed).collect()}
    assert out == {"x": ("c c ab", 3), "y": ("a", 0), "z": ("", 0)}
    out = {r["contract_id"]: r["text"] for r in rules.correct(df, listed, order="global_first").collect()}
    assert out["x"] == "b c ab"
    out = rules.correct(df, [("a", "$1\\", [])] * 45).where("contract_id = 'y'").first()
    assert out["text"] == "$1\\" and out["n_corrections"] == 1


def test_sectors_and_document_types(spark):
    labels = ["Detectives MOA", "UFA Fire", "UFT Teachers", "Plumbers", "Something"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(rules.sector_of(F.col("l"))).collect()]
    assert got == ["uniformed-police", "uniformed-fire", "education", "skilled-trades", "other"]
    art = "\n".join(f"ARTICLE {i}\nbody" for i in range(1, 14))
    rows = [
        ("a", "This INDENTURE made", []), ("b", "Memorandum of Economic Agreement. all other terms shall remain", []), ("c", "before the Comptroller, memorandum of agreement: Consent Determination", []), ("d", "the UOCEA letter", []),
        ("e", "executed contract " + art, []), ("f", "x" * 40001, ["Article 1"] * 8), ("g", "terms of the predecessor agreement are continued", []), ("h", "x" * 40001, ["Article 1"] * 4), ("i", None, None),
    ]
    df = spark.createDataFrame(rows, "label string, text string, headings array<string>")
    got = {r["label"]: (r["doc_type"], r["amends_predecessor"]) for r in rules.classify_documents(df).collect()}
    assert got == {"a": ("consent-determination", False), "b": ("moa", True), "c": ("consent-determination", False), "d": ("unit-agreement", False), "e": ("full-agreement", False), "f": ("full-agreement", False), "g": ("moa", True), "h": ("full-agreement", False), "i": ("moa", False)}
    ev = rules.classify_documents(df).where("label = 'g'").first()["amends_evidence"]
    assert ev == "terms of the predecessor agreement are continued"


def test_indexed_corrections_equal_the_plain_fold(spark):
    """Rules that bring in words of later rules, that join words, scoped, without a word, and repeated."""
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "naïve", "x1", "a-b", "b", "-b", "c.", "é", "f_g", "two words", "beta gamma", "...", "a", "'s"]
    made = [(rng.choice(words), rng.choice([*words, "", "$1 \\", "-", "q"]), rng.choice([[], [], ["x"], ["y", "z"]])) for _ in range(60)]
    texts = [" ".join(rng.choice([*words, "plain", "betamax", "a-b-c", "\n"]) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "alpha " * 300]
    docs = spark.createDataFrame([(i, rng.choice(["x", "y", "w", None]), t) for i, t in enumerate(texts)], "doc_id int, contract_id string, text string")
    for order in ("list", "global_first"):
        plain = rules.correct(docs, made, order=order, step=1000).orderBy("doc_id").collect()
        assert plain == rules.correct_indexed(docs, made, order=order).orderBy("doc_id").collect()
        assert plain == rules.correct_indexed(docs, made, order=order, at_once=7).orderBy("doc_id").collect()
    assert sum(r["n_corrections"] for r in plain) > 300


def test_texts_meet_only_their_rules():
    index = rules.RuleIndex([("b", "c", []), ("a", "b", []), ("b", "d e", []), ("z", "y", []), ("e", "f", ["x"]), ("d f", "g", []), ("q", "r", [])])
    assert index.correct("a", "x") == ("g", 4, 4)
    assert index.correct("a b", "w") == ("d e c", 3, 4)
    assert index.correct("none of them", None) == ("none of them", 0, 0)


def test_many_rules_on_a_long_text():
    """Work follows the words of a text: every rule applies once, in order, and joins nothing anew."""
    chain = [(f"w{k}", f"w{k + 1}", []) for k in range(20_000)]
    text, n, tried = rules.RuleIndex(chain).correct("w0 " + "plain words " * 50_000, "x")
    assert text.startswith("w20000 plain") and n == tried == 20_000


def test_patterns_that_start_words_share_their_first_tests(spark):
    from foliospark.functions import fixed, rules

    assert all(rules.any_of(p).startswith("(?=[") for p in fixed.TOPICS.values())
    assert rules.any_of([r"\bno|so", r"\bx"]) == r"(?:\bno|so)|(?:\bx)"
    assert rules.any_of([r"\bx?y"]) == r"(?:\bx?y)" and rules.any_of([r"\$[0-9]"]) == r"(?:\$[0-9])"
    texts = ["Wages", "xwages wage", "O.T. due", "éwages", "no-strike; RIF", "step 5", "", "_tour tour_ TOUR", "unsalary", "child\nbonding and DEI"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    plain = F.array_compact(F.array(*[F.when(F.col("t").rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(k)) for k, ps in fixed.TOPICS.items()]))
    assert df.where(rules.tags(F.col("t"), fixed.TOPICS) != plain).count() == 0
