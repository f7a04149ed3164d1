import json
import zipfile

from pyspark.sql import functions as F

from foliospark.sources import readers, sinks
from foliospark.streaming import ingest


def rows(df, *cols):
    return sorted((tuple(x) for x in (df.select(*cols) if cols else df).collect()), key=repr)


def test_json_and_optional(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "n": 1}, {"id": "y"}]))
    schema = "id string, n int"
    assert rows(readers.json_array(spark, str(tmp_path / "a.json"), schema)) == [("x", 1), ("y", None)]
    assert rows(readers.optional(spark, str(tmp_path / "none.json"), schema)) == []
    assert readers.exists(spark, str(tmp_path / "*.json")) and not readers.exists(spark, str(tmp_path / "z*"))


def test_merged_maps_last_file_wins(spark, tmp_path):
    (tmp_path / "part1.json").write_text(json.dumps({"m": {"a": {"v": 1}, "b": {"v": 2}}}))
    (tmp_path / "part2.json").write_text(json.dumps({"m": {"a": {"v": 3}}}))
    assert rows(readers.merged_maps(spark, str(tmp_path / "part*.json"), "struct<v:int>", "m"), "key", "value.v") == [("a", 3), ("b", 2)]


def test_source_pairs_and_words(spark, tmp_path):
    (tmp_path / "t.js").write_text('const M = {\n "UFT": "Teachers", "237": "Local", "toolongkey": "x" };')
    assert rows(readers.source_pairs(spark, str(tmp_path / "t.js")), "key", "value") == [("237", "Local"), ("UFT", "Teachers")]
    (tmp_path / "w").write_text("Pay\npay \n\nday\n")
    assert rows(readers.word_list(spark, str(tmp_path / "w"))) == [("day",), ("pay",)]


def test_vision_and_added(spark, tmp_path):
    (tmp_path / "v.pages.json").write_text(json.dumps({"contract_id": "c", "engine": "e", "pages": [{"page": 1, "text": "a b", "confidence": 0.5}, {"page": 2, "error": "bad"}]}))
    assert rows(readers.vision_pages(spark, str(tmp_path / "*.pages.json")), "page", "text", "words", "ocr", "error") == [(1, "a b", 2, True, None), (2, "", 0, True, "bad")]
    (tmp_path / "add.json").write_text(json.dumps({"note": "n", "documents": [{"id": "b"}, {"id": "a"}]}))
    assert rows(readers.added_documents(spark, str(tmp_path / "add.json")), "pos", "id") == [(0, "b"), (1, "a")]


def test_links(spark):
    html = '<h2>Uniformed agreements</h2><a href="/olr/One-Pact.pdf"></a><a href="/olr/One-Pact.pdf">again</a><strong>Note</strong><a href="/olr/two.PDF"><b>Two</b>\n 2021</a><a href="/x/three.pdf">no</a><h3>Education Board</h3><a class=x href=\'http://h/collectivebargaining/f.pdf\'>Four</a>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert rows(readers.links(df), "section", "label", "href") == [("Education Board", "Four", "http://h/collectivebargaining/f.pdf"), ("Uniformed agreements", "One Pact", "/olr/One-Pact.pdf"), ("Uniformed agreements", "Two 2021", "/olr/two.PDF")]


def test_page_choice_and_probes(spark):
    pages = spark.createDataFrame([("c", 1, "few words", 2), ("c", 2, "word " * 30, 30), ("c", 3, "", 0)], "contract_id string, page int, text string, words int")
    rec = spark.createDataFrame([("c", 1, "now three words", 3), ("c", 2, "x " * 99, 99), ("c", 3, "", 0)], "contract_id string, page int, text string, words int")
    assert rows(readers.choose_recognised(pages, rec), "page", "words", "ocr") == [(1, 3, True), (2, 30, False), (3, 0, False)]
    items = spark.createDataFrame([("a", None), ("b", True), ("c", None)], "url string, skip_check boolean")
    probes = spark.createDataFrame([("a", 200, "%PDF-1.4"), ("c", 404, "<html>")], "url string, code int, head string")
    assert rows(readers.live_links(items, probes), "url") == [("a",), ("b",)]


def test_pdf_pages_with_an_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF" + b"x" * 2000)
    (tmp_path / "b.pdf").write_bytes(b"HTML" + b"x" * 2000)
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = readers.pdf_pages(spark, str(tmp_path / "*.pdf"), lambda b: [("good words " * 15, 1), ("", 0)])
    assert rows(got, "page", "tables", "words", "needs_ocr") == [(1, 1, 30, False), (2, 0, 0, True)]


def test_columns():
    two = [{"x0": x, "x1": x + 1, "top": 10.0 * k, "text": t} for k in range(60) for x, t in ((50, "a"), (60, "b"), (400, "c"), (410, "d"))]
    assert readers.column_count(two, 612) == 2 and readers.column_count(two[:100], 612) == 1
    text = readers.page_text(two, 612)
    assert text.split("\n")[0] == "ab" and text.split("\n")[-1] == "cd"


def docs(spark):
    none = F.lit(None)
    d = spark.createDataFrame([("a", "A MOA", "http://x/a.pdf", 2021, 2026, None, None), ("b", "B MOA", "http://x/b.pdf", None, None, "earlier", ["a"])], "id string, label string, url string, term_start int, term_end int, era string, later_ids array<string>")
    return d.withColumns({"expanded": F.col("label"), "sector": none.cast("string"), "union_full": none.cast("string"), "headcount": F.lit(5), "headcount_verified": F.col("id") == "a", "wage_verified": none.cast("string"), "wage_cumulative_pct": none.cast("double"), "summary": none.cast("string")})


def test_markdown_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "First page", False, 0), ("a", 2, "  ", False, 0), ("a", 10, "Tenth", True, 1)], "contract_id string, page int, text string, ocr boolean, tables int")
    clauses = spark.createDataFrame([("a", i, f"Head {i}", i) for i in range(6)], "contract_id string, clause_no int, heading string, page int")
    made = sinks.markdown(docs(spark), pages, clauses)
    content = {r["id"]: r["content"] for r in made.collect()}
    assert "## Contents" in content["a"] and "## Page 2" not in content["a"] and "sector" not in content["a"]
    assert content["a"].index("## Page 1") < content["a"].index("## Page 10") and "headcount_approx: 5" in content["a"]
    assert "Earlier agreement" in content["b"] and "headcount_approx" not in content["b"]
    names = sinks.write_files(made, str(tmp_path / "md"))
    back = readers.markdown_documents(spark, str(tmp_path / "md" / "*.md"))
    assert rows(back, "contract_id", "label", "term_start", "pages", "ocr_pages", "era") == [("a", "A MOA", "2021", "3", "1", None), ("b", "B MOA", None, "0", "0", "earlier")]
    assert rows(readers.markdown_pages(back), "contract_id", "page", "ocr", "text") == [("a", 1, False, "First page"), ("a", 10, True, "Tenth")]
    z1, z2 = str(tmp_path / "1.zip"), str(tmp_path / "2.zip")
    sinks.bundle(names, z1, "docs")
    sinks.bundle(list(reversed(names)), z2, "docs")
    assert open(z1, "rb").read() == open(z2, "rb").read()
    assert zipfile.ZipFile(z1).namelist() == ["docs/a.md", "docs/b.md"]


def test_text_only_and_joined(spark):
    pages = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("b", 1, None)], "contract_id string, page int, text string")
    assert rows(sinks.joined_text(pages)) == [("a", "one\n\f\ntwo"), ("b", "")]
    d = spark.createDataFrame([("a", "T", None, None, "x" * 60 + "\f\n\n\ny"), ("b", "T", "earlier", ["L1", "L2"], "z" * 60), ("c", "T", None, None, "short")], "id string, title string, era string, later_labels array<string>, text string")
    got = dict(rows(sinks.text_only(d)))
    assert set(got) == {"a", "b"} and got["a"] == "# T\n\n" + "x" * 60 + "\n\ny\n" and ": L1; L2." in got["b"]


def test_reports(spark):
    d = spark.createDataFrame([("b", None), ("a", 3)], "k string, n int")
    assert sinks.table(d, {"k": "Key", "n": "N"}, ["k"], "T").splitlines()[-2:] == ["| a | 3 |", "| b | n/a |"]
    assert "- clauses: 1,200" in sinks.about(spark.createDataFrame([(1200,)], "clauses int"), "About")
    assert "- **a**: b" in sinks.glossary(spark.createDataFrame([("a", "b")], "key string, value string"))


def test_stream_adds_each_document_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def put(name, *ids):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": i, "text": "t " + i}) for i in ids))

    def run():
        q = ingest.ingest(spark, source, "id string, text string", target, check, "id", [lambda df: df.withColumn("n", F.length("text"))])
        q.awaitTermination()
        return rows(spark.read.parquet(target), "id", "n")

    put("1.json", "a", "b", "a")
    assert run() == [("a", 3), ("b", 3)]
    put("2.json", "b", "c")
    assert run() == [("a", 3), ("b", 3), ("c", 3)]
    assert run() == [("a", 3), ("b", 3), ("c", 3)]


def test_field_kinds_explode_a_record_once(spark):
    """Fields of three depths, with fields of their own counted once, from one pass over the records."""
    from foliospark.sources import fields

    rows = spark.createDataFrame([(x,) for x in ['{"a": {"b": {"c": 1, "d": {"e": 2}}, "x": null}, "y": []}', '{"a": {}, "y": [1, 2]}', '{"a": 1}', "[1]", "broken", None, "{}"]], "j string")
    found = fields.field_kinds(fields.records(rows, "j"))
    want = {("a", "object", 2), ("a", "number", 1), ("y", "array", 2), ("a.b", "object", 1), ("a.x", "null", 1), ("a.b.c", "number", 1), ("a.b.d", "object", 1)}
    assert {tuple(r) for r in found.collect()} == want
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
