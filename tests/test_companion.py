import json

from pyspark.sql import functions as F

from foliospark.functions import labels
from foliospark.sources import companion, fetch

ACRONYMS = {"UFT": "United Federation of Teachers", "DC37": "District Council 37", "CWA": "Communications Workers", "USA": "Sanitationmen"}
PARENTS = {"1180": "CWA Local 1180", "237": "Teamsters Local 237"}


def test_labels(spark):
    asked = ["UFT MOA 2022-2027", "DC37 L1180 MOA", "DC 37 Agreement", "CWA 1180 MOA", "Local 237 MOU", "L237 x", "Bridge MOA", "MOAT", "USA MOA", "", None, "CWA 9999 MOA"]
    df = spark.createDataFrame([(x,) for x in asked], "l string")
    got = [r[0] for r in df.select(labels.expand(F.col("l"), ACRONYMS, PARENTS, ["Bridge", "USA"])).collect()]
    assert got == [
        "United Federation of Teachers (UFT) — Memorandum of Agreement 2022-2027", "District Council 37 Local 1180 (DC37 Local 1180) — Memorandum of Agreement", "District Council 37 (DC37) — Agreement", "Communications Workers Local 1180 (CWA Local 1180) — Memorandum of Agreement",
        "Teamsters Local 237 — Memorandum of Understanding", "Teamsters Local 237 — x", "Bridge Memorandum of Agreement", "MOAT", "USA Memorandum of Agreement", "", None, "Communications Workers (CWA) — 9999 Memorandum of Agreement",
    ]
    got = [r[0] for r in df.select(labels.expand_for_export(F.col("l"), ACRONYMS)).collect()]
    assert got[0] == "United Federation of Teachers (UFT) — Memorandum of Agreement 2022-2027" and got[7] == "Memorandum of AgreementT" and got[5] == "L237 x"


def test_fetching(tmp_path):
    calls = []

    def opener(url, timeout):
        calls.append(url)
        if "bad" in url:
            raise OSError("no")
        return b"%PDF" + b"x" * 2000 if url.endswith("pdf") else b"<html>"

    cache = str(tmp_path / "c" / "p.html")
    assert fetch.page("http://x/", cache, opener) == fetch.page("http://x/", cache, opener) == "<html>" and len(calls) == 1
    items = [("a", "http://x/a.pdf"), ("b", "http://x/b.html"), ("c", "http://x/bad")]
    assert fetch.pdfs(items, str(tmp_path / "pdf"), opener, pause=0) == {"ok": 1, "skip": 0, "fail": 2}
    assert fetch.pdfs(items, str(tmp_path / "pdf"), opener, pause=0) == {"ok": 0, "skip": 1, "fail": 2}

    def read(image):
        if image == b"2":
            raise RuntimeError("blurred")
        return "text", 0.9

    target = str(tmp_path / "r.json")
    assert [p.get("error") for p in fetch.recognise("c", [b"1", b"2"], target, read, "e")["pages"]] == [None, "blurred"]
    assert fetch.recognise("c", [b"1"], target, read, "e") is None and json.load(open(target))["engine"] == "e"


def contracts(spark):
    rows = [
        ("a", "Alpha", None, "moa", 10, True, [("e")], None, None, 2021, 2026, 1, 2, None, None), ("b", "beta", None, "full", 30, True, [], {"id": "a"}, None, None, None, None, None, None, None),
        ("c", "Gamma", None, "moa", 20, True, [], None, {"url": "http://u", "label": "Old", "term": "2010", "note": None}, 2021, 2026, 0, 3, None, None), ("d", "Delta", None, "moa", None, True, [], None, None, None, None, None, None, None, "ask them"),
        ("e", "Early", "earlier", None, 5, False, [], None, None, 2001, 2005, None, None, ["a", "gone"], None),
    ]
    return spark.createDataFrame(rows, "id string, label string, era string, doc_type string, chars int, amends_predecessor boolean, lineage array<string>, companion struct<id:string>, predecessor struct<url:string,label:string,term:string,note:string>, term_start int, term_end int, ocr_pages int, total_pages int, later_ids array<string>, base_note string")


def test_reports(spark):
    c = contracts(spark)
    text = companion.index(c)
    assert "| Alpha | 2021–2026 | 1 of 2 |" in text and "| Early | 2001–2005 | Alpha |" in text and text.index("| Alpha") < text.index("| beta") < text.index("| Gamma")
    text = companion.underlying(c)
    assert "| Alpha | Early |" in text and "| beta | Alpha |" in text and "| Gamma | Old | 2010 | http://u |" in text and "| Delta | ask them |" in text
    clauses = spark.createDataFrame([("a", ["x"]), ("c", ["x", "y"]), ("b", ["y"])], "contract_id string, topics array<string>")
    text = companion.document_types(c.where("era IS NULL"), clauses, ["full", "moa"])
    assert "| full | 1 | 30 |" in text and "| moa | 3 | 10 |" in text and "| x | 0 | 67 |" in text and "| y | 100 | 33 |" in text
    u = spark.createDataFrame([("A", "U", 1500, True, True, None), ("B", "V", 9, False, True, None)], "contract_label string, union_full string, headcount int, headcount_verified boolean, curated boolean, headcount_duplicate_of string")
    assert "| A | U | 1,500 |" in companion.units(u) and "| B | V | n/a |" in companion.units(u) and "headcount: 1,500" in companion.cautions(u)
    w = spark.createDataFrame([("A", [("2024-01-01", 3.0)], 3.0, True, 1)], "contract_label string, increases array<struct<effective:string,pct:double>>, cumulative_pct double, curated boolean, n int")
    assert "| A | 2024-01-01: 3.00% | 3.0 |" in companion.wages(w, "n")
