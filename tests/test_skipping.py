"""A search that skips files finds what a full scan finds, and does not open files that cannot have a hit."""

import random

import pytest

from pyspark.sql import functions as F

from foliospark.functions.query import Families, compile_query
from foliospark.functions.text import haystack
from foliospark.operators import search
from foliospark.sources import skipping

FAMILIES = Families.of({"DC37": "District Council 37", "UFT": "United Federation of Teachers (Local 2)"})
QUERIES = ["overtime", "overt", "tea", '"sick leave"', "per-session pay", "worker's", "UFT", "dc37 overtime", "$1,000", "§ 220", "!!", "naïve", "Kelvin", "rare2", "rare17 overtime", '"rare3 word"', "absentword", "x"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("skip") / "a table+%20"
    rng = random.Random(6)
    stock = ["overtime", "Teas", "sick\nleave", "sick leave", "persession", "per session", "workers’", "worker's", "the United Federation of Teachers", "UFTs", "District  Council 37", "$1,000", "§ 220", "NAÏVE naïve", "Kelvin", "Kovertime", "!!", "covert", "x", "é-overtime"]
    rows = [(k // 20, k, rng.choice(["Pay", None, "Overtime"]) if k // 20 == 3 else None, " ".join(rng.choice(stock) for _ in range(3)) + f" rare{k // 20} word" if k // 20 % 3 else (f"plain rare{k // 20} word" if k % 7 else None)) for k in range(400)]
    df = spark.createDataFrame(rows, "part int, id int, heading string, text string")
    for part in range(20):
        df.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(str(top))
    skipping.build(spark, str(top), str(top.parent / "filters"), ["heading", "text"])
    return str(top), str(top.parent / "filters")


@pytest.mark.parametrize("text", QUERIES)
def test_no_hit_is_lost(spark, table, text):
    query = compile_query(text, FAMILIES)
    hit = search.matches(query, haystack("heading", "text"))
    want = sorted(r["id"] for r in spark.read.parquet(table[0]).where(hit).collect())
    assert sorted(r["id"] for r in skipping.read(spark, *table, query).where(hit).collect()) == want


def test_files_without_the_rarer_word_are_not_read(spark, table):
    read = lambda text: skipping.read(spark, *table, compile_query(text, FAMILIES))
    assert len(read("rare17 overtime").inputFiles()) == 1 and {r["part"] for r in read("rare17 overtime").select("part").distinct().collect()} == {17}
    assert read("absentword").count() == 0 and read("absentword").columns == spark.read.parquet(table[0]).columns
    assert len(read("word").inputFiles()) == 20 and len(read("!!").inputFiles()) == 20
    assert 1 < len(read("overtime").inputFiles()) < 20


def test_files_that_the_table_does_not_know_are_read(spark, tmp_path):
    source, filters = str(tmp_path / "t"), str(tmp_path / "f")
    one = lambda text: spark.createDataFrame([(1, text)], "id int, text string").coalesce(1)
    one("first").write.parquet(source)
    skipping.build(spark, source, filters, ["text"])
    query = compile_query("second")
    assert skipping.read(spark, source, filters, query).count() == 0
    one("second").write.mode("append").parquet(source)
    assert [r["text"] for r in skipping.read(spark, source, filters, query).collect()] == ["second"]
    one("a second text in the old place").write.mode("overwrite").parquet(source)
    assert skipping.read(spark, source, filters, query).count() == 1


def test_needed_grams():
    assert skipping.needed("Per-Session") == ["^per", "ess", "ion", "per", "ses", "sio", "ssi"]
    assert skipping.needed("$1,000") == ["000"] and skipping.needed("§!") == [] and skipping.needed("extraordinary")[0] == "^extraordin"
