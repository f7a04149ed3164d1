"""Readers: JSON arrays, optional files, link pages, page tables, Markdown exports, binaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text
from ..session import ship
from . import soup


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON array file, or of all files of a pattern."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern finds anything, in any store that Spark can open."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def optional(spark: SparkSession, path: str, schema: T.StructType | str, read: Callable = json_array) -> DataFrame:
    """The same, or no rows where the file is missing."""
    return read(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def merged_maps(spark: SparkSession, pattern: str, value_schema: str, field: str) -> DataFrame:
    """``key, value`` of objects in all files of a pattern; of a key, the last file's counts."""
    rows = spark.read.schema(f"`{field}` map<string, {value_schema}>").option("multiLine", True).json(pattern).withColumn("file", F.input_file_name())
    entries = rows.select("file", F.explode(field).alias("key", "value"))
    return entries.groupBy("key").agg(F.max_by("value", "file").alias("value"))


def source_pairs(spark: SparkSession, path: str, longest_key: int | None = 8) -> DataFrame:
    """``key, value, pos``: quoted pairs in a source file that holds a table; keys of at most so many characters."""
    body = spark.read.text(path, wholetext=True).select("value")
    pattern = r'"([^"\n]+)"\s*:\s*"([^"\n]*)"'
    pairs = body.select(F.posexplode(F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("value"))).alias("pos", "kv"))
    out = pairs.select("kv.key", "kv.value", "pos")
    return out.where(F.length("key") <= longest_key) if longest_key else out


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case words, one a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def vision_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """``contract_id, page, text, words, ocr, engine, confidence`` of recognised pages; failed pages are empty."""
    schema = "contract_id string, engine string, pages array<struct<page:int, text:string, confidence:double, char_count:int, error:string>>"
    rows = json_array(spark, pattern, schema).select("contract_id", "engine", F.explode("pages").alias("p"))
    body = F.coalesce("p.text", F.lit(""))
    return rows.select("contract_id", F.col("p.page").alias("page"), body.alias("text"), text.space_count(body).alias("words"), F.lit(True).alias("ocr"), "engine", F.col("p.confidence").alias("confidence"), F.col("p.error").alias("error"))


def added_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an ingest list, in its order."""
    schema = "note string, documents array<struct<id:string, label:string, source:string, section:string, url:string>>"
    return json_array(spark, path, schema).select(F.posexplode("documents").alias("pos", "d")).select("pos", "d.*")


def page_counts(contracts: DataFrame, pages: DataFrame) -> DataFrame:
    """``ocr_pages, total_pages`` of each document, null where it has no page table."""
    n = pages.groupBy("contract_id").agg(F.count_if(F.coalesce("ocr", F.lit(False))).alias("ocr_pages"), F.count(F.lit(1)).alias("total_pages"))
    return contracts.join(n.withColumnRenamed("contract_id", "id"), "id", "left")


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: str = r"(?i)\.pdf$", also: str | None = r"(?i)collectivebargaining|olr", section_words: str | None = fixed.SECTION_WORDS) -> DataFrame:
    """``id, pos, section, label, href``: links of a page in order, each under the last heading above it.

    Pages are read by ``soup.Walk``, so unclosed and nested tags, attributes without quotes, comments and
    scripts are no matter.  A heading counts if it is under 120 characters and has one of the section
    words (a pattern).  Of links to one place the first is kept; a link without text takes its file name.  A null page has
    no links, a repeated page gives its links again.
    """
    ship(pages.sparkSession)
    picked = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    found = picked.mapInArrow(soup.read_links(section_words), f"id {dict(picked.dtypes)['id']}, pos int, section string, label string, href string").withColumnRenamed("id", id_col)
    found = found.where(F.col("href").rlike(keep))
    if also:
        found = found.where(F.col("href").rlike(also))
    name = F.initcap(F.replace(F.regexp_replace(F.element_at(F.split("href", "/"), -1), r"(?i)\.pdf", ""), F.lit("-"), F.lit(" ")))
    return found.withColumn("label", F.when(F.col("label") == "", name).otherwise(F.col("label")))


_FIELDS = ["contract_id", "label", "expanded_label", "term_start", "term_end", "source_pdf", "era", "later_documents", "pages", "ocr_pages", "pages_with_tables", "clauses", "sector", "union_full", "headcount_approx", "wage_verified", "wage_cumulative_pct"]


def markdown_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Front matter and body of Markdown exports; absent fields are null."""
    raw = spark.read.text(pattern, wholetext=True).where(F.col("value").startswith("---"))
    parts = F.split("value", r"(?m)^---\s*$", 3)
    rows = raw.select(F.get(parts, F.lit(1)).alias("head"), F.get(parts, F.lit(2)).alias("body"))

    def field(name: str) -> Column:
        return text.some(F.regexp_replace(F.regexp_extract("head", rf"(?m)^{name}:[ ]*(\"[^\"]*\"|.*?)[ ]*(?:#.*)?$", 1), '^"|"$', "")).alias(name)

    return rows.select(*map(field, _FIELDS), "body")


def markdown_pages(documents: DataFrame) -> DataFrame:
    """``contract_id, page, ocr, text``: page blocks of Markdown exports."""
    blocks = F.slice(F.split("body", r"(?m)^(?=## Page \d+)"), 2, 100_000)
    rows = documents.select("contract_id", F.explode(blocks).alias("b"))
    body = F.regexp_replace("b", r"^## Page \d+[^\n]*\n", "")
    body = F.regexp_replace(body, r"(?s)\n---\n_End of contract\..*$", "")
    body = F.regexp_replace(body, r"\s*<a id=\"page-\d+\"></a>\s*$", "")
    return rows.select("contract_id", F.regexp_extract("b", r"^## Page (\d+)", 1).cast("int").alias("page"), F.contains("b", F.lit("_OCR-reconstructed_")).alias("ocr"), F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")).alias("text"))


def pdf_pages(spark: SparkSession, pattern: str, extract: Callable[[bytes], list[tuple[str, int]]] | None = None) -> DataFrame:
    """``path, page, text, tables, words, needs_ocr`` of PDF files, a task a file.

    ``extract`` turns a file's bytes into (text, number of tables) of each page; without one
    a PDF library is needed.  A file that is no PDF, or fails, gives no pages.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(pattern).where("length > 1000").select("path", "content")
    extract = extract or _plumber

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if bytes(content[:4]) == b"%PDF":
                    out += [(path, k, t, n) for k, (t, n) in enumerate(extract(bytes(content)), 1)]
            yield pd.DataFrame(out, columns=["path", "page", "text", "tables"])

    pages = files.mapInPandas(run, "path string, page int, text string, tables int").withColumn("words", text.word_count("text"))
    return pages.withColumn("needs_ocr", text.page_needs_recognition("text", "words"))


def _plumber(content: bytes) -> list[tuple[str, int]]:
    import io

    import pdfplumber  # not part of the base install

    out = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            try:
                out.append((page_text(page.chars, page.width), len(page.find_tables())))
            except Exception:  # noqa: BLE001  a page that cannot be read is an empty page
                out.append(("", 0))
    return out


def column_count(chars: list[dict], width: float | None) -> int:
    """Columns of a page by where its characters' middles lie: two if the halves are balanced and
    the gutter is nearly empty."""
    if len(chars) < 200:
        return 1
    width = width or 612
    middles = [(c["x0"] + c["x1"]) / 2 for c in chars]
    left = sum(x < width / 2 for x in middles)
    right = len(middles) - left
    gutter = sum(abs(x - width / 2) < width * 0.04 for x in middles) / len(middles)
    return 2 if min(left, right) / max(left, right) > 0.4 and gutter < 0.05 else 1


def page_text(chars: list[dict], width: float | None) -> str:
    """Text of positioned characters, line by line; the left column before the right."""
    halves = [chars]
    if column_count(chars, width) == 2:
        middle = (width or 612) / 2
        halves = [[c for c in chars if (c["x0"] + c["x1"]) / 2 < middle], [c for c in chars if (c["x0"] + c["x1"]) / 2 >= middle]]
    out = []
    for half in halves:
        lines: dict[int, list[dict]] = {}
        for c in half:
            lines.setdefault(round(c["top"] / 3), []).append(c)
        for _, line in sorted(lines.items()):
            out.append("".join(c["text"] for c in sorted(line, key=lambda c: c["x0"])))
    return "\n".join(out)


def choose_recognised(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages with recognised text where they need it and it has strictly more words."""
    r = recognised.select("contract_id", "page", F.col("text").alias("__t"), F.col("words").alias("__w"))
    better = text.page_needs_recognition("text", "words") & (F.coalesce("__w", F.lit(0)) > F.coalesce("words", F.lit(0)))
    out = pages.join(r, ["contract_id", "page"], "left").withColumn("ocr", F.coalesce(better, F.lit(False)))
    return out.withColumns({"text": F.when(F.col("ocr"), F.col("__t")).otherwise(F.col("text")), "words": F.when(F.col("ocr"), F.col("__w")).otherwise(F.col("words"))}).drop("__t", "__w")


def live_links(items: DataFrame, probes: DataFrame) -> DataFrame:
    """Items whose URL a probe found alive, or that are exempt: ``probes(url, code, head)``."""
    alive = probes.where((F.col("code") == 200) & (F.col("head").startswith("%PDF") | F.lower("head").contains("<html") | F.lower("head").contains("<!doctype"))).select("url").distinct().withColumn("__ok", F.lit(True))
    return items.join(alive, "url", "left").where(F.coalesce("skip_check", F.lit(False)) | F.coalesce("__ok", F.lit(False))).drop("__ok")
