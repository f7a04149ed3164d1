"""Writers.  Content is made by expressions, a row a file; only finished text reaches the driver,
one partition at a time, where files must have names of their own."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Shared

PAGE_BREAK = "\n\f\n"


def write_stage(rows: DataFrame, path: str, by: list[str] = ()) -> DataFrame:
    """Write a stage to a new place and read it back; what a stage reads is never overwritten."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def replace_partitions(fresh: DataFrame, target: str, by: str, gone: list[str] = ()) -> None:
    """Partitions of a Parquet table that ``fresh`` has rows of, replaced by these; ``gone`` are removed as well.

    ``fresh`` is written beside the table first, so it may be made from the table.  Spark then
    writes the partitions to a staging folder and swaps those in: other partitions are neither read nor
    written, and running again after a failure gives the same table.  A partition with most of the rows is written
    by many tasks.  Partitions of ``gone`` without fresh rows are removed, which is what a source that has no new rows needs;
    it is done last, and a missing one is no matter.  A target that does not exist is made.
    """
    spark = fresh.sparkSession
    shared = Shared(spark, "partitions")
    staged = shared.save(fresh, "fresh")
    staged.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(target)
    if gone:
        jvm = spark._jvm
        left = {r[0] for r in staged.where(F.col(by).cast("string").isin(list(gone))).select(F.col(by).cast("string")).distinct().collect()}
        for value in sorted(set(gone) - left):
            where = jvm.org.apache.hadoop.fs.Path(target, jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by, value))
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    shared.drop("fresh")


def joined_text(pages: DataFrame) -> DataFrame:
    """``contract_id, text``: pages in order with page breaks between."""
    return pages.groupBy("contract_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), PAGE_BREAK).alias("text"))


def text_only(docs: DataFrame) -> DataFrame:
    """``id, content``: a title and the text, page breaks as blank lines; under 50 characters none.

    ``docs`` has ``id, title, era, later_labels, text``.
    """
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "\f", "\n\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    later = F.array_join(F.coalesce("later_labels", F.array().cast("array<string>")), "; ")
    warn = F.concat(
        F.lit("# EARLIER AGREEMENT, MAY BE SUPERSEDED: "), F.col("title"),
        F.lit("\n\n> This is an older agreement. Later documents keep parts of it in force and change others; where they conflict, the later document governs. Do not present a clause from it as current without checking the later documents"),
        F.when(later != "", F.concat(F.lit(": "), later)).otherwise(""), F.lit(".\n\n"), body, F.lit("\n"),
    )
    plain = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), body, F.lit("\n"))
    return docs.where(F.length("text") >= 50).select("id", F.when(F.coalesce("era", F.lit("")) == "earlier", warn).otherwise(plain).alias("content"))


def _line(name: str, value: Column, quoted: bool = False) -> Column:
    v = F.concat(F.lit('"'), value, F.lit('"')) if quoted else value.cast("string")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), v))


def markdown(docs: DataFrame, pages: DataFrame, clauses: DataFrame, note: str = "Verify quotations against the source PDF.") -> DataFrame:
    """``id, content``: front matter, title, contents of more than five headings, and all pages with text.

    ``docs`` has ``id, label, expanded, url, term_start, term_end, era, later_ids, sector, union_full,
    headcount, headcount_verified, wage_verified, wage_cumulative_pct, summary``.  Absent fields are left out.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    block = F.concat(F.lit('<a id="page-'), F.col("page"), F.lit('"></a>\n## Page '), F.col("page"), F.when(F.coalesce("ocr", F.lit(False)), "  ·  _OCR-reconstructed_").otherwise(""), F.lit("\n\n"), text, F.lit("\n"))
    p = pages.groupBy(F.col("contract_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.coalesce("ocr", F.lit(False))).alias("n_ocr"), F.count_if(F.coalesce("tables", F.lit(0)) > 0).alias("n_tables"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text != "", F.struct("page", block.alias("b"))))), lambda x: x["b"]), "\n").alias("blocks"),
    )
    entry = F.concat(F.lit("- ["), F.col("heading"), F.lit("](#page-"), F.coalesce("page", F.lit(0)), F.lit(")"))
    c = clauses.groupBy(F.col("contract_id").alias("id")).agg(F.count(F.lit(1)).alias("n_clauses"), F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("heading", F.lit("")) != "", F.struct("clause_no", entry.alias("e"))))), lambda x: x["e"]).alias("toc"))
    rows = docs.join(p, "id", "left").join(c, "id", "left").fillna(0, ["n_pages", "n_ocr", "n_tables", "n_clauses"])
    some = lambda x: F.nullif(F.col(x), F.lit(0))
    earlier = F.coalesce("era", F.lit("")) == "earlier"
    later = F.coalesce("later_ids", F.array().cast("array<string>"))
    front = F.concat_ws(
        "\n", F.lit("---"), _line("contract_id", F.col("id")), _line("label", F.col("label"), True), _line("expanded_label", F.col("expanded"), True), _line("term_start", some("term_start")), _line("term_end", some("term_end")), _line("source_pdf", F.col("url"), True),
        F.when(earlier, F.concat(F.lit('era: "earlier"  # older agreement, may be superseded in part by later documents\nlater_documents: '), F.to_json(later))),
        _line("pages", F.col("n_pages")), _line("ocr_pages", F.col("n_ocr")), _line("pages_with_tables", F.col("n_tables")), _line("clauses", F.col("n_clauses")), _line("sector", F.col("sector"), True), _line("union_full", F.col("union_full"), True),
        F.when(F.coalesce("headcount_verified", F.lit(False)), _line("headcount_approx", F.col("headcount"))), _line("wage_verified", F.col("wage_verified"), True), _line("wage_cumulative_pct", F.col("wage_cumulative_pct")), F.lit("---"),
    )
    term = F.when(some("term_start").isNotNull() & some("term_end").isNotNull(), F.concat(F.col("term_start").cast("string"), F.lit("–"), F.col("term_end").cast("string"))).otherwise("term n/a")
    head = F.concat_ws(
        "\n", F.concat(F.lit("\n# "), F.col("expanded")),
        F.when(earlier, F.concat(F.lit("\n> **Earlier agreement, may be superseded.** Where they conflict, the later document governs: "), F.array_join(later, ", "), F.lit("."))),
        F.concat(F.lit("\n**Term:** "), term, F.lit("  \n**Source PDF:** ["), F.col("url"), F.lit("]("), F.col("url"), F.lit(")  \n**Pages:** "), F.col("n_pages").cast("string"), F.when(F.col("n_ocr") > 0, F.concat(F.lit(" ("), F.col("n_ocr").cast("string"), F.lit(" OCR-reconstructed)"))).otherwise(""), F.lit("  \n**Clauses extracted:** "), F.col("n_clauses").cast("string")),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("\n**Workforce:** "), F.col("summary"))), F.lit(f"\n> {note}\n\n---\n"),
        F.when(F.size("toc") > 5, F.concat(F.lit("## Contents\n\n"), F.array_join("toc", "\n"), F.lit("\n\n---\n"))),
    )
    tail = F.concat(F.lit("---\n_End of contract. Source PDF: <"), F.col("url"), F.lit(">_\n"))
    return rows.select("id", F.concat_ws("\n", front, head, F.coalesce("blocks", F.lit("")), tail).alias("content"))


def table(rows: DataFrame, columns: dict[str, str], order: list, title: str, intro: str = "", missing: str = "n/a") -> str:
    """A Markdown report table of a bounded report; lines are made on the executors."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns]), F.lit(" |")).alias("l")
    body = [r["l"] for r in rows.orderBy(*order).select(line).toLocalIterator()]
    return "\n".join([f"# {title}", "", *([intro, ""] if intro else []), "| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns), *body, ""])


def about(counts: DataFrame, title: str) -> str:
    """A page of corpus counts."""
    r = counts.first().asDict()
    return "\n".join([f"# {title}", "", *[f"- {k.replace('_', ' ')}: {v:,}" for k, v in r.items()], ""])


def glossary(pairs: DataFrame, title: str = "Glossary") -> str:
    return "\n".join([f"# {title}", "", *[f"- **{r['key']}**: {r['value']}" for r in pairs.orderBy("key").toLocalIterator()], ""])


def write_files(contents: DataFrame, folder: str, ending: str = ".md") -> list[str]:
    """One local file a row of ``id, content``; rows come one partition at a time."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for r in contents.orderBy("id").toLocalIterator():
        name = os.path.join(folder, r["id"] + ending)
        with open(name, "w", encoding="utf-8", newline="") as f:
            f.write(r["content"])
        names.append(name)
    return names


def bundle(names: list[str], target: str, folder: str = "") -> str:
    """A ZIP of files, the same bytes for the same content."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(names):
            info = zipfile.ZipInfo(os.path.join(folder, os.path.basename(name)))
            info.compress_type = zipfile.ZIP_DEFLATED
            with io.open(name, "rb") as f:
                z.writestr(info, f.read())
    return target


def approved(decisions: DataFrame) -> DataFrame:
    """Approved decisions of a review as correction rules, with the documents they hold for."""
    return decisions.where("action = 'approve'").groupBy("original", "replacement").agg(F.array_sort(F.collect_set("contract_id")).alias("contracts"), F.count(F.lit(1)).alias("count"))
