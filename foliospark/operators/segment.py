"""Splitting documents into sections by heading lines, with safe fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import some
from ..shared import Shared

_BLANK = r"[\s ]"


def lines_of(docs: DataFrame, id_col: str = "contract_id") -> DataFrame:
    """``id, line_no, page, line``: text lines in order; a form feed ends a line and a page."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    pages = docs.select(F.col(id_col), F.posexplode(F.split(text, "\f")).alias("p", "body"))
    flat = pages.select(F.col(id_col), (F.col("p") + 1).alias("page"), F.posexplode(F.split("body", "\n")).alias("k", "line"))
    order = Window.partitionBy(id_col).orderBy("page", "k")
    return flat.withColumn("line_no", F.row_number().over(order) - 1).drop("k")


def heading_kind(line: Column) -> Column:
    """``struct(level, num, title)`` of a trimmed heading line, null for any other line.

    A dotted line is a table of contents.  Articles, then sections, numbered lines of at most
    80 characters, and lines in capitals of 5 to 60.
    """

    def of(level: str, pattern: str, number: int, title: int) -> Column:
        num = F.regexp_extract(line, pattern, number) if number else F.lit("")
        return F.struct(F.lit(level).alias("level"), num.alias("num"), F.trim(F.regexp_extract(line, pattern, title)).alias("title"))

    return (
        F.when((line == "") | F.contains(line, F.lit("....")), None)
        .when(line.rlike(fixed.ARTICLE_LINE), of("article", fixed.ARTICLE_LINE, 1, 2))
        .when(line.rlike(fixed.SECTION_LINE), of("section", fixed.SECTION_LINE, 1, 2))
        .when(line.rlike(fixed.NUMBERED_LINE) & (F.length(line) <= 80), of("section", fixed.NUMBERED_LINE, 1, 2))
        .when(line.rlike(fixed.CAPITALS_LINE) & F.length(line).between(5, 60), of("section", fixed.CAPITALS_LINE, 0, 1))
    )


def _solid(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _BLANK, ""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def spans(lines: DataFrame, is_boundary: Column, id_col: str = "contract_id") -> DataFrame:
    """Lines with the number of the span they belong to: 0 before the first boundary.

    One running count in line order, so a document is sorted once; linear in its lines."""
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("span", F.sum(is_boundary.cast("int")).over(w))


def segment(docs: DataFrame, pages: DataFrame | None = None, id_col: str = "contract_id", least_coverage: float = 0.70) -> DataFrame:
    """Clauses of documents with ``contract_id, label, text``.

    Without a heading the whole text is one clause.  Text of at least 80 solid characters
    before the first heading is a preamble.  Articles carry forward to the sections under
    them.  Clauses without text go, which leaves gaps in ids.  Where clauses hold
    under ``least_coverage`` of more than 200 solid characters, the document is cut by page
    instead.  ``pages(contract_id, page, ocr)`` marks recognised pages.

    A document is one key: its lines are sorted once, and all other work is grouped by span.  Spans are
    written once, for four kinds of clauses read them.
    """
    shared = Shared(docs.sparkSession, "segment")
    raw = lines_of(docs, id_col)
    trimmed = raw.withColumn("h", heading_kind(_strip(F.col("line"))))
    marked = spans(trimmed, F.col("h").isNotNull(), id_col)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("line_no", "page", "line")))), lambda x: x["line"]), "\n")
    grouped = marked.groupBy(id_col, "span").agg(_strip(body).alias("text"), F.max("h").alias("h"), F.min("page").alias("page"))
    carry = Window.partitionBy(id_col).orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    article = F.when(F.col("h.level") == "article", F.struct(F.col("h.num").alias("n"), F.col("h.title").alias("t")))
    grouped = grouped.withColumn("a", F.last(article, ignorenulls=True).over(carry)).withColumn("size", _solid(F.col("text")))
    grouped = shared.save(grouped, "spans")
    whole = docs.select(F.col(id_col), "label", _solid(F.coalesce("text", F.lit(""))).alias("solid"))
    counted = grouped.groupBy(id_col).agg(F.max("span").alias("n_headings"), F.sum(F.when((F.col("span") > 0) | (F.col("size") >= 80), F.col("size")).otherwise(0)).alias("held"))
    info = whole.join(counted, id_col, "left")
    mode = F.when(F.coalesce("n_headings", F.lit(0)) == 0, "whole").when((F.col("solid") > 200) & (F.col("held") / F.col("solid") < least_coverage), "pages").otherwise("headings")
    info = shared.save(info.select(id_col, "label", mode.alias("mode")), "modes")
    named = grouped.join(info, id_col)

    def clause(rows: DataFrame, no: Column, ident: Column, heading: Column, text: Column, page: Column, art=None, sec=None) -> DataFrame:
        nothing = F.lit(None).cast("string")
        art, sec = art or (nothing, nothing), sec or (nothing, nothing)
        return rows.select(F.concat(F.col(id_col), F.lit("__"), ident).alias("id"), F.col(id_col), no.cast("int").alias("clause_no"), art[0].alias("article"), art[1].alias("article_label"), sec[0].alias("section"), sec[1].alias("section_label"), heading.alias("heading"), text.alias("text"), page.cast("int").alias("page"))

    headed = named.where("mode = 'headings' AND span > 0")
    is_article = F.col("h.level") == "article"
    section = F.when(~is_article, some(F.col("h.num")))
    dash = F.when(F.col("h.title") != "", F.concat(F.lit(" — "), F.col("h.title"))).otherwise("")
    heading = F.when(is_article, F.concat(F.lit("Article "), F.col("h.num"), dash)).when(section.isNotNull(), F.concat(F.lit("Section "), section, dash)).otherwise(F.col("h.title"))
    number = (F.col("span") - 1).cast("string")
    sections = clause(headed, F.col("span"), number, heading, F.col("text"), F.col("page"), (F.col("a.n"), F.col("a.t")), (section, F.when(~is_article, F.col("h.title"))))
    before = named.where("mode = 'headings' AND span = 0").where("size >= 80")
    preamble = clause(before, F.lit(0), F.lit("preamble"), F.col("label"), F.col("text"), F.lit(1))
    single = clause(docs.join(info.drop("label"), id_col).where("mode = 'whole'"), F.lit(0), F.lit("whole"), F.col("label"), _strip(F.coalesce("text", F.lit(""))), F.lit(1))
    paged = docs.join(info.drop("label"), id_col).where("mode = 'pages'").select(id_col, "label", F.posexplode(F.split("text", "\f")).alias("p", "body"))
    by_page = clause(paged, F.col("p") + 1, F.concat(F.lit("page"), (F.col("p") + 1).cast("string")), F.concat("label", F.lit(" — page "), (F.col("p") + 1).cast("string")), _strip(F.col("body")), F.col("p") + 1)
    out = sections.union(preamble).union(by_page).where("text <> ''").union(single)
    if pages is None:
        return out.withColumn("ocr", F.lit(False))
    seen = pages.where("ocr").select(F.col(id_col).alias("__c"), F.col("page").alias("__p")).distinct()
    some_page = seen.groupBy("__c").agg(F.lit(True).alias("__any"))
    out = out.join(seen.withColumn("__hit", F.lit(True)), (F.col(id_col) == F.col("__c")) & (F.col("page") == F.col("__p")), "left").drop("__c", "__p")
    out = out.join(some_page, F.col(id_col) == F.col("__c"), "left").drop("__c")
    whole_ocr = F.col("id").endswith("__whole") & F.coalesce("__any", F.lit(False))
    return out.withColumn("ocr", whole_ocr | F.coalesce("__hit", F.lit(False))).drop("__hit", "__any")


def coverage(clauses: DataFrame, docs: DataFrame, id_col: str = "contract_id") -> DataFrame:
    """Share of a document's solid characters that its clauses hold."""
    held = clauses.groupBy(id_col).agg(F.sum(_solid(F.col("text"))).alias("held"))
    return docs.select(id_col, _solid(F.coalesce("text", F.lit(""))).alias("solid")).join(held, id_col, "left").select(id_col, "solid", F.coalesce("held", F.lit(0)).alias("held"), F.when(F.col("solid") > 0, F.coalesce("held", F.lit(0)) / F.col("solid")).alias("share"))


def page_of_offset(offsets: DataFrame, lookups: DataFrame, id_col: str = "contract_id") -> DataFrame:
    """The page with the largest start at or before each offset, 1 without one.

    Starts and lookups are sorted together once and the page carried forward, which costs one
    shuffle on the document and no range join."""
    a = offsets.select(id_col, F.col("start").alias("at"), F.lit(0).alias("side"), F.col("page"), F.lit(None).cast("long").alias("lookup"))
    b = lookups.select(id_col, F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("page"), F.col("lookup").cast("long"))
    w = Window.partitionBy(id_col).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.union(b).withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(w), F.lit(1)))
    return both.where("side = 1").select(id_col, "lookup", F.col("at").alias("offset"), "page")


def relabel(clauses: DataFrame, signers: list[str], signatures: str, letterheads: str, captions: str, fragments: str, tables: str = r"^(HOURLY|SATURDAY|SUNDAY|PERIOD|RATE|CATEGORY|MONTH|ANNUAL LEA)", id_col: str = "contract_id") -> DataFrame:
    """Headings of signature blocks, letterheads, captions and stray fragments replaced.

    Patterns are parameters.  A fragment takes the last real heading of its document, marked as
    continued.  ``heading_raw`` keeps what was there where it changed, so doing it twice
    changes nothing.
    """
    had = F.col("heading_raw") if "heading_raw" in clauses.columns else F.lit(None).cast("string")
    raw = F.coalesce(had, F.col("heading"), F.lit(""))
    h, text = F.trim(F.regexp_replace(raw, r"\s+", " ")), F.coalesce("text", F.lit(""))
    names = "^(?:(?:" + "|".join(signers) + r")\s*)+$" if signers else "^$x"
    kind = (
        F.when(h == "", None)
        .when(h.rlike(names) | h.rlike(signatures), "signature")
        .when(h.rlike(letterheads), "letter")
        .when(h.rlike(captions), "caption")
        .when(h.rlike(fragments), "continued")
        .when((F.length(_strip(text)) < 40) & ~h.rlike(r"^(Article|Section|APPENDIX)\b"), "continued")
    )
    out = clauses.withColumn("__raw", raw).withColumn("heading_kind", kind)
    w = Window.partitionBy(id_col).orderBy("clause_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("heading_kind").isNull() & (F.col("__raw") != ""), F.col("__raw")), ignorenulls=True).over(w)
    head = F.substring(text, 1, 1500)
    subject = F.regexp_replace(F.regexp_replace(F.regexp_extract(head, r"(?:^|\n)\s*(?:Re|RE|Subject|SUBJECT)\s*[:.]\s*(.{4,120})", 1), r"\s+", " "), r"^[ .,:;]+|[ .,:;]+$", "")
    letter = F.when(head.rlike("(?i)Attached for your information"), "Cover memo from the Office of Labor Relations").when(subject != "", F.concat(F.lit("Letter: "), subject)).when(F.substring(head, 1, 600).rlike(r"\bDear\b"), "Side letter").otherwise("Letterhead")
    k = F.col("heading_kind")
    fresh = (
        F.when(k.isNull(), F.col("__raw"))
        .when(k == "signature", "Signatures")
        .when(k == "caption", "Caption")
        .when(k == "letter", letter)
        .when(last.isNotNull(), F.concat(last, F.lit(" (continued)")))
        .when(F.col("__raw").rlike(tables), "Rate and leave tables")
        .otherwise("Untitled section")
    )
    out = out.withColumn("heading", fresh)
    return out.withColumn("heading_raw", F.when(F.col("__raw") != F.col("heading"), F.col("__raw"))).drop("__raw")
