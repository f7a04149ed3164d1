"""Companion reports as Markdown, composed from the report operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import lineage, reports
from . import sinks


def _years() -> Column:
    return F.when(F.col("term_start").isNotNull() & F.col("term_end").isNotNull(), F.concat_ws("–", F.col("term_start").cast("string"), F.col("term_end").cast("string"))).otherwise("n/a")


def index(contracts: DataFrame, title: str = "Index") -> str:
    """Current documents, then earlier ones with what continues them; sorted by label in lower case."""
    rows = contracts.withColumn("term", _years())
    pages = F.when(F.coalesce("total_pages", F.lit(0)) > 0, F.concat(F.col("ocr_pages").cast("string"), F.lit(" of "), F.col("total_pages").cast("string")))
    rows = rows.withColumn("recognised", pages)
    order = [F.lower("label"), "id"]
    now = sinks.table(rows.where(reports.is_current()), {"label": "Document", "term": "Term", "recognised": "Recognised pages"}, order, title)
    names = contracts.select(F.col("id").alias("__to"), F.col("label").alias("__l"))
    later = rows.where(~reports.is_current()).select("id", F.posexplode("later_ids").alias("pos", "__to")).join(names, "__to")
    joined = later.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__l"))), lambda x: x["__l"]), "; ").alias("later"))
    old = rows.where(~reports.is_current()).join(joined, "id", "left")
    return now + "\n" + sinks.table(old, {"label": "Earlier document", "term": "Term", "later": "Continued by"}, order, "Earlier agreements")


def units(rows: DataFrame) -> str:
    curated = rows.where("curated").withColumn("people", F.when(F.coalesce("headcount_verified", F.lit(False)), F.format_number("headcount", 0)))
    return sinks.table(curated, {"contract_label": "Document", "union_full": "Union", "people": "People"}, [F.desc(F.coalesce("headcount", F.lit(0))), "contract_label"], "Units")


def wages(rows: DataFrame, ordinal: str) -> str:
    steps = F.array_join(F.transform("increases", lambda x: F.concat(x["effective"], F.lit(": "), F.format_number(x["pct"], 2), F.lit("%"))), "; ")
    return sinks.table(rows.where("curated").withColumn("steps", steps), {"contract_label": "Document", "steps": "Steps", "cumulative_pct": "Compounded %"}, [ordinal], "Wages")


def document_types(contracts: DataFrame, clauses: DataFrame, types: list[str]) -> str:
    """Counts and upper medians of each type, its documents by length, and the topics that each covers."""
    sizes = reports.type_summary(contracts)
    listing = contracts.select("doc_type", "label", "chars")
    topics = clauses.select("contract_id", F.explode("topics").alias("topic")).join(contracts.select(F.col("id").alias("contract_id"), "doc_type"), "contract_id")
    matrix = reports.coverage_matrix(topics, contracts.select(F.col("id").alias("contract_id"), "doc_type"), "topic", "doc_type", "contract_id", types)
    place = F.array_position(F.array(*map(F.lit, types)), F.col("doc_type"))
    return "\n".join(
        [
            sinks.table(sizes, {"doc_type": "Type", "n": "Documents", "median": "Median characters"}, [place, "doc_type"], "Document types"),
            sinks.table(listing, {"doc_type": "Type", "label": "Document", "chars": "Characters"}, [place, F.desc(F.coalesce("chars", F.lit(0))), "label"], "Documents by length"),
            sinks.table(matrix, {"topic": "Topic"} | {t: t for t in types}, ["topic"], "Topics by type, percent"),
        ]
    )


def underlying(contracts: DataFrame) -> str:
    """Where the agreement that an amendment changes can be read: included, in another document, linked, or nowhere.

    ``contracts`` has ``lineage, companion struct<id>, predecessor struct<url,label,term,note>, base_note``."""
    g = lineage.amendment_groups(contracts, exporter=True)
    chained = lineage.render(g.where("has_chain"), contracts.select("id", "label"))
    pairs = g.where("amends_predecessor AND companion IS NOT NULL").withColumn("__to", F.col("companion.id")).join(contracts.select(F.col("id").alias("__to"), F.col("label").alias("other")), "__to")
    linked = g.where("linked_only").select("label", F.concat(F.col("predecessor.label"), F.coalesce(F.concat(F.lit(" ("), F.col("predecessor.note"), F.lit(")")), F.lit(""))).alias("earlier"), F.coalesce("predecessor.term", F.lit("")).alias("term"), F.col("predecessor.url").alias("url"))
    return "\n".join(
        [
            sinks.table(chained, {"label": "Document", "chain": "Earlier agreements"}, ["label"], "Earlier agreements included"),
            sinks.table(pairs, {"label": "Document", "other": "Full terms in"}, ["label"], "Full terms in another document"),
            sinks.table(linked, {"label": "Amendment", "earlier": "Earlier agreement", "term": "Term", "url": "Link"}, ["label"], "Earlier agreements published elsewhere"),
            sinks.table(g.where("lacks_base"), {"label": "Document", "base_note": "Note"}, ["label"], "No earlier agreement available", missing=""),
        ]
    )


def cautions(units: DataFrame) -> str:
    """How many units are counted, with how many people, none twice."""
    return sinks.about(reports.headcount_total(units), "Headcounts")
