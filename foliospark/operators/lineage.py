"""Chains of earlier agreements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug_of_url, year_of
from .relations import gather, number_duplicates


def chain_links(lineage: DataFrame, contracts: DataFrame, self_complete: list[str] = ()) -> DataFrame:
    """``contract_id, pos, url`` and the fields of each link, up to the first without a URL.

    ``lineage`` has ``contract_id, self_complete, chain array<struct<url, ...>>``.  Documents that
    are unknown or complete in themselves have no chain.
    """
    rows = lineage.where(~F.coalesce("self_complete", F.lit(False)) & ~F.col("contract_id").isin(list(self_complete)))
    rows = rows.join(contracts.select(F.col("id").alias("contract_id")), "contract_id", "left_semi")
    links = rows.select("contract_id", F.posexplode("chain").alias("pos", "link"))
    bad = F.coalesce(F.col("link.url"), F.lit("")) == ""
    stop = F.min(F.when(bad, F.col("pos"))).over(Window.partitionBy("contract_id"))
    return links.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("pos") < F.col("__stop"))).select("contract_id", "pos", "link.*")


def earlier_documents(links: DataFrame, contracts: DataFrame) -> DataFrame:
    """One document for each URL that no current document has.

    The first link supplies its fields, the first note its gap note; ``later_ids`` are the
    documents that continue it, in order.  Ids are made unique before chains use them.
    """
    fresh = links.join(contracts.select("url").distinct(), "url", "left_anti")
    order = F.struct("contract_id", "pos")
    first = lambda c: F.min_by(c, order)
    docs = fresh.groupBy("url").agg(
        F.coalesce(first("title"), F.element_at(F.split(F.first("url"), "/"), -1)).alias("label"),
        year_of(first("term_start")).alias("term_start"),
        year_of(first("term_end")).alias("term_end"),
        F.coalesce(first("complete"), F.lit(False)).alias("complete"),
        F.min_by("gap_note", F.when(F.coalesce("gap_note", F.lit("")) != "", order)).alias("gap_note"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["contract_id"])).alias("later_ids"),
        F.min(order).alias("__o"),
    )
    docs = docs.withColumn("id", slug_of_url("url"))
    return number_duplicates(docs, "id", ["__o"], every=False).drop("__o")


def chains(links: DataFrame, earlier: DataFrame, contracts: DataFrame) -> DataFrame:
    """``contract_id, lineage``: ids of the chain in order, current documents under their own ids."""
    ids = earlier.select("url", "id").union(contracts.groupBy("url").agg(F.min("id").alias("id")))
    return gather(links.join(ids, "url"), "contract_id", "pos", "id", "lineage")


def render(rows: DataFrame, names: DataFrame, links: str = "lineage", arrow: str = " → ") -> DataFrame:
    """Chains as text, ids that no document has left out."""
    pairs = rows.select("id", F.posexplode(links).alias("pos", "to")).join(names.select(F.col("id").alias("to"), F.col("label").alias("name")), "to")
    text = pairs.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), arrow).alias("chain"))
    return rows.join(text, "id", "left")


def ends_incomplete(rows: DataFrame, earlier: DataFrame, links: str = "lineage") -> DataFrame:
    """Whether the last document of each chain is itself not complete."""
    last = rows.withColumn("__last", F.try_element_at(F.col(links), F.lit(-1)))
    return last.join(earlier.select(F.col("id").alias("__last"), F.col("complete").alias("__c")), "__last", "left").withColumn("incomplete", ~F.coalesce("__c", F.lit(False))).drop("__last", "__c")


def amendment_groups(contracts: DataFrame, exporter: bool = False) -> DataFrame:
    """``has_chain, lacks_base, linked_only`` of documents with ``lineage, era, ...``.

    The exporter's variant does not look at chains, and calls a document linked whether or not it amends.
    """
    earlier = contracts.where("era = 'earlier'").select(F.col("id").alias("__to"))
    hit = contracts.select("id", F.explode("lineage").alias("__to")).join(earlier, "__to", "left_semi").select("id").distinct().withColumn("has_chain", F.lit(True))
    out = contracts.join(hit, "id", "left").withColumn("has_chain", F.coalesce("has_chain", F.lit(False)))
    amends, pre, comp = F.coalesce("amends_predecessor", F.lit(False)), F.col("predecessor").isNotNull(), F.col("companion").isNotNull()
    if exporter:
        return out.withColumns({"lacks_base": amends & ~pre & ~comp, "linked_only": pre & ~comp})
    return out.withColumns({"lacks_base": amends & ~pre & ~comp & ~F.col("has_chain"), "linked_only": amends & pre & ~comp & ~F.col("has_chain")})
