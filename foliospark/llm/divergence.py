"""Which sources of a language differ, and in which words: an audit by whole-number divergences."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Runs of letters A to Z and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

#: A term is kept in languages where at least so many documents have it.
LEAST_DOCS = 10
#: Terms reported a group.
TOP_TERMS = 10
#: Groups up to this many are broadcast (about 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of a term in a group, and documents that have it.

    Every row is a document, so repeated rows count each time.  A row's terms are exploded twice, as they
    stand and without repeats, so both counts come from one aggregation.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    found = _groups(docs, F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms"))
    lists = found.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "list"))
    each = lists.select("lang", "source", F.col("once").cast("long").alias("once"), F.explode("list").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def _groups(docs: DataFrame, *more: Column) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), *more)


def share(n: str, total: str, kinds: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kinds)), in whole numbers of up to 31 digits."""
    return F.expr(f"1L + (CAST({n} + 2 AS DECIMAL(20, 0)) * 1000000000BD) div CAST({total} + 2 * {kinds} AS DECIMAL(20, 0))")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so a long holds the square."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def audit(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group of language and source how far it is from
    every other source of the language (part ``pair``) and the terms it has more of than its language
    (part ``term``, the ``top_terms`` furthest).

    Null texts, languages and sources are ''.  A group whose texts have no term takes part with counts
    of 0; a language without kept terms gives pairs of value 0; a language with one source has no pair.
    Equal values rank by item.  Repeated rows are documents of their own; an empty table gives no rows;
    other columns are not read.

    Terms are counted map-side before anything is shuffled, whatever source a row has.  Kept terms meet
    the groups of their language (broadcast if counted few), and sources meet on language and term, which
    holds a row a source; each pair is summed once and turned round, for its value is the same from both ends.
    """
    counts = scratch.save(term_counts(docs), "counts")
    sums = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = scratch.save(sums.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "kept")
    have = scratch.save(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "have")
    totals = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
    own = have.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = _groups(docs).distinct().join(own, ["lang", "source"], "left").join(totals, "lang", "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kinds", "lang_total")])
    groups = scratch.save(groups, "groups")
    few = groups.count() <= BROADCAST_GROUPS

    def beside(rows: DataFrame, on: list[str]) -> DataFrame:
        return rows.join(F.broadcast(groups) if few else groups, on)

    dense = beside(kept.select("lang", "term"), ["lang"]).join(have, ["lang", "source", "term"], "left").select("lang", "term", "source", share("coalesce(n, 0L)", "total", "kinds").alias("p"))
    other = F.col("other")
    dense = scratch.save(dense, "dense")
    met = dense.join(dense.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q")), ["lang", "term"]).where("source < other")
    half = met.groupBy("lang", "source", "other").agg(F.sum(distance("p", "q")).alias("value"))
    both = half.union(half.select("lang", other.alias("source"), F.col("source").alias("other"), "value"))
    # a language without kept terms has pairs, too
    bare = groups.where("kinds = 0").select("lang", "source")
    zeros = bare.join(bare.select("lang", F.col("source").alias("other")), "lang").where("source <> other").select("lang", "source", "other", zero.alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.union(zeros).withColumnRenamed("other", "item").withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))

    seen = beside(have, ["lang", "source"]).join(kept, ["lang", "term"])
    apart = seen.select("lang", "source", F.col("term").alias("item"), share("n", "total", "kinds").alias("p"), share("lang_n", "lang_total", "kinds").alias("q")).where("p > q")
    terms = apart.select("lang", "source", "item", distance("p", "q").alias("value")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).union(terms.select(columns))
