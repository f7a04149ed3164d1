"""Token counts: an exact length histogram whose suffix sums answer for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch

#: Lengths per block of the two-level suffix sum.
BLOCK = 1024


def histogram(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """``n_tokens, n_docs``: how many documents have each encoded length.

    Exact.  Null and empty texts count as length 0; an empty table gives no rows.
    Counts are pre-aggregated in each task, so a hot length costs one row a task.
    """
    return bpe.count_tokens(docs, rank_file, pattern).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct length, read as a context limit.

    ``n_tokens`` (the limit), ``n_docs`` of exactly that length, ``docs_at_least`` and
    ``tokens_at_least`` (suffix sums), ``docs_below``, ``total_tokens``,
    ``truncated_tokens`` (sum of min(length, limit)) and ``lost_tokens``.

    The suffix sum has two levels, so no task sees the whole histogram: blocks of
    ``block`` lengths are summed first, the sums of later blocks are added to each
    block, and a window inside the block does the rest.  Block sums are again a
    histogram, ``block`` times shorter.
    """
    h = hist.select(F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_docs").cast("long").alias("n_docs"))
    h = h.withColumn("b", F.floor(F.col("n_tokens") / block).cast("long")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = h.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    # a block row for each block of 1,024 blocks: lengths up to 10^12 give at most 10^6 of them
    later = Window.partitionBy("g").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.withColumn("g", F.floor(F.col("b") / block))
    groups = tops.groupBy("g").agg(F.sum("bd").alias("gd"), F.sum("bt").alias("gt"))
    over = Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select(
        "g",
        F.coalesce(F.sum("gd").over(over), F.lit(0)).alias("gd"),
        F.coalesce(F.sum("gt").over(over), F.lit(0)).alias("gt"),
        F.sum("gd").over(whole).alias("total_docs"),
        F.sum("gt").over(whole).alias("total_tokens"),
    )
    tops = tops.join(groups, "g").select(
        "b",
        (F.coalesce(F.sum("bd").over(later), F.lit(0)) + F.col("gd")).alias("ld"),
        (F.coalesce(F.sum("bt").over(later), F.lit(0)) + F.col("gt")).alias("lt"),
        "total_docs",
        "total_tokens",
    )
    inside = Window.partitionBy("b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(tops, "b").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("ld")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("lt")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    out = out.withColumn("docs_below", F.col("total_docs") - F.col("docs_at_least"))
    out = out.withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
    return out.withColumn("lost_tokens", F.col("total_tokens") - F.col("truncated_tokens"))


def totals_for(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents cut, tokens kept and lost.

    Any limit is answered from one row, that of the next longer length: its suffix sums are of
    the documents that the limit cuts.  Above the longest document nothing is cut.  An empty
    table answers zeros.  One pass finds the rows for all limits.
    """
    spark = sums.sparkSession
    next_ = [F.min(F.when(F.col("n_tokens") > x, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias(f"r{k}") for k, x in enumerate(limits)]
    row = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"), *next_).first()
    out = []
    for k, x in enumerate(limits):
        r = row[f"r{k}"]
        cut, lost = (r["docs_at_least"], r["tokens_at_least"] - x * r["docs_at_least"]) if r else (0, 0)
        out.append((int(x), cut, row["total"] - lost, lost))
    return spark.createDataFrame(out, "context_limit long, docs_cut long, kept_tokens long, lost_tokens long")


def quantile(sums: DataFrame, q: float) -> int | None:
    """The exact lower quantile of document length: the least length with at least
    a share ``q`` of the documents at or below it; None for an empty table."""
    at = F.col("docs_below") + F.col("n_docs")
    return sums.where(at >= F.lit(q) * F.col("total_docs")).agg(F.min("n_tokens").alias("x")).first()["x"]


def token_counts(docs: DataFrame, scratch: Scratch, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Histogram and suffix sums of all documents; the histogram is written, so texts are encoded once.

    Null and empty texts have length 0; repeated rows count each time; an empty table gives no rows; texts are encoded
    whole; columns other than the text are not read."""
    return suffix_sums(scratch.save(histogram(docs, rank_file, pattern), "lengths"))
