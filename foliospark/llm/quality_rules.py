"""Quality rules on native expressions: per-text counts, then host-level verdicts.

Everything here is DataFrame or SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, without

#: A text fails the base rule with fewer words, or with a larger share of repeated words.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunken failure rate is above this.
MAX_HOST_RATE = 0.5
#: Hosts up to this many rows of verdicts are broadcast; beyond it the join shuffles.
BROADCAST_HOSTS = 50_000
#: Up to so many different repeated windows are looked up one by one; beyond it all windows are sorted.
FEW = 16


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once a row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text.

    Windows are hashed; where all hashes differ, no window repeats.  Otherwise the
    windows whose hash repeats are sorted by their words, and neighbours compared on the
    words themselves, so a hash collision cannot change the count.  n log n in the text.
    """

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - 2)
        return let(F.transform(at, lambda i: F.xxhash64(_at(w, i), _at(w, i + 1), _at(w, i + 2))), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(w, at, h)))

    def repeated(w: Column, at: Column, h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == F.get(s, k - 1)))))
        picked = let(twice, lambda d: F.when(F.size(d) <= FEW, F.filter(at, lambda i: F.array_contains(d, F.get(h, i - 1)))).otherwise(at))
        rows = F.sort_array(F.transform(picked, lambda i: F.struct(F.get(h, i - 1).alias("h"), _at(w, i).alias("a"), _at(w, i + 1).alias("b"), _at(w, i + 2).alias("c"), i.alias("i"))))
        return let(rows, covered)

    def covered(rows: Column) -> Column:
        same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        found = F.filter(rows, lambda x, k: F.coalesce((k > 0) & same(x, F.get(rows, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(rows, k + 1)), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(w, of)).cast("long")


def _at(w: Column, i: Column) -> Column:
    return F.get(w, i - 1)


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    A null text has no words, which fails the rule.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = docs.select("doc_id", F.col(host).alias("host"), text.alias("text"))
    row = row.select("doc_id", "host", "text", words(F.col("text")).alias("w"))
    row = row.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        word_chars(F.col("w")).alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"),
        n_repeat_words(F.col("w")).alias("n_repeat_words"),
    )
    return row.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_rates(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, n, k, rate``: failure rate of each host, shrunken to the corpus by an empirical beta prior.

    The prior's mean is the corpus failure rate m.  Its strength is
    m(1-m)/v - 1, v being the variance of the hosts' rates (weighted by documents) less
    what sampling alone would give, kept within 1 and the number of documents;
    with one host, or no or only failures, the prior is the corpus itself.
    ``rate = (k + m*strength) / (n + strength)``.  Documents without a host take no part.
    Counts are pre-aggregated map-side, so a hot host costs one row a task; hosts are written
    once, and the driver gets their moments.
    """
    n, k = F.col("n"), F.col("k")
    hosts = counts.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if("base_failed").cast("double").alias("k"))
    hosts = scratch.save(hosts, "host-counts")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("docs"), F.sum(k).alias("failed")).first()
    if not sums["hosts"]:
        return hosts.withColumn("rate", F.lit(0.0))
    docs, mean = sums["docs"], sums["failed"] / sums["docs"]
    strength = docs
    if sums["hosts"] > 1 and 0 < mean < 1:
        spread = hosts.agg(F.sum(n * F.pow(k / n - mean, 2)).alias("v")).first()["v"] / docs
        strength = max(1.0, min(docs, mean * (1 - mean) / max(spread - mean * (1 - mean) * sums["hosts"] / docs, 1e-9) - 1))
    return hosts.withColumn("rate", (k + mean * strength) / (n + strength))


def verdicts(docs: DataFrame, scratch: Scratch, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Base counts of every document with its host's rate and ``kept``.

    ``kept`` is false where the base rule failed or the host's shrunken rate is above
    ``max_rate``.  A document without a host is judged by the base rule alone.  Repeated
    rows give repeated verdicts; an empty table gives none.  Counts are written once and
    read for both the host rates and the verdicts, so texts are read once.  Null texts have no words; texts
    are counted whole; other columns, whatever their names, are neither read nor returned.
    """
    counts = scratch.save(base_counts(docs, host), "rule-counts")
    hosts = host_rates(counts, scratch).select("host", F.col("rate").alias("host_rate"), F.col("n").cast("long").alias("host_docs"))
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    out = counts.join(side, "host", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_rate))


def keep_documents(docs: DataFrame, scratch: Scratch, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    Host verdicts reach the documents through the ids of the rejected.  Rows with a null
    id stay.
    """
    return without(docs, verdicts(docs, scratch, host).where("NOT kept").select("doc_id"), scratch, "rule-rejects")
