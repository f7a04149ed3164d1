"""Exact search with a reproducible score, and the views built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query import Families, Query, QuerySpec, compile_query
from ..functions.text import haystack


def matches(query: Query, hay: Column) -> Column:
    """Every term in any of its spellings."""
    out = F.lit(True)
    for term in query.terms:
        out = out & term.matches(hay)
    return out


def score(query: Query, text: Column, heading: Column, earlier: Column | None = None) -> Column:
    """Sum over terms of weight * (occurrences up to 12, damped by length, + 8 for a heading hit,
    less on short texts); times 0.6 for an earlier document."""
    t, h = F.coalesce(text, F.lit("")), F.coalesce(heading, F.lit(""))
    length = F.length(t).cast("double")
    total = F.lit(0.0)
    for term in query.terms:
        often = F.least(term.count(t), F.lit(12)).cast("double") / (1 + length / 12000)
        head = F.when(term.matches(h), 8 * F.least(F.lit(1.0), length / 400)).otherwise(0.0)
        total = total + term.weight * (often + head)
    return total if earlier is None else F.when(F.coalesce(earlier, F.lit(False)), total * 0.6).otherwise(total)


def select(clauses: DataFrame, spec: QuerySpec) -> DataFrame:
    """The filters that need no text: topic, document and era.  They come first, so they reach the scan."""
    out = clauses
    if spec.topic:
        out = out.where(F.array_contains(F.coalesce("topics", F.array().cast("array<string>")), spec.topic))
    if spec.contract:
        out = out.where(F.col("contract_id") == spec.contract)
    if not spec.earlier:
        out = out.where(~F.coalesce("earlier", F.lit(False)))
    return out


def hits(clauses: DataFrame, query: Query | None, order: str = "clause_no") -> DataFrame:
    """Matching clauses with ``score``; all clauses with a null score without a query.

    Only matches are scored.  ``order`` is the corpus order that breaks ties.
    """
    if query is None:
        return clauses.withColumn("score", F.lit(None).cast("double"))
    earlier = F.col("earlier") if "earlier" in clauses.columns else None
    found = clauses.where(matches(query, haystack("heading", "text")))
    return found.withColumn("score", score(query, F.col("text"), F.col("heading"), earlier))


def relevance_order(order: str = "clause_no") -> list[Column]:
    """Best score first, ties in corpus order."""
    return [F.desc_nulls_last("score"), F.col(order)]


def best_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, numbered by ``rank``.

    A lone row_number filter keeps Spark's group limit before the shuffle, so a hot group sends
    ``k`` rows a task; totals are left to ``group_totals``."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_totals(rows: DataFrame, group: str, key: list[Column]) -> DataFrame:
    """Rows of each group and its best key, pre-aggregated."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.min(F.struct(*key)).alias("best"))


def results(clauses: DataFrame, spec: QuerySpec, families: Families | None = None) -> DataFrame:
    """Search results: up to 3 clauses a document, or 5 without a query, documents in order of
    their best clause; each with its document's number of hits."""
    query = compile_query(spec.query, families)
    found = hits(select(clauses, spec), query)
    keys = [(-F.coalesce("score", F.lit(0.0))).alias("minus"), F.col("clause_no"), F.col("id")]
    top = best_per_group(found, "contract_id", [*relevance_order(), F.col("id")], 3 if query else 5)
    return top.join(group_totals(found, "contract_id", keys), "contract_id").orderBy("best", "contract_id", "rank")


def zero_hit_topics(text: str, topics: dict[str, str]) -> list[str]:
    """Topics to offer when nothing was found: those that a word of the query is part of."""
    words = [w for w in text.lower().split() if len(w) > 3]
    return [key for key, label in topics.items() if any(w in label.lower() or w in key.lower() for w in words)]


def topic_menu(clauses: DataFrame, hide_empty: bool = True) -> DataFrame:
    """Clauses and documents of each topic, largest first."""
    out = clauses.select("contract_id", F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n_clauses"), F.countDistinct("contract_id").alias("n_contracts"))
    return (out.where("n_clauses > 0") if hide_empty else out).orderBy(F.desc("n_clauses"), "topic")


def compare(clauses: DataFrame, spec: QuerySpec, families: Families | None = None) -> DataFrame:
    """Clauses of up to four picked documents that have the topic and match the query, any era."""
    picked = clauses.where(F.col("contract_id").isin(list(spec.compare[: QuerySpec.MOST_COMPARED])))
    if spec.topic:
        picked = picked.where(F.array_contains("topics", spec.topic))
    return hits(picked, compile_query(spec.query, families))


def shared_topics(clauses: DataFrame, contracts: list[str]) -> DataFrame:
    """In how many of the picked documents each topic occurs."""
    return clauses.where(F.col("contract_id").isin(contracts)).select("contract_id", F.explode("topics").alias("topic")).groupBy("topic").agg(F.countDistinct("contract_id").alias("n")).orderBy(F.desc("n"), "topic")


def random_clause(clauses: DataFrame, spec: QuerySpec, seed: int) -> DataFrame:
    """One clause of a current document, by a hash of its id and the seed."""
    return select(clauses, QuerySpec(topic=spec.topic, contract=spec.contract, earlier=False)).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1)


def table_of_contents(clauses: DataFrame) -> DataFrame:
    """Headings of a document in order, without continued ones and those equal to the one shown before."""
    shown = clauses.where((F.coalesce("heading", F.lit("")) != "") & (F.coalesce("heading_kind", F.lit("")) != "continued"))
    w = Window.partitionBy("contract_id").orderBy("clause_no")
    return shown.withColumn("__before", F.lag("heading").over(w)).where(~F.col("heading").eqNullSafe(F.col("__before"))).drop("__before")


#: Words of an item that documents are looked up by, and items of so few words that none is whole inside.
KEY_WORDS, SHORT_ITEMS = 5, 1000


def _by_first_letters(docs: DataFrame, short: DataFrame, doc_id: str, item_id: str, most: int = 3) -> DataFrame:
    """Documents that hold items as they are, met on the first ``most`` letters of an item; the texts then decide."""
    key = F.substring("__item", 1, most)
    keyed = short.select(item_id, "__item", key.alias("__key"))
    sizes = sorted(r["n"] for r in keyed.select(F.length("__key").alias("n")).distinct().collect())
    text = F.coalesce("text", F.lit(""))
    every = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    met = docs.select(doc_id, F.explode(F.array_distinct(F.concat(*map(every, sizes)))).alias("__key")).join(keyed, "__key")
    return met.join(docs.select(doc_id, "text"), doc_id).where(F.contains("text", F.col("__item"))).select(doc_id, item_id)


def containing(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """``doc_id, item_id``: documents whose text holds an item's text as it is.

    All words of an item but its first and last stand whole in a text that holds it, so items
    and documents meet on up to ``KEY_WORDS`` of these, by hash; the texts then decide.  Runs of a
    document are made for the lengths that items ask for.  Items of one or two words are looked for in
    every text while they are few (``SHORT_ITEMS``, counted); more of them meet the texts on their first letters.
    """
    split = lambda c: F.array_remove(F.split(c, r"\s+"), "")
    asked = items.select(F.col(item_id), F.col("text").alias("__item"), split("text").alias("w")).where("length(__item) > 0")
    asked = asked.withColumn("n", F.least(F.size("w") - 2, F.lit(KEY_WORDS)))
    sizes = sorted(r["n"] for r in asked.where("n > 0").select("n").distinct().collect())
    run = lambda w, at, n: F.xxhash64(F.lit(n), F.array_join(F.slice(w, at, n), " "))
    keyed = asked.where("n > 0")
    key = F
    for n in sizes:
        key = key.when(F.col("n") == n, run(F.col("w"), F.lit(2), n))
    out = docs.where(F.lit(False)).select(doc_id, F.lit(None).cast(dict(items.dtypes)[item_id]).alias(item_id))
    if sizes:
        words = docs.select(doc_id, split("text").alias("w"))
        every = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: run(F.col("w"), i, n))
        runs = F.concat(*[F.when(F.size("w") >= n, every(n)).otherwise(F.array().cast("array<bigint>")) for n in sizes])
        met = words.select(doc_id, F.explode(F.array_distinct(runs)).alias("__key")).join(keyed.select(item_id, "__item", key.alias("__key")), "__key").select(doc_id, item_id, "__item")
        out = met.join(docs.select(doc_id, "text"), doc_id).where(F.contains("text", F.col("__item"))).select(doc_id, item_id)
    few = asked.where("n <= 0").select(item_id, "__item").limit(SHORT_ITEMS + 1).collect()
    if len(few) > SHORT_ITEMS:
        short = _by_first_letters(docs, asked.where("n <= 0").select(item_id, "__item"), doc_id, item_id)
        out = out.union(short) if sizes else short
    elif few:
        kind = dict(items.dtypes)[item_id]
        hit = F.filter(F.array(*[F.when(F.contains("text", F.lit(r["__item"])), F.lit(r[item_id]).cast(kind)) for r in few]), lambda x: x.isNotNull())
        short = docs.select(doc_id, F.explode(hit).alias(item_id))
        out = out.union(short) if sizes else short
    return out.distinct()
