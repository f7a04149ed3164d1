"""Aggregates, pivots and status reports."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.query import quote
from ..functions.text import ap_date, compounded, facts_date, term_text
from . import ranks
from .relations import expiry_key


def is_current() -> Column:
    return F.coalesce("era", F.lit("current")) != "earlier"


def headcount_total(units: DataFrame) -> DataFrame:
    """Units with a verified count that duplicates no other, and their people."""
    own = F.coalesce("headcount_verified", F.lit(False)) & F.col("headcount_duplicate_of").isNull()
    return units.agg(F.count_if(own).alias("n_units"), F.coalesce(F.sum(F.when(own, F.coalesce("headcount", F.lit(0)))), F.lit(0)).alias("headcount"))


def manifest(contracts: DataFrame, clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """One row of corpus counts, each table counted by itself."""
    a = contracts.agg(F.count_if(is_current()).alias("contracts"), F.count_if(~is_current()).alias("earlier_documents"))
    b = clauses.agg(F.count(F.lit(1)).alias("clauses"))
    c = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.coalesce("ocr", F.lit(False))).alias("ocr_pages"))
    one = lambda df: df.withColumn("__k", F.lit(1))
    return one(a).join(one(b), "__k").join(one(c), "__k").drop("__k")


def type_summary(contracts: DataFrame, group: str = "doc_type", value: str = "chars") -> DataFrame:
    """Documents of each type and the upper median of their length, nothing counting as zero.

    Exact by counting passes, see ``ranks.at_place``; no task gathers a type's documents or values."""
    kind = dict(contracts.dtypes)[value]
    return ranks.at_place(contracts.withColumn(value, F.coalesce(F.col(value), F.lit(0)).cast(kind)), group, value)


def coverage_matrix(pairs: DataFrame, totals: DataFrame, row: str, col: str, key: str, columns: list[str]) -> DataFrame:
    """Percent of a column's keys that have each row's value: distinct pairs, a pivot over fixed
    columns, and the column totals; halves round to even."""
    counts = pairs.select(key, row, col).distinct().groupBy(row).pivot(col, columns).count()
    sizes = totals.select(key, col).distinct().groupBy().pivot(col, columns).count()
    sizes = sizes.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in columns], F.lit(1).alias("__k"))
    out = counts.withColumn("__k", F.lit(1)).join(sizes, "__k")
    return out.select(row, *[F.bround(100.0 * F.coalesce(F.col(f"`{c}`"), F.lit(0)) / F.greatest(F.coalesce(F.col(f"`__{c}`"), F.lit(0)), F.lit(1)), 0).cast("int").alias(c) for c in columns])


def concatenated(rows: DataFrame, key: str, ordinal: str, text: str, sep: str, name: str) -> DataFrame:
    """Texts of a key joined in order."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, text))), lambda x: x[text]), sep).alias(name))


def topic_sets(clauses: DataFrame) -> DataFrame:
    """All topics of a document's clauses."""
    return clauses.groupBy("contract_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topics"))


def average_in_band(values: DataFrame, column: str, low: float = 18, high: float = 25) -> DataFrame:
    """Average of values from ``low`` to below ``high``, with two places; a dash without any."""
    a = values.where((F.col(column) >= low) & (F.col(column) < high)).agg(F.avg(column).alias("v"))
    return a.select(F.coalesce(F.format_number("v", 2), F.lit("—")).alias("average"))


def bar_widths(steps: DataFrame, pct: str = "pct", floor: float = 4.0) -> DataFrame:
    """Each step as a share of the largest, which counts as 4 at least; one place."""
    top = steps.agg(F.greatest(F.max(pct), F.lit(floor)).alias("__m")).withColumn("__k", F.lit(1))
    return steps.withColumn("__k", F.lit(1)).join(top, "__k").withColumn("width", F.round(F.col(pct) / F.col("__m") * 100, 1)).drop("__k", "__m")


def status(contracts: DataFrame, as_of: date, gaps: DataFrame | None = None, continued_by: DataFrame | None = None) -> DataFrame:
    """``status_key, status`` of each document on a day.

    A gap's status first, then a known successor, then the exact end date (expired, within 183
    days, running), then the year.  ``gaps(contract_id, pos, status, status_key)``,
    ``continued_by(id, next_id)``.
    """
    out = contracts
    if gaps is not None:
        first = gaps.groupBy(F.col("contract_id").alias("id")).agg(F.min_by(F.struct("status", "status_key"), "pos").alias("__gap"))
        out = out.join(first.where("coalesce(__gap.status, '') <> ''"), "id", "left")
    else:
        out = out.withColumn("__gap", F.lit(None).cast("struct<status:string,status_key:string>"))
    if continued_by is not None:
        nxt = contracts.select(F.col("id").alias("next_id"), F.struct(F.col("term_start").alias("a"), F.col("term_end").alias("z")).alias("__next"))
        out = out.join(continued_by.join(nxt, "next_id").drop("next_id"), "id", "left")
    else:
        out = out.withColumn("__next", F.lit(None).cast("struct<a:int,z:int>"))
    end, year = F.to_date("end_date"), F.nullif(F.col("term_end"), F.lit(0))
    day = F.lit(as_of).cast("date")
    left = F.datediff(end, day)
    key = (
        F.when(F.col("__gap").isNotNull(), F.coalesce("__gap.status_key", F.lit("continued")))
        .when(F.col("__next").isNotNull(), "continued")
        .when(end.isNotNull(), F.when(left < 0, "expired").when(left <= 183, "expiring").otherwise("current"))
        .when(year.isNull(), "unknown")
        .otherwise(F.when(year < as_of.year, "expired").when(year == as_of.year, "expiring").otherwise("current"))
    )
    y = year.cast("string")
    text = (
        F.when(F.col("__gap").isNotNull(), F.col("__gap.status"))
        .when(F.col("__next").isNotNull(), F.concat(F.lit("Expired; continued, as changed by the "), F.col("__next.a").cast("string"), F.lit("-"), F.col("__next.z").cast("string"), F.lit(" agreement")))
        .when(end.isNotNull(), F.when(left < 0, F.concat(F.lit("Expired "), ap_date(end), F.lit("; terms continue until a successor is reached"))).when(left <= 183, F.concat(F.lit("Expires "), ap_date(end))).otherwise(F.concat(F.lit("Runs to "), ap_date(end))))
        .when(year.isNull(), "End date not stated")
        .otherwise(F.when(year < as_of.year, F.concat(F.lit("Expired in "), y, F.lit("; terms continue until a successor is reached"))).when(year == as_of.year, F.concat(F.lit("Ends in "), y, F.lit(" (exact date not stated)"))).otherwise(F.concat(F.lit("Runs to "), y)))
    )
    return out.withColumns({"status_key": key, "status": text}).drop("__gap", "__next")


def expirations(with_status: DataFrame) -> DataFrame:
    """Documents by status in report order, then by end and label, with the term in words."""
    place = F.array_position(F.array(*map(F.lit, fixed.STATUS_ORDER)), F.col("status_key"))
    out = with_status.withColumn("expiry", expiry_key(F.col("end_date"), F.col("term_end"))).withColumn("term", term_text("start_date", "end_date", "term_start", "term_end"))
    return out.orderBy(place, "expiry", "label")


def past_due(with_status: DataFrame) -> DataFrame:
    """How many documents have each status, and how many are past their end."""
    return with_status.agg(*[F.count_if(F.col("status_key") == k).alias(k) for k in fixed.STATUS_ORDER], F.count_if(F.col("status_key").isin("expired", "continued", "superseded")).alias("past"), F.count(F.lit(1)).alias("total"))


def union_index(bridge: DataFrame, contracts: DataFrame) -> DataFrame:
    """Sectors, unions and documents in bridge order, each with its distinct documents."""
    rows = bridge.join(contracts, bridge["doc_id"] == contracts["id"], "left")
    counts = bridge.groupBy("union_name").agg(F.countDistinct("doc_id").alias("n_docs"))
    return rows.join(counts, "union_name").orderBy("sector_pos", "union_pos", "doc_pos")


def directory(contracts: DataFrame, types: list[str], default: str = "moa") -> DataFrame:
    """Documents by type in a fixed order, then by people and label; earlier documents last."""
    kind = F.coalesce("doc_type", F.lit(default))
    place = F.array_position(F.array(*map(F.lit, types)), kind)
    return contracts.withColumn("doc_type", kind).orderBy(~is_current(), place, F.desc(F.coalesce("headcount", F.lit(0))), "label")


def find_units(units: DataFrame, text: str, synonyms: dict[str, list[str]], columns: list[str], sector: str = "") -> DataFrame:
    """Units whose fields hold a text, or that a synonym found in it names.  Synonyms are patterns
    that stand as whole words."""
    q = text.strip().lower()
    ids = sorted({i for term, found in synonyms.items() if q and re.search(rf"(^|[^a-z0-9]){term}($|[^a-z0-9])", q) for i in found})
    out = units.where(F.col("sector") == sector) if sector else units
    if not q:
        return out
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(F.array_join(c, " ") if dict(units.dtypes)[c].startswith("array") else F.col(c).cast("string"), F.lit("")) for c in columns]))
    return out.where(F.contains(blob, F.lit(q)) | F.col("contract_id").isin(ids))


def wage_tracker(wages: DataFrame) -> DataFrame:
    """Wages with the compound of their steps."""
    return wages.withColumn("cumulative_pct", compounded(F.transform("increases", lambda x: x["pct"].cast("double"))))


def date_patterns(iso: str) -> list[str]:
    """How a text may write a date, or the month of a term that a step falls in."""
    m = re.fullmatch(r"month-(\d+)", iso)
    if m:
        n = int(m[1])
        return [r"first\s+day\s+of\s+the\s+applicable\s+Successor"] if n == 1 else [rf"{n}\s*(?:st|nd|rd|th)\s+month"]
    try:
        d = date.fromisoformat(iso)
    except ValueError:
        return []
    long, short, yy = fixed.MONTHS_LONG[d.month - 1], fixed.MONTHS_LONG[d.month - 1][:3], d.year % 100
    forms = [f"{long} {d.day}, {d.year}", f"{long} {d.day} {d.year}", f"{short}. {d.day}, {d.year}", f"{short} {d.day}, {d.year}"]
    forms += [f"{d.month}/{d.day}/{y}" for y in (d.year, f"{yy:02d}")] + [f"{d.month:02d}/{d.day:02d}/{y}" for y in (d.year, f"{yy:02d}")]
    return [quote(f).replace(" ", r"\s*") for f in forms]


def percent_pattern(pct: float) -> str:
    """How a text may write a percentage, with or without closing zeros."""
    body = rf"{int(pct)}(?:\.0+)?" if abs(pct - int(pct)) < 1e-9 else quote(f"{pct:.2f}".rstrip("0")) + "0*"
    return rf"(?<![\d.]){body}\s*%"


def verify_steps(steps: DataFrame, texts: DataFrame, reach: int = 250) -> DataFrame:
    """``contract_id, effective, pct, verified``: whether the percentage stands within ``reach``
    characters of a spelling of the date, in the document's text with its white space squeezed.

    Patterns depend on the step alone and are made once for each distinct pair; the text is tested
    by an expression that looks around each date.
    """
    pairs = steps.select("effective", F.col("pct").cast("double").alias("pct")).distinct().collect()  # a few hundred wage steps
    spark = steps.sparkSession
    known = spark.createDataFrame([(r["effective"], r["pct"], "(?i)" + "|".join(f"(?:{p})" for p in date_patterns(r["effective"])) if date_patterns(r["effective"]) else None, percent_pattern(r["pct"])) for r in pairs], "effective string, pct double, on string, rate string")
    rows = steps.withColumn("pct", F.col("pct").cast("double")).join(known, ["effective", "pct"], "left").join(texts.select("contract_id", F.regexp_replace("text", r"[\s ]+", " ").alias("flat")), "contract_id", "left")
    # a run before each date and a run after it: the date itself is inside the window
    marked = F.split(F.regexp_replace("flat", F.expr("concat('(', `on`, ')')"), "\ue000$1\ue001"), "\ue000")
    windows = F.transform(
        F.sequence(F.lit(1), F.size(marked) - 1),
        lambda i: F.concat(
            F.right(F.translate(F.array_join(F.slice(marked, 1, i), ""), "\ue001", ""), F.lit(reach)),
            F.left(F.translate(F.array_join(F.slice(marked, i + 1, 1_000_000), ""), "\ue001", ""), F.length(F.element_at(F.split(F.get(marked, i), "\ue001"), 1)) + reach),
        ),
    )
    ok = F.when(F.size(marked) > 1, F.exists(windows, lambda w: F.regexp_like(w, F.col("rate")))).otherwise(F.lit(False))
    return rows.select("contract_id", "effective", "pct", F.coalesce(ok, F.lit(False)).alias("verified"))


def verified_contracts(checked: DataFrame) -> DataFrame:
    """Documents all of whose steps are verified."""
    return checked.groupBy("contract_id").agg(F.bool_and("verified").alias("text_checked"))


def facts(contracts: DataFrame, units: DataFrame, wages: DataFrame) -> DataFrame:
    """What may be published: verified headcounts with a source, and wages checked against the text."""
    u = units.where("headcount_verified AND headcount > 0 AND headcount_source IS NOT NULL").select(F.col("contract_id").alias("id"), "headcount", "headcount_source")
    w = wages.where("text_checked").select(F.col("contract_id").alias("id"), F.transform("increases", lambda x: F.struct(facts_date(x["effective"]).alias("effective"), x["pct"].alias("pct"))).alias("steps"), "cumulative_pct")
    return contracts.select("id", "label").join(u, "id", "left").join(w, "id", "left").where("headcount IS NOT NULL OR steps IS NOT NULL")


def review_tally(decisions: DataFrame, suspects: DataFrame) -> DataFrame:
    """Approved, skipped and pending items of a review queue; keys are clause and token."""
    done = decisions.groupBy("clause_id", "original").agg(F.max_by("action", "at").alias("action"))
    return suspects.select("clause_id", "original").distinct().join(done, ["clause_id", "original"], "left").agg(F.count_if(F.col("action") == "approve").alias("approved"), F.count_if(F.col("action") == "skip").alias("skipped"), F.count_if(F.col("action").isNull()).alias("pending"))


def recognition_text(clauses: DataFrame, chars: int = 1500) -> DataFrame:
    """The recognition clause of each document: the longest under such a heading, else the start
    of its first clause if it speaks of recognition."""
    h = F.lower(F.coalesce("heading", F.lit("")))
    wanted = F.contains(h, F.lit("recogni")) | F.contains(h, F.lit("bargaining unit")) | F.contains(h, F.lit("preamble"))
    best = F.max(F.when(wanted, F.struct(F.length(F.coalesce("text", F.lit(""))).alias("n"), (-F.col("clause_no")).alias("o"), F.col("text").alias("t"))))["t"]
    first = F.substring(F.coalesce(F.min_by("text", "clause_no"), F.lit("")), 1, chars)
    spoken = F.when(first.rlike(r"(?i)recogni[sz]e[ds]?\s+as|hereby recognized|exclusive (collective )?bargaining representative"), first)
    return clauses.groupBy("contract_id").agg(F.coalesce(best, spoken).alias("recognition"))


def ocr_badge(quality: str = "ocr_quality") -> Column:
    """The badge of a document whose recognised pages were rated; none for other ratings."""
    out = F
    for rating, badge in fixed.OCR_BADGES.items():
        out = out.when(F.col(quality) == rating, badge)
    return out


def missing_panel(grouped: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row on what the corpus lacks: unpublished documents, and amendments whose base is outside it,
    those of them that only link it, and those whose chain is inside.

    ``grouped`` has the flags of ``lineage.amendment_groups``."""
    chain = F.coalesce("amends_predecessor", F.lit(False)) & F.col("companion").isNull() & F.col("has_chain")
    a = grouped.agg(F.count_if("lacks_base").alias("n_lacking"), F.count_if("linked_only").alias("n_linked"), F.count_if(chain).alias("n_chain"), F.count_if(F.col("lacks_base") | F.col("linked_only")).alias("n_outside"))
    b = gaps.agg(F.count(F.lit(1)).alias("n_unpublished"))
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").drop("__k")


def lacking_base(grouped: DataFrame) -> DataFrame:
    """The documents whose base is not in the corpus, by label."""
    return grouped.where("lacks_base").orderBy("label")
