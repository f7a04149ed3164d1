"""Aggregates, pivots, status and verification reports over the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranks, reports
from .registry import Tables, query

AS_OF = date(1999, 6, 30)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def agg03_by_sector(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")
def agg04_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n"))


@query("""
SELECT count(*) FILTER (c_acctbal > 0 AND c_custkey % 10 <> 0) AS n_units, CAST(coalesce(sum(c_nationkey) FILTER (c_acctbal > 0 AND c_custkey % 10 <> 0), 0) AS BIGINT) AS headcount FROM customer
""")
def agg05_headcount(t: Tables) -> DataFrame:
    units = t.customer.select((F.col("c_acctbal") > 0).alias("headcount_verified"), F.when(F.col("c_custkey") % 10 == 0, "other").alias("headcount_duplicate_of"), F.col("c_nationkey").alias("headcount"))
    return reports.headcount_total(units)


@query("""
SELECT (SELECT count(*) FROM documents WHERE lang <> 'de') AS contracts, (SELECT count(*) FROM documents WHERE lang = 'de') AS earlier_documents, (SELECT count(*) FROM conversations) AS clauses,
       (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM pages WHERE page_id % 5 = 0) AS ocr_pages
""")
def agg06_manifest(t: Tables) -> DataFrame:
    return reports.manifest(t.documents.select(F.when(F.col("lang") == "de", "earlier").alias("era")), t.conversations, t.pages.select((F.col("page_id") % 5 == 0).alias("ocr")))


@query("""
WITH l AS (SELECT l_orderkey, list(l_discount * 100 ORDER BY l_linenumber, l_discount) AS p FROM lineitem GROUP BY l_orderkey),
f AS (SELECT l_orderkey, (list_reduce(list_prepend(1.0::DOUBLE, p), lambda a, x: a * (1 + x / 100)) - 1) * 100 AS c FROM l)
SELECT l_orderkey, CAST(round(CAST(CAST(c AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS compounded FROM f
""")
def agg07_compounded(t: Tables) -> DataFrame:
    """All lines of an order in turn; ties of the shortest decimal form go up."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount"))).alias("p"))
    return lines.select("l_orderkey", text.compounded(F.transform("p", lambda x: x["l_discount"] * 100)).alias("compounded"))


@query("""
SELECT l_orderkey, floor(product(100 + round(l_discount * 100)) / pow(100, count(*)) * 1000000 + 0.5) / 1000000 AS factor FROM lineitem GROUP BY l_orderkey
""")
def agg07_product(t: Tables) -> DataFrame:
    """Per order over all its lines, multiplied in hundredths, which is exact up to seven lines."""
    whole = F.product(100 + F.round(F.col("l_discount") * 100)) / F.pow(F.lit(100.0), F.count(F.lit(1)))
    return t.lineitem.groupBy("l_orderkey").agg((F.floor(whole * 1000000 + 0.5) / 1000000).alias("factor"))


@query("SELECT coalesce(format('{:.2f}', round(avg(value), 2)), '—') AS average FROM events WHERE value >= 18 AND value < 25")
def agg08_band(t: Tables) -> DataFrame:
    return reports.average_in_band(t.events, "value")


@query("""
SELECT o_orderpriority AS doc_type, count(*) AS n, list_sort(list(o_totalprice))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM orders GROUP BY o_orderpriority
""")
def agg09_upper_median(t: Tables) -> DataFrame:
    return reports.type_summary(t.orders.select(F.col("o_orderpriority").alias("doc_type"), F.col("o_totalprice").alias("chars")))


@query("SELECT vendor_id, n, sorted[greatest(CAST(ceil(n * 0.9::DOUBLE) AS BIGINT), 1)] AS amount FROM (SELECT vendor_id, count(amount) AS n, list_sort(list(amount) FILTER (amount IS NOT NULL)) AS sorted FROM sale_lines GROUP BY vendor_id) WHERE n > 0")
def agg09_vendor_amounts(t: Tables) -> DataFrame:
    """The amount that nine lines in ten of a vendor do not exceed."""
    return ranks.at_place(t.sale_lines, "vendor_id", "amount", ranks.percentile_place(0.9), "amount")


@query("""
WITH p AS (SELECT DISTINCT source, lang, length(text) % 5 AS topic FROM documents), s AS (SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY lang),
c AS (SELECT topic, lang, count(*) AS k FROM p GROUP BY topic, lang)
SELECT CAST(topic AS VARCHAR) AS topic, CAST(round_even(100.0 * coalesce(max(k) FILTER (c.lang = 'en'), 0) / (SELECT n FROM s WHERE lang = 'en'), 0) AS INTEGER) AS en,
       CAST(round_even(100.0 * coalesce(max(k) FILTER (c.lang = 'de'), 0) / (SELECT n FROM s WHERE lang = 'de'), 0) AS INTEGER) AS de FROM c GROUP BY topic
""")
def agg10_coverage(t: Tables) -> DataFrame:
    d = t.documents.select("source", "lang", (F.length("text") % 5).cast("string").alias("topic"))
    return reports.coverage_matrix(d, d, "topic", "lang", "source", ["en", "de"])


@query("SELECT conv_id, string_agg(role, chr(10) ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def agg11_concat(t: Tables) -> DataFrame:
    return reports.concatenated(t.conversations, "conv_id", "turn", "role", "\n", "roles")


@query("SELECT CAST(user_id AS VARCHAR) AS contract_id, list_sort(list_distinct(list(event_type))) AS topics FROM events GROUP BY user_id")
def agg12_topic_sets(t: Tables) -> DataFrame:
    return reports.topic_sets(t.events.select(F.col("user_id").cast("string").alias("contract_id"), F.array("event_type").alias("topics")))


@query("""
SELECT doc_id AS contract_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS INTEGER) AS solid FROM documents
""")
def agg18_solid(t: Tables) -> DataFrame:
    from ..operators import segment

    d = t.documents.select(F.col("doc_id").alias("contract_id"), "text")
    return segment.coverage(d, d).select("contract_id", "solid")


@query("SELECT conv_id, max(coalesce(turn, 1)) AS last_page, count(DISTINCT turn) FILTER (role = 'user') AS ocr_pages FROM conversations GROUP BY conv_id")
def agg19_page_span(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max(F.coalesce("turn", F.lit(1))).alias("last_page"), F.countDistinct(F.when(F.col("role") == "user", F.col("turn"))).alias("ocr_pages"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def agg21_duplicates(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT r_name, count(DISTINCT c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def agg22_per_sector(t: Tables) -> DataFrame:
    return t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("r_name").agg(F.countDistinct("c_custkey").alias("n"))


@query("""
WITH d AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, event_type),
s AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT count(*) FILTER (v > 50) AS approved, count(*) FILTER (v <= 50) AS skipped, count(*) FILTER (v IS NULL) AS pending FROM s LEFT JOIN d USING (user_id, event_type)
""")
def agg23_review(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("clause_id"), F.col("event_type").alias("original"), F.when(F.col("value") > 50, "approve").otherwise("skip").alias("action"), F.col("event_id").alias("at"))
    return reports.review_tally(e.where("original IN ('click', 'view')"), e)


_STATUS = """
WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS e, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE year(o_orderdate) END AS y FROM orders),
s AS (SELECT id, e, y, CASE WHEN id % 50 = 0 THEN 'superseded' WHEN e IS NOT NULL THEN CASE WHEN e < DATE '1999-06-30' THEN 'expired' WHEN e - DATE '1999-06-30' <= 183 THEN 'expiring' ELSE 'current' END
  WHEN y IS NULL THEN 'unknown' WHEN y < 1999 THEN 'expired' WHEN y = 1999 THEN 'expiring' ELSE 'current' END AS status_key FROM c)
"""


def _status(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("label"), F.lit(None).cast("string").alias("start_date"), F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate").cast("string")).alias("end_date"), F.lit(None).cast("int").alias("term_start"), F.when(F.col("o_orderkey") % 6 != 0, F.year("o_orderdate")).alias("term_end"))
    gaps = t.orders.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("contract_id"), F.lit(0).alias("pos"), F.lit("Replaced").alias("status"), F.lit("superseded").alias("status_key"))
    return reports.status(o, AS_OF, gaps)


@query(_STATUS + "SELECT id, status_key FROM s")
def cas08_status(t: Tables) -> DataFrame:
    return _status(t).select("id", "status_key")


@query(_STATUS + "SELECT count(*) FILTER (status_key = 'superseded') AS superseded, count(*) FILTER (status_key = 'continued') AS continued, count(*) FILTER (status_key = 'expired') AS expired, count(*) FILTER (status_key = 'expiring') AS expiring, count(*) FILTER (status_key = 'current') AS current, count(*) FILTER (status_key = 'unknown') AS unknown, count(*) FILTER (status_key IN ('expired', 'continued', 'superseded')) AS past, count(*) AS total FROM s")
def agg20_past_due(t: Tables) -> DataFrame:
    return reports.past_due(_status(t))


@query(_STATUS + """
SELECT id, CASE WHEN status_key = 'superseded' THEN 'Replaced' WHEN e IS NOT NULL THEN CASE status_key WHEN 'expired' THEN 'Expired ' || d || '; terms continue until a successor is reached' WHEN 'expiring' THEN 'Expires ' || d ELSE 'Runs to ' || d END
  WHEN y IS NULL THEN 'End date not stated' WHEN status_key = 'expired' THEN 'Expired in ' || y || '; terms continue until a successor is reached' WHEN status_key = 'expiring' THEN 'Ends in ' || y || ' (exact date not stated)' ELSE 'Runs to ' || y END AS status
FROM (SELECT *, ['Jan.', 'Feb.', 'March', 'April', 'May', 'June', 'July', 'Aug.', 'Sept.', 'Oct.', 'Nov.', 'Dec.'][month(e)] || ' ' || day(e) || ', ' || year(e) AS d FROM s)
""")
def qry08_expirations(t: Tables) -> DataFrame:
    return reports.expirations(_status(t)).select("id", "status")


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-06-30') AS days FROM orders")
def scl36_days(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.datediff(F.lit(AS_OF), F.to_date("o_orderdate")).cast("long").alias("days"))


@query("SELECT o_orderkey, ['Jan.', 'Feb.', 'March', 'April', 'May', 'June', 'July', 'Aug.', 'Sept.', 'Oct.', 'Nov.', 'Dec.'][month(o_orderdate)] || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) AS d FROM orders")
def scl05_ap_date(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", text.ap_date("o_orderdate").alias("d"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Day 1 of unit agreement' WHEN o_orderkey % 4 = 1 THEN 'Month ' || (o_orderkey % 60 + 2) WHEN o_orderkey % 4 = 2 THEN 'On ratification' ELSE
  ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][month(o_orderdate)] || ' ' || day(o_orderdate) || ', ' || (year(o_orderdate) + 20) END AS d FROM orders
""")
def scl06_step_dates(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    iso = F.concat((F.year(d) + 20).cast("string"), F.date_format(d, "-MM-dd"))
    e = F.when(k % 4 == 0, "month-1").when(k % 4 == 1, F.concat(F.lit("month-"), (k % 60 + 2).cast("string"))).when(k % 4 == 2, "on-ratification").otherwise(iso)
    return t.orders.select("o_orderkey", text.step_date(e).alias("d"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || '–' || (year(o_orderdate) + 3) ELSE 'Term not stated' END AS term FROM orders")
def prj05_term_text(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    y = F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate"))
    return t.orders.select("o_orderkey", text.term_text(none, none, y, y + 3).alias("term"))


@query("SELECT page_id, url || '#page=' || (page_id % 9) AS link FROM pages")
def prj07_page_link(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.page_link("url", F.col("page_id") % 9).alias("link"))


@query("SELECT doc_id, CASE WHEN source <> 'src1' THEN source END AS heading_raw FROM documents")
def prj08_drop_equal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.col("source") != "src1", F.col("source")).alias("heading_raw"))


@query("SELECT event_id, round(value / greatest((SELECT max(value) FROM events), 4) * 100, 1) AS width FROM events")
def prj11_bar_width(t: Tables) -> DataFrame:
    return reports.bar_widths(t.events.select("event_id", "value"), "value").select("event_id", "width")


@query("""
SELECT doc_id, list_slice(list_filter(list_transform(regexp_extract_all(substr(t, 1, 8000), '(\\d{1,2}\\.\\d{1,2})\\s*%', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x > 0.5 AND x < 8.5), 1, 8) AS pcts
FROM (SELECT doc_id, (doc_id % 12) || '.25% and ' || (doc_id % 7) || '.5 % of ' || text AS t FROM documents)
""")
def scl10_percents(t: Tables) -> DataFrame:
    made = F.concat((F.col("doc_id") % 12).cast("string"), F.lit(".25% and "), (F.col("doc_id") % 7).cast("string"), F.lit(".5 % of "), F.col("text"))
    return t.documents.select("doc_id", text.percents(made).alias("pcts"))


@query("""
SELECT s_suppkey AS contract_id FROM supplier WHERE strpos(lower(s_name || ' ' || s_nationkey), '#00000001') > 0 OR s_suppkey IN (3, 4)
""")
def flt06_units(t: Tables) -> DataFrame:
    units = t.supplier.select(F.col("s_suppkey").alias("contract_id"), "s_name", "s_nationkey")
    return reports.find_units(units, "#00000001", {"#00000001": [3, 4]}, ["s_name", "s_nationkey"]).select("contract_id")


@query("""
SELECT r_name AS union_name, n_nationkey AS id, (SELECT count(*) FROM nation m WHERE m.n_regionkey = r_regionkey) AS n_docs FROM region JOIN nation ON n_regionkey = r_regionkey
""")
def qry06_union_index(t: Tables) -> DataFrame:
    bridge = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit(0).alias("sector_pos"), F.col("r_regionkey").alias("union_pos"), F.col("n_nationkey").alias("doc_pos"), F.col("r_name").alias("union_name"), F.col("n_nationkey").alias("doc_id"))
    return reports.union_index(bridge, t.nation.select(F.col("n_nationkey").alias("id"))).select("union_name", "id", "n_docs")


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, 'moa') AS doc_type FROM customer")
def qry07_directory(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit(None).cast("string").alias("era"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("doc_type"), F.col("c_nationkey").alias("headcount"))
    return reports.directory(c, ["moa", "AUTOMOBILE", "FURNITURE", "MACHINERY", "HOUSEHOLD"]).select("id", "doc_type")


@query("""
WITH s AS (SELECT l_orderkey, list(CAST(CAST(l_quantity AS BIGINT) % 4 AS DOUBLE) ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS contract_id, round((list_reduce(list_prepend(CAST(1 AS DOUBLE), list_transform(p, lambda x: 1 + x / 100)), lambda a, b: a * b) - 1) * 100, 2) AS cumulative_pct FROM s
""")
def qry14_wages(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("contract_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", (F.col("l_quantity").cast("long") % 4).cast("double").alias("pct")))), lambda x: F.struct(x["pct"].alias("pct"))).alias("increases"))
    return reports.wage_tracker(s).select("contract_id", "cumulative_pct")


@query("""
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 AND c_nationkey > 0 AND c_custkey % 8 <> 0 THEN c_nationkey END AS headcount, c_custkey % 3 = 0 AS paid FROM customer)
SELECT id, headcount, CASE WHEN paid THEN CASE WHEN id % 2 = 0 THEN 'July 1, 2024' ELSE 'First day of month 5' END END AS effective, CASE WHEN paid THEN 3.25 END AS pct FROM c WHERE headcount IS NOT NULL OR paid
""")
def qry15_facts(t: Tables) -> DataFrame:
    """Headcounts that are verified, positive and sourced; wages that were checked against the text."""
    k = F.col("c_custkey")
    c = t.customer.select(k.alias("id"), F.col("c_name").alias("label"))
    source = F.when(k % 8 != 0, F.struct(F.lit("p").alias("publisher")))
    units = t.customer.select(k.alias("contract_id"), (F.col("c_acctbal") > 0).alias("headcount_verified"), F.col("c_nationkey").alias("headcount"), source.alias("headcount_source"))
    step = F.struct(F.when(k % 2 == 0, "2024-07-01").otherwise("month-5").alias("effective"), F.lit(3.25).alias("pct"))
    wages = t.customer.where("c_custkey % 3 <> 1").select(k.alias("contract_id"), (k % 3 == 0).alias("text_checked"), F.array(step).alias("increases"), F.lit(3.25).alias("cumulative_pct"))
    out = reports.facts(c, units, wages)
    return out.select("id", "headcount", F.get("steps", F.lit(0))["effective"].alias("effective"), F.get("steps", F.lit(0))["pct"].alias("pct"))


@query("""
SELECT item_id AS contract_id, CASE WHEN item_id % 3 = 0 THEN false WHEN item_id % 3 = 1 THEN true ELSE false END AS verified FROM benchmark
""")
def qry19_verified_steps(t: Tables) -> DataFrame:
    near, far = F.lit(" On July 1, 2024 all rates rise by 3.25 % . "), F.concat(F.lit(" July 1, 2024 "), F.repeat(F.lit("word "), 80), F.lit(" 3.25% "))
    k = F.col("item_id") % 3
    texts = t.benchmark.select(F.col("item_id").alias("contract_id"), F.concat("text", F.when(k == 1, near).when(k == 2, far).otherwise(""), "text").alias("text"))
    steps = texts.select("contract_id", F.lit("2024-07-01").alias("effective"), F.lit(3.25).alias("pct"))
    return reports.verified_contracts(reports.verify_steps(steps, texts)).select("contract_id", F.col("text_checked").alias("verified"))


@query("""
WITH x AS (SELECT source, doc_id, text, lang, row_number() OVER (PARTITION BY source ORDER BY (lang = 'fr') DESC, CASE WHEN lang = 'fr' THEN -length(text) ELSE 0 END, doc_id) AS n FROM documents)
SELECT source AS contract_id, CASE WHEN lang = 'fr' THEN md5(text) END AS digest FROM x WHERE n = 1
""")
def cas09_recognition(t: Tables) -> DataFrame:
    c = t.documents.select(F.col("source").alias("contract_id"), F.col("doc_id").alias("clause_no"), F.when(F.col("lang") == "fr", "Recognition").otherwise("Other").alias("heading"), "text")
    return reports.recognition_text(c).select("contract_id", F.md5("recognition").alias("digest"))


@query("""
WITH x AS (SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'Union (U' || page_id || ')' ELSE 'Guild, Local' END) AS name, 'Full Name — Part ' || page_id AS label FROM pages)
SELECT page_id, (CASE WHEN page_id % 3 = 0 THEN 'U' || page_id ELSE 'Guild' END) || ': Part ' || page_id AS chip FROM x
""")
def scl22_chips(t: Tables) -> DataFrame:
    k = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Union (U"), k, F.lit(")"))).otherwise("Guild, Local")
    return t.pages.select("page_id", text.chip_label(name, F.concat(F.lit("Full Name — Part "), k)).alias("chip"))


@query("SELECT o_orderkey, format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS shown FROM orders")
def scl34_numbers(t: Tables) -> DataFrame:
    """Ties go away from zero."""
    return t.orders.select("o_orderkey", F.format_number(F.round("o_totalprice"), 0).alias("shown"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'seen ' || event_id ELSE '' END AS caveat FROM events")
def scl37_caveats(t: Tables) -> DataFrame:
    note = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Note. Caveat:  seen "), F.col("event_id").cast("string"))).otherwise("plain")
    return t.events.select("event_id", text.after_mark(note).alias("caveat"))


@query("""
SELECT s_name AS original, upper(s_name) AS replacement, list_sort(list(DISTINCT CAST(s_nationkey AS VARCHAR))) AS contracts, count(*) AS count FROM supplier WHERE s_acctbal > 0 GROUP BY s_name
""")
def snk17_approved(t: Tables) -> DataFrame:
    from ..sources import sinks

    d = t.supplier.select(F.col("s_name").alias("original"), F.upper("s_name").alias("replacement"), F.col("s_nationkey").cast("string").alias("contract_id"), F.when(F.col("s_acctbal") > 0, "approve").otherwise("skip").alias("action"))
    return sinks.approved(d)


@query("""
SELECT l_orderkey, sum(l_quantity) AS quantity, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS BIGINT) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY l_orderkey
""")
def agg_revenue(t: Tables) -> DataFrame:
    """A fact table by its dimension: both meet on the key that is grouped by, so one shuffle serves both."""
    o = t.orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(o, "l_orderkey").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("long")).alias("revenue"))
