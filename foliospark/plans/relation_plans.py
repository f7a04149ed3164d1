"""Joins, windows, sorts, set operations and chains over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.query import QuerySpec
from ..operators import lineage, quality, ranks, relations as r, reports, search
from ..shared import Shared
from ..sources import fields, readers, sinks
from ..streaming import ingest
from .registry import Tables, query


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def src01_json_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""
SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id
""")
def src14_last_wins(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("""
SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def jon01_lookup(t: Tables) -> DataFrame:
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    region = t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return r.lookup(r.lookup(t.customer, nation, "c_nationkey"), region, "n_regionkey").select("c_custkey", "n_name", "r_name")


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN NULL ELSE 'checked' END ELSE d.lang END AS lang, l.doc_id IS NOT NULL AS curated
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def prj02_overlay(t: Tables) -> DataFrame:
    curated = t.labels.select("doc_id", F.when(F.col("toxic") != 1, "checked").alias("lang"))
    return r.overlay(t.documents.select("doc_id", "lang"), curated, "doc_id")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1
""")
def jon05_first_link(t: Tables) -> DataFrame:
    return r.first_link(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def _gathered(orders: DataFrame) -> DataFrame:
    return r.gather(orders.withColumn("at", F.struct("o_orderdate", "o_orderkey")), "o_custkey", "at", "o_orderkey", "orders")


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def jon06_gather(t: Tables) -> DataFrame:
    return _gathered(t.orders)


@query("""
SELECT a.n_nationkey, b.n_name AS next_name FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 1
""")
def jon07_self_join(t: Tables) -> DataFrame:
    nxt = t.nation.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("next_name"))
    return r.lookup(t.nation.select("n_nationkey"), nxt, "n_nationkey")


@query("""
WITH l AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name, unnest([CAST(n_regionkey AS VARCHAR), CAST(n_nationkey + 1 AS VARCHAR), 'none']) AS t, unnest([0, 1, 2]) AS pos FROM nation),
j AS (SELECT l.id, pos, n.n_name AS v FROM l JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = l.t)
SELECT id, list(v ORDER BY pos) AS names FROM j GROUP BY id
""")
def jon08_follow_links(t: Tables) -> DataFrame:
    s = lambda c: c.cast("string")
    rows = t.nation.select(s(F.col("n_nationkey")).alias("id"), "n_name", F.array(s(F.col("n_regionkey")), s(F.col("n_nationkey") + 1), F.lit("none")).alias("links"))
    return r.follow(rows, "id", "links", "names", "n_name").select("id", "names")


@query("""
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
""")
def jon09_overlap(t: Tables) -> DataFrame:
    links = t.customer.select("c_custkey", F.array("c_custkey").alias("links"))
    return r.overlapping(links, "c_custkey", "links", t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("id"))).select("c_custkey")


@query("""
SELECT DISTINCT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
""")
def jon10_add_new(t: Tables) -> DataFrame:
    a, b = t.orders.select(F.col("o_custkey").alias("k")).distinct(), t.customer.select(F.col("c_custkey").alias("k"))
    once = r.add_new(a, b, "k")
    return r.add_new(once, b, "k")


@query("""
SELECT e.event_id, f.event_id AS event_id_other FROM events e JOIN events f ON e.user_id = f.user_id AND e.event_type = 'error' AND f.event_type = 'click'
 AND abs(CAST(floor(epoch(e.ts)) AS BIGINT) - CAST(floor(epoch(f.ts)) AS BIGINT)) <= 600
""")
def jon14_within(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    pick = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    return r.within(pick("error"), pick("click"), "user_id", "at", 600).select("event_id", "event_id_other")


@query("""
SELECT e.event_id, (SELECT max_by(s.event_id, s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) AS signup FROM events e WHERE e.event_type = 'purchase'
""")
def jon15_as_of(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "ts", "event_id", "event_type")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("mark"))
    return r.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), marks, "user_id", "ts", "mark", "signup").select("event_id", "signup")


@query("""
SELECT o_orderkey, CASE WHEN l.l_orderkey IS NOT NULL THEN 'on url' END AS found FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) l ON l_orderkey = o_orderkey
""")
def jon17_match(t: Tables) -> DataFrame:
    hit = t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("found", F.lit("on url"))
    return t.orders.select("o_orderkey").join(hit, "o_orderkey", "left")


@query("""
SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations
""")
def jon18_neighbours(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.conversations.select("conv_id", "turn", "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_role"))


@query("""
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders
""")
def jon19_flag(t: Tables) -> DataFrame:
    hit = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("returned", F.lit(True))
    return t.orders.select("o_orderkey").join(hit, "o_orderkey", "left").withColumn("returned", F.coalesce("returned", F.lit(False)))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events
""")
def win01_carry(t: Tables) -> DataFrame:
    return r.carry(t.events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "before", own=False).select("event_id", "before")


@query("""
WITH x AS (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS c, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, CASE WHEN c > 1 THEN p_name || '-' || n ELSE p_name END AS p_name FROM x
""")
def win02_numbered(t: Tables) -> DataFrame:
    return r.number_duplicates(t.part.select("p_partkey", "p_name"), "p_name", ["p_partkey"])


@query("""
WITH x AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, CASE WHEN n > 1 THEN p_name || '-' || n ELSE p_name END AS p_name FROM x
""")
def win09_unique(t: Tables) -> DataFrame:
    return r.number_duplicates(t.part.select("p_partkey", "p_name"), "p_name", ["p_partkey"], every=False)


@query("""
SELECT event_id, CAST(coalesce(sum(length(event_type) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM events
""")
def win04_offsets(t: Tables) -> DataFrame:
    return r.running_offset(t.events, "user_id", ["event_id"], F.length("event_type") + 1, "start").select("event_id", "start")


@query("""
SELECT o_custkey, o_orderkey, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3
""")
def win05_top_k(t: Tables) -> DataFrame:
    return r.top_k(t.orders, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("int").alias("rank"))


@query("""
WITH x AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) SELECT user_id, event_type, event_id FROM x WHERE n = 1
""")
def win07_first_per_key(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", "event_id").withColumn("k", F.struct("user_id", "event_type"))
    return r.first_link(e, "k", ["event_id"]).drop("k")


@query("""
WITH x AS (SELECT *, (event_type = 'purchase')::INT AS p, min(event_id) OVER (PARTITION BY user_id) AS first FROM events),
y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, CASE WHEN p = 1 THEN event_id ELSE -event_id END) AS n FROM x)
SELECT user_id, event_type, first AS event_id, value FROM y WHERE n = 1
""")
def win08_prefer_source(t: Tables) -> DataFrame:
    return r.prefer(t.events.select("user_id", "event_type", "event_id", "value"), "user_id", "event_id", F.col("event_type") == "purchase")


@query("""
WITH x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT event_id FROM x WHERE b IS NULL OR b <> event_type
""")
def win10_drop_repeats(t: Tables) -> DataFrame:
    return r.drop_repeats(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id")


@query("""
SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS n FROM documents) WHERE n = 1
""")
def srt09_longest(t: Tables) -> DataFrame:
    return r.longest(t.documents.select("source", "doc_id", "text"), "source", "text", "doc_id").select("source", "doc_id")


@query("""
SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, 0) DESC, s_name) AS place FROM supplier
""")
def srt02_headcount(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_nationkey", F.col("s_name").alias("label"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("headcount"))
    return ranks.places(s, r.headcount_order(), "s_nationkey").select("s_suppkey", "place")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_name || p_partkey) AS place FROM part")
def srt03_labels(t: Tables) -> DataFrame:
    """Without counts, labels alone decide."""
    p = t.part.select("p_partkey", "p_size", F.concat("p_name", F.col("p_partkey").cast("string")).alias("label"), F.lit(None).cast("int").alias("headcount"))
    return ranks.places(p, r.headcount_order(), "p_size").select("p_partkey", "place")


@query("""
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(nullif(CASE WHEN p_size % 5 = 0 THEN p_size % 2 ELSE p_size END, 0), 9999), p_name || p_partkey) AS place FROM part
""")
def srt04_term(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_brand", F.concat("p_name", F.col("p_partkey").cast("string")).alias("label"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).otherwise(F.col("p_size") % 2).alias("term_end"))
    return ranks.places(p, r.term_order("term_end"), "p_brand").select("p_partkey", "place")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice END DESC, o_orderkey) AS place FROM orders
""")
def srt05_cumulative(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("cumulative_pct"))
    return ranks.places(o, r.largest_order("cumulative_pct", "o_orderkey"), "o_custkey").select("o_orderkey", "place")


@query("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END, conv_id || '__' || turn) AS place FROM conversations
""")
def srt07_clause_order(t: Tables) -> DataFrame:
    """Ids are text: ``x__10`` comes before ``x__2`` on the same page."""
    c = t.conversations.select("conv_id", "turn", F.col("conv_id").alias("contract_id"), F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("page"), F.concat(F.col("conv_id").cast("string"), F.lit("__"), F.col("turn").cast("string")).alias("id"))
    return ranks.places(c, r.clause_order(), "contract_id").select("conv_id", "turn", "place")


@query("""
SELECT event_id, count(*) OVER (PARTITION BY token) AS frequency, row_number() OVER (PARTITION BY contract_id ORDER BY f DESC, distance, token, event_id) AS place
FROM (SELECT *, count(*) OVER (PARTITION BY token) AS f FROM (SELECT event_id, user_id AS contract_id, event_type || (event_id % 5) AS token, event_id % 2 AS distance FROM events))
""")
def srt08_suspects(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.col("user_id").alias("contract_id"), F.concat("event_type", (F.col("event_id") % 5).cast("string")).alias("token"), (F.col("event_id") % 2).alias("distance"))
    return quality.by_frequency(e, "distance", "token", "event_id").select("event_id", "frequency", "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice END DESC, o_orderkey) AS place FROM orders")
def srt05_overall(t: Tables) -> DataFrame:
    """The place of every order among all."""
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("cumulative_pct"))
    return ranks.places(o, r.largest_order("cumulative_pct", "o_orderkey")).select("o_orderkey", "place")


@query("SELECT sale_id, line_no, n, row_number() OVER (PARTITION BY vendor_id ORDER BY coalesce(amount, 0) DESC, sale_id NULLS FIRST, line_no, n) AS place FROM (SELECT vendor_id, sale_id, line_no, amount, count(*) AS n FROM sale_lines GROUP BY ALL)")
def srt05_vendor_lines(t: Tables) -> DataFrame:
    """The place of each different line among its vendor's, one of whom may have a third of all."""
    s = t.sale_lines.groupBy("vendor_id", "sale_id", "line_no", "amount").agg(F.count(F.lit(1)).alias("n"))
    return ranks.places(s, r.largest_order("amount", "sale_id", "line_no", "n"), "vendor_id").select("sale_id", "line_no", "n", "place")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY coalesce(CASE WHEN doc_id % 9 <> 0 THEN length(text) END, 0) DESC, doc_id) AS place FROM documents")
def srt11_chars(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", F.when(F.col("doc_id") % 9 != 0, F.length("text")).alias("chars"))
    return ranks.places(d, r.largest_order("chars", "doc_id"), "lang").select("doc_id", "place")


@query("""
SELECT doc_id, list_slice(list_filter(list_transform(regexp_extract_all(t, '(\\d{1,2}\\.\\d{1,2})\\s*%', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x > 0.5 AND x < 8.5), 1, 2) AS firsts
FROM (SELECT doc_id, '1.5% and ' || (doc_id % 12) || '.25% and 3.0 % and ' || (doc_id % 7) || '.5 %' AS t FROM documents)
""")
def lim01_first_k(t: Tables) -> DataFrame:
    made = F.concat(F.lit("1.5% and "), (F.col("doc_id") % 12).cast("string"), F.lit(".25% and 3.0 % and "), (F.col("doc_id") % 7).cast("string"), F.lit(".5 %"))
    return t.documents.select("doc_id", text.percents(made, most=2).alias("firsts"))


@query("SELECT c_custkey AS k, 'c' AS kind, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, 's', NULL FROM supplier")
def set01_union(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("k"), F.lit("c").alias("kind"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.lit("s").alias("kind")), allowMissingColumns=True)


@query("""
SELECT doc_id, source, lang FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 3 = 0
""")
def set03_replace(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "lang")
    fresh = d.where("source IN ('src1', 'src2') AND doc_id % 3 = 0").withColumn("lang", F.lit("new"))
    return r.replace_partition(d, fresh, "source")


@query("""
SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE lang END AS lang FROM documents
WHERE source <> 'src3' AND (source NOT IN ('src1', 'src2') OR n_chars >= 200)
""")
def set03_partitions(t: Tables) -> DataFrame:
    """A table by source in which two sources are replaced by what is made from them, and one is removed."""
    target = Shared(t.spark, "table").path("documents")
    sinks.replace_partitions(t.documents.select("doc_id", "source", "lang"), target, "source")
    mine = t.spark.read.parquet(target).where("source IN ('src1', 'src2')")
    long = t.documents.where("n_chars >= 200").select("doc_id")
    sinks.replace_partitions(mine.join(long, "doc_id", "left_semi").withColumn("lang", F.lit("new")), target, "source", gone=["src1", "src2", "src3"])
    return t.spark.read.parquet(target).select("doc_id", "source", "lang")


@query("""
SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""")
def flt13_ingest(t: Tables) -> DataFrame:
    """Events that arrive in three drops, of which a stream with state keeps the first of each user."""
    shared = Shared(t.spark, "ingest")
    e = t.events.select("user_id", "ts", "event_id", "event_type")
    days = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    first, last = days.agg(F.min("day"), F.max("day")).first() or (None, None)
    if first is None:
        return e.select("user_id", "event_id", "event_type", "ts")
    third = max((last - first).days // 3, 1)
    drop = F.least(F.floor(F.datediff(F.to_date("ts"), F.lit(first)) / third), F.lit(2))
    for k in range(3):
        e.where(drop == k).write.mode("append").parquet(shared.path("arrived"))
        run = ingest.ingest(t.spark, shared.path("arrived"), e.schema, shared.path("first"), shared.path("state"), "user_id", format="parquet", order=["ts", "event_id"])
        run.awaitTermination()
    return ingest.ingested(t.spark, shared.path("first")).select("user_id", "event_id", "event_type", "ts")


_FIELDS_SQL = """
WITH c AS (SELECT CASE WHEN json_valid(props) THEN CAST(props AS JSON) END AS p FROM clicks),
a AS (SELECT e.key AS path, e.value AS v FROM c, json_each(c.p) e WHERE json_type(c.p) = 'OBJECT'),
b AS (SELECT a.path || '.' || e.key AS path, e.value AS v FROM a, json_each(a.v) e WHERE json_type(a.v) = 'OBJECT')
"""


@query(_FIELDS_SQL + """
SELECT path, CASE json_type(v) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind, count(*) AS n
FROM (FROM a UNION ALL FROM b) GROUP BY ALL
""")
def src01_field_kinds(t: Tables) -> DataFrame:
    """The fields of all records and the kinds of their values, none of which is listed beforehand."""
    return fields.field_kinds(fields.records(t.clicks, "props"))


@query("""
WITH c AS (SELECT click_id, CASE WHEN json_valid(props) THEN CAST(props AS JSON) END AS p FROM clicks)
SELECT click_id, TRY_CAST(p ->> '$.k' AS BIGINT) AS k, p ->> '$.device.os' AS os, p ->> '$.items[0].sku' AS sku,
  CASE WHEN p IS NULL OR NOT json_exists(p, '$.tags') THEN 'absent' WHEN json_type(p, '$.tags') = 'NULL' THEN 'null' WHEN json_array_length(p, '$.tags') = 0 THEN 'empty' ELSE 'present' END AS tags FROM clicks JOIN c USING (click_id)
WHERE click_id IN (SELECT click_id FROM clicks GROUP BY click_id HAVING count(*) = 1)
""")
def src01_field_values(t: Tables) -> DataFrame:
    """Fields of the records of clicks that came once, absent told from empty."""
    once = t.clicks.groupBy("click_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("click_id")
    r = fields.records(t.clicks.join(once, "click_id", "left_semi"), "props")
    return r.select("click_id", fields.field("record", "k", "bigint").alias("k"), fields.field("record", "device.os", "string").alias("os"), fields.field("record", "items[0].sku", "string").alias("sku"), fields.state("record", "tags").alias("tags"))


@query("SELECT DISTINCT lang FROM documents WHERE lang IN ('en', 'de', 'xx')")
def set04_menu(t: Tables) -> DataFrame:
    menu = t.spark.createDataFrame([("en",), ("de",), ("xx",)], "lang string")
    return menu.join(t.documents.select("lang").distinct(), "lang", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set05_except(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY user_id")
def set06_distinct_array(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.sort_array(F.array_distinct(F.collect_list("event_type"))).alias("kinds"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'ring') THEN 'jewel' WHEN regexp_matches(lower(p_name), 'red|blue') THEN 'coloured' WHEN regexp_matches(lower(p_name), 'widget') THEN 'machine' ELSE 'other' END AS sector FROM part
""")
def cas06_first_match(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", rules.first_match(F.lower("p_name"), [("ring", "jewel"), ("red|blue", "coloured"), ("widget", "machine")], "other").alias("sector"))


@query("""
SELECT o_orderkey, CAST(regexp_extract(l, '(\\d{4})\\s*[-–]\\s*(\\d{4})', 1) AS INTEGER) AS a, CAST(regexp_extract(l, '(\\d{4})\\s*[-–]\\s*(\\d{4})', 2) AS INTEGER) AS z,
       CAST(nullif(regexp_extract(l, '(\\d{4})\\D+(\\d{4})\\s*$', 1), '') AS INTEGER) AS at_end
FROM (SELECT o_orderkey, 'Agreement ' || year(o_orderdate) || ' – ' || (year(o_orderdate) + 5) || CASE WHEN o_orderkey % 2 = 0 THEN ' amended' ELSE '' END AS l FROM orders)
""")
def prj09_terms(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    label = F.concat(F.lit("Agreement "), y.cast("string"), F.lit(" – "), (y + 5).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " amended").otherwise(""))
    rows = t.orders.select("o_orderkey", label.alias("l"))
    a, z = text.term_anywhere("l")
    return rows.select("o_orderkey", a.alias("a"), z.alias("z"), text.term_at_end("l")[0].alias("at_end"))


@query("""
WITH l AS (SELECT n_nationkey AS id, unnest([n_regionkey, n_nationkey, 99]) AS x, unnest([0, 1, 2]) AS pos FROM nation),
j AS (SELECT l.id, pos, n_name FROM l JOIN nation ON n_nationkey = x) SELECT id, string_agg(n_name, ' → ' ORDER BY pos) AS chain FROM j GROUP BY id
""")
def grf03_chains(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_nationkey").alias("id"), F.array("n_regionkey", "n_nationkey", F.lit(99)).alias("lineage"))
    return lineage.render(rows, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))).select("id", "chain")


def _chain_parts(t: Tables, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders of a customer as the chain of a document: urls by price bucket, none at every seventh order."""
    url = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("http://x/doc-"), F.floor(F.col("o_totalprice") / 50000).cast("string"), F.lit(".pdf")))
    link = F.struct("o_orderkey", F.struct(url.alias("url"), F.lit(None).cast("string").alias("title"), F.lit("2001-01-01").alias("term_start"), F.lit("2005-01-01").alias("term_end"), F.lit(True).alias("complete"), F.lit(None).cast("string").alias("gap_note")).alias("l"))
    made = orders.groupBy(F.col("o_custkey").cast("string").alias("contract_id")).agg(F.transform(F.array_sort(F.collect_list(link)), lambda x: x["l"]).alias("chain")).withColumn("self_complete", F.lit(False))
    contracts = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("http://own/"), F.col("c_custkey").cast("string")).alias("url"))
    return made, contracts


_CHAIN_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey % 7 = 0 AS bad, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CAST(floor(o_totalprice / 50000) AS BIGINT) AS b FROM orders),
s AS (SELECT *, min(CASE WHEN bad THEN pos END) OVER (PARTITION BY o_custkey) AS stop FROM o),
"""


@query(_CHAIN_SQL + "l AS (SELECT * FROM s WHERE stop IS NULL OR pos < stop) SELECT CAST(o_custkey AS VARCHAR) AS contract_id, CAST(pos AS INTEGER) AS pos, 'http://x/doc-' || b || '.pdf' AS url FROM l")
def grf01_chain_links(t: Tables) -> DataFrame:
    return lineage.chain_links(*_chain_parts(t, t.orders)).select("contract_id", "pos", "url")


@query(_CHAIN_SQL + "k AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS c, b FROM s WHERE stop IS NULL OR pos < stop) SELECT 'earlier-doc-' || b AS id, list(c ORDER BY c) AS later_ids FROM k GROUP BY b")
def grf02_earlier_documents(t: Tables) -> DataFrame:
    made, contracts = _chain_parts(t, t.orders)
    return lineage.earlier_documents(lineage.chain_links(made, contracts), contracts).select("id", "later_ids")


@query("""
SELECT CAST(doc_id AS VARCHAR) AS id, lang = 'en' AND source <> 'src1' AND NOT (doc_id % 4 = 0) AS lacks_base, lang = 'en' AND source = 'src1' AND NOT (doc_id % 4 = 0) AS linked_only FROM documents
""")
def flt10_amendments(t: Tables) -> DataFrame:
    d = t.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "de", "earlier").alias("era"), (F.col("lang") == "en").alias("amends_predecessor"), F.when(F.col("source") == "src1", "x").alias("predecessor"),
        F.when(F.col("doc_id") % 4 == 0, "y").alias("companion"), F.array().cast("array<string>").alias("lineage"),
    )
    return lineage.amendment_groups(d).select("id", "lacks_base", "linked_only")


@query("SELECT p.page_id, p.page_id % 2 = 0 OR p.url LIKE 'https%' AS kept FROM pages p WHERE p.page_id % 2 = 0 OR p.url LIKE 'https%'")
def src17_live_links(t: Tables) -> DataFrame:
    items = t.pages.select("page_id", "url", (F.col("page_id") % 2 == 0).alias("skip_check"))
    probes = t.pages.where("url LIKE 'https%'").select("url", F.lit(200).alias("code"), F.lit("<!DOCTYPE html>").alias("head")).distinct()
    return readers.live_links(items, probes).select("page_id", F.lit(True).alias("kept"))


@query("""
SELECT c_custkey AS id, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS ocr_pages, count(o_orderkey) AS total_pages FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def src21_page_counts(t: Tables) -> DataFrame:
    pages = t.orders.select(F.col("o_custkey").alias("contract_id"), (F.col("o_orderstatus") == "F").alias("ocr"))
    return readers.page_counts(t.customer.select(F.col("c_custkey").alias("id")), pages)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || '-12-31' ELSE '9999-12-31' END AS k FROM orders
""")
def srt06_expiry_key(t: Tables) -> DataFrame:
    """Exact dates, years alone, and neither."""
    end = F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", r.expiry_key(end, F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate"))).alias("k"))


@query("""
SELECT o_orderkey, list_filter([CAST(floor(o_totalprice / 10) AS INTEGER), 500, 25000, 25001], lambda x: x >= 500 AND x <= 25000)[1:3] AS sums FROM orders
""")
def flt12_bands(t: Tables) -> DataFrame:
    """Lump sums from 500 to 25,000, ends included."""
    said = F.concat(F.lit("a $"), F.format_number(F.floor(F.col("o_totalprice") / 10), 0), F.lit(" bonus, $500 cash, $25,000 lump sum and $25,001 payment"))
    return t.orders.select("o_orderkey", text.lump_sums(said).alias("sums"))


@query("SELECT doc_id FROM documents WHERE lang <> 'de'")
def flt03_era(t: Tables) -> DataFrame:
    return t.documents.withColumn("era", F.when(F.col("lang") == "de", "earlier")).where(reports.is_current()).select("doc_id")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'heavy OCR errors' WHEN '2-HIGH' THEN 'some OCR errors' END AS badge FROM orders")
def cas10_badge(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    rated = t.orders.select("o_orderkey", F.when(p == "1-URGENT", "poor").when(p == "2-HIGH", "fair").when(p == "3-MEDIUM", "good").alias("ocr_quality"))
    return rated.select("o_orderkey", reports.ocr_badge().alias("badge"))


def _amendments(t: Tables) -> DataFrame:
    d = t.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("label"), F.when(F.col("lang") == "de", "earlier").alias("era"), (F.col("lang") == "en").alias("amends_predecessor"), F.when(F.col("source") == "src1", "x").alias("predecessor"),
        F.when(F.col("doc_id") % 4 == 0, "y").alias("companion"), F.array((F.col("doc_id") + 1).cast("string")).alias("lineage"),
    )
    return lineage.amendment_groups(d)


@query("""
WITH d AS (SELECT doc_id, source, lang = 'en' AND doc_id % 4 <> 0 AS open, doc_id + 1 IN (SELECT doc_id FROM documents WHERE lang = 'de') AS chain, source = 'src1' AS linked FROM documents)
SELECT count(*) FILTER (open AND NOT chain AND NOT linked) AS n_lacking, count(*) FILTER (open AND NOT chain AND linked) AS n_linked, count(*) FILTER (open AND chain) AS n_chain,
       count(*) FILTER (open AND NOT chain) AS n_outside, (SELECT count(*) FROM nation) AS n_unpublished FROM d
""")
def qry13_missing(t: Tables) -> DataFrame:
    return reports.missing_panel(_amendments(t), t.nation)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS label FROM documents WHERE lang = 'en' AND doc_id % 4 <> 0 AND source <> 'src1' AND doc_id + 1 NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def qry13_lacking(t: Tables) -> DataFrame:
    return reports.lacking_base(_amendments(t)).select("id", "label")


@query("""
WITH n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 99 ELSE n_regionkey END AS last FROM nation)
SELECT n.id, coalesce(e.n_nationkey % 2 <> 0, true) AS incomplete FROM n LEFT JOIN nation e ON e.n_nationkey = n.last
""")
def grf04_incomplete(t: Tables) -> DataFrame:
    """The last document of a chain says whether the chain is complete; one that is not there does not."""
    k = F.col("n_nationkey")
    rows = t.nation.select(k.alias("id"), F.array(k, F.when(k % 5 == 0, F.lit(99)).otherwise(F.col("n_regionkey"))).alias("lineage"))
    return lineage.ends_incomplete(rows, t.nation.select(k.alias("id"), (k % 2 == 0).alias("complete"))).select("id", "incomplete")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'First day of the term' WHEN o_orderkey % 3 = 1 THEN 'First day of month ' || (o_orderkey % 60 + 2) ELSE
  ['Jan.', 'Feb.', 'March', 'April', 'May', 'June', 'July', 'Aug.', 'Sept.', 'Oct.', 'Nov.', 'Dec.'][month(o_orderdate)] || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) END AS d FROM orders
""")
def scl07_facts_date(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    e = F.when(k % 3 == 0, "month-1").when(k % 3 == 1, F.concat(F.lit("month-"), (k % 60 + 2).cast("string"))).otherwise(F.to_date("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", text.facts_date(e).alias("d"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def scl04_year(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", text.year_of(F.to_date("o_orderdate").cast("string")).alias("y"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source = 'src2'")
def flt02_contract(t: Tables) -> DataFrame:
    c = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("contract_id"))
    return search.select(c.withColumn("earlier", F.lit(False)), QuerySpec(contract="src2")).select("id")


@query("SELECT c_custkey AS contract_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def flt04_sector(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("contract_id"), F.col("c_mktsegment").alias("sector"))
    return reports.find_units(c, "", {}, ["sector"], "BUILDING").select("contract_id")


@query("""
SELECT s_suppkey AS contract_id FROM supplier WHERE s_nationkey = 3 AND (strpos(lower(s_name), '#0000000') > 0 OR s_suppkey IN (17, 23))
""")
def qry09_units(t: Tables) -> DataFrame:
    """Units of a sector that hold a text or that a synonym names."""
    u = t.supplier.select(F.col("s_suppkey").alias("contract_id"), F.col("s_nationkey").cast("string").alias("sector"), "s_name")
    return reports.find_units(u, "#0000000", {"#0000000": [17, 23]}, ["s_name"], "3").select("contract_id")
