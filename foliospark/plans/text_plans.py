"""Search, tagging, segmenting and text-quality queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, rules, text
from ..functions.query import QuerySpec, compile_query
from ..operators import quality, ranks, relations, search, segment
from ..sources import files, layout, readers, sinks, skipping
from ..shared import Shared
from .registry import Tables, query

#: Topics that occur in the driver's texts.
TOPICS = {"licence": [r"\blicense\b", r"\blicensed\b"], "function": [r"\bthe\b", r"\band\b"], "money": [r"\$[0-9]"], "list": [r"\| "], "rare": [r"\bnowhere\b"]}


def clauses(t: Tables, documents: DataFrame | None = None) -> DataFrame:
    """Documents as clauses: the source is the contract, the id the order, German texts the earlier era."""
    d = documents or t.documents
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("contract_id"), F.col("doc_id").alias("clause_no"), F.col("lang").alias("heading"), "text", (F.col("lang") == "de").alias("earlier"), (F.col("doc_id") % 3 == 0).alias("ocr"))


def scanned(t: Tables) -> DataFrame:
    """All documents as recognised text, as the tables have no such flag: detectors scan every one."""
    return clauses(t).withColumn("ocr", F.lit(True))


_EDGE = "(?:^|[^A-Za-z0-9])"


_SEARCH_SQL = f"""
WITH m AS (SELECT doc_id, source, text, lang, len(regexp_extract_all(text, '(?i){_EDGE}then')) AS n,
                  len(regexp_extract_all(text, '(?i){_EDGE}thor')) AS k FROM documents),
s AS (SELECT doc_id, source, (CASE WHEN lang = 'de' THEN 0.6 ELSE 1.0 END) *
             (least(n, 12) / (1 + length(text) / 12000.0) + least(k, 12) / (1 + length(text) / 12000.0)) AS score
      FROM m WHERE n > 0 AND k > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS total FROM s)
SELECT source AS contract_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, CAST(total AS BIGINT) AS total FROM r WHERE rank <= 3
"""


@query(_SEARCH_SQL)
def qry01_search(t: Tables) -> DataFrame:
    out = search.results(clauses(t), QuerySpec("then thor"))
    return out.select("contract_id", F.col("clause_no").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"), "total")


@query(_SEARCH_SQL)
def qry01_skipping(t: Tables) -> DataFrame:
    """The same search over documents cut into files by language, of which it opens those that can hold a hit."""
    shared = Shared(t.spark, "skipping")
    # files follow the table, so a filter tells apart as much of a large one
    width = max(16, t.documents.rdd.getNumPartitions())
    t.documents.repartitionByRange(width, "lang", "doc_id").write.parquet(shared.path("documents"))
    skipping.build(t.spark, shared.path("documents"), shared.path("filters"), ["lang", "text"])
    spec = QuerySpec("then thor")
    found = skipping.read(t.spark, shared.path("documents"), shared.path("filters"), compile_query(spec.query))
    out = search.results(clauses(t, found), spec)
    return out.select("contract_id", F.col("clause_no").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"), "total")


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)
SELECT source AS contract_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def qry01_browse(t: Tables) -> DataFrame:
    return search.results(clauses(t), QuerySpec("")).select("contract_id", F.col("clause_no").alias("doc_id"), F.col("rank").cast("int").alias("rank"))


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)mit[\\s]+license')")
def flt05_phrase(t: Tables) -> DataFrame:
    q = compile_query('"MIT License"')
    return t.documents.where(search.matches(q, F.col("text"))).select("doc_id", "source")


@query("""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x IN ('the', 'thes', 'thees'))) AS BIGINT) AS n
FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x IN ('the', 'thes', 'thees'))) > 0
""")
def scl14_short_words(t: Tables) -> DataFrame:
    term = compile_query("the").terms[0]
    return t.documents.where(term.matches(F.col("text"))).select("doc_id", term.count(F.col("text")).cast("long").alias("n"))


@query("""
SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x = 'license')) > 0 AS licensed,
       regexp_matches(text, '\\$[0-9]') AS priced FROM documents
""")
def qry11_find_flags(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", search.matches(compile_query('"license"'), F.col("text")).alias("licensed"), F.col("text").rlike(r"\$[0-9]").alias("priced"))


_TAG_SQL = """
WITH b AS (SELECT doc_id, source, lang, substr(lang || chr(10) || text, 1, 5000) AS t FROM documents),
g AS (SELECT doc_id, source, lang, unnest([CASE WHEN regexp_matches(t, '(?i)\\b(license|licensed)\\b') THEN 'licence' END,
  CASE WHEN len(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9_]+'), lambda x: x IN ('the', 'and'))) > 0 THEN 'function' END,
  CASE WHEN regexp_matches(t, '\\$[0-9]') THEN 'money' END, CASE WHEN regexp_matches(t, '\\| ') THEN 'list' END]) AS topic FROM b)
"""


def _tagged(t: Tables) -> DataFrame:
    return rules.clause_topics(clauses(t), TOPICS)


@query(_TAG_SQL + "SELECT doc_id, topic FROM g WHERE topic IS NOT NULL")
def cas03_topics(t: Tables) -> DataFrame:
    return _tagged(t).select(F.col("clause_no").alias("doc_id"), F.explode("topics").alias("topic"))


@query(_TAG_SQL + "SELECT topic, count(*) AS n_clauses, count(DISTINCT source) AS n_contracts FROM g WHERE topic IS NOT NULL GROUP BY topic")
def qry03_topic_menu(t: Tables) -> DataFrame:
    return search.topic_menu(_tagged(t))


@query(_TAG_SQL + ", f AS (SELECT doc_id, source FROM g WHERE topic = 'list') SELECT source AS contract_id, count(*) AS n FROM f GROUP BY source")
def qry04_topic_pivot(t: Tables) -> DataFrame:
    return search.select(_tagged(t), QuerySpec(topic="list")).groupBy("contract_id").agg(F.count(F.lit(1)).alias("n"))


@query(_TAG_SQL + "SELECT source AS contract_id, doc_id FROM g WHERE topic = 'list' AND source IN ('src1', 'src2', 'src3')")
def qry05_compare(t: Tables) -> DataFrame:
    return search.compare(_tagged(t), QuerySpec(topic="list", compare=("src1", "src2", "src3"))).select("contract_id", F.col("clause_no").alias("doc_id"))


@query(_TAG_SQL + "SELECT topic, count(DISTINCT source) AS n FROM g WHERE topic IS NOT NULL AND source IN ('src1', 'src2', 'src3') GROUP BY topic")
def agg24_shared_topics(t: Tables) -> DataFrame:
    return search.shared_topics(_tagged(t), ["src1", "src2", "src3"])


@query("SELECT source AS contract_id, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY source")
def qry17_clause_counts(t: Tables) -> DataFrame:
    return search.select(clauses(t), QuerySpec(earlier=False)).groupBy("contract_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS contract_id FROM documents WHERE doc_id = 17")
def qry12_permalink(t: Tables) -> DataFrame:
    # the number is what the table holds, so the filter reaches the scan
    return clauses(t).where(F.col("clause_no") == int("17")).select("id", "contract_id")


@query()
def qry16_random_clause(t: Tables) -> DataFrame:
    return search.random_clause(clauses(t), QuerySpec(), 7).select("id", "contract_id")


@query("""
SELECT doc_id, CASE WHEN strpos(text, 'License') > 0
  THEN replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), 'License', '<mark>License</mark>') END AS marked
FROM documents WHERE strpos(text, 'License') > 0
""")
def scl16_highlight(t: Tables) -> DataFrame:
    return t.documents.where(F.contains("text", F.lit("License"))).select("doc_id", text.highlight("text", "License").alias("marked"))


@query("""
WITH p AS (SELECT doc_id, text, strpos(text, 'License') AS pos FROM documents WHERE strpos(text, 'License') > 0),
c AS (SELECT *, substr(text, 1, pos - 120) AS b FROM p),
s AS (SELECT *, CASE WHEN pos <= 160 THEN text ELSE substr(text, CASE WHEN strpos(b, ' ') > 0 THEN length(b) - strpos(reverse(b), ' ') + 2 ELSE 2 END) END AS cut FROM c)
SELECT doc_id, (CASE WHEN pos <= 160 THEN '' ELSE '&hellip;' END) ||
  replace(replace(replace(replace(replace(cut, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), 'License', '<mark>License</mark>') AS snippet FROM s
""")
def scl17_snippet(t: Tables) -> DataFrame:
    return t.documents.where(F.contains("text", F.lit("License"))).select("doc_id", text.snippet("text", "License").alias("snippet"))


@query("SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def scl18_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.escape_html("url").alias("escaped"))


@query("""
SELECT doc_id, (CASE WHEN greatest(s - 71, 0) > 0 THEN '…' ELSE '' END) || replace(substr(text, greatest(s - 71, 0) + 1, least(s + 6 + 70, length(text)) - greatest(s - 71, 0)), chr(10), ' ')
  || (CASE WHEN least(s + 6 + 70, length(text)) < length(text) THEN '…' ELSE '' END) AS context
FROM (SELECT doc_id, text, strpos(text, 'License') AS s FROM documents) WHERE s > 0
""")
def scl19_context(t: Tables) -> DataFrame:
    at = F.instr("text", "License")
    return t.documents.where(at > 0).select("doc_id", text.context("text", at - 1, at + 6).alias("context"))


@query("""
SELECT p_partkey, substr(lower(regexp_replace(regexp_replace(p_name || ' / ' || p_brand, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 80) AS slug FROM part
""")
def scl01_slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slugify(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("""
SELECT page_id, 'earlier-' || regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(list_extract(string_split(url, '/'), -1), '\\s+', '-', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70), '-+$', '') AS slug FROM pages
""")
def scl02_url_slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.slug_of_url("url").alias("slug"))


@query("""
SELECT doc_id, substr(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), 1, 180) AS start FROM documents
""")
def scl32_squeeze(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.squeeze("text", 180).alias("start"))


@query("""
SELECT doc_id, CASE WHEN length(s) > 30 AND length(s) < 320 THEN s END AS sentence
FROM (SELECT doc_id, regexp_extract(trim(text), '(?s)^(.*?[.\\n])\\s', 1) AS x, trim(text) AS t,
             CASE WHEN regexp_matches(trim(text), '[.\\n]\\s') THEN regexp_extract(trim(text), '(?s)^(.*?[.\\n])\\s', 1) ELSE trim(text) END AS s FROM documents)
""")
def scl31_first_sentence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.first_sentence("text").alias("sentence"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM documents")
def agg25_word_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.space_count("text").cast("long").alias("words"))


@query("""
WITH c AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words,
                  length(text) - length(regexp_replace(text, '[\\p{L}\\s.,;:!?\\-()/&%$''"]', '', 'g')) AS plain FROM documents)
SELECT doc_id, words < 20 OR (length(text) > 0 AND plain / length(text) < 0.55) AS needs_ocr FROM c
""")
def src11_page_gate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.page_needs_recognition("text", text.space_count("text")).alias("needs_ocr"))


_RULES = [("The", "Thee", []), ("Thee", "THE", ["en"]), ("und", "vnd", ["de"])]


def _whole(text: str, word: str, put: str) -> str:
    """SQL that replaces whole words; a second pass finds those that share a separator with one before."""
    p = f"'(^|[^A-Za-z0-9_À-ÿ]){word}($|[^A-Za-z0-9_À-ÿ])', '\\1{put}\\2', 'g'"
    return f"regexp_replace(regexp_replace({text}, {p}), {p})"


@query(f"""
WITH a AS (SELECT doc_id, lang, text, ' ' || array_to_string(regexp_split_to_array(text, '[^A-Za-z0-9_À-ÿ]+'), '  ') || ' ' AS t FROM documents),
n AS (SELECT doc_id, lang, len(regexp_extract_all(t, ' The ')) AS the, len(regexp_extract_all(t, ' Thee ')) AS thee, len(regexp_extract_all(t, ' und ')) AS und, {_whole('text', 'The', 'Thee')} AS x FROM a),
m AS (SELECT *, CASE WHEN lang = 'en' THEN {_whole('x', 'Thee', 'THE')} WHEN lang = 'de' THEN {_whole('x', 'und', 'vnd')} ELSE x END AS y FROM n)
SELECT doc_id, CAST(the + (CASE WHEN lang = 'en' THEN the + thee ELSE 0 END) + (CASE WHEN lang = 'de' THEN und ELSE 0 END) AS INTEGER) AS n_corrections, md5(y) AS corrected FROM m
""")
def scl24_corrections(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("lang").alias("contract_id"), "text")
    return rules.correct(docs, _RULES).select("doc_id", "n_corrections", F.md5("text").alias("corrected"))


#: Rules of the query below: as many different words of ``benchmark`` as a curated list may have.
CURATED = 5000


def _curated(t: Tables) -> list[tuple[str, str, list[str]]]:
    """Ordered corrections made from the words of ``benchmark``: each word becomes the next one in the
    order of their bytes reversed, every third only in two sources, so that rules bring in words of later ones."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).distinct()
    listed = [r["w"] for r in words.orderBy(F.reverse("w"), "w").limit(CURATED).collect()]
    return [(w, listed[(k + 1) % len(listed)] if k % 2 else w.upper(), ["src1", "src2"] if k % 3 == 0 else []) for k, w in enumerate(listed)]


@query(r"""
WITH RECURSIVE w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark),
l AS (SELECT w, row_number() OVER (ORDER BY reverse(w), w) - 1 AS k FROM w QUALIFY k < 5000),
rule AS (SELECT k, w, CASE WHEN k % 2 = 1 THEN coalesce(lead(w) OVER (ORDER BY k), first(w) OVER (ORDER BY k)) ELSE upper(w) END AS r, k % 3 = 0 AS scoped FROM l),
d AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+') AS parts FROM documents),
t AS (SELECT doc_id, source IN ('src1', 'src2') AS mine, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM d),
-- a word goes from rule to rule, always to the first behind the last one that changed it
c AS (SELECT DISTINCT mine, part, part AS now, -1::BIGINT AS at, 0 AS n FROM t
      UNION ALL
      SELECT mine, part, r, k, n + 1 FROM (SELECT c.*, rule.k, rule.r, row_number() OVER (PARTITION BY c.mine, c.part ORDER BY rule.k) AS o FROM c JOIN rule ON rule.w = c.now AND rule.k > c.at AND (c.mine OR NOT rule.scoped)) WHERE o = 1),
f AS (SELECT mine, part, arg_max(now, n) AS now, max(n) AS n FROM c GROUP BY ALL)
SELECT doc_id, CAST(coalesce(sum(n), 0) AS INTEGER) AS n_corrections, md5(coalesce(string_agg(now, '' ORDER BY i), '')) AS corrected
FROM (SELECT doc_id FROM documents) LEFT JOIN t USING (doc_id) LEFT JOIN f USING (mine, part) GROUP BY doc_id
""")
def jon11_scoped_rules(t: Tables) -> DataFrame:
    """Thousands of ordered corrections over whole texts, each text meeting those its words call for."""
    docs = t.documents.select("doc_id", F.col("source").alias("contract_id"), "text")
    return rules.correct(docs, _curated(t)).select("doc_id", "n_corrections", F.md5("text").alias("corrected"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS p, unnest(range(len(regexp_split_to_array(text, '\n\s*\n')))) AS k FROM documents),
l AS (SELECT doc_id, k, list_filter(list_transform(regexp_split_to_array(p, '[\n\x0B\f\r]'), lambda x: rtrim(x, ' ' || chr(9))), lambda x: x <> '') AS l FROM p),
g AS (SELECT *, len(l) >= 3 AND (len(list_filter(l, lambda x: length(x) < 40)) > 0.6 * len(l) OR len(list_filter(l, lambda x: regexp_full_match(x, '[0-9$.,\-•*\s]+'))) > 0.4 * len(l)) AS kept FROM l WHERE len(l) > 0),
f AS (SELECT doc_id, k, CASE WHEN kept THEN array_to_string(l, chr(10)) ELSE list_reduce(l, lambda a, x:
  CASE WHEN ends_with(a, '-') AND regexp_matches(x, '^\p{Ll}') THEN left(a, -1) || x
       WHEN ends_with(a, '-') OR (length(string_split(a, chr(10))[-1]) >= 30 AND NOT regexp_matches(a, '[.!?"''’):]$') AND NOT (regexp_matches(x, '^[0-9]') AND length(x) < 40) AND NOT ends_with(x, ':')) THEN a || ' ' || x
       ELSE a || chr(10) || x END) END AS t FROM g)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(t, chr(10) || chr(10) ORDER BY k), '') END AS text FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id, d.text
""")
def scl23_reflow(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.reflow("text").alias("text"))


_LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
b AS (SELECT *, CASE WHEN regexp_matches(line, '[Ll]icense') THEN 1 ELSE 0 END AS is_b FROM l),
s AS (SELECT *, sum(is_b) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS span FROM b)
"""


@query(_LINES + "SELECT doc_id, CAST(span AS BIGINT) AS span, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY doc_id, span")
def win02_spans(t: Tables) -> DataFrame:
    lines = segment.lines_of(t.documents.select("doc_id", "text"), "doc_id")
    out = segment.spans(lines, F.col("line").rlike("[Ll]icense"), "doc_id")
    return out.groupBy("doc_id", "span").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("""
WITH d AS (SELECT doc_id, regexp_replace(text, '(?m)^(Released under .*|This work .*)$', 'ARTICLE 1 - LICENSE', 'g') AS text FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^ARTICLE 1 - LICENSE$') THEN 1 ELSE 0 END AS articles FROM d
WHERE regexp_matches(text, '(?m)^ARTICLE 1 - LICENSE$')
""")
def cas01_headings(t: Tables) -> DataFrame:
    made = t.documents.select("doc_id", F.regexp_replace("text", "(?m)^(Released under .*|This work .*)$", "ARTICLE 1 - LICENSE").alias("text"))
    kinds = segment.lines_of(made, "doc_id").select("doc_id", segment.heading_kind(F.trim("line")).alias("h"))
    return kinds.where("h.level = 'article' AND h.num = '1' AND h.title = 'LICENSE'").groupBy("doc_id").agg(F.max(F.lit(1)).alias("articles"))


def _made(t: Tables) -> DataFrame:
    """Documents whose license lines are headings of four kinds."""
    said = F.regexp_replace("text", r"(?m)^Released under .*$", "ARTICLE IV - LICENSE")
    said = F.regexp_replace(said, r"(?m)^This work .*$", "Section 2.1: Works")
    said = F.regexp_replace(F.regexp_replace(said, r"(?m)^Thth.*$", "3. TERMS AND HOURS"), r"(?m)^An[a-z]* .*$", "GENERAL PROVISIONS")
    made = t.documents.select(F.col("doc_id").cast("string").alias("contract_id"), F.col("source").alias("label"), said.alias("text"))
    # read several times by the segmenter, so written once
    return Shared(t.spark, "made").save(made, "documents")


_SEGMENTS = rf"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS c, source AS label, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^Released under .*$', 'ARTICLE IV - LICENSE', 'g'),
      '(?m)^This work .*$', 'Section 2.1: Works', 'g'), '(?m)^Thth.*$', '3. TERMS AND HOURS', 'g'), '(?m)^An[a-z]* .*$', 'GENERAL PROVISIONS', 'g') AS text FROM documents),
p AS (SELECT c, unnest(string_split(text, chr(12))) AS body, unnest(range(len(string_split(text, chr(12))))) + 1 AS page FROM d),
l AS (SELECT c, page, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS k FROM p),
s AS (SELECT *, regexp_replace(line, '^[\s]+|[\s]+$', '', 'g') AS s FROM l),
h AS (SELECT *, CASE WHEN s = '' OR contains(s, '....') THEN NULL WHEN regexp_matches(s, $a${fixed.ARTICLE_LINE}$a$) THEN 1 WHEN regexp_matches(s, $a${fixed.SECTION_LINE}$a$) THEN 2
      WHEN regexp_matches(s, $a${fixed.NUMBERED_LINE}$a$) AND length(s) <= 80 THEN 3 WHEN regexp_matches(s, $a${fixed.CAPITALS_LINE}$a$) AND length(s) BETWEEN 5 AND 60 THEN 4 END AS h FROM s),
n AS (SELECT *, CASE h WHEN 1 THEN regexp_extract(s, $a${fixed.ARTICLE_LINE}$a$, 1) WHEN 2 THEN regexp_extract(s, $a${fixed.SECTION_LINE}$a$, 1) WHEN 3 THEN regexp_extract(s, $a${fixed.NUMBERED_LINE}$a$, 1) ELSE '' END AS num,
      trim(CASE h WHEN 1 THEN regexp_extract(s, $a${fixed.ARTICLE_LINE}$a$, 2) WHEN 2 THEN regexp_extract(s, $a${fixed.SECTION_LINE}$a$, 2) WHEN 3 THEN regexp_extract(s, $a${fixed.NUMBERED_LINE}$a$, 2) ELSE regexp_extract(s, $a${fixed.CAPITALS_LINE}$a$, 1) END) AS title,
      count(h) OVER (PARTITION BY c ORDER BY page, k ROWS UNBOUNDED PRECEDING) AS span FROM h),
g AS (SELECT c, span, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY page, k) FILTER (h IS NULL), ''), '^[\s]+|[\s]+$', '', 'g') AS text, max(h) AS h, max(num) FILTER (h IS NOT NULL) AS num, max(title) FILTER (h IS NOT NULL) AS title, min(page) AS page FROM n GROUP BY c, span),
z AS (SELECT *, length(regexp_replace(text, '[\s]', '', 'g')) AS size FROM g),
m AS (SELECT d.c, label, d.text, CASE WHEN max(span) = 0 THEN 'whole' WHEN any_value(length(regexp_replace(d.text, '[\s]', '', 'g'))) > 200 AND sum(CASE WHEN span > 0 OR size >= 80 THEN size ELSE 0 END) / any_value(length(regexp_replace(d.text, '[\s]', '', 'g'))) < 0.7 THEN 'pages' ELSE 'headings' END AS mode
      FROM d JOIN z USING (c) GROUP BY ALL),
o AS (SELECT c || '__' || (span - 1) AS id, c, span AS no, CASE WHEN h = 1 THEN 'Article ' || num || CASE WHEN title <> '' THEN ' — ' || title ELSE '' END WHEN num <> '' THEN 'Section ' || num || CASE WHEN title <> '' THEN ' — ' || title ELSE '' END ELSE title END AS heading, page, z.text FROM z JOIN m USING (c) WHERE mode = 'headings' AND span > 0 AND z.text <> ''
      UNION ALL SELECT c || '__preamble', c, 0, label, 1, z.text FROM z JOIN m USING (c) WHERE mode = 'headings' AND span = 0 AND size >= 80
      UNION ALL SELECT c || '__page' || page, c, page, label || ' — page ' || page, page, regexp_replace(body, '^[\s]+|[\s]+$', '', 'g') FROM p JOIN m USING (c) WHERE mode = 'pages' AND regexp_replace(body, '^[\s]+|[\s]+$', '', 'g') <> ''
      UNION ALL SELECT c || '__whole', c, 0, label, 1, regexp_replace(text, '^[\s]+|[\s]+$', '', 'g') FROM m WHERE mode = 'whole')
"""


@query(_SEGMENTS + "SELECT id, c AS contract_id, CAST(no AS INTEGER) AS clause_no, heading, CAST(page AS INTEGER) AS page, CAST(length(text) AS INTEGER) AS chars FROM o")
def cas02_segment(t: Tables) -> DataFrame:
    return segment.segment(_made(t)).select("id", "contract_id", "clause_no", "heading", "page", F.length("text").alias("chars"))


@query(_SEGMENTS + r"""
, q AS (SELECT c, sum(length(regexp_replace(text, '[\s]', '', 'g'))) AS held FROM o GROUP BY c),
t AS (SELECT c, length(regexp_replace(text, '[\s]', '', 'g')) AS solid FROM d)
SELECT c AS contract_id, CAST(solid AS INTEGER) AS solid, CAST(coalesce(held, 0) AS BIGINT) AS held, CASE WHEN solid > 0 THEN round(coalesce(held, 0) / solid, 6) END AS share FROM t LEFT JOIN q USING (c)
""")
def agg18_coverage(t: Tables) -> DataFrame:
    """The share of every document that its clauses hold."""
    docs = _made(t)
    return segment.coverage(segment.segment(docs), docs).select("contract_id", "solid", "held", F.round("share", 6).alias("share"))


@query("""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents)
SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 3
""")
def agg14_vocabulary(t: Tables) -> DataFrame:
    return quality.vocabulary(clauses(t))


@query("""
WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''’\\-]{2,}')) AS t FROM documents),
s AS (SELECT source, regexp_replace(lower(t), '^[''\\-]+|[''\\-]+$', '', 'g') AS word FROM w)
SELECT word, count(DISTINCT source) AS n_docs, count(*) AS n FROM s GROUP BY word HAVING count(DISTINCT source) >= 3 AND count(*) >= 5
""")
def agg15_spread_vocabulary(t: Tables) -> DataFrame:
    return quality.spread_vocabulary(clauses(t))


@query("""
WITH w AS (SELECT doc_id % 3 = 0 AS ocr, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents)
SELECT word, count(*) FILTER (NOT ocr) AS native, count(*) FILTER (ocr) AS recognised FROM w GROUP BY word
HAVING count(*) FILTER (NOT ocr) > 0 OR count(*) FILTER (ocr) >= 10
""")
def agg16_trusted_vocabulary(t: Tables) -> DataFrame:
    return quality.trusted_vocabulary(clauses(t))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents),
v AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 3),
r AS (SELECT doc_id, avg(CASE WHEN v.word IS NULL THEN 0.0 ELSE 1.0 END) AS r FROM w LEFT JOIN v USING (word) GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS id, round(coalesce(r, 0), 6) AS realness FROM documents d LEFT JOIN r USING (doc_id)
""")
def agg17_realness(t: Tables) -> DataFrame:
    c = clauses(t)
    return quality.realness(c, quality.vocabulary(c)).select("id", F.round("realness", 6).alias("realness"))


@query("""
WITH b AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents WHERE lang = 'en'),
m AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents WHERE lang = 'fr'),
x AS (SELECT word FROM b INTERSECT SELECT word FROM m), u AS (SELECT word FROM b UNION SELECT word FROM m)
SELECT 'narrow' AS kind, count(*) AS n FROM x WHERE length(word) >= 4 UNION ALL SELECT 'broad', count(*) FROM u WHERE length(word) >= 4
""")
def set02_vocabularies(t: Tables) -> DataFrame:
    words = lambda lang: quality.vocabulary(clauses(t).where(F.col("heading") == lang), 1).select("word")
    en, fr = words("en"), words("fr")
    count = lambda df, kind: df.where("length(word) >= 4").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(en.intersect(fr), "narrow").union(count(en.union(fr).distinct(), "broad"))


_KNOWN = """
WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''’\\-]{2,}')) AS token FROM documents),
v AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM benchmark),
d AS (SELECT DISTINCT word FROM v), k AS (SELECT DISTINCT token, regexp_replace(lower(token), '^[''’\\-]+|[''’\\-]+$', '', 'g') AS t FROM w),
f AS (SELECT token, unnest([t, CASE WHEN t LIKE '%s' THEN substr(t, 1, length(t) - 1) END, CASE WHEN t LIKE '%es' THEN substr(t, 1, length(t) - 2) END,
  CASE WHEN t LIKE '%ed' THEN substr(t, 1, length(t) - 2) END, CASE WHEN t LIKE '%ed' THEN substr(t, 1, length(t) - 1) END,
  CASE WHEN t LIKE '%ing' THEN substr(t, 1, length(t) - 3) END, CASE WHEN t LIKE '%ing' THEN substr(t, 1, length(t) - 3) || 'e' END,
  CASE WHEN t LIKE '%ly' THEN substr(t, 1, length(t) - 2) END, CASE WHEN t LIKE '%''s' THEN substr(t, 1, length(t) - 2) END,
  CASE WHEN t LIKE '%ies' THEN substr(t, 1, length(t) - 3) || 'y' END]) AS word FROM k)
"""


@query(_KNOWN + "SELECT token, bool_or(d.word IS NOT NULL) AS known FROM f LEFT JOIN d USING (word) GROUP BY token")
def jon12_known_tokens(t: Tables) -> DataFrame:
    words = quality.vocabulary(t.benchmark, 1)
    return quality.known(quality.tokens(clauses(t)).select("token").distinct(), "token", words)


@query("""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM benchmark),
n AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS t FROM part), d AS (SELECT DISTINCT lower(t) AS token FROM n WHERE length(t) >= 3)
SELECT token, word, CAST(levenshtein(token, word) AS INTEGER) AS distance FROM d, v WHERE levenshtein(token, word) <= 2
""")
def jon13_near_words(t: Tables) -> DataFrame:
    rows = t.part.select(F.explode(F.split("p_name", " ")).alias("token"))
    return quality.near_words(rows, quality.vocabulary(t.benchmark, 1))


_CONTEXT_SQL = "(CASE WHEN start > 70 THEN '…' ELSE '' END) || replace(substr(text, greatest(start - 70, 0) + 1, least(stop + 70, length(text)) - greatest(start - 70, 0)), chr(10), ' ') || (CASE WHEN stop + 70 < length(text) THEN '…' ELSE '' END)"
_BARE = r"regexp_replace(lower({}), '^[\x27’\-]+|[\x27’\-]+$', '', 'g')"


def _detector_sql(least: int, shortest: int, text_sql: str = "text", longest: str = "") -> str:
    """Tokens ``k`` of all texts with their places, words ``i`` seen ``least`` times with their inflections, and
    ``u``, the first place in each source of every token that is no word."""
    return rf"""
WITH d AS (SELECT doc_id, source, {text_sql} AS text FROM documents),
v AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM documents) GROUP BY w HAVING count(*) >= {least}{longest}),
i AS (SELECT DISTINCT word FROM (SELECT unnest([w, w || 's', w || 'es', w || 'ed', w || 'ing', w || 'ly', w || chr(39) || 's', CASE WHEN w LIKE '%e' THEN w || 'd' END, CASE WHEN w LIKE '%e' THEN left(w, -1) || 'ing' END, CASE WHEN w LIKE '%y' THEN left(w, -1) || 'ies' END]) AS word FROM v) WHERE word <> ''),
m AS (SELECT doc_id, source, regexp_extract_all(text, '[A-Za-z][A-Za-z\x27’\-]{{2,}}') AS m, regexp_split_to_array(text, '[A-Za-z][A-Za-z\x27’\-]{{2,}}') AS g FROM d),
k AS (SELECT *, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS stop, {_BARE.format("token")} AS bare
      FROM (SELECT doc_id, source, unnest(m) AS token, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS pos FROM m)),
u AS (SELECT doc_id, source, token, pos, stop - length(token) AS start, stop FROM k
      WHERE length(token) >= {shortest} AND NOT regexp_matches(token, '[0-9]') AND (token <> upper(token) OR lower(token) = upper(token)) AND bare NOT IN (SELECT word FROM i)
      QUALIFY row_number() OVER (PARTITION BY source, token ORDER BY CAST(doc_id AS VARCHAR), pos) = 1),
"""


@query(
    _detector_sql(50, 5, longest=" AND length(w) >= 5")
    + """
n AS (SELECT t, w, CAST(levenshtein(t, w) AS INTEGER) AS distance FROM (SELECT DISTINCT lower(token) AS t FROM u) JOIN v ON abs(length(t) - length(w)) <= 2 WHERE levenshtein(t, w) <= 2),
b AS (SELECT *, row_number() OVER o AS r, lead(distance) OVER o AS next_distance FROM n WINDOW o AS (PARTITION BY t ORDER BY distance, w)),
c AS (SELECT * FROM b WHERE r = 1 AND distance > 0 AND (distance = 1 OR next_distance IS NULL) AND NOT (distance = 1 AND (w = t || 's' OR t = w || 's' OR w = t || 'd' OR t = w || 'd')))
SELECT source AS contract_id, token, CASE WHEN regexp_matches(token, '^[A-Z]') THEN upper(left(w, 1)) || substr(w, 2) ELSE w END AS candidate, distance, next_distance FROM u JOIN c ON c.t = lower(u.token)
"""
)
def win06_clear_winner(t: Tables) -> DataFrame:
    words = Shared(t.spark, "vocabulary").save(quality.vocabulary(clauses(t), 50).where("length(word) >= 5").select("word"), "words")
    return quality.fuzzy_words(scanned(t), words, words).select("contract_id", "token", "candidate", "distance", "next_distance")


def _suggested() -> Column:
    """Suggestions as one text, each with its rule."""
    return F.array_join(F.transform("suggestions", lambda x: F.concat(x["candidate"], F.lit(" ("), x["rule"], F.lit(")"))), "; ").alias("suggestions")


@query(
    _detector_sql(50, 4)
    + f"""
a AS (SELECT token, candidate, arg_min(rule, k * 1000 + o) AS rule, min(k) AS k FROM (
      SELECT token, left(token, o - 1) || new || substr(token, o + length(old)) AS candidate, old || '→' || new AS rule, k, o
      FROM (SELECT token, old, new, k, unnest(range(1, length(token) + 1)) AS o FROM (SELECT DISTINCT token FROM u), (VALUES {", ".join(f"({k}, '{old}', '{new}')" for k, (old, new) in enumerate(fixed.CONFUSIONS))}) r(k, old, new))
      WHERE substr(lower(token), o, length(old)) = old) WHERE candidate <> token GROUP BY ALL),
s AS (SELECT token, string_agg(candidate || ' (' || rule || ')', '; ' ORDER BY k, candidate) AS suggestions FROM a WHERE {_BARE.format("candidate")} IN (SELECT word FROM i) GROUP BY token)
SELECT u.source AS contract_id, token, suggestions, {_CONTEXT_SQL} AS context FROM u JOIN s USING (token) JOIN d USING (doc_id)
"""
)
def qry20_substitutions(t: Tables) -> DataFrame:
    return quality.suspects(scanned(t), quality.vocabulary(clauses(t), 50)).select("contract_id", "token", _suggested(), "context")


@query(
    _detector_sql(200, 5)
    + f"""
x AS (SELECT token, unnest(range(length(token) + 1)) AS o FROM (SELECT DISTINCT token FROM u)),
a AS (SELECT token, w, arg_min(rule, k) AS rule, min(k) AS k FROM (
      SELECT token, left(lower(token), o) || c || substr(lower(token), o + 1) AS w, 'insert ' || chr(39) || c || chr(39) || ' at ' || o AS rule, o * 100 + ascii(c) - 97 AS k FROM (SELECT *, unnest({sorted(fixed.DROPPED_LETTERS)}) AS c FROM x)
      UNION ALL SELECT token, left(lower(token), o) || substr(lower(token), o + 2), 'drop char at ' || o, o + 1000000 FROM x WHERE o < length(token))
      WHERE w <> '' AND w <> lower(token) GROUP BY ALL),
e AS (SELECT token, CASE WHEN regexp_matches(token, '^[A-Z]') THEN upper(left(w, 1)) || substr(w, 2) ELSE w END AS candidate, rule, k FROM a),
s AS (SELECT token, array_to_string(list(candidate || ' (' || rule || ')' ORDER BY k, candidate)[1:3], '; ') AS suggestions FROM e WHERE {_BARE.format("candidate")} IN (SELECT word FROM i) GROUP BY token)
SELECT u.source AS contract_id, token, suggestions FROM u JOIN s USING (token)
"""
)
def qry20_drops(t: Tables) -> DataFrame:
    return quality.suspects(scanned(t), quality.vocabulary(clauses(t), 200), "drops").select("contract_id", "token", _suggested())


@query()
def qry20_fragments(t: Tables) -> DataFrame:
    return quality.fragments(scanned(t), quality.vocabulary(clauses(t), 200))


@query(
    _detector_sql(200, 3, "replace(text, '. T', 'T')")
    + f"""
c AS (SELECT *, regexp_extract(token, '([a-z]{{2,}})([A-Z][a-z]{{2,}})', 1) AS a, regexp_extract(token, '([a-z]{{2,}})([A-Z][a-z]{{2,}})', 2) AS b FROM k
      QUALIFY row_number() OVER (PARTITION BY source, token ORDER BY CAST(doc_id AS VARCHAR), pos) = 1),
w AS (SELECT *, stop - length(token) AS start FROM c WHERE a <> '' AND {_BARE.format("a")} IN (SELECT word FROM i) AND {_BARE.format("b")} IN (SELECT word FROM i) AND bare NOT IN (SELECT word FROM i))
SELECT w.source AS contract_id, CAST(doc_id AS VARCHAR) AS id, token AS original, regexp_replace(token, '^(.*?[a-z]{{2,}})([A-Z][a-z]{{2,}})', '\\1 \\2') AS candidate, 'split' AS rule, {_CONTEXT_SQL} AS context FROM w JOIN d USING (doc_id)
"""
)
def qry20_missing_spaces(t: Tables) -> DataFrame:
    """Sentences that lost what stands between them."""
    run_on = scanned(t).withColumn("text", F.replace("text", F.lit(". T"), F.lit("T")))
    return quality.missing_spaces(run_on, quality.vocabulary(clauses(t), 200)).select("contract_id", "id", "original", "candidate", "rule", "context")


@query("""
WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''’\\-]{2,}')) AS token FROM documents)
SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 20
""")
def agg13_most_common(t: Tables) -> DataFrame:
    return quality.most_common(quality.tokens(clauses(t)), "token")


@query("""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>(?:.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\b[^>]*href="(?:[^"]*)"[^>]*>(.*?)</a>', 1) AS x FROM pages),
r AS (SELECT page_id, unnest(h) AS href, unnest(x) AS label, generate_subscripts(h, 1) AS pos FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS n FROM r WHERE href <> '')
SELECT page_id, href, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS label FROM f WHERE n = 1
""")
def src03_links(t: Tables) -> DataFrame:
    return readers.links(t.pages, keep=".", also=None).select("page_id", "href", "label")


def _pieces(t: Tables) -> DataFrame:
    """Texts as pages of a fixed-width font: ``page, row, length, cells``, a line a row, cut at its separators."""
    rows = t.documents.select(F.col("doc_id").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("row", "line"))
    rows = rows.select("page", "row", F.length("line").alias("length"), F.split("line", r" \| ").alias("cut"))
    rows = rows.withColumn("sizes", F.transform("cut", F.length))
    start = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, x: a + x) + 3 * i
    cells = F.transform("cut", lambda x, i: F.struct((6.0 * start(i)).alias("x0"), x.alias("text")))
    # read three times below, so written once
    return Shared(t.spark, "pieces").save(rows.select("page", "row", "length", cells.alias("cells")), "rows")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS r FROM documents),
f AS (SELECT *, string_split(line, ' | ') AS f FROM l),
p AS (SELECT doc_id, r, t, x0, x0 + 6.0 * length(t) AS x1
      FROM (SELECT doc_id, r, f[i + 1] AS t, 6.0 * (coalesce(list_sum([length(x) FOR x IN f[1:i]]), 0) + 3 * i) AS x0 FROM (SELECT *, unnest(range(len(f))) AS i FROM f)) WHERE t <> ''),
b AS (SELECT doc_id, r, 6.0 * (length(f[1]) + 3) + CASE WHEN r % 2 = 0 THEN 1 ELSE 2 END AS bx0, 6.0 * length(line) - CASE WHEN r % 2 = 0 THEN 1 ELSE 2 END AS bx1, '| ' || array_to_string(f[2:], ' | ') || ' |' AS md FROM f WHERE len(f) > 1),
w AS (SELECT doc_id, greatest(612.0, 6.0 * max(length(line))) AS w FROM l GROUP BY doc_id),
c AS (SELECT w.doc_id, w, count(x0) AS n, count(*) FILTER ((x0 + x1) / 2 < w / 2) AS a, count(*) FILTER (abs((x0 + x1) / 2 - w / 2) < w * 0.04) AS g FROM w LEFT JOIN p USING (doc_id) GROUP BY ALL),
k AS (SELECT doc_id, w, CASE WHEN n >= 200 AND least(a, n - a) > 0.4 * greatest(a, n - a) AND g < 0.05 * n THEN 2 ELSE 1 END AS columns FROM c),
o AS (SELECT p.doc_id, r, x0, t, CASE WHEN columns = 2 AND (x0 + x1) / 2 >= w / 2 THEN 1 ELSE 0 END AS side FROM p JOIN k USING (doc_id) LEFT JOIN b USING (doc_id, r)
      WHERE bx0 IS NULL OR bx0 > bx1 OR NOT (x0 >= bx0 - 1 AND x1 <= bx1 + 1)),
i AS (SELECT doc_id, side, r, trim(regexp_replace(string_agg(t, ' ' ORDER BY x0), ' +', ' ', 'g')) AS line FROM o GROUP BY ALL),
y AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY side, r) AS body FROM i WHERE line <> '' GROUP BY doc_id),
z AS (SELECT doc_id, string_agg(chr(10) || md || chr(10), chr(10) ORDER BY r) AS tables FROM b GROUP BY doc_id)
SELECT doc_id, CAST(columns AS INTEGER) AS columns, regexp_replace(array_to_string(list_filter([tables, body], lambda x: x IS NOT NULL), chr(10)), '^\s+|\s+$', '', 'g') AS text
FROM k LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
""".replace(r"\\", "\\"))
def src08_masked_text(t: Tables) -> DataFrame:
    """Lines cut at separators as positioned pieces; all but the first piece of a line make a table, of which
    every second is drawn too narrow for its first and last piece."""
    rows = _pieces(t)
    inset = F.when(F.col("row") % 2 == 0, 1.0).otherwise(2.0)
    top = F.col("row") * 10.0
    pieces = rows.select("page", top.alias("top"), (top + 8).alias("bottom"), F.explode("cells").alias("c")).select("page", "top", "bottom", "c.x0", (F.col("c.x0") + 6.0 * F.length("c.text")).alias("x1"), "c.text").where("text <> ''")
    table = F.concat(F.lit("| "), F.array_join(F.transform(F.slice("cells", 2, 1_000_000), lambda x: x["text"]), " | "), F.lit(" |"))
    boxes = rows.where(F.size("cells") > 1).select("page", (top + 1).alias("top"), (top + 7).alias("bottom"), (F.get("cells", F.lit(1))["x0"] + inset).alias("x0"), (6.0 * F.col("length") - inset).alias("x1"), table.alias("markdown"))
    pages = rows.groupBy("page").agg(F.greatest(F.lit(612.0), 6.0 * F.max("length")).alias("width"))
    return layout.page_texts(pieces, boxes, pages).select(F.col("page").alias("doc_id"), "columns", "text")


@query("""
SELECT conv_id AS contract_id, string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id
""")
def snk02_joined_pages(t: Tables) -> DataFrame:
    return sinks.joined_text(t.conversations.select(F.col("conv_id").alias("contract_id"), F.col("turn").alias("page"), "text"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS content FROM documents")
def snk02_files(t: Tables) -> DataFrame:
    """A file for each document, written by the executors and read back."""
    folder = Shared(t.spark, "files").path("documents")
    files.write_files(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), folder, ".txt")
    return files.read_files(t.spark, folder, ".txt")


@query("""
SELECT doc_id AS id, '# ' || source || chr(10) || chr(10) || regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10) AS content
FROM documents WHERE length(text) >= 50
""")
def snk06_text_only(t: Tables) -> DataFrame:
    none = F.lit(None)
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), none.cast("string").alias("era"), none.cast("array<string>").alias("later_labels"), "text")
    return sinks.text_only(docs)


@query("""
SELECT item_id, trim(text) || chr(10) || '— Item ' || item_id || ', Heading, p. ' || (item_id % 7) || '.' || chr(10) || 'Source PDF: http://x/' || item_id || '#page=' || (item_id % 7) || chr(10)
  || 'Via the archive: #/' || item_id || (CASE WHEN item_id % 2 = 0 THEN chr(10) || 'Note: this page was transcribed via OCR — verify wording against the source PDF before publication.' ELSE '' END) AS citation FROM benchmark
""")
def snk16_citation(t: Tables) -> DataFrame:
    i = F.col("item_id").cast("string")
    c = text.citation("text", F.concat(F.lit("Item "), i), F.lit("Heading"), F.col("item_id") % 7, F.concat(F.lit("http://x/"), i), F.concat(F.lit("#/"), i), F.col("item_id") % 2 == 0, "the archive")
    return t.benchmark.select("item_id", c.alias("citation"))


@query("""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON strpos(d.text, b.text) > 0
""")
def flt_benchmark_contained(t: Tables) -> DataFrame:
    """Documents that hold a benchmark item whole."""
    return search.containing(t.documents, t.benchmark, "doc_id", "item_id")


@query("""
WITH m AS (SELECT doc_id, source, text, lang, len(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9])then')) AS n, len(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9])thor')) AS k FROM documents),
s AS (SELECT doc_id, lang, (CASE WHEN lang = 'de' THEN 0.6 ELSE 1.0 END) * (least(n, 12) / (1 + length(text) / 12000.0) + least(k, 12) / (1 + length(text) / 12000.0)) AS score FROM m WHERE n > 0 AND k > 0)
SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS place FROM s
""")
def srt01_relevance(t: Tables) -> DataFrame:
    """All hits in order of their score, ties in corpus order."""
    found = search.hits(clauses(t), compile_query("then thor"))
    return ranks.places(found, search.relevance_order(), "heading").select(F.col("clause_no").alias("doc_id"), "place")


@query("""
SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ ]'))) AS BIGINT) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)
""")
def flt07_scanned_lines(t: Tables) -> DataFrame:
    """Lines of recognised clauses only."""
    d = clauses(t).where(F.coalesce("ocr", F.lit(False))).select(F.col("clause_no").alias("doc_id"), "text")
    return d.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ ]"))).cast("long").alias("n"))
