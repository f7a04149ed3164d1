"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its class of near-duplicates."""
    from . import near_dup

    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a probabilistic suffix tree learned from the texts not held out."""
    from . import suffix_tree

    return suffix_tree.score(_read(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2,048 ids along the Hilbert curve."""
    from . import packing

    return packing.pack(_read(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the rank file and decoded again."""
    from . import bpe

    return bpe.round_trip(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram with its suffix sums: an answer for every context limit."""
    from . import token_counts

    return token_counts.token_counts(_read(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from . import html_text

    return html_text.extract(_read(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weak label, its score and whether it is kept."""
    from . import weak_labels

    return weak_labels.classify(_read(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-text counts and the verdict of the base rule and of the host's shrunken rate."""
    from . import quality_rules

    out = quality_rules.verdicts(_read(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS k
      FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS mean, count(*) AS hosts, sum(n) AS docs FROM h),
v AS (SELECT sum(n * power(k / n - (SELECT mean FROM m), 2)) / (SELECT docs FROM m) AS var FROM h),
s AS (SELECT mean, CASE WHEN hosts < 2 OR mean <= 0 OR mean >= 1 THEN docs
             ELSE greatest(1.0, least(docs, mean * (1 - mean) / greatest((SELECT var FROM v) - mean * (1 - mean) * hosts / docs, 1e-9) - 1)) END AS strength FROM m),
r AS (SELECT source, (k + (SELECT mean * strength FROM s)) / (n + (SELECT strength FROM s)) AS rate FROM h)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept
FROM b LEFT JOIN r USING (source)
"""

def op9_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links of cosine 0.93 or more within its label, and its class."""
    from . import embedding_dup

    return embedding_dup.near_duplicates(_read(spark, sf_dir, "embeddings"), Scratch(spark, "op9"))


OP9_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id WHERE r.c < p.b),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and their capture index written, then every page's record looked up in the index and read by range."""
    from . import warc

    scratch = Scratch(spark, "op10")
    pages = _read(spark, sf_dir, "pages")
    archives = warc.write(pages, scratch)
    index = warc.build_index(spark, archives, scratch)
    return warc.read_back(spark, pages, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every vendor's daily quantities, by their least penalised cost."""
    from . import change_points

    return change_points.change_points(_read(spark, sf_dir, "sale_lines"), "vendor_id", "shipped_at", "quantity")


OP11_SQL = """
WITH RECURSIVE
d AS (SELECT vendor_id, date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS day, CAST(sum(quantity) AS HUGEINT) AS n
      FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
v AS (SELECT vendor_id, min(day) AS lo, max(day) - min(day) + 1 AS size FROM d GROUP BY vendor_id),
x AS (SELECT v.vendor_id, lo, size, i, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(size)) AS i FROM v) v
      LEFT JOIN d ON d.vendor_id IS NOT DISTINCT FROM v.vendor_id AND d.day = lo + i),
p AS (SELECT vendor_id, lo, size, list_prepend(0::HUGEINT, list(s ORDER BY i)) AS s, list_prepend(0::HUGEINT, list(q ORDER BY i)) AS q
      FROM (SELECT *, sum(n) OVER w AS s, sum(n * n) OVER w AS q FROM x WINDOW w AS (PARTITION BY vendor_id ORDER BY i)) GROUP BY ALL),
-- f: least cost, fewest segments and start of the last one for each length of prefix so far
f AS (SELECT vendor_id, lo, size, s, q, 13 AS t, [-40000::BIGINT] || [NULL::BIGINT FOR k IN range(13)] AS best,
             [0::BIGINT] || [NULL::BIGINT FOR k IN range(13)] AS pieces, [NULL::BIGINT FOR k IN range(14)] AS back FROM p
      UNION ALL
      SELECT vendor_id, lo, size, s, q, t + 1, list_append(best, m // 100000000), list_append(pieces, m // 10000 % 10000 + 1), list_append(back, m % 10000)
      FROM (SELECT *, list_min([(best[a + 1] + 40000 + (t + 1 - a) * CAST(floor(1000 * ln(CAST(1 + ((t + 1 - a) * (q[t + 2] - q[a + 1]) - (s[t + 2] - s[a + 1]) * (s[t + 2] - s[a + 1])) // ((t + 1 - a) * (t + 1 - a)) AS DOUBLE))) AS BIGINT)) * 100000000 + pieces[a + 1] * 10000 + a
                                FOR a IN range(t - 12) IF a = 0 OR a >= 14]) AS m FROM f WHERE t < size)),
e AS (SELECT vendor_id, lo, size, s, q, CASE WHEN size < 14 THEN [] ELSE back END AS back FROM f WHERE t = greatest(size, 13)),
g AS (SELECT *, size AS b, CASE WHEN size < 14 THEN 0 ELSE back[size + 1] END AS a FROM e
      UNION ALL
      SELECT * EXCLUDE (a, b), a AS b, back[a + 1] AS a FROM g WHERE a > 0),
c AS (SELECT vendor_id, lo + a AS first_day, b - a AS n_days, s[b + 1] - s[a + 1] AS total,
             1 + ((b - a) * (q[b + 1] - q[a + 1]) - (s[b + 1] - s[a + 1]) * (s[b + 1] - s[a + 1])) // ((b - a) * (b - a)) AS spread FROM g),
h AS (SELECT *, n_days * CAST(floor(1000 * ln(CAST(spread AS DOUBLE))) AS BIGINT) AS cost FROM c)
SELECT vendor_id, CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY first_day) AS INTEGER) AS segment_no, CAST(first_day AS BIGINT) AS first_day,
       CAST(n_days AS BIGINT) AS n_days, CAST(total AS BIGINT) AS total, CAST(spread AS BIGINT) AS spread, CAST(cost AS BIGINT) AS cost,
       count(*) OVER (PARTITION BY vendor_id) AS n_segments,
       CAST(sum(cost + 40000) OVER (PARTITION BY vendor_id) - 40000 AS BIGINT) AS best_cost FROM h
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is from the others of its language, and its most telling terms."""
    from . import divergence

    return divergence.audit(_read(spark, sf_dir, "documents"), Scratch(spark, "op12"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
o AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 2)) // (coalesce(sum(o.n) OVER (PARTITION BY g.lang, g.source), 0) + 2 * v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM o GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM every UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 10
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by its words, learned from the documents not held out."""
    from . import language_id

    return language_id.identify(_read(spark, sf_dir, "documents"), Scratch(spark, "op13"))


QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_packing": op3_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_html_text": op6_html_text,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_embedding_dup": op9_embedding_dup,
    "op10_warc": op10_warc,
    "op11_change_points": op11_change_points,
    "op12_source_divergence": op12_source_divergence,
    "op13_language_id": op13_language_id,
}

ORACLES = {"op8_quality_rules": OP8_SQL, "op9_embedding_dup": OP9_SQL, "op10_warc": OP10_SQL, "op11_change_points": OP11_SQL, "op12_source_divergence": OP12_SQL}
