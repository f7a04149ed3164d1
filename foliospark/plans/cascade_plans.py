"""Rule cascades with their full tables: topics, sectors, document types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, rules
from .registry import Tables, query

#: Frequent words of the driver's texts, and the phrase of each topic that stands for one of them here.
WORDS = "that with this tion from ment rewh thatin elle ononst inoran hehely orantion thth ther thon than sich thre thhe thnt thha pour lich thor keit thed".split()
PHRASES = ["wages", "longevity", "overtime", "holiday", "annual leave", "sick bank", "child-bonding", "jury duty", "Welfare Fund", "NYCERS", "step 2", "just cause", "RIF", "tour", "night differential", "uniform allowance", "tuition", "unsafe", "no-strike", "management rights", "work rules", "dues check-off", "Bargaining Unit", "eligible list", "telework", "DEI", "workforce composition"]


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Letters beyond ASCII as plain ones, for the word edges of SQL's patterns know ASCII only.
_PLAIN = "translate({}, 'àâáäçéèêëîïíìñôöóòùûüúÿßÀÂÁÄÇÉÈÊËÎÏÍÌÑÔÖÓÒÙÛÜÚŸœŒæÆ', repeat('x', 60))"
_PHRASED = reduce(lambda sql, pair: f"replace({sql}, ' {pair[0]} ', {_literal(f' {pair[1]} ')})", zip(WORDS, PHRASES, strict=True), "text")
_TOPICS_SQL = f"""
WITH b AS (SELECT doc_id, {_PLAIN.format(f"lang || chr(10) || {_PHRASED}")} AS t FROM documents),
g AS (SELECT doc_id, unnest([{", ".join(f"CASE WHEN regexp_matches(t, {_literal('(?i)' + '|'.join(f'(?:{p})' for p in patterns))}) THEN {_literal(topic)} END" for topic, patterns in fixed.TOPICS.items())}]) AS topic FROM b)
"""


@query(_TOPICS_SQL + "SELECT doc_id, topic FROM g WHERE topic IS NOT NULL")
def cas03_all_topics(t: Tables) -> DataFrame:
    """All topics of the table on whole texts that speak of them."""
    said = reduce(lambda c, pair: F.replace(c, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), zip(WORDS, PHRASES, strict=True), F.col("text"))
    tagged = rules.clause_topics(t.documents.select("doc_id", F.col("lang").alias("heading"), said.alias("text")), most=None)
    # outer, for a plain explode is preceded by a filter that finds all topics once more, from texts replaced once a topic
    return tagged.select("doc_id", F.explode_outer("topics").alias("topic")).where("topic IS NOT NULL")


#: Names of units, one for each nation.
UNITS = ["Police", "Sergeants", "UFOA", "Fire Officers", "Sanitation", "USA-Local 831", "Correction Captains", "COBA", "Teachers", "School crossing", "Doctors Council", "Nurses", "Building Inspectors", "Investigators", "Electricians", "Boilermaker", "Attorneys", "Legislative staff", "DC 37 Clericals", "Local 1549", "CWA 1180", "Managers", "Librarians", "Firefighters", "Dental hygienists"]
_SECTORS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(l, {_literal(pattern)}) THEN {_literal(sector)}" for pattern, sector in fixed.SECTORS) + " ELSE 'other' END"


@query(f"SELECT c_custkey, {_SECTORS_SQL} AS sector FROM (SELECT c_custkey, lower({'[' + ', '.join(map(_literal, UNITS)) + ']'}[c_nationkey + 1] || ' ' || c_mktsegment || ' ' || c_name) AS l FROM customer)")
def cas06_sectors(t: Tables) -> DataFrame:
    """The sector of every customer's unit, by the full table."""
    name = F.concat_ws(" ", F.get(F.array(*map(F.lit, UNITS)), F.col("c_nationkey")), "c_mktsegment", "c_name")
    return t.customer.select("c_custkey", rules.sector_of(name).alias("sector"))


#: Beginnings of documents by the number of their source.
OPENINGS = [
    "INDENTURE made this day. ", "Memorandum of Economic Agreement. ", "Memorandum of Agreement before the Comptroller. ", "In the matter of a consent\ndetermination: ", "Letter on Unit Bargaining. ", "EXECUTED CONTRACT ", "All other terms of the predecessor unit agreement\n remain in effect. ", "",
    "The terms of  the predecessor agreement shall be continued except as modified here. ", "Executed Contract that shall continue as modified by the letter. ", "Uniform Officers Coalition. ",
]
_TYPED = "WITH d AS (SELECT doc_id, {opening} || regexp_replace(coalesce(text, ''), '(?m)^T', 'ARTICLE 3' || chr(10) || 'T', 'g') AS t, lower(source || CASE WHEN source = 'src7' THEN ' wage indenture' ELSE '' END) AS l FROM documents),"
_TYPED = _TYPED.format(opening="[" + ", ".join(_literal(x) for x in OPENINGS) + "][CAST(regexp_replace(source, '[^0-9]', '', 'g') AS INTEGER) % " + str(len(OPENINGS)) + " + 1]")
_TYPES_SQL = (
    _TYPED
    + f"""
e AS (SELECT *, {_PLAIN.format("t")} AS p FROM d),
f AS (SELECT *, length(t) AS chars, regexp_matches(p, {_literal(fixed.AMENDS)}) AS amends, regexp_extract(t, {_literal(fixed.AMENDS)}) AS evidence, len(regexp_extract_all(p, '(?im)^\\s*ARTICLE\\s+(?:[IVXLC]+|\\d+)\\b')) AS articles FROM e)
SELECT doc_id, CASE WHEN regexp_matches(substr(p, 1, 700), '\\bINDENTURE\\b') THEN 'consent-determination'
  WHEN regexp_matches(substr(p, 1, 700), '(?i)memorandum\\s+of\\s+(?:economic\\s+)?agreement') AND NOT regexp_matches(substr(p, 1, 700), '(?i)before\\s+the\\s+comptroller|consent\\s+determination') THEN 'moa'
  WHEN regexp_matches(substr(p, 1, 6000), {_literal(fixed.CONSENT)}) OR contains(l, 'consent determination') OR contains(l, 'wage indenture') THEN 'consent-determination'
  WHEN regexp_matches(substr(p, 1, 6000), {_literal(fixed.UNIT_LETTER)}) THEN 'unit-agreement'
  WHEN regexp_matches(substr(p, 1, 3000), '(?i)executed\\s+contract') AND articles >= 12 AND NOT amends THEN 'full-agreement'
  WHEN articles >= 8 AND chars > 40000 THEN 'full-agreement' WHEN amends THEN 'moa' WHEN chars > 40000 AND articles >= 4 THEN 'full-agreement' ELSE 'moa' END AS doc_type,
  amends AS amends_predecessor, CASE WHEN amends THEN substr(trim(regexp_replace(evidence, '\\s+', ' ', 'g')), 1, 180) END AS amends_evidence, CAST(chars AS INTEGER) AS chars FROM f
"""
)


def _typed(t: Tables) -> DataFrame:
    number = F.regexp_replace("source", "[^0-9]", "").cast("int") % len(OPENINGS)
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^T", "ARTICLE 3\nT")
    label = F.concat("source", F.when(F.col("source") == "src7", " wage indenture").otherwise(""))
    docs = t.documents.select("doc_id", label.alias("label"), F.concat(F.get(F.array(*map(F.lit, OPENINGS)), number), body).alias("text"), F.array().cast("array<string>").alias("headings"))
    return rules.classify_documents(docs)


@query(_TYPES_SQL)
def cas04_document_type(t: Tables) -> DataFrame:
    """Type, amending wording and length of every document."""
    return _typed(t).select("doc_id", "doc_type", "amends_predecessor", "amends_evidence", "chars")


@query(f"SELECT doc_type, count(*) FILTER (amends_predecessor) AS amending, count(DISTINCT amends_evidence) AS wordings FROM ({_TYPES_SQL}) GROUP BY doc_type")
def cas05_amends(t: Tables) -> DataFrame:
    """Amending documents of each type and their different wordings."""
    return _typed(t).groupBy("doc_type").agg(F.count_if("amends_predecessor").alias("amending"), F.count_distinct("amends_evidence").alias("wordings"))
