"""Ordered rule tables compiled to expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from heapq import heappop, heappush
from operator import or_

import pandas as pd
import regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import fixed
from .query import quote


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The value of the first rule whose pattern is found."""
    out = F
    for pattern, value in rules:
        out = out.when(text.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(default)) if rules else F.lit(default)


def sector_of(label: Column) -> Column:
    return first_match(F.lower(label), fixed.SECTORS, "other")


_WORD_START = re.compile(r"\\b([A-Za-z])(?![?*{])")


def any_of(patterns: list[str]) -> str:
    """A pattern that is found where one of ``patterns`` is, in either case of ASCII letters where case is ignored.

    Patterns that all start a word with a letter share their first tests, so most places of a text are passed
    by at one look."""
    flat = [re.sub(r"\\.|\[[^\]]*\]", "", p) for p in patterns]
    while any("(" in x for x in flat) and flat != (fewer := [re.sub(r"\([^()]*\)", "", x) for x in flat]):
        flat = fewer
    starts = [_WORD_START.match(p) for p in patterns]
    if not patterns or not all(starts) or any(c in x for x in flat for c in "|()"):
        return "|".join(f"(?:{p})" for p in patterns)
    letters = "".join(sorted({c for m in starts for c in (m[1].lower(), m[1].upper())}))
    return f"(?=[{letters}])\\b(?:{'|'.join(f'(?:{p[2:]})' for p in patterns)})"


def tags(text: Column, topics: dict[str, list[str]], most: int | None = fixed.TAG_CHARS, ignore_case: bool = True) -> Column:
    """All topics with a pattern in the first characters of a text, in table order."""
    head = F.substring(text, 1, most) if most else text
    flag = "(?i)" if ignore_case else ""
    return F.filter(F.array(*[F.when(head.rlike(flag + any_of(patterns)), F.lit(topic)) for topic, patterns in topics.items()]), lambda x: x.isNotNull())


def clause_topics(clauses: DataFrame, topics: dict[str, list[str]] = fixed.TOPICS, most: int | None = fixed.TAG_CHARS) -> DataFrame:
    """Clauses with the topics of their heading and text: of the first ``most`` characters, or of all with None."""
    blob = F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    # a column of its own, for every topic looks at it and none should make it anew
    headed = clauses.withColumn("__head", F.substring(blob, 1, most) if most else blob)
    return headed.withColumn("topics", tags(F.col("__head"), topics, None)).drop("__head")


def order_rules(rules: list[tuple[str, str, list[str]]], order: str = "list") -> list[tuple[str, str, list[str]]]:
    """Corrections in the order they apply: as listed, or those for all documents first."""
    if order == "list":
        return list(rules)
    if order == "global_first":
        return [r for r in rules if not r[2]] + [r for r in rules if r[2]]
    raise ValueError(f"unknown order {order!r}")


def _whole_word(original: str) -> str:
    return r"(?U)\b" + quote(original) + r"\b"


def _replacement(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def _fold(text: Column, n: Column, rules: Column) -> Column:
    """``struct(t, n)``: a text after rules ``array<struct<p, r>>`` one after another, and their replacements."""
    start = F.struct(F.coalesce(text, F.lit("")).alias("t"), n.alias("n"))
    return F.aggregate(rules, start, lambda a, x: F.struct(F.regexp_replace(a["t"], x["p"], x["r"]).alias("t"), (a["n"] + F.regexp_count(a["t"], x["p"])).alias("n")))


def correct(docs: DataFrame, rules: list[tuple[str, str, list[str]]], order: str = "list", id_col: str = "contract_id", text_col: str = "text", step: int = 40) -> DataFrame:
    """Whole-word corrections one after another; ``n_corrections`` counts replacements.

    A rule is (original, replacement, ids); without ids it holds for all documents.  Each
    rule sees what the rules before it made.  A null text is empty, a rule without original is none.  Up to ``step`` rules are
    folded over every text; of more rules only those that a text can meet, see ``correct_indexed``.
    """
    rules = [r for r in rules if r[0]]
    if len(rules) > step:
        return correct_indexed(docs, rules, order, id_col, text_col)
    table = F.array(*[F.struct(F.lit(_whole_word(o)).alias("p"), F.lit(_replacement(r)).alias("r"), (F.array(*map(F.lit, ids)) if ids else F.array().cast("array<string>")).alias("ids")) for o, r, ids in order_rules(rules, order)])
    mine = F.filter(table, lambda x: (F.size(x["ids"]) == 0) | F.array_contains(x["ids"], F.col(id_col).cast("string")))
    out = docs.withColumn("__fold", _fold(F.col(text_col), F.lit(0), mine)) if rules else docs.withColumn("__fold", F.struct(F.coalesce(text_col, F.lit("")).alias("t"), F.lit(0).alias("n")))
    return out.withColumn(text_col, F.col("__fold.t")).withColumn("n_corrections", F.col("__fold.n")).drop("__fold")


#: Word characters as the JVM's word boundary takes them with ``(?U)``.
_W = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]"
_RUNS = regex.compile(f"({_W}+)")
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

#: Rules that one pass sends to the tasks (some 20 MB); more rules take several passes, one after another.
RULES_AT_ONCE = 100_000


class RuleIndex:
    """Ordered whole-word corrections by the words they need.

    The first run of word characters of an original stands as a whole word wherever the original
    is found.  So a text starts with the rules of its words, and a replacement adds the later rules of
    the words that it brings in; which are waiting is kept as a heap of their places.  A rule of a single word
    changes the places of that word and nothing else is looked at.  Any other rule searches the text, and what the
    text then consists of is taken anew, for such a rule may join what it leaves to its neighbours.
    """

    def __init__(self, rules: list[tuple[str, str, list[str]]]):
        self.rules = [(o, r, frozenset(ids)) for o, r, ids in rules]
        self.by_word: dict[str, list[int]] = {}
        self.everywhere: list[int] = []
        self.single: list[bool] = []
        for k, (original, _, _) in enumerate(self.rules):
            words = _RUNS.findall(original)
            self.single.append(words == [original])
            self.by_word.setdefault(words[0], []).append(k) if words else self.everywhere.append(k)

    def correct(self, text: str, scope: str | None) -> tuple[str, int, int]:
        """The corrected text, the number of replacements and the number of rules that were tried."""
        parts: list[str] = []
        places: dict[str, list[int]] = {}
        mixed: set[str] = set()
        waiting: list[int] = []
        known: set[int] = set()

        def wait(words: Iterable[str], behind: int) -> None:
            for w in words:
                for k in self.by_word.get(w, ()):
                    if k > behind and k not in known and (not self.rules[k][2] or scope in self.rules[k][2]):
                        known.add(k)
                        heappush(waiting, k)

        def take(whole: str, behind: int) -> None:
            """What a text consists of: words at odd places, the rest between."""
            parts[:] = _RUNS.split(whole)
            places.clear()
            mixed.clear()
            for i in range(1, len(parts), 2):
                if parts[i] in self.by_word:
                    places.setdefault(parts[i], []).append(i)
            wait(places, behind)

        take(text, -1)
        for k in self.everywhere:
            if not self.rules[k][2] or scope in self.rules[k][2]:
                heappush(waiting, k)
        done = tried = 0
        while waiting:
            k = heappop(waiting)
            tried += 1
            original, replacement, _ = self.rules[k]
            if self.single[k]:
                if original in mixed:
                    take("".join(parts), k)
                at = places.pop(original, [])
                if at and original != replacement:
                    words = _RUNS.findall(replacement)
                    if words == [replacement]:
                        places.setdefault(replacement, []).extend(at)
                    else:
                        # words inside a part; they are told apart once a rule asks for one
                        mixed.update(words)
                    for i in at:
                        parts[i] = replacement
                    wait(words, k)
                done += len(at)
                if at and original == replacement:
                    places[original] = at
            else:
                whole = "".join(parts)
                whole, n = regex.subn(f"{_EDGE}{regex.escape(original)}{_EDGE}", lambda m, r=replacement: r, whole)
                if n:
                    done += n
                    take(whole, k)
        return "".join(parts), done, tried


def correct_indexed(docs: DataFrame, rules: list[tuple[str, str, list[str]]], order: str = "list", id_col: str = "contract_id", text_col: str = "text", at_once: int = RULES_AT_ONCE) -> DataFrame:
    """``correct`` for thousands of rules: the same texts and counts, but a text meets only the rules its words
    call for, see ``RuleIndex``.

    Nothing is shuffled, and the work follows the words of the texts, not texts times rules.  The rule list is
    what a driver holds; each pass sends ``at_once`` rules at most.
    """
    ship(docs.sparkSession)
    out = docs.withColumns({text_col: F.coalesce(text_col, F.lit("")), "n_corrections": F.lit(0)})
    ordered = order_rules(rules, order)
    for at in range(0, len(ordered), at_once):
        out = out.withColumn("__fixed", _corrected(ordered[at : at + at_once])(text_col, F.col(id_col).cast("string")))
        out = out.withColumn(text_col, F.col("__fixed.t")).withColumn("n_corrections", F.col("n_corrections") + F.col("__fixed.n")).drop("__fixed")
    return out


def _corrected(rules: list[tuple[str, str, list[str]]]):
    """A function of a text and its scope that gives the corrected text and the number of replacements."""
    index = RuleIndex(rules)

    @F.pandas_udf("t string, n int")
    def run(texts: pd.Series, scopes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([index.correct(t, s)[:2] for t, s in zip(texts, scopes, strict=True)], columns=["t", "n"])

    return run


def classify_documents(docs: DataFrame) -> DataFrame:
    """``doc_type, amends_predecessor, amends_evidence, chars`` of documents with ``label, text, headings``.

    First rule wins.  Articles are counted in the text and among headings, for segmenting
    lifts heading lines out of the text.
    """
    text, label = F.coalesce("text", F.lit("")), F.lower(F.coalesce("label", F.lit("")))
    found = F.regexp_extract(text, fixed.AMENDS, 0)
    amends = text.rlike(fixed.AMENDS)
    in_text = F.regexp_count(text, F.lit(fixed.ARTICLE_IN_TEXT))
    in_heads = F.size(F.filter(F.coalesce("headings", F.array().cast("array<string>")), lambda h: h.rlike(fixed.ARTICLE_HEADING)))
    articles, head, length = in_text + in_heads, F.substring(text, 1, fixed.HEAD_CHARS), F.length(text)
    wording = F.substring(text, 1, fixed.WORDING_CHARS)
    labelled = reduce(or_, [F.contains(label, F.lit(x)) for x in fixed.CONSENT_LABELS])
    kind = (
        F.when(head.rlike(fixed.INDENTURE), "consent-determination")
        .when(head.rlike(fixed.MEMORANDUM) & ~head.rlike(fixed.NO_MEMORANDUM), "moa")
        .when(wording.rlike(fixed.CONSENT) | labelled, "consent-determination")
        .when(wording.rlike(fixed.UNIT_LETTER), "unit-agreement")
        .when(F.substring(text, 1, fixed.EXECUTED_CHARS).rlike(fixed.EXECUTED) & (articles >= fixed.EXECUTED_ARTICLES) & ~amends, "full-agreement")
        .when((articles >= fixed.MANY_ARTICLES) & (length > fixed.FULL_CHARS), "full-agreement")
        .when(amends, "moa")
        .when((length > fixed.FULL_CHARS) & (articles >= fixed.SOME_ARTICLES), "full-agreement")
        .otherwise("moa")
    )
    evidence = F.when(amends, F.substring(F.trim(F.regexp_replace(found, r"[\s ]+", " ")), 1, fixed.EVIDENCE_CHARS))
    return docs.withColumns({"doc_type": kind, "amends_predecessor": amends, "amends_evidence": evidence, "chars": length})
