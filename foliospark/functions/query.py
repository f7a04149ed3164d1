"""The search language: a string becomes terms, terms become Catalyst expressions.

Everything here runs on the driver and looks at the query only, never at data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEFT, _RIGHT = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
_SPACE = "[\\s ]"


def quote(text: str) -> str:
    """A literal for the regular expressions of the JVM."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def literal(text: str) -> str:
    """Words in order with any white space between; hyphens and apostrophes optional; whole
    words where the text begins or ends in a letter or digit."""
    text = text.strip()
    parts = [re.sub(r"['’]", "['’]?", quote(w).replace("-", "[-\\s]?")) for w in text.split()]
    body = f"{_SPACE}+".join(parts)
    return (_LEFT if re.match(r"[A-Za-z0-9]", text) else "") + body + (_RIGHT if re.search(r"[A-Za-z0-9]$", text) else "")


@dataclass(frozen=True)
class Term:
    """One condition of a query: any of its spellings may match.

    ``texts`` are what the patterns ``sources`` were made from, one each: letters and digits of a text stand in
    this order in whatever its pattern matches."""

    sources: tuple[str, ...]
    weight: int = 1
    texts: tuple[str, ...] = ()

    def matches(self, text: Column) -> Column:
        return text.rlike("(?i)" + "|".join(f"(?:{s})" for s in self.sources))

    def count(self, text: Column) -> Column:
        """Occurrences summed over spellings, so a text may count twice."""
        total = F.lit(0)
        for s in self.sources:
            total = total + F.regexp_count(text, F.lit(f"(?i){s}"))
        return total


@dataclass(frozen=True)
class Query:
    terms: tuple[Term, ...]

    @property
    def highlight(self) -> str:
        return "(?i)" + "|".join(f"(?:{s})" for t in self.terms for s in t.sources)


@dataclass
class Families:
    """Spellings of a name: abbreviations and the full name, parentheses dropped."""

    members: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)

    @classmethod
    def of(cls, acronyms: dict[str, str]) -> Families:
        names: dict[str, list[str]] = {}
        for short, full in acronyms.items():
            names.setdefault(re.sub(r"\s*\([^)]*\)", "", full).strip(), []).append(short)
        return cls([(name, tuple(shorts)) for name, shorts in names.items()])

    @staticmethod
    def sources(name: str, shorts: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(literal(x) for x in (*shorts, name))

    def find(self, token: str) -> tuple[str, tuple[str, ...]] | None:
        return next((m for m in self.members if token.lower() in (s.lower() for s in m[1])), None)


def split_phrases(text: str) -> tuple[list[str], str]:
    """Quoted phrases, and the rest of a query."""
    text = re.sub("[“”]", '"', text)
    phrases = [p.strip() for p in re.findall(r'"([^"]+)"', text) if p.strip()]
    return phrases, re.sub(r'"([^"]+)"', " ", text).strip()


def _tokens(text: str) -> list[str]:
    """Tokens between white space; a lone currency or section sign joins what follows."""
    out: list[str] = []
    for t in text.split():
        if out and re.fullmatch(r"[$§¶]+", out[-1]):
            out[-1] += ("" if out[-1] == "$" else " ") + t
        else:
            out.append(t)
    return out


def _token_term(token: str, families: Families) -> Term:
    t = re.sub(r'^[.,;:!?"]+|[.,;:!?"]+$', "", token) or token
    family = families.find(t)
    if family:
        typed = literal(t)
        plural = typed[: -len(_RIGHT)] + "(?:s)?" + _RIGHT if typed.endswith(_RIGHT) else typed
        return Term((plural, *Families.sources(*family)), texts=(t, *family[1], family[0]))
    if re.search(r"[^A-Za-z'’]", t):
        return Term((literal(t),), texts=(t,))
    word = re.sub(r"['’]", "['’]?", quote(t))
    if len(t) <= 3:
        return Term((f"{_LEFT}{word}(?:s|es)?{_RIGHT}",), texts=(t,))
    return Term((f"{_LEFT}{word}",), texts=(t,))


def compile_query(text: str | None, families: Families | None = None) -> Query | None:
    """Terms of a query, or None for a query without any.

    Phrases first and names next, both with weight two; then the remaining tokens: a known
    abbreviation stands for its whole family, anything with symbols or hyphens is literal, words
    of three letters or fewer are whole words with an optional plural, longer ones match
    from the start of a word.
    """
    if not text or not text.strip():
        return None
    families = families or Families()
    phrases, loose = split_phrases(text)
    terms = [Term((literal(p),), 2, (p,)) for p in phrases]
    for name, shorts in families.members:
        for form in (name, *(s for s in shorts if re.search(r"[^A-Za-z0-9]", s))):
            found = re.search(literal(form), loose, re.I)
            if found:
                loose = loose[: found.start()] + " " + loose[found.end() :]
                terms.append(Term(Families.sources(name, shorts), 2, (*shorts, name)))
    terms += [_token_term(t, families) for t in _tokens(loose)]
    return Query(tuple(terms)) if terms else None


@dataclass(frozen=True)
class QuerySpec:
    """What a search page is asked for, as its link says it."""

    query: str = ""
    topic: str = ""
    contract: str = ""
    sector: str = ""
    earlier: bool = True
    compare: tuple[str, ...] = ()

    MOST_COMPARED = 4

    @classmethod
    def parse(cls, link: str, topics=None) -> QuerySpec:
        from urllib.parse import parse_qs

        got = {k: v[0] for k, v in parse_qs(link.partition("?")[2] or link).items()}
        topic = got.get("topic", "")
        if topics is not None and topic not in topics:
            topic = ""
        picked = tuple(x for x in got.get("compare", "").split(",") if x)
        return cls(got.get("q", ""), topic, got.get("contract", ""), got.get("sector", ""), got.get("earlier") != "0", picked[: cls.MOST_COMPARED])

    def link(self) -> str:
        """The link of this page; what has its default value is left out."""
        from urllib.parse import urlencode

        parts = {"q": self.query, "topic": self.topic, "contract": self.contract, "sector": self.sector, "earlier": "" if self.earlier else "0", "compare": ",".join(self.compare)}
        return urlencode({k: v for k, v in parts.items() if v})
