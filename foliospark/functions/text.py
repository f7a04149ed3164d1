"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import fixed

_ACCENTED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿÇçÑñ"
_PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuYyyCcNn"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def slugify(label, most: int = 80) -> Column:
    """Lower-case words joined by hyphens; accents dropped, other non-ASCII characters removed;
    cut after trimming, so a cut may end in a hyphen."""
    plain = F.regexp_replace(F.translate(_col(label), _ACCENTED, _PLAIN), r"[^\x00-\x7F]", "")
    return F.substring(F.lower(F.regexp_replace(F.regexp_replace(plain, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")), 1, most)


def slug_of_url(url, prefix: str = "earlier-", most: int = 70) -> Column:
    """A slug from the last part of a URL, without its ending."""
    name = F.regexp_replace(F.element_at(F.split(_col(url), "/"), -1), r"%20|\s+", "-")
    name = F.lower(F.regexp_replace(name, r"(?i)\.pdf$", ""))
    slug = F.regexp_replace(F.regexp_replace(name, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit(prefix), F.regexp_replace(F.substring(slug, 1, most), "-+$", ""))


def some(text: Column) -> Column:
    """Null for the empty string that a failed extraction gives."""
    return F.nullif(text, F.lit(""))


def term_anywhere(label) -> tuple[Column, Column]:
    """First pair of years joined by a dash."""
    p = r"(\d{4})\s*[-–]\s*(\d{4})"
    return tuple(some(F.regexp_extract(_col(label), p, k)).cast("int") for k in (1, 2))


def term_at_end(label) -> tuple[Column, Column]:
    """A pair of years at the end, whatever is between them."""
    p = r"(\d{4})\D+(\d{4})\s*$"
    return tuple(some(F.regexp_extract(_col(label), p, k)).cast("int") for k in (1, 2))


def year_of(iso) -> Column:
    return F.substring(_col(iso), 1, 4).cast("int")


def _month(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), number)


def ap_date(date) -> Column:
    """``Sept. 5, 2024``; empty for null."""
    d = F.to_date(_col(date))
    return F.coalesce(F.concat(_month(fixed.MONTHS_AP, F.month(d)), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string")), F.lit(""))


def step_date(effective, first: str = "Day 1 of unit agreement", later: str = "Month ") -> Column:
    """A wage step's date as a tracker shows it: symbolic dates in words, others short."""
    e = _col(effective)
    n = some(F.regexp_extract(e, r"^month-(\d+)", 1)).cast("int")
    y, m, d = (some(F.regexp_extract(e, r"^(20\d\d)-(\d{2})(?:-(\d{2}))?", k)) for k in (1, 2, 3))
    month = _month(fixed.MONTHS_SHORT, F.greatest(m.cast("int"), F.lit(1)))
    return (
        F.when(F.coalesce(e, F.lit("")) == "", "")
        .when(n == 1, first)
        .when(n.isNotNull(), F.concat(F.lit(later), n.cast("string")))
        .when(e == "on-ratification", "On ratification")
        .when(d.isNotNull(), F.concat(month, F.lit(" "), d.cast("int").cast("string"), F.lit(", "), y))
        .when(m.isNotNull(), F.concat(month, F.lit(" "), y))
        .otherwise(F.regexp_replace(e, "-on-ratification", " on ratification"))
    )


def facts_date(effective) -> Column:
    """The same for a fact sheet, with full AP dates."""
    e = _col(effective)
    return F.when(e.rlike(r"^\d{4}-\d{2}-\d{2}$"), ap_date(F.try_to_date(e))).otherwise(F.regexp_replace(F.regexp_replace(e, r"^month-1$", "First day of the term"), r"^month-(\d+)$", "First day of month $1"))


def term_text(start, end, first_year, last_year) -> Column:
    """Exact dates, else years, else a remark."""
    s, e, a, z = map(_col, (start, end, first_year, last_year))
    return F.when(s.isNotNull() & e.isNotNull(), F.concat(ap_date(s), F.lit(" to "), ap_date(e))).when((F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(z, F.lit(0)) != 0), F.concat(a.cast("string"), F.lit("–"), z.cast("string"))).otherwise("Term not stated")


def haystack(*parts) -> Column:
    """Searchable text: parts on lines of their own, nulls empty."""
    return F.concat_ws("\n", *[F.coalesce(_col(p), F.lit("")) for p in parts])


def page_link(url, page) -> Column:
    return F.concat(_col(url), F.lit("#page="), _col(page).cast("string"))


def squeeze(text, most: int | None = None) -> Column:
    """White space made single spaces and trimmed; optionally cut."""
    out = F.trim(F.regexp_replace(_col(text), r"[\s ]+", " "))
    return F.substring(out, 1, most) if most else out


def escape_html(text, apostrophe: bool = False) -> Column:
    out = F.coalesce(_col(text).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")) + ((("'", "&#39;"),) if apostrophe else ()):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def highlight(text, pattern: str) -> Column:
    """Matches marked, everything escaped.  Marks are set before escaping, with signs that no
    text holds, so a match may touch an escaped character."""
    on, off = "\ue000", "\ue001"
    out = escape_html(F.regexp_replace(F.coalesce(_col(text), F.lit("")), f"({pattern})", f"{on}$1{off}"))
    out = F.replace(out, F.lit(on + off), F.lit(""))  # empty matches
    return F.replace(F.replace(out, F.lit(on), F.lit("<mark>")), F.lit(off), F.lit("</mark>"))


def snippet(text, pattern: str) -> Column:
    """Highlighted text from a little before its first match; whole if the match is early."""
    t = F.coalesce(_col(text), F.lit(""))
    at = F.regexp_instr(t, F.lit(pattern))
    before = F.substring(t, F.lit(1), at - F.lit(120))
    space = F.length(before) - F.instr(F.reverse(before), " ") + 1
    start = F.when(F.instr(before, " ") > 0, space + 1).otherwise(F.lit(2))
    cut = F.substring(t, start, F.length(t))
    return F.when((at == 0) | (at <= 160), highlight(t, pattern)).otherwise(F.concat(F.lit("&hellip;"), highlight(cut, pattern)))


def context(text, start, end, pad: int = 70) -> Column:
    """Text around 0-based offsets, ellipses where it is cut, line breaks as spaces."""
    t, s, e = _col(text), _col(start), _col(end)
    a, b = F.greatest(s - pad, F.lit(0)), F.least(e + pad, F.length(t))
    body = F.replace(F.substring(t, a + 1, b - a), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(a > 0, "…").otherwise(""), body, F.when(b < F.length(t), "…").otherwise(""))


def first_sentence(text, least: int = 30, most: int = 320) -> Column:
    """The first sentence or line of a text if it is of a sensible length, else null."""
    s = F.element_at(F.split(F.trim(_col(text)), r"(?<=[.\n])\s+", 2), 1)
    return F.when((F.length(s) > least) & (F.length(s) < most), s)


def after_mark(note, mark: str = "Caveat:") -> Column:
    """What stands between the first mark and the next, trimmed; empty without one."""
    n = F.coalesce(_col(note), F.lit(""))
    return F.when(F.contains(n, F.lit(mark)), F.trim(F.get(F.split(n, mark), F.lit(1)))).otherwise("")


def short_label(label) -> Column:
    """What follows the first long dash."""
    x = _col(label)
    at = F.instr(x, " — ")
    return F.when(at > 1, F.substring(x, at + 3, F.length(x))).otherwise(x)


def chip_label(name, label) -> Column:
    """A union's short name (its parentheses, else what is before a comma) and the short label."""
    n = F.coalesce(_col(name), F.lit(""))
    inner = some(F.regexp_extract(n, r"\(([^)]+)\)", 1))
    who = F.coalesce(inner, F.trim(F.element_at(F.split(n, "[,(]"), 1)))
    return F.when(who != "", F.concat(who, F.lit(": "), short_label(label))).otherwise(short_label(label))


def percents(text, chars: int = 8000, most: int = 8) -> Column:
    """Percentages above 0.5 and below 8.5 in the first characters of a text."""
    found = F.transform(F.regexp_extract_all(F.substring(_col(text), 1, chars), F.lit(fixed.PERCENTS), F.lit(1)), lambda x: x.cast("double"))
    return F.slice(F.filter(found, lambda p: (p > 0.5) & (p < 8.5)), 1, most)


def lump_sums(text, chars: int = 8000, most: int = 3) -> Column:
    """Lump sums from 500 to 25,000."""
    found = F.transform(F.regexp_extract_all(F.substring(_col(text), 1, chars), F.lit(fixed.LUMP_SUMS), F.lit(1)), lambda x: F.try_to_number(F.replace(x, F.lit(","), F.lit("")), F.lit("9999999")).cast("int"))
    return F.slice(F.filter(found, lambda p: (p >= 500) & (p <= 25000)), 1, most)


def compounded(pcts: Column) -> Column:
    """Compound of percentages, to two places; null for none."""
    f = F.aggregate(pcts, F.lit(1.0).cast("double"), lambda a, p: a * (1 + p / 100))
    return F.when(F.size(pcts) > 0, F.round((f - 1) * 100, 2))


def upper_median(values: Column) -> Column:
    """The middle of sorted values, the upper one of two."""
    s = F.sort_array(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def letters_share(text) -> Column:
    """Share of letters, white space and common punctuation; 0 for no text."""
    t = F.coalesce(_col(text), F.lit(""))
    odd = F.length(F.regexp_replace(t, r"[\p{L}\s.,;:!?\-()/&%$'\"]", ""))
    return F.when(F.length(t) > 0, (F.length(t) - odd) / F.length(t)).otherwise(F.lit(0.0))


def page_needs_recognition(text, words) -> Column:
    """Under 20 words, or some text of which under 0.55 is readable."""
    return (F.coalesce(_col(words), F.lit(0)) < 20) | ((F.length(F.coalesce(_col(text), F.lit(""))) > 0) & (letters_share(text) < 0.55))


def word_count(text) -> Column:
    """Words in the Unicode sense."""
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(r"(?U)\b\w+\b"))


def space_count(text) -> Column:
    """Stretches between white space."""
    return F.size(F.array_remove(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), ""))


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a pipe table, a rule after the first row; nulls and line breaks tidied."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(squeeze(c), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(rows, line)
    empty = F.coalesce(F.size(rows), F.lit(0)) <= 0
    return F.when(empty, "").when(F.size(F.get(rows, F.lit(0))) <= 0, "").otherwise(F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, 1_000_000)), "\n"))


def citation(text, label, heading, page, url, link, ocr, source: str) -> Column:
    """A quotation block: text, origin, links and a note on recognised text; empty parts left out."""
    t, lab, h, p, u, k, o = map(_col, (text, label, heading, page, url, link, ocr))
    head = F.when((F.coalesce(h, F.lit("")) != "") & (h != lab), F.concat(F.lit(", "), h)).otherwise("")
    return F.concat_ws(
        "\n",
        some(F.trim(F.coalesce(t, F.lit("")))),
        F.concat(F.lit("— "), lab, head, F.lit(", p. "), p.cast("string"), F.lit(".")),
        F.when(u.isNotNull(), F.concat(F.lit("Source PDF: "), page_link(u, p))),
        F.concat(F.lit(f"Via {source}: "), k),
        F.when(F.coalesce(o, F.lit(False)), F.lit("Note: this page was transcribed via OCR — verify wording against the source PDF before publication.")),
    )


def _goes_on(last: str, size: int, line: str) -> bool:
    """Whether a line goes on from the open one before it, of so many characters and this last piece,
    which looks like wrapped prose."""
    if last.endswith("-"):
        return True
    if size < 30 or last[-1:] in fixed.SENTENCE_ENDS or last.endswith(":"):
        return False
    return not (line[:1].isdigit() and len(line) < 40) and not line.endswith(":")


def join_lines(lines: list[str]) -> list[str]:
    """Wrapped lines joined, in one pass: only the open line is kept, as the pieces it is made of."""
    out, pieces, size = [], [], 0
    for line in lines:
        if pieces and pieces[-1].endswith("-") and line[:1].islower():
            pieces[-1] = pieces[-1][:-1]
            pieces.append(line)
            size += len(line) - 1
        elif pieces and _goes_on(pieces[-1], size, line):
            pieces += [" ", line]
            size += len(line) + 1
        else:
            if pieces:
                out.append("".join(pieces))
            pieces, size = [line], len(line)
    return [*out, "".join(pieces)] if pieces else out


def reflow_text(text: str) -> str:
    """Wrapped lines of each paragraph joined; tables and lists of short lines left alone."""
    done = []
    for paragraph in re.split(r"\n\s*\n", text, flags=re.ASCII):
        lines = [x.rstrip() for x in re.split("[\n\x0b\x0c\r\u2028]", paragraph)]
        lines = [x for x in lines if x]
        short = sum(len(x) < 40 for x in lines) > len(lines) * 0.6
        numbers = sum(_NUMBERS.match(x) is not None for x in lines) > len(lines) * 0.4
        if lines:
            done.append("\n".join(lines if len(lines) >= 3 and (short or numbers) else join_lines(lines)))
    return "\n\n".join(done)


_NUMBERS = re.compile(fixed.NUMBERS_LINE, re.ASCII)


def reflow(text) -> Column:
    """Wrapped lines of each paragraph joined; tables and lists of short lines left alone.  Null stays null.

    A fold over lines, for each depends on what was joined before, in Arrow tasks: linear in a text,
    however many lines a paragraph has.  Not idempotent: a joined line may join again, so a document is reflowed
    once.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(reflow_text, na_action="ignore")

    return run(_col(text))
