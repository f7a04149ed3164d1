"""Document labels written out: acronyms and local numbers become names.

The tables of names are parameters; ``sources.readers.source_pairs`` reads them from a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import some

#: What a label's remaining words are abbreviated to.
FORMS = (("MOA", "Memorandum of Agreement"), ("MOU", "Memorandum of Understanding"))


def _table(pairs: dict[str, str]) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")


def _from(tokens: Column, start: Column) -> Column:
    """Tokens from a 0-based place on, joined."""
    return F.array_join(F.slice(tokens, start + 1, 10_000), " ")


def _forms(text: Column, whole: bool) -> Column:
    for short, full in FORMS:
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_]){short}(?![A-Za-z0-9_])", full) if whole else F.replace(text, F.lit(short), F.lit(full))
    return text


def _local(tokens: Column, at: Column, parents: Column) -> Column:
    """``struct(n, used)`` if a known local's number stands here: ``L12``, ``Local 12`` or ``12``."""
    t, nxt = F.coalesce(F.get(tokens, at), F.lit("")), F.coalesce(F.get(tokens, at + 1), F.lit(""))
    known = lambda n: F.coalesce(F.map_contains_key(parents, F.coalesce(n, F.lit(""))), F.lit(False))
    short, bare, digits = some(F.regexp_extract(t, r"(?i)^L(\d{1,4})$", 1)), some(F.regexp_extract(t, r"^(\d{2,4})$", 1)), F.regexp_replace(nxt, "[^0-9]", "")
    found = lambda n, used: F.struct(n.alias("n"), F.lit(used).alias("used"))
    return F.when(known(short), found(short, 1)).when((F.lower(t) == "local") & known(digits), found(digits, 2)).when(known(bare), found(bare, 1))


def expand(label: Column, acronyms: dict[str, str], parents: dict[str, str] | None = None, plain: list[str] = ()) -> Column:
    """A label with its union written out.

    A leading acronym (one token, or two run together) gives ``Name (KEY) — rest``, with the
    local if its number follows; a leading local number gives its parent; otherwise only the
    abbreviations of the document's kind are written out.  ``plain`` are first words that are no acronyms.
    """
    names, locals_ = _table(acronyms), _table(parents or {})
    tokens = F.split(label, r"[\s ]+")
    t0, t1 = F.get(tokens, F.lit(0)), F.coalesce(F.get(tokens, F.lit(1)), F.lit(""))
    one = F.upper(F.regexp_replace(t0, "[^A-Za-z0-9/]", ""))
    two = F.upper(F.regexp_replace(F.concat(t0, t1), "[^A-Za-z0-9]", ""))
    skip = t0.isin(list(plain)) if plain else F.lit(False)
    has = lambda k: F.map_contains_key(names, k)
    key = F.when(has(one) & ~skip, F.struct(one.alias("k"), F.lit(1).alias("used"))).when((F.size(tokens) >= 2) & has(two), F.struct(two.alias("k"), F.lit(2).alias("used")))
    after = _local(tokens, F.coalesce(key["used"], F.lit(0)), locals_)
    name = F.element_at(names, key["k"])
    rest = _forms(_from(tokens, F.coalesce(key["used"], F.lit(0)) + F.coalesce(after["used"], F.lit(0))), True)
    with_local = F.concat(name, F.lit(" Local "), after["n"], F.lit(" ("), key["k"], F.lit(" Local "), after["n"], F.lit(") — "), rest)
    return (
        F.when(F.coalesce(label, F.lit("")) == "", label)
        .when(key.isNotNull() & after.isNotNull(), with_local)
        .when(key.isNotNull(), F.concat(name, F.lit(" ("), key["k"], F.lit(") — "), rest))
        .when(after.isNotNull(), F.concat(F.element_at(locals_, after["n"]), F.lit(" — "), rest))
        .otherwise(_forms(label, True))
    )


def expand_for_export(label: Column, acronyms: dict[str, str]) -> Column:
    """The export's simpler form: a leading acronym of one token, no locals, and abbreviations
    written out wherever they stand, inside words too."""
    names = _table(acronyms)
    tokens = F.split(F.trim(label), r"[\s ]+")
    key = F.upper(F.regexp_replace(F.get(tokens, F.lit(0)), "[^A-Za-z0-9/]", ""))
    rest = _forms(_from(tokens, F.lit(1)), False)
    return F.when(F.coalesce(F.trim(label), F.lit("")) == "", label).when(F.map_contains_key(names, key), F.concat(F.element_at(names, key), F.lit(" ("), key, F.lit(") — "), rest)).otherwise(_forms(label, False))
