"""Text keys and regular-expression helpers as Column expressions. Null counts as empty text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import vocabulary as v

#: Marks put around matches; they are removed from the text first.
MATCH, GROUP = "\u0001", "\u0002"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def norm(c: Column | str) -> Column:
    """Lower case without accents, runs of white space (no-break spaces too) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text(c)), v.ACCENTED, v.PLAIN), "[\\s ]+", " "))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the text contains one of the words, also inside others."""
    return c.rlike("|".join(map(re.escape, words)))


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    """As ``contains_any``, by a byte search for each word, which is far cheaper on long texts; ``c`` is computed for each word, so it is to be bound."""
    hit = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def matches_any(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def first_group(c: Column, groups, otherwise: Column | str | None) -> Column:
    """Label of the first group of words that the text contains."""
    out = None
    for label, words in groups:
        hit = contains_any(c, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def nonblank(c: Column) -> Column:
    """Null instead of blank text."""
    return F.when(F.trim(c) != "", c)


def company_key(c: Column | str) -> Column:
    plain = norm(c)
    t = F.regexp_replace(F.regexp_replace(plain, "[.,-]", ""), v.LEGAL_FORMS, " ")
    key = F.regexp_replace(F.regexp_replace(t, v.GENERIC_NAMES, " "), "[^a-z0-9]", "")
    return F.when(key == "", F.regexp_replace(plain, "[^a-z0-9]", "")).otherwise(key)


def location_key(c: Column | str) -> Column:
    t = F.regexp_replace(F.regexp_replace(norm(c), "[.,]", ""), v.LOCATION_FILLERS, " ")
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def clean_url(c: Column | str) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.trim(F.regexp_replace(text(c), "[?#][\\s\\S]*$", "")), "/+$", "")


def strip_html(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), "<[^>]*>", " "), "\\s+", " "))


SMALL_WORDS = ("de", "del", "la", "las", "el", "los", "y", "en", "para", "con", "a", "o")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def title_case(c: Column | str) -> Column:
    """Shouting titles (70 % of the letters in capitals) in title case; others as they are."""
    s = text(c)
    letters, capitals = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(r"\p{Lu}"))
    words = F.transform(F.split(F.lower(s), " "), lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(_capital(w)))
    return F.when((letters > 0) & (capitals >= 0.7 * letters), F.array_join(words, " ")).otherwise(s)


def capitalized(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), _capital), " ")


#: Parts of a split text that are put together at a time; even, so that a run of parts begins outside a match.
RUN = 256


def find_all(c: Column, pattern: str, groups: int = 0) -> Column:
    """array<struct<start, end, m, g array<string>>> of all matches, as an engine with positions would give them.

    Every match is put between marks along with its groups; the text is split at the marks, and the lengths of the
    parts add up to the offsets. Lookarounds see the whole text, since the replacement runs over it. An array grows by
    copying, so a text of very many matches is put together in runs.
    """
    plain = F.translate(c, MATCH + GROUP, "")
    inserted = "".join(f"${g}{GROUP}" for g in range(1, groups + 1)) + "$0"
    return bind(F.split(F.regexp_replace(plain, pattern, f"{MATCH}{inserted}{MATCH}"), MATCH), lambda parts: F.when(F.size(parts) <= RUN, _run(parts, F.lit(0))).otherwise(_runs(parts)))


def _run(parts: Column, at: Column) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,m:string,g:array<string>>>")

    def add(acc: Column, part: Column) -> Column:
        pieces = F.split(part, GROUP)
        m = F.when(acc["hit"], F.element_at(pieces, -1)).otherwise(part)
        end = acc["pos"] + F.length(m)
        found = F.struct(acc["pos"].alias("start"), end.alias("end"), m.alias("m"), F.slice(pieces, 1, F.size(pieces) - 1).alias("g"))
        return F.struct(end.alias("pos"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, F.struct(at.alias("pos"), F.lit(False).alias("hit"), none.alias("out")), add, lambda acc: acc["out"])


def _runs(parts: Column) -> Column:
    numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int"))
    size = lambda part: F.length(F.substring_index(part, GROUP, -1))
    sizes = F.transform(numbers, lambda k: F.aggregate(F.slice(parts, k * RUN + 1, RUN), F.lit(0), lambda n, part: n + size(part)))
    begins = F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    return bind(begins, lambda at: F.flatten(F.transform(numbers, lambda k: _run(F.slice(parts, k * RUN + 1, RUN), F.get(at, k)))))


def before(c: Column, start: Column, chars: int) -> Column:
    """Up to so many characters that end at ``start``."""
    at = F.greatest(start - chars, F.lit(0))
    return F.substring(c, at + 1, start - at)


def after(c: Column, end: Column, chars: int) -> Column:
    return F.substring(c, end + 1, F.lit(chars))


def amount_label(low: Column, high: Column, currency: Column, raw: Column) -> Column:
    """A salary in few characters; null if nothing is known."""
    money = F.coalesce(currency, F.lit("S/"))

    def short(x: Column) -> Column:
        k = x / 1000
        thousands = F.when(k == F.floor(k), F.concat(F.floor(k).cast("int").cast("string"), F.lit("k"))).otherwise(F.format_string("%.1fk", k))
        return F.when(x >= 1000, thousands).otherwise(x.cast("int").cast("string"))

    known = F.when((F.trim(text(raw)) != "") & ~F.lower(text(raw)).contains("no especificado"), raw)
    return (
        F.when(low.isNotNull() & high.isNotNull() & (high > low), F.concat(money, F.lit(" "), short(low), F.lit(" – "), short(high)))
        .when(low.isNotNull(), F.concat(F.lit("Desde "), money, F.lit(" "), short(low)))
        .when(high.isNotNull(), F.concat(F.lit("Hasta "), money, F.lit(" "), short(high)))
        .otherwise(known)
    )
