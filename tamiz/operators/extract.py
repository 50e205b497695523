"""Attributes of a posting from its title and description: Column in, Column (or struct) out, all inside the JVM.

Texts are normalised once for each attribute; ``normal`` tells that they already are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import vocabulary as v
from tamiz.functions.text import bind, contains_any, find_all, first_group, matches_any, nonblank, norm, text


def _of(c: Column | str, normal: bool, use) -> Column:
    return bind(text(c) if normal else norm(c), use)


def seniority(title: Column | str) -> Column:
    return bind(F.concat(F.lit(" "), norm(title), F.lit(" ")), _seniority)


def _seniority(t: Column) -> Column:
    out = F.when(matches_any(t, v.SENIORITY[-1][1]), v.SENIORITY[-1][0])
    for label, patterns in v.SENIORITY:
        out = out.when(matches_any(t, patterns), label)
    return out.otherwise(v.NO_SENIORITY)


def _amounts(t: Column, pattern: str, accepted: tuple[float, float]) -> Column:
    found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda m: F.regexp_replace(m, "[.,]", "").try_cast("double"))
    return F.filter(found, lambda x: x.between(*accepted))


def salary(description: Column | str, normal: bool = False) -> Column:
    """struct<min, max, currency>; amounts count only where a salary word stands in the text."""

    def paid(a: Column) -> Column:
        soles, dollars = a["soles"], a["dollars"]
        chosen = F.when(F.size(soles) > 0, soles).when(F.size(dollars) > 0, dollars)
        currency = F.when(F.size(soles) > 0, "PEN").when(F.size(dollars) > 0, "USD")
        return F.struct(F.array_min(chosen).alias("min"), F.array_max(chosen).alias("max"), currency.alias("currency"))

    def read(t: Column) -> Column:
        none = F.array().cast("array<double>")
        spoken = lambda amounts: F.when(contains_any(t, v.SALARY_WORDS), amounts).otherwise(none)
        return bind(F.struct(spoken(_amounts(t, v.SOLES, v.SOLES_RANGE)).alias("soles"), spoken(_amounts(t, v.DOLLARS, v.DOLLARS_RANGE)).alias("dollars")), paid)

    return _of(description, normal, read)


def education(description: Column | str, normal: bool = False) -> Column:
    return _of(description, normal, lambda t: first_group(t, v.EDUCATION, v.NO_EDUCATION))


def english(description: Column | str, normal: bool = False) -> Column:
    """struct<required, level>."""
    level = _of(description, normal, lambda t: first_group(t, v.ENGLISH, F.when(t.rlike(v.ENGLISH_WORD), v.ENGLISH_NAMED)))
    return bind(level, lambda x: F.struct(x.isNotNull().alias("required"), x.alias("level")))


def work_shift(description: Column | str, normal: bool = False) -> Column:
    """struct<shift, camp>: the first NxM that is neither 24x7, 0xM nor near words that mean something else."""
    return _of(description, normal, _work_shift)


def _work_shift(t: Column) -> Column:
    def real(m: Column) -> Column:
        on, off = m["g"][0].cast("int"), m["g"][1].cast("int")
        at = F.greatest(m["start"] - 50, F.lit(0))
        return (on > 0) & ~((on == 24) & (off == 7)) & ~contains_any(F.substring(t, at + 1, m["start"] + 50 - at), v.SHIFT_NOISE)

    def read(first: Column) -> Column:
        on, off = first["g"][0].cast("int"), first["g"][1].cast("int")
        long = F.coalesce((on >= 7) | (on + off >= 10), F.lit(False))
        return F.struct(F.concat(on.cast("string"), F.lit("x"), off.cast("string")).alias("shift"), (contains_any(t, v.CAMP_WORDS) | long).alias("camp"))

    return bind(F.get(F.filter(find_all(t, v.SHIFT, 2), real), 0), read)


def _whole(title: Column | str, description: Column | str) -> Column:
    return F.concat(text(title), F.lit(" "), text(description))


def industrial_only(title: Column | str, description: Column | str) -> Column:
    return _of(_whole(title, description), False, names_one_career)


def names_one_career(t: Column) -> Column:
    return ~t.rlike(v.RELATED_CAREERS) & ~contains_any(t, v.OTHER_CAREERS)


def benefits(description: Column | str, normal: bool = False) -> Column:
    return _of(description, normal, lambda t: F.filter(F.array(*(F.when(contains_any(t, words), label) for label, words in v.BENEFITS)), lambda x: x.isNotNull()))


def area(title: Column | str, description: Column | str, portal_area: Column | str) -> Column:
    return area_of(portal_area, norm(_whole(title, description)))


def area_of(portal_area: Column | str, t: Column) -> Column:
    """From the portal's area, or else from normalised text."""
    given = text(portal_area)

    def by_text(t: Column) -> Column:
        out = None
        for label, words in v.AREAS_BY_TEXT:
            hit = t.rlike(rf"\b({'|'.join(words)})\b")
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out.otherwise(v.DEFAULT_AREA)

    return F.when(F.trim(given) != "", first_group(norm(given), v.AREAS_BY_PORTAL, F.trim(given))).otherwise(bind(t, by_text))


def work_mode(current: Column, t: Column) -> Column:
    """From the mode so far and normalised text; explicit on-site words win."""
    return (
        F.when(contains_any(t, v.ON_SITE), "Presencial")
        .when((text(current) == "Remoto") | contains_any(t, v.REMOTE), "Remoto")
        .when((text(current) == "Hibrido") | contains_any(t, v.HYBRID), "Hibrido")
        .otherwise("Presencial")
    )


def shift_kind(shift: Column, camp: Column, description: Column) -> Column:
    return F.when((F.trim(text(shift)) != "") | camp, "ATIPICO").when(F.length(text(description)) < v.DETAIL_FROM_CHARS, "NO_DETERMINADO").otherwise("ESTANDAR")


def shift_text(shift: Column, camp: Column, description: Column) -> Column:
    """What a card says of the shift; nothing for standard ones."""
    kind, named = shift_kind(shift, camp, description), nonblank(shift)
    return F.when(kind == "ATIPICO", F.array_join(F.filter(F.array(named, F.when(camp, "Campamento")), lambda x: x.isNotNull()), " · ")).when(kind == "NO_DETERMINADO", "Jornada s/d")


def names_career(t: Column) -> Column:
    return t.rlike(v.CAREER) & ~(t.rlike(v.NOT_CAREER) & ~t.rlike(v.CAREER_NAMED))
