"""Required experience from normalised text, with its evidence; all inside the JVM.

Matches come with offsets (``find_all``), their surroundings decide whether they speak of the company, an age or a term, and
the least number of months of the rest counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import vocabulary as v
from tamiz.functions.text import MATCH, after, before, bind, contains_any, find_all

_CANDIDATE = "array<struct<months:int,top:int,m:string>>"


def without_footer(t: Column) -> Column:
    """Cut at the first portal footer beyond the 201st character."""
    cuts = [bind(F.instr(t, marker), lambda at: F.when(at > 201, at - 1)) for marker in v.PORTAL_FOOTERS]
    return F.substring(t, 1, F.coalesce(F.least(*cuts), F.length(t)))


def _number(g: Column) -> Column:
    words = F.lit(None).cast("double")
    for w, n in v.NUMBER_WORDS.items():
        words = F.when(g == w, F.lit(float(n))).otherwise(words)
    return F.coalesce(F.replace(g, F.lit(","), F.lit(".")).try_cast("double"), words)


def _months(n: Column, unit: Column) -> Column:
    factor = F.when(unit.startswith("mes"), 1).when(unit.startswith("semestre"), 6).otherwise(12)
    return F.floor(n * factor + 0.5).cast("int")


def _about_something_else(pre: Column, m: Column, post: Column) -> Column:
    return bind(F.struct(pre.alias("pre"), m.alias("m"), post.alias("post")), lambda w: _elsewhere(w["pre"], w["m"], w["post"]))


def _elsewhere(pre: Column, m: Column, post: Column) -> Column:
    company = F.concat(pre, m, post).rlike(v.COMPANY_ANYWHERE) | pre.rlike(v.COMPANY_BEFORE) | post.rlike(v.COMPANY_AFTER)
    term = contains_any(pre, v.TERM_BEFORE) | F.ltrim(post).rlike("^(?:" + "|".join(v.TERM_AFTER) + ")")
    return company | contains_any(pre, v.AGE_BEFORE) | term


def _ranges(t: Column) -> Column:
    def read(x: Column) -> Column:
        pre, post = before(t, x["start"], 40), after(t, x["end"], 45)
        low, high = _number(x["g"][0]), _number(x["g"][1])
        ok = (contains_any(pre, v.RANGE_BEFORE) | contains_any(post, v.RANGE_AFTER)) & ~_about_something_else(pre, x["m"], post) & (low <= high)
        months = _months(low, x["g"][2])
        return F.struct(F.when(ok & months.between(0, v.MAX_EXPERIENCE_MONTHS), months).alias("months"), _months(high, x["g"][2]).alias("top"), x["m"].alias("m"))

    return F.filter(F.transform(find_all(t, v.EXPERIENCE_RANGE, 3), read), lambda c: c["months"].isNotNull()).cast(_CANDIDATE)


def _simple(t: Column, pattern: str) -> Column:
    def read(x: Column) -> Column:
        pre = F.regexp_extract(before(t, x["start"], 45), r"([^.;:]*)$", 1)
        months = _months(_number(x["g"][0]), x["g"][1])
        ok = ~_about_something_else(pre, x["m"], after(t, x["end"], 35)) & months.between(0, v.MAX_EXPERIENCE_MONTHS)
        return F.struct(F.when(ok, months).alias("months"), F.lit(None).cast("int").alias("top"), x["m"].alias("m"))

    return F.filter(F.transform(find_all(t, pattern, 2), read), lambda c: c["months"].isNotNull()).cast(_CANDIDATE)


def _any_clear(t: Column, pattern: str, chars_before: int, chars_after: int, noise: tuple[str, ...]) -> Column:
    def clear(x: Column) -> Column:
        at = F.greatest(x["start"] - chars_before, F.lit(0))
        return ~contains_any(F.substring(t, at + 1, x["end"] + chars_after - at), noise)

    return F.exists(find_all(t, pattern), clear)


#: Characters kept on either side of a number with its unit: more than the widest pattern and what is looked at around it.
AROUND = 200


def near_spans(t: Column) -> Column:
    """The stretches of a text around its numbers with a unit, parted by ends of sentences; null if there is none.

    All quantified patterns match inside these stretches as they do in the whole text. Only a word beyond all measure could reach further; a text that
    holds one near a span is kept whole.
    """

    def joined(parts: Column) -> Column:
        last = F.size(parts) - 1

        def kept(part: Column, i: Column) -> Column:
            # Every other part is a span; the text before the first and after the last one is cut on one side.
            left, right = F.substring(part, 1, AROUND), F.substring(part, -AROUND, AROUND)
            between = F.when(F.length(part) <= 2 * AROUND, part).otherwise(F.concat(left, F.lit(" ; "), right))
            return F.when(i % 2 == 1, part).when(i == 0, F.when(F.length(part) > AROUND, F.concat(F.lit("; "), right)).otherwise(part)).when(i == last, left).otherwise(between)

        return bind(F.array_join(F.transform(parts, kept), ""), lambda x: F.when(x.rlike("[a-z]{80}"), F.array_join(parts, "")).otherwise(x))

    marked = F.split(F.regexp_replace(F.translate(t, MATCH, ""), v.SPAN_CORE, f"{MATCH}$0{MATCH}"), MATCH)
    return bind(marked, lambda parts: F.when(F.size(parts) > 1, joined(parts)))


def experience(normalized: Column) -> Column:
    """struct<months_min, months_max, evidence, kind>.

    The quantified patterns run over the surroundings of numbers with a unit only; texts without "experiencia" skip the patterns that contain it.
    """
    cut = bind(normalized, without_footer)
    return bind(F.replace(F.replace(cut, F.lit("anos"), F.lit("anios")), F.lit("ano "), F.lit("anio ")), _experience)


def _experience(t: Column) -> Column:
    none = F.array().cast(_CANDIDATE)

    def quantified(near: Column) -> Column:
        named = F.contains(near, F.lit("experiencia"))
        simple = F.concat(*(F.when(named, _simple(near, p)).otherwise(none) if "experiencia" in p else _simple(near, p) for p in v.EXPERIENCE_PATTERNS))
        some = lambda c, found: F.when(near.isNotNull() & c, found).otherwise(none)
        return F.struct(some(near.rlike(v.RANGE_END), _ranges(near)).alias("ranges"), some(near.rlike(v.SPAN), simple).alias("simple"))

    return bind(bind(near_spans(t), quantified), lambda c: _decided(t, c["ranges"], F.concat(c["ranges"], c["simple"])))


def _decided(t: Column, ranges: Column, found: Column) -> Column:
    least = F.array_min(F.transform(found, lambda c: c["months"]))
    best = F.get(F.filter(found, lambda c: c["months"] == least), 0)
    top = F.try_element_at(F.transform(ranges, lambda c: c["top"]), F.lit(-1))
    none = F.lit(None).cast("int")

    def result(low: Column, high: Column, evidence: Column, kind: Column | str) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(low.alias("months_min"), high.alias("months_max"), evidence.alias("evidence"), kind.alias("kind"))

    text_none = F.lit(None).cast("string")
    return (
        F.when(F.trim(t) == "", result(none, none, text_none, "NO_MENCIONADA"))
        .when(best.isNotNull(), result(best["months"], top, best["m"], F.when(best["months"] == 0, "NO_REQUERIDA").otherwise("CUANTIFICADA")))
        .when(contains_any(t, ("experiencia", "primer")) & _any_clear(t, v.NO_EXPERIENCE, 60, 40, v.NO_EXPERIENCE_NOISE), result(F.lit(0), none, F.lit("sin experiencia requerida"), "NO_REQUERIDA"))
        .when(F.contains(t, F.lit("experiencia")) & _any_clear(t, v.UNQUANTIFIED, 25, 35, v.CUSTOMER_EXPERIENCE), result(none, none, F.lit("requerida sin cuantificar"), "REQUERIDA_SIN_CUANTIFICAR"))
        .otherwise(result(none, none, text_none, "NO_MENCIONADA"))
    )


KINDS = ("CUANTIFICADA", "NO_REQUERIDA", "REQUERIDA_SIN_CUANTIFICAR", "NO_MENCIONADA")


def known_kind(kind: Column) -> Column:
    """A stored kind; one that isn't known, or none, counts as not mentioned."""
    return F.when(kind.isin(*KINDS), kind).otherwise("NO_MENCIONADA")


def experience_label(months: Column, kind: Column) -> Column:
    return bind(known_kind(kind), lambda k: _label(months, k))


def _label(months: Column, kind: Column) -> Column:
    years = F.floor(months / 12).cast("string")
    return (
        F.when((kind == "NO_REQUERIDA") | ((kind == "CUANTIFICADA") & (months == 0)), "Sin exp.")
        .when(kind == "REQUERIDA_SIN_CUANTIFICAR", "Exp. sin precisar")
        .when(kind != "CUANTIFICADA", "Exp. no indicada")
        .when(months.isNull(), "Exp. no indicada")
        .when(months < 12, F.concat(months.cast("string"), F.lit(" meses")))
        .when(months % 12 == 0, F.concat(years, F.lit("+ años")))
        .otherwise(F.concat(years, F.lit("."), F.floor(months % 12 * 10 / 12).cast("string"), F.lit("+ años")))
    )
