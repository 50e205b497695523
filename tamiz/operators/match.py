"""Score of a posting against the profile, 0 to 100, and the reasons for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import vocabulary as v
from tamiz.functions.text import bind, holds_any, text


def _rules(t: Column, rules, cap: int) -> Column:
    """struct<points, labels>: capped points, and the labels that hold, most points first. Each text is searched for a word once."""
    hits = [F.when(holds_any(t, words), F.struct(F.lit(-points).alias("p"), F.lit(i).alias("i"), F.lit(label).alias("label"))) for i, (points, label, words) in enumerate(rules)]

    def read(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0), lambda n, h: n - h["p"])
        return F.struct(F.least(total, F.lit(cap)).alias("points"), F.transform(F.array_sort(found), lambda h: h["label"]).alias("labels"))

    return bind(F.filter(F.array(*hits), lambda h: h.isNotNull()), read)


def match(t: Column, offer: dict[str, Column]) -> Column:
    """struct<score, reasons> from normalised text and the columns seniority, months, kind, mode, industrial_only, english_level, zone, shift, camp.

    The text is computed once for all rules; each of them would normalise it anew.
    """
    return bind(t, lambda t: _known(t, offer))


def _known(t: Column, offer: dict[str, Column]) -> Column:
    patterns = {"asked": v.ASKS_CAREER, "high_english": v.HIGH_ENGLISH, "licensed": v.LICENSED, "driving": v.DRIVING}
    known = F.struct(*(c.alias(k) for k, c in offer.items()), *(t.rlike(p).alias(k) for k, p in patterns.items()), _rules(t, v.TOOLS, v.TOOLS_CAP).alias("tools"), _lanes(t).alias("lanes"))
    return bind(known, _match)


def _lane(i: int, name: str) -> Callable[[Column], Column]:
    return lambda r: F.struct((-r["points"]).alias("p"), F.lit(i).alias("i"), F.lit(name).alias("name"), r["labels"].alias("labels"))


def _lanes(t: Column) -> Column:
    """The lanes with their points (negative) and labels, best first."""
    lanes = []
    for i, (name, cap, rules) in enumerate(v.LANES):
        lanes.append(bind(_rules(t, rules, cap), _lane(i, name)))
    return F.array_sort(F.array(*lanes))


def _match(offer: Column) -> Column:
    """From a struct of what is known of a posting and of its text."""
    tools, tool_labels, lanes = offer["tools"]["points"], offer["tools"]["labels"], offer["lanes"]
    best, second = -lanes[0]["p"], -lanes[1]["p"]
    domain = F.least(best + F.floor(second * 0.33).cast("int"), F.lit(v.DOMAIN_CAP))

    level, months = offer["seniority"], offer["months"]
    fit = F.when(level.isin("Junior", "Semi Senior"), 8).when(level == v.NO_SENIORITY, 6).when(level == "Practicante", 3).otherwise(0)
    fit = fit + F.when(offer["kind"] == "NO_REQUERIDA", 10).when(months.isNull(), 4).when(months <= 12, 10).when(months <= 24, 5).otherwise(0)
    fit = F.least(fit + F.when(offer["mode"].isin("Remoto", "Hibrido"), 4).otherwise(2), F.lit(v.FIT_CAP))

    asked = offer["asked"]
    career = F.when(asked, 8).otherwise(0) + F.when(offer["industrial_only"], 4).otherwise(0)
    penalties = (
        (10, "Inglés avanzado", F.lower(text(offer["english_level"])).contains("avanzado") | offer["high_english"]),
        (8, "Pide colegiatura/título", offer["licensed"]),
        (4, "Pide brevete", offer["driving"]),
        (8, "Fuera de Lima", offer["zone"] == "OTRO_DEPARTAMENTO"),
        (4, "Provincia de Lima", offer["zone"] == "LIMA_PROVINCIAS"),
        (6, "Régimen atípico", offer["camp"] | offer["shift"].isNotNull()),
    )
    less = F.lit(0)
    for points, _, when in penalties:
        less = less + F.when(when, points).otherwise(0)
    score = F.least(F.greatest(tools + domain + fit + career - less, F.lit(0)), F.lit(100))

    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    lane = F.when(best > 0, F.concat(F.array(lanes[0]["name"]), F.slice(lanes[0]["labels"], 1, 2))).otherwise(F.array().cast("array<string>"))
    extra = some(F.array(F.when(months <= 24, "Pide ≤ 2 años"), F.when(asked, "Pide Ing. Industrial"), F.when(offer["industrial_only"], "Exclusiva Ing. Industrial")))
    alerts = some(F.array(*(F.when(when, f"⚠ {label}") for _, label, when in penalties)))
    reasons = F.slice(F.array_distinct(F.concat(F.slice(tool_labels, 1, 2), lane, extra)), 1, 4)
    return F.struct(score.cast("int").alias("score"), F.slice(F.concat(reasons, alerts), 1, 6).alias("reasons"))
