"""Rows as the store's flat form has them, with texts in place of lists, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import text
from tamiz.operators.experience import known_kind
from tamiz.operators.geo import known_zone
from tamiz.plans.pipeline import STORE_COLUMNS

#: Columns that are numbers, flags or may be missing; all others are texts, empty where they are missing.
_KINDS = {
    "fechaEpoch": "bigint", "matchScore": "int", "mesesExperiencia": "int", "salarioMin": "double", "salarioMax": "double", "nuevo": "boolean", "requiereIngles": "boolean",
    "trabajoEnCampamento": "boolean", "ingIndustrialExclusiva": "boolean", "salarioMoneda": "string", "nivelIngles": "string", "regimenTrabajo": "string",
}
#: What the columns hold where nothing is given.
_DEFAULTS = {"fechaEpoch": 0, "matchScore": 0, "nuevo": True, "requiereIngles": False, "trabajoEnCampamento": False, "ingIndustrialExclusiva": False}


def benefit_text(benefits: Column) -> Column:
    return F.array_join(F.coalesce(benefits, F.array().cast("array<string>")), "|")


def benefit_list(stored: Column) -> Column:
    """Without blank parts; nothing of a blank text."""
    return F.filter(F.split(text(stored), r"\|"), lambda x: F.trim(x) != "")


def to_stored(rows: DataFrame) -> DataFrame:
    """The store's columns in its order, with defaults for what is missing or null, benefits as one text, unknown zones and kinds of experience named so."""

    def column(name: str) -> Column:
        given = F.col(name) if name in rows.columns else F.lit(None)
        if name == "beneficios":
            return benefit_text(given.cast("array<string>"))
        if name == "zona":
            return known_zone(given.cast("string"))
        if name == "expTipo":
            return known_kind(given.cast("string"))
        if name == "estado":
            return F.coalesce(given.cast("string"), F.lit("pendiente"))
        value = given.cast(_KINDS.get(name, "string"))
        if name in _DEFAULTS:
            return F.coalesce(value, F.lit(_DEFAULTS[name]).cast(_KINDS[name]))
        return value if name in _KINDS else text(value)

    return rows.select(*(column(c).alias(c) for c in STORE_COLUMNS))


def to_offer(stored: DataFrame) -> DataFrame:
    """The stored columns but ``estado``, with benefits as a list."""
    return stored.withColumn("beneficios", benefit_list(F.col("beneficios"))).drop("estado")
