"""Ages of postings from dates in many spellings, relative to an explicit ``as_of`` (never the wall clock)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import vocabulary as v
from tamiz.functions.text import bind, contains_any, norm, text

DAY_MS = 86_400_000
#: Prefix of the text, and the format it is read with, in order of trial.
FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}(?:Z|[+-]\d{2}:\d{2})", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"^\d{2}-\d{2}-\d{4}", "dd-MM-yyyy"),
    (r"^\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"),
)
ACCEPTED_DAYS = (-2, 3650)


def relative_days(c: Column | str) -> Column:
    """Days from words such as "hace 2 semanas", on normalised text; null if there are none."""
    return bind(norm(c), _relative_days)


def _relative_days(t: Column) -> Column:
    n = F.regexp_extract(t, r"(\d+)", 1).try_cast("int").cast("bigint")
    out = F.when(contains_any(t, v.TODAY), F.lit(0)).when(contains_any(t, v.YESTERDAY), F.lit(1))
    for words, days in v.UNIT_DAYS:
        out = out.when(n.isNotNull() & contains_any(t, words), (n * days).try_cast("int"))
    return out


def _days(earlier: Column, later: Column, unit: int) -> Column:
    """Whole days between two times in parts of ``unit`` to the day, towards zero; null beyond 32 bits."""
    return F.call_function("div", later - earlier, F.lit(unit)).try_cast("int")


def days_since(c: Column | str, as_of: Column) -> Column:
    """Age in days: epoch milliseconds or seconds, relative words, then the formats; null if none fits, whatever the text."""
    return bind(F.trim(text(c)), lambda s: _days_since(s, as_of))


def _days_since(s: Column, as_of: Column) -> Column:
    now_ms = F.unix_millis(as_of)
    number = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))
    formatted = []
    for prefix, pattern in FORMATS:
        when = F.try_to_timestamp(F.nullif(F.regexp_extract(s, prefix, 0), F.lit("")), F.lit(pattern))
        days = _days(F.unix_millis(when), now_ms, DAY_MS)
        formatted.append(F.when(days.between(*ACCEPTED_DAYS), days))
    return (
        F.when(s == "", None)
        .when(number > 1_000_000_000_000, _days(number, now_ms, DAY_MS))
        .when(number > 1_000_000_000, _days(number, F.floor(now_ms / 1000), 86_400))
        .otherwise(F.coalesce(relative_days(s), *formatted))
    )


def epoch_of(c: Column | str, as_of: Column) -> Column:
    """Milliseconds of ``as_of`` less the age; 0 if the age is unknown."""
    return F.coalesce(F.unix_millis(as_of) - days_since(c, as_of).cast("bigint") * DAY_MS, F.lit(0).cast("bigint"))
