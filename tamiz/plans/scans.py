"""Where the scan of a query ends: pages of many scans at once, each (portal, query) in its own order of pages.

A scan stops before a page that isn't Ok (empty, blocked or failed) or never landed; a rule of its portal may stop it before a page that brings no id new to the
scan (``by_id``), after a page whose last readable date is too old (``max_days``) or after so many pages. What it returns are the cards before its end: by id the first of each, by date
without those that are readably too old. Pages are
the unit of all windows: cards meet only to tell which is the first of its id in the scan, by (scan, id), and to be summed by page, so a
long scan spreads over tasks; the end of a scan is found among its pages, one small row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions.dates import days_since
from tamiz.functions.vocabulary import MAX_DAYS

SCAN = ("portal", "query")


@dataclass(frozen=True)
class Rules:
    """How the scans of a portal end."""

    by_id: bool = False
    max_days: int | None = MAX_DAYS
    most_pages: int | None = None


def page_facts(pages: DataFrame, cards: DataFrame, as_of: Column) -> DataFrame:
    """Of each page of ``pages`` (portal, query, page, page_status): n_cards, n_new (ids not seen on an earlier page of the scan) and last_age, the last readable one."""
    first = F.row_number().over(Window.partitionBy(*SCAN, "job_id").orderBy("page", "item")) == 1
    read = cards.withColumns({"_first": first, "_age": days_since("fechaPublicacion", as_of)})
    last = F.max(F.when(F.col("_age").isNotNull(), F.struct("item", "_age")))["_age"]
    facts = read.groupBy(*SCAN, "page").agg(F.count(F.lit(1)).alias("n_cards"), F.count_if("_first").alias("n_new"), last.alias("last_age"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.select(*SCAN, "page", "page_status").join(facts, [*SCAN, "page"], "left").select(*SCAN, "page", "page_status", zero("n_cards"), zero("n_new"), "last_age")


def scan_ends(facts: DataFrame, rules: Rules) -> DataFrame:
    """The pages that a scan asks for, up to its end, with the ``reason`` why it ends on the last one; null if it goes on.

    A page that ends its scan brings nothing itself, unless its reason is ``antigua``: its last date is too old.
    """
    order = Window.partitionBy(*SCAN).orderBy("page")
    at = F.row_number().over(order) - 1
    never = F.lit(False)
    reason = (
        F.when(never if rules.most_pages is None else at >= rules.most_pages, "limite")
        .when(F.col("page") != F.first("page").over(order) + at, "falta")
        .when(F.col("page_status") != "Ok", F.lower("page_status"))
        .when((F.col("n_new") == 0) if rules.by_id else never, "repetida")
        .when(never if rules.max_days is None else F.col("last_age") > rules.max_days, "antigua")
    )
    rows = facts.withColumn("reason", reason)
    over = F.max(F.col("reason").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_over", F.coalesce(over, F.lit(False))).where("not _over").drop("_over")


def scanned(pages: DataFrame, cards: DataFrame, as_of: Column, rules: Rules = Rules()) -> DataFrame:
    """The cards that the scans return, in no order; ``page`` and ``item`` tell theirs."""
    ends = scan_ends(page_facts(pages, cards, as_of), rules)
    read = ends.where("reason is null or reason = 'antigua'").select(*SCAN, "page")
    if rules.by_id:
        first = F.row_number().over(Window.partitionBy(*SCAN, "job_id").orderBy("page", "item"))
        cards = cards.withColumn("_n", first).where("_n = 1").drop("_n")
    age = days_since("fechaPublicacion", as_of)
    return cards.join(read, [*SCAN, "page"]).where(F.lit(True) if rules.max_days is None else age.isNull() | (age <= rules.max_days))
