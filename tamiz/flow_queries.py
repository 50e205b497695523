"""Queries of what moves postings: the bucketed store and its views, scans by portal and query, landed pages, odd inputs; with their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz import oracles
from tamiz.functions import dates
from tamiz.functions.text import norm
from tamiz.operators import geo
from tamiz.plans import pipeline, scans
from tamiz.plans.bucket_store import BucketStore
from tamiz.plans.live_views import LiveViews
from tamiz.plans.shared import shared_folder
from tamiz.queries import AS_OF_MS, _as_of, _html_pages
from tamiz.sources import html_pages, landed
from tamiz.sources.offers import offers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# The store: all postings of two portals, then those of two portals again and twice, then the purge.


def _incoming(spark, sf_dir):
    rows, k = pipeline.dedupe(offers(spark, sf_dir)), F.col("doc_id")
    return rows.select(
        "doc_id", F.col("clean_url").alias("url"), "portal", "descripcion", geo.zone(geo.split_location("ubicacion")).alias("zona"),
        F.when(k % 9 == 0, 0).otherwise(AS_OF_MS - (k % 90) * 86_400_000).cast("long").alias("fechaEpoch"), (k * 37 % 101).cast("int").alias("matchScore"),
        F.when(k % 6 == 0, "14x7").alias("regimenTrabajo"), (k % 8 == 0).alias("trabajoEnCampamento"),
    )


def _filled(spark, sf_dir, after: Callable[[BucketStore], None] = lambda _: None) -> BucketStore:
    rows = _incoming(spark, sf_dir)
    store = BucketStore(spark, shared_folder(spark, "store"), buckets=16)
    store.merge(rows.where("portal != 'portal_c'"))
    after(store)
    new = rows.where("portal != 'portal_a'")
    again = new.withColumn("arrival", F.lit(1)).unionByName(new.withColumn("arrival", F.lit(2)))
    store.merge(again.withColumn("matchScore", F.col("matchScore") + F.col("arrival")), order="arrival")
    after(store)
    store.purge(AS_OF_MS)
    after(store)
    return store


@query
def bucket_merge(spark, sf_dir):
    return _filled(spark, sf_dir).read().select("url", "portal", "nuevo", "estado", "matchScore", "doc_id")


@query
def store_changes(spark, sf_dir):
    rows = _filled(spark, sf_dir).changes(0)
    return rows.select("url", F.col("old.matchScore").alias("old_score"), F.col("new.matchScore").alias("new_score"))


@query
def cleared_store(spark, sf_dir):
    """How many rows a store holds before it is cleared, after it, and in the version before."""
    rows = _incoming(spark, sf_dir)
    store = BucketStore(spark, shared_folder(spark, "store"), buckets=16)
    store.merge(rows)
    store.clear()
    counts = (store.read(v).agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(v)) for v in store.versions())
    return functools.reduce(DataFrame.unionByName, counts)


def _views(spark, sf_dir) -> LiveViews:
    """Brought up to date after each change of the store."""
    made: list[LiveViews] = []

    def refresh(store: BucketStore) -> None:
        if not made:
            made.append(LiveViews(store, shared_folder(spark, "views"), shown=50, reserve=150))
        made[0].refresh()

    _filled(spark, sf_dir, refresh)
    return made[0]


@query
def live_counts(spark, sf_dir):
    return _views(spark, sf_dir).counts()


@query
def live_best(spark, sf_dir):
    """The feature is the first fifty of the live list."""
    return _views(spark, sf_dir).best()


# Scans: the cards of each portal and title, a hundred postings a page; pages that are missing, blocked or empty.


def _scans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows, k = offers(spark, sf_dir), F.col("doc_id")
    page = F.floor(k / 100).cast("int")
    mark = page * 7 + F.length("puesto")
    status = F.when(mark % 23 == 3, "Blocked").when(mark % 23 == 5, "Error").when(mark % 23 == 7, "Empty").otherwise("Ok")
    cards = rows.select("portal", F.col("puesto").alias("query"), page.alias("page"), k.cast("int").alias("item"), F.concat(F.lit("j"), (F.floor(k / 33) % 40).cast("string")).alias("job_id"), "fechaPublicacion", status.alias("page_status"))
    cards = cards.where((F.col("page") + F.length("query")) % 29 != 11)
    return cards.select("portal", "query", "page", "page_status").distinct(), cards.where("page_status = 'Ok'").drop("page_status")


_BY_DATE, _BY_ID = scans.Rules(), scans.Rules(by_id=True, max_days=None, most_pages=20)


@query
def scan_cards(spark, sf_dir):
    return scans.scanned(*_scans(spark, sf_dir), _as_of(), _BY_DATE).select("portal", "query", "page", "item", "job_id")


@query
def scan_cards_by_id(spark, sf_dir):
    return scans.scanned(*_scans(spark, sf_dir), _as_of(), _BY_ID).select("portal", "query", "page", "item", "job_id")


@query
def scan_reasons(spark, sf_dir):
    facts = scans.page_facts(*_scans(spark, sf_dir), _as_of())
    named = lambda name, rules: scans.scan_ends(facts, rules).withColumn("rules", F.lit(name))
    return named("date", _BY_DATE).unionByName(named("id", _BY_ID)).select("rules", "portal", "query", "page", "n_cards", "n_new", "last_age", "reason")


@query
def landed_recent(spark, sf_dir):
    """Pages of titles, landed as files; those of two portals that are recent or of unknown age, by what their folders are named."""
    rows = offers(spark, sf_dir).select("doc_id", "puesto", "portal", F.concat(F.lit("q/"), "modalidad").alias("query"), F.floor(F.col("doc_id") / 500).cast("int").alias("page"))
    page = F.col("page")
    code = F.when(page % 7 == 6, 429).otherwise(200)
    newest = F.when(page % 5 != 4, F.date_sub(F.lit("2026-07-20").cast("date"), page * 9 % 50))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "puesto"))), lambda x: x["puesto"]), "\n")
    pages = rows.groupBy("portal", "query", "page").agg(body.alias("body")).withColumns({"http_status": code, "newest": newest})
    folder = shared_folder(spark, "landed")
    landed.land(pages, folder)
    return landed.recent(landed.landed(spark, folder).where("portal != 'portal_b' and http_status = 200"), F.lit("2026-07-20").cast("date"), 30)


@query
def gazetteer_centers(spark, sf_dir):
    """Places with the district that their text names, the districts taken from a table."""
    rows = offers(spark, sf_dir).select("doc_id", norm("ubicacion").alias("place"))
    return geo.centers(rows, "place", geo.gazetteer(spark)).select("doc_id", F.col("center.name").alias("name"), F.col("center.lat").alias("lat"))


@query
def part_words(spark, sf_dir):
    """The longest word of any part's name or type that a part's text contains, also inside others."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    words = part.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("name")).distinct()
    names = words.select("name", F.length("name").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    return geo.centers(part.select("p_partkey", text.alias("place")), "place", names).select("p_partkey", F.col("center.name").alias("name"), F.col("center.lat").alias("size"))


# Odd inputs.


@query
def age_of_odd_dates(spark, sf_dir):
    """Numbers that are too long, too large once multiplied, or beyond the range of a clock."""
    k = F.col("doc_id")
    spoken = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    odd = (
        F.when(k % 6 == 0, spoken("Ref ", k * 30_011, " verano, una semana"))
        .when(k % 6 == 1, spoken("hace ", k * 1_000_003, " anos"))
        .when(k % 6 == 2, (F.lit(1_500_000_000) + k * 86_413).cast("string"))
        .when(k % 6 == 3, (F.lit(1_500_000_000_000) + k * 864_130_007).cast("string"))
        .when(k % 6 == 4, spoken(k, "99999999999999999999"))
        .otherwise(spoken("9", k * 1_000_000_007 + 9_000_000_000_000_000))
    )
    rows = offers(spark, sf_dir).select("doc_id", odd.alias("spoken"))
    return rows.select("doc_id", dates.days_since("spoken", _as_of()).alias("days"), dates.epoch_of("spoken", _as_of()).alias("epoch"))


@query
def html_listing_unclosed(spark, sf_dir):
    """The listing of pages whose paragraphs, and on every third page whose cards, were left open."""
    pages = _html_pages(spark, sf_dir).withColumn("body", F.regexp_replace("body", "</p>", ""))
    pages = pages.withColumn("body", F.when(F.col("page") % 3 == 0, F.regexp_replace("body", "</article>", "")).otherwise(F.col("body")))
    rows = html_pages.listing(pages, "portal_b", "https://jobs.example.com")
    return rows.select("page", "item", "page_status", "puesto", "url", "empresa", "ubicacion", "distrito", "salario", "area", "fechaPublicacion", "job_id")


def _sql() -> dict[str, str]:
    ms, day = oracles.MS, oracles.DAY
    stored = f"""{oracles.DEDUPED}, s AS (SELECT clean_url AS url, portal, {oracles.ZONE} AS zona, doc_id, CAST(CASE WHEN doc_id % 9 = 0 THEN 0 ELSE {ms} - (doc_id % 90) * {day} END AS BIGINT) AS epoch,
        CAST(doc_id * 37 % 101 AS INTEGER) AS score, doc_id % 6 = 0 OR doc_id % 8 = 0 AS odd FROM u o),
      r AS (SELECT *, CAST(score + CASE WHEN portal <> 'portal_a' THEN 2 ELSE 0 END AS INTEGER) AS "matchScore" FROM s WHERE epoch = 0 OR epoch >= {ms - 30 * day})"""
    counts = " UNION ALL ".join(f"SELECT '{view}' AS view, {key} AS key, count(*) AS n FROM r GROUP BY 2" for view, key in (("zona", "zona"), ("portal", "portal"), ("tab", "CASE WHEN odd THEN 'atipico' ELSE 'estandar' END"), ("estado", "'pendiente'")))
    scan = f"""{oracles.O}, c AS (SELECT portal, puesto AS query, CAST(floor(doc_id / 100) AS INTEGER) AS page, CAST(doc_id AS INTEGER) AS item, 'j' || (CAST(floor(doc_id / 33) AS BIGINT) % 40) AS job_id, {oracles.AGE} AS age,
        (CAST(floor(doc_id / 100) AS INTEGER) * 7 + length(puesto)) % 23 AS mark FROM o WHERE (CAST(floor(doc_id / 100) AS INTEGER) + length(puesto)) % 29 <> 11),
      g AS (SELECT *, row_number() OVER (PARTITION BY portal, query, job_id ORDER BY page, item) AS nth FROM c WHERE mark NOT IN (3, 5, 7)),
      f AS (SELECT portal, query, page, any_value(CASE mark WHEN 3 THEN 'blocked' WHEN 5 THEN 'error' WHEN 7 THEN 'empty' END) AS bad FROM c GROUP BY ALL),
      n AS (SELECT portal, query, page, count(*) AS n_cards, count(*) FILTER (WHERE nth = 1) AS n_new, max_by(age, item) FILTER (WHERE age IS NOT NULL) AS last_age FROM g GROUP BY ALL),
      h AS (SELECT f.*, coalesce(n_cards, 0) AS n_cards, coalesce(n_new, 0) AS n_new, last_age, row_number() OVER w - 1 AS place, min(f.page) OVER (PARTITION BY f.portal, f.query) AS begun FROM f LEFT JOIN n USING (portal, query, page) WINDOW w AS (PARTITION BY f.portal, f.query ORDER BY f.page)),
      q AS (SELECT 'date' AS rules, *, CASE WHEN page <> begun + place THEN 'falta' WHEN bad IS NOT NULL THEN bad WHEN last_age > 30 THEN 'antigua' END AS reason FROM h
        UNION ALL SELECT 'id', *, CASE WHEN place >= 20 THEN 'limite' WHEN page <> begun + place THEN 'falta' WHEN bad IS NOT NULL THEN bad WHEN n_new = 0 THEN 'repetida' END FROM h),
      e AS (SELECT * FROM (SELECT *, count(reason) OVER (PARTITION BY rules, portal, query ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM q) WHERE over = 0)"""
    read = "JOIN e USING (portal, query, page) WHERE (e.reason IS NULL OR e.reason = 'antigua')"
    odd = 'CASE WHEN doc_id % 6 = 0 AND doc_id * 30011 < 2147483648 THEN doc_id * 30011 * 7 WHEN doc_id % 6 = 1 AND doc_id * 1000003 < 2147483648 THEN doc_id * 1000003 * 365'
    odd += f" WHEN doc_id % 6 = 2 THEN trunc(({ms // 1000} - 1500000000 - doc_id * 86413) / 86400.0)::BIGINT WHEN doc_id % 6 = 3 THEN trunc(({ms} - 1500000000000 - doc_id * 864130007) / 86400000.0)::BIGINT"
    odd += f" WHEN doc_id % 6 = 5 THEN -((CAST('9' || CAST(doc_id * 1000000007 + 9000000000000000 AS VARCHAR) AS BIGINT) - {ms}) // {day}) END"
    return {
        "bucket_merge": f"""{stored} SELECT url, portal, portal <> 'portal_b' AS nuevo, 'pendiente' AS estado, "matchScore", doc_id FROM r""",
        "cleared_store": f"{stored} SELECT count(*) AS n, 0::INTEGER AS version FROM s UNION ALL SELECT 0, 1",
        "store_changes": f"""{stored} SELECT url, CASE WHEN portal <> 'portal_c' THEN score END AS old_score, r."matchScore" AS new_score FROM s LEFT JOIN (SELECT url, "matchScore" FROM r) r USING (url) WHERE portal = 'portal_b' OR (portal = 'portal_a' AND r.url IS NULL) OR (portal = 'portal_c' AND r.url IS NOT NULL)""",
        "live_counts": f"{stored} {counts}",
        "live_best": f"""{stored} SELECT url, "matchScore" FROM r ORDER BY 2 DESC, 1 LIMIT 50""",
        "scan_cards": f"{scan} SELECT portal, query, page, item, job_id FROM g {read} AND rules = 'date' AND (age IS NULL OR age <= 30)",
        "scan_cards_by_id": f"{scan} SELECT portal, query, page, item, job_id FROM g {read} AND rules = 'id' AND nth = 1",
        "scan_reasons": f"{scan} SELECT rules, portal, query, page, n_cards, n_new, last_age, reason FROM e",
        "landed_recent": f"""{oracles.O}, p AS (SELECT portal, 'q/' || modalidad AS query, CAST(floor(doc_id / 500) AS INTEGER) AS page, string_agg(puesto, chr(10) ORDER BY doc_id) AS body FROM o GROUP BY ALL)
            SELECT portal, query, page, CAST(200 AS INTEGER) AS http_status, CASE WHEN page % 5 <> 4 THEN DATE '2026-07-20' - page * 9 % 50 END AS newest, body FROM p WHERE portal <> 'portal_b' AND page % 7 <> 6 AND (page % 5 = 4 OR page * 9 % 50 <= 30)""",
        "gazetteer_centers": oracles.sql()["district_center"],
        "part_words": """WITH t AS (SELECT p_partkey, lower(concat_ws(' ', p_name, p_type, p_brand)) AS place FROM part), w AS (SELECT DISTINCT unnest(string_split(lower(concat_ws(' ', p_name, p_type)), ' ')) AS name FROM part)
            SELECT p_partkey, arg_min(name, (-length(name), name)) AS name, CAST(max(length(name)) AS DOUBLE) AS size FROM t JOIN w ON contains(place, name) GROUP BY p_partkey""",
        "age_of_odd_dates": f"{oracles.O}, a AS (SELECT doc_id, {odd} AS n FROM o), b AS (SELECT doc_id, CASE WHEN n BETWEEN -2147483648 AND 2147483647 THEN n::INTEGER END AS days FROM a) SELECT doc_id, days, coalesce({ms} - CAST(days AS BIGINT) * {day}, 0) AS epoch FROM b",
        "html_listing_unclosed": oracles.sql()["html_listing"],
    }


ORACLES = _sql()
