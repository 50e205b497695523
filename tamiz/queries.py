"""The registered queries of the engine, each over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import dates
from tamiz.functions import text as tx
from tamiz.operators import experience, extract, geo, requirements
from tamiz.plans import pipeline, store, views
from tamiz.sources import html_pages, json_pages
from tamiz.sources.offers import AS_OF, offers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AS_OF_MS = 1784548800000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _as_of():
    return pipeline.as_of_column(AS_OF)


def _simple(query_name: str, /, **columns) -> None:
    """Registers a projection of the postings by doc_id."""
    QUERIES[query_name] = lambda spark, sf_dir: offers(spark, sf_dir).select("doc_id", *(f().alias(c) for c, f in columns.items()))


_D = "descripcion"
_simple("text_norm", norm_text=lambda: tx.norm(F.concat("puesto", F.lit(" "), F.col(_D))))
_simple("company_key", company_key=lambda: tx.company_key("empresa"), raw_key=lambda: tx.company_key(F.concat(F.lit("Inversiones "), F.col("empresa"), F.lit(" S.A.C."))))
_simple("location_key", location_key=lambda: tx.location_key("ubicacion"))
_simple("title_case", title=lambda: tx.title_case("puesto"))
_simple("days_since", days=lambda: dates.days_since("fechaPublicacion", _as_of()), epoch=lambda: dates.epoch_of("fechaPublicacion", _as_of()))
_simple("salary", salary_min=lambda: extract.salary(_D)["min"], salary_max=lambda: extract.salary(_D)["max"], currency=lambda: extract.salary(_D)["currency"])
_simple("education", education=lambda: extract.education(_D))
_simple("english", required=lambda: extract.english(_D)["required"], level=lambda: extract.english(_D)["level"])
_simple("exclusivity", only_industrial=lambda: extract.industrial_only("puesto", _D))
_simple("benefits", benefits=lambda: F.array_join(extract.benefits(_D), "|"))
_simple("area", area_label=lambda: extract.area("puesto", _D, "area"))
_simple("work_mode", mode=lambda: extract.work_mode(F.col("modalidad"), tx.norm(_D)))
_simple("location_parts", district=lambda: geo.split_location("ubicacion")["district"], department=lambda: geo.split_location("ubicacion")["department"], shown=lambda: geo.shown_district("ubicacion"))
_simple("work_regime", shift=lambda: extract.work_shift(_D)["shift"], camp=lambda: extract.work_shift(_D)["camp"])
_simple("shift_label", kind=lambda: extract.shift_kind(extract.work_shift(_D)["shift"], extract.work_shift(_D)["camp"], F.col(_D)))
_simple("shift_text", shown=lambda: extract.shift_text(extract.work_shift(_D)["shift"], extract.work_shift(_D)["camp"], F.col(_D)))
_simple("career_gate", career=lambda: extract.names_career(tx.norm(F.concat("puesto", F.lit(" "), F.col(_D)))))
_simple("district_center", name=lambda: geo.district_center(tx.norm("ubicacion"))["name"], lat=lambda: geo.district_center(tx.norm("ubicacion"))["lat"])


@query
def salary_label(spark, sf_dir):
    rows = offers(spark, sf_dir).select("doc_id", "salario", extract.salary(_D).alias("s"))
    return rows.select("doc_id", tx.amount_label(F.col("s.min"), F.col("s.max"), F.col("s.currency"), F.col("salario")).alias("label"))


@query
def job_ids(spark, sf_dir):
    key = F.lpad(F.col("doc_id").cast("string"), 8, "7")
    link = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://x.example/s?currentJobId="), key, F.lit("&q=1"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("https://x.example/jobs/view/"), key)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("https://x.example/analyst-"), key, F.lit("?r=2"))).otherwise(F.lit("https://x.example/"))
    return offers(spark, sf_dir).select("doc_id", html_pages.job_id(link).alias("job_id"))


@query
def stated_modes(spark, sf_dir):
    title = F.concat("puesto", F.lit(" "), F.col("modalidad"))
    return offers(spark, sf_dir).groupBy(html_pages.stated_mode(title, F.col("ubicacion")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query
def detail_texts(spark, sf_dir):
    return html_pages.detail_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy("url").agg(F.min("html").alias("html")), html_pages.ANY_BLOCK)


@query
def url_dedupe(spark, sf_dir):
    return pipeline.dedupe(offers(spark, sf_dir)).select("doc_id", "clean_url")


@query
def portal_counts(spark, sf_dir):
    return pipeline.dedupe(offers(spark, sf_dir)).groupBy("portal").agg(F.count(F.lit(1)).alias("n"))


@query
def distinct_portals(spark, sf_dir):
    return offers(spark, sf_dir).select("portal").distinct().orderBy("portal")


@query
def seniority_hist(spark, sf_dir):
    return offers(spark, sf_dir).groupBy(extract.seniority("puesto").alias("seniority")).agg(F.count(F.lit(1)).alias("n"))


@query
def prefilter_reasons(spark, sf_dir):
    return pipeline.prefilter(pipeline.dedupe(offers(spark, sf_dir)), AS_OF).select("doc_id", "motivo")


@query
def zone_counts(spark, sf_dir):
    return offers(spark, sf_dir).groupBy(geo.zone(geo.split_location("ubicacion")).alias("zona")).agg(F.count(F.lit(1)).alias("n"))


@query
def facet_filter(spark, sf_dir):
    rows = offers(spark, sf_dir).withColumn("zona", geo.zone(geo.split_location("ubicacion")))
    return views.facet_filter(rows, zones=("LIMA_METROPOLITANA", "CALLAO"), modes=("Remoto", "Híbrido")).select("doc_id", "zona", "modalidad")


@query
def experience_read(spark, sf_dir):
    rows = offers(spark, sf_dir).select("doc_id", experience.experience(tx.norm(F.concat("puesto", F.lit(" "), F.col(_D)))).alias("e"))
    return rows.select("doc_id", "e.months_min", "e.months_max", "e.evidence", "e.kind", experience.experience_label(F.col("e.months_min"), F.col("e.kind")).alias("label"))


@query
def requirements_top6(spark, sf_dir):
    rows = offers(spark, sf_dir).select("doc_id", requirements.requirements("puesto", _D).alias("r"))
    return rows.select("doc_id", F.array_join(requirements.labels(F.col("r"), 6), "; ").alias("top"), F.size("r").alias("n"))


def _skill_counts(rows):
    skills = rows.select(F.explode(requirements.requirements("puesto", _D)).alias("r"))
    return skills.groupBy(F.col("r.name").alias("skill")).agg(F.count(F.lit(1)).alias("n"))


@query
def skill_counts(spark, sf_dir):
    # The four skills of its SQL; all_skill_counts has the whole catalogue.
    return _skill_counts(offers(spark, sf_dir)).where(F.col("skill").isin("Excel", "Power BI", "Python", "KPIs"))


@query
def all_skill_counts(spark, sf_dir):
    return _skill_counts(offers(spark, sf_dir))


def _accepted(spark, sf_dir):
    return pipeline.refresh(offers(spark, sf_dir), AS_OF)


@query
def ranked_offers(spark, sf_dir):
    rows = pipeline.ranked(_accepted(spark, sf_dir)[0])
    return rows.select("url", "puesto", "zona", "seniority", "mesesExperiencia", "expTipo", "requisitos", "matchScore", F.array_join("razones", " · ").alias("razones"))


@query
def match_score(spark, sf_dir):
    return _accepted(spark, sf_dir)[0].groupBy("matchScore").agg(F.count(F.lit(1)).alias("n"))


@query
def reject_reasons(spark, sf_dir):
    rows = _accepted(spark, sf_dir)[1]
    return rows.groupBy(F.regexp_replace("motivo", "[0-9]+ (dias|meses).*", "N $1").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def run_totals(spark, sf_dir):
    accepted, rejected = _accepted(spark, sf_dir)
    both = accepted.select(F.lit(True).alias("ok")).unionByName(rejected.select(F.lit(False).alias("ok")))
    return both.agg(F.count_if("ok").alias("active"), F.count_if(~F.col("ok")).alias("discarded"))


@query
def csv_rows(spark, sf_dir):
    rows = _accepted(spark, sf_dir)[0]
    return views.csv_lines(rows)


@query
def card_rows(spark, sf_dir):
    rows = _accepted(spark, sf_dir)[0].withColumns({"nuevo": F.lit(True), "estado": F.lit("pendiente")})
    return views.cards(rows).withColumn("tags", F.array_join("tags", "|"))


# A store with given states, ages and scores, by key.


def _stored(spark, sf_dir):
    rows = pipeline.dedupe(offers(spark, sf_dir))
    k = F.col("doc_id")
    return rows.select(
        "doc_id", F.col("clean_url").alias("url"), "portal", _D, F.when(k % 5 == 0, "descartada").when(k % 5 == 1, "postulada").otherwise("pendiente").alias("estado"),
        F.when(k % 9 == 0, 0).otherwise(AS_OF_MS - (k % 90) * 86_400_000).cast("long").alias("fechaEpoch"), (k * 37 % 101).cast("int").alias("matchScore"),
        F.when(k % 4 != 0, k * 7 % 60).cast("int").alias("mesesExperiencia"), F.when(k % 6 == 0, "14x7").alias("regimenTrabajo"), (k % 8 == 0).alias("trabajoEnCampamento"),
    )


@query
def live_list(spark, sf_dir):
    return store.live(_stored(spark, sf_dir)).select("url", "matchScore")


@query
def discarded_count(spark, sf_dir):
    return _stored(spark, sf_dir).where("estado = 'descartada'").agg(F.count(F.lit(1)).alias("n"))


@query
def restored_states(spark, sf_dir):
    return store.restore_discarded(_stored(spark, sf_dir)).groupBy("estado").agg(F.count(F.lit(1)).alias("n"))


@query
def stored_states(spark, sf_dir):
    return store.states(_stored(spark, sf_dir))


@query
def purge_old(spark, sf_dir):
    return store.purge(_stored(spark, sf_dir), AS_OF_MS).select("url")


@query
def cached_descriptions(spark, sf_dir):
    return store.descriptions(_stored(spark, sf_dir))


@query
def stored_count(spark, sf_dir):
    return _stored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query
def new_offers(spark, sf_dir):
    """All postings come in; those of two portals are stored already."""
    rows = _stored(spark, sf_dir)
    return store.keep_state(rows, rows.where("portal != 'portal_c'")).select("url", "nuevo", "estado")


@query
def upsert_merge(spark, sf_dir):
    """Postings of portal_b are stored and come in again, twice; those of portal_a are stored only, those of portal_c new."""
    rows = _stored(spark, sf_dir).select("url", "estado", "matchScore", "doc_id", "portal")
    old, new = rows.where("portal != 'portal_c'"), rows.where("portal != 'portal_a'")
    again = new.withColumn("arrival", F.lit(1)).unionByName(new.withColumn("arrival", F.lit(2)))
    again = again.withColumn("matchScore", F.col("matchScore") + F.col("arrival"))
    return store.upsert(old, store.keep_state(again, old).select(*old.columns, "arrival"), order="arrival")


@query
def sort_recent(spark, sf_dir):
    return views.ordered(_stored(spark, sf_dir), "recent").select("url", "fechaEpoch", "matchScore")


@query
def sort_least_experience(spark, sf_dir):
    return views.ordered(_stored(spark, sf_dir), "experience").select("url", "mesesExperiencia", "matchScore")


@query
def tab_counts(spark, sf_dir):
    return views.with_tab(_stored(spark, sf_dir)).groupBy("tab").agg(F.count(F.lit(1)).alias("n"))


# Sources: pages of JSON and HTML made from the postings.


def _json_pages(spark, sf_dir):
    rows = offers(spark, sf_dir)
    item = F.struct(
        F.col("doc_id").alias("id"), F.col("puesto").alias("titulo"), F.struct(F.col("empresa").alias("nombre")).alias("empresa"), (F.col("doc_id") % 13 == 0).alias("confidencial"),
        F.struct(F.get(F.split("ubicacion", ", "), 0).alias("nombre"), F.get(F.split("ubicacion", ", "), 1).alias("nombreSuperior")).alias("localizacion"), F.col("modalidad").alias("modalidadTrabajo"),
        F.when(F.col("doc_id") % 3 == 1, 1500).otherwise(0).alias("salarioMinimo"), F.lit(2500).alias("salarioMaximo"), F.col("fechaPublicacion"), F.col(_D).alias("detalle"), (F.col("doc_id") % 2).cast("string").alias("idArea"),
    )
    content = F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("k"), item.alias("v"))))
    facets = F.array(F.struct(F.lit("area").alias("type"), F.array(F.struct(F.lit("0").alias("id"), F.lit("Operaciones").alias("name")), F.struct(F.lit("1").alias("id"), F.lit("Ventas").alias("name"))).alias("facets")))
    return rows.groupBy("page").agg(content.alias("c")).select("page", F.to_json(F.struct(F.transform("c", lambda x: x["v"]).alias("content"), facets.alias("filters"))).alias("body"))


@query
def json_items(spark, sf_dir):
    rows = json_pages.postings(_json_pages(spark, sf_dir), "portal_a", "https://jobs.example.com/o")
    return rows.select("page", "item", "puesto", "empresa", "ubicacion", "modalidad", "salario", "area", "fechaPublicacion")


@query
def page_cutoff(spark, sf_dir):
    return json_pages.before_cutoff(offers(spark, sf_dir), _as_of()).select("doc_id", "portal", "page")


@query
def html_pages_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", html_pages.flat_text("html").alias("plain"))


def _html_pages(spark, sf_dir):
    """A page of cards for each page of postings; some are blocked, some fail, and one in ten has no cards: a long notice or nothing."""
    rows = offers(spark, sf_dir)
    link = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit('href="/o/x-'), F.lpad(F.col("doc_id").cast("string"), 9, "1"), F.lit('"')))
    card = F.format_string(
        '<article class="card" data-entity-urn="urn:li:posting:%s"><h2><a %s>%s Vista</a></h2><p class="f"><a href="/empresas/e">%s</a></p><p><span>%s</span></p><div><span title="Salario"></span>%s</div><p><span class="tag">%s</span></p><time datetime="%s"></time></article>',
        F.lpad(F.col("doc_id").cast("string"), 9, "1"), link, "puesto", "empresa", "ubicacion", "salario", "area", "fechaPublicacion",
    )
    listed = F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", card.alias("c")))), lambda x: x["c"]), "\n"), F.lit("</body></html>"))
    code = F.when(F.col("page") % 10 == 3, 429).when(F.col("page") % 10 == 5, 500).otherwise(200)
    pages = rows.groupBy("page").agg(listed.alias("body")).withColumn("http_status", code)
    return pages.withColumn("body", F.when(F.col("page") % 20 == 7, F.repeat(F.lit("Inicie sesión. "), 200)).when(F.col("page") % 20 == 17, "").otherwise(F.col("body")))


@query
def html_page_status(spark, sf_dir):
    return html_pages.page_statuses(_html_pages(spark, sf_dir))


@query
def html_listing(spark, sf_dir):
    rows = html_pages.listing(_html_pages(spark, sf_dir), "portal_b", "https://jobs.example.com")
    return rows.select("page", "item", "page_status", "puesto", "url", "empresa", "ubicacion", "distrito", "salario", "area", "fechaPublicacion", "job_id")


@query
def details_by_job(spark, sf_dir):
    """Detail pages by job id: the first marked block, whatever is nested in it."""
    rows = offers(spark, sf_dir)
    url = F.concat(F.lit("https://jobs.example.com/jobs/view/"), F.col("doc_id").cast("string"))
    html = F.concat(F.lit('<div class="top">menu</div><section class="description"><div><b>'), F.col("puesto"), F.lit("</b></div> en <p>"), F.col("empresa"), F.lit('</p></section><div class="description__text">otro texto mucho mas largo que el primero de la pagina</div>'))
    return html_pages.details_by_job(rows.select(url.alias("url"), html.alias("html")))


@query
def jsonld_postings(spark, sf_dir):
    one = F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("<p>"), F.col("puesto"), F.lit("</p>")).alias("description"), F.col("fechaPublicacion").alias("datePosted"), F.struct(F.col("empresa").alias("name")).alias("hiringOrganization"))
    body = F.when(F.col("doc_id") % 3 == 0, F.to_json(one)).when(F.col("doc_id") % 3 == 1, F.to_json(F.array(one))).otherwise(F.to_json(F.struct(F.array(one).alias("@graph"))))
    html = F.concat(F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">'), body, F.lit("</script></html>"))
    rows = html_pages.json_ld_postings(offers(spark, sf_dir).select("doc_id", html.alias("html")))
    return rows.select("doc_id", "descripcion", "fechaPublicacion", "empresa")
