"""From raw postings to ranked ones: dedupe, prefilter, enrich, gate, score. One lazy plan; it shuffles for the dedupe, and for cached and detail texts where they are given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import vocabulary as v
from tamiz.functions.dates import days_since, epoch_of
from tamiz.functions.text import clean_url, nonblank, norm, strip_html, text
from tamiz.operators import experience, extract, geo, requirements
from tamiz.operators.match import match
from tamiz.sources.html_pages import job_id


def as_of_column(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def dedupe(raw: DataFrame) -> DataFrame:
    """One posting for each cleaned URL, the first in source order; blank URLs go."""
    key = clean_url("url")
    first = F.row_number().over(Window.partitionBy("clean_url").orderBy("src_ord", "page", "item"))
    return raw.where(F.trim(text("url")) != "").withColumn("clean_url", key).withColumn("_n", first).where("_n = 1").drop("_n")


def prefilter_reason(title: Column, level: Column, age: Column) -> Column:
    """Why a posting is rejected by its title or age; null if it isn't. The first reason counts."""
    return (
        F.when(norm(title).rlike(v.TRAINEE_TITLE), "Puesto de practicante")
        .when(level.isin(*v.SENIOR_LEVELS), F.concat(F.lit("Nivel "), level, F.lit(" en el titulo")))
        .when(age > v.MAX_DAYS, F.concat(F.lit("Publicada hace "), age.cast("string"), F.lit(" dias")))
    )


def prefilter(unique: DataFrame, as_of: str) -> DataFrame:
    """Adds age, seniority and motivo; the cheap tests come before any work on descriptions."""
    rows = unique.withColumn("age", days_since("fechaPublicacion", as_of_column(as_of))).withColumn("seniority", extract.seniority("puesto"))
    return rows.withColumn("motivo", prefilter_reason(F.col("puesto"), F.col("seniority"), F.col("age")))


def in_task_order(*sources: DataFrame) -> DataFrame:
    """All sources, each with its place in ``src_ord``; a null is a query that failed and brings nothing."""
    out = None
    for k, rows in enumerate(sources):
        if rows is not None:
            rows = rows.withColumn("src_ord", F.lit(k))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source brought anything")
    return out


def choose_description(rows: DataFrame, cached: DataFrame | None, details: DataFrame | None, portals: tuple[str, ...], by_job: DataFrame | None = None) -> DataFrame:
    """A long cached description first; else, on the given portals, the detail page's in place of a short one.

    Detail pages are known by (url, descripcion) in ``details`` and by (job_id, descripcion) in ``by_job``.
    """
    if cached is not None:
        rows = rows.join(cached.select("url", F.col("descripcion").alias("_cached")), "url", "left")
    if details is not None:
        rows = rows.join(details.select("url", F.col("descripcion").alias("_detail")), "url", "left")
    if by_job is not None:
        rows = rows.withColumn("_job", job_id(F.col("url"))).join(by_job.select(F.col("job_id").alias("_job"), F.col("descripcion").alias("_by_job")), "_job", "left")
    own, out = text("descripcion"), text("descripcion")
    found = [nonblank(F.col(c)) for c, given in (("_detail", details), ("_by_job", by_job)) if given is not None]
    if found:
        out = F.when(F.col("portal").isin(*portals) & (F.length(own) < v.DETAIL_FROM_CHARS), F.coalesce(*found, own)).otherwise(own)
    if cached is not None:
        out = F.when(F.length("_cached") >= v.DETAIL_FROM_CHARS, F.col("_cached")).otherwise(out)
    return rows.withColumn("descripcion", out).drop("_cached", "_detail", "_job", "_by_job")


def gate_reason(career: Column, months: Column, evidence: Column, level: Column) -> Column:
    return (
        F.when(~career, "No menciona Ingenieria Industrial")
        .when(months > v.MAX_MONTHS, F.concat(F.lit("Pide "), months.cast("string"), F.lit(f" meses de experiencia (tope {v.MAX_MONTHS}) — "), text(evidence)))
        .when(level.isin(*v.SENIOR_LEVELS), F.concat(F.lit("Cargo de nivel "), level, F.lit(" (Senior / Jefatura)")))
    )


def gate(rows: DataFrame) -> DataFrame:
    """Cleans descriptions, reads the experience asked for and gives the rejected their motivo."""
    rows = rows.withColumn("descripcion", strip_html("descripcion"))
    rows = rows.withColumn("texto", norm(F.concat(text("puesto"), F.lit(" "), F.col("descripcion"))))
    rows = rows.withColumn("exp", experience.experience(F.col("texto")))
    reason = gate_reason(extract.names_career(F.col("texto")), F.col("exp.months_min"), F.col("exp.evidence"), F.col("seniority"))
    # Through the generator no filter on the motivo goes down, which would read every text again to test it.
    known = F.struct(F.col("descripcion").alias("descripcion"), F.col("texto").alias("texto"), F.col("exp").alias("exp"), reason.alias("motivo"))
    return rows.select(*[c for c in rows.columns if c not in ("descripcion", "texto", "exp", "motivo")], F.inline(F.array(known)))


def enrich(rows: DataFrame, as_of: str) -> DataFrame:
    """All derived columns of the store, the score and its reasons."""
    # The description and the whole text are normalised once for all that is read from them.
    rows = rows.withColumn("_plain", norm("descripcion"))
    d = F.col("_plain")
    rows = rows.withColumns({"_pay": extract.salary(d, True), "_english": extract.english(d, True), "_shift": extract.work_shift(d, True), "_place": geo.split_location("ubicacion"), "_req": requirements.requirements("puesto", "descripcion")})
    rows = rows.withColumns({
        "modalidad": extract.work_mode(F.col("modalidad"), F.col("texto")),
        "distrito": geo.shown_district("ubicacion"),
        "departamento": text(geo.shown_department(F.col("_place"))),
        "zona": geo.zone(F.col("_place")),
        "fechaEpoch": epoch_of("fechaPublicacion", as_of_column(as_of)),
        "mesesExperiencia": F.col("exp.months_min"),
        "expTipo": F.col("exp.kind"),
        "expEvidencia": text(F.col("exp.evidence")),
        "area": extract.area_of("area", F.col("texto")),
        "rubro": F.lit(""),
        "requisitos": F.array_join(requirements.labels(F.col("_req"), 6), "; "),
        "salarioMin": F.col("_pay.min"), "salarioMax": F.col("_pay.max"), "salarioMoneda": F.col("_pay.currency"),
        "nivelEducativo": extract.education(d, True),
        "requiereIngles": F.col("_english.required"), "nivelIngles": F.col("_english.level"),
        "regimenTrabajo": F.col("_shift.shift"), "trabajoEnCampamento": F.col("_shift.camp"),
        "ingIndustrialExclusiva": extract.names_one_career(F.col("texto")),
        "beneficios": extract.benefits(d, True),
    })
    t = norm(F.concat_ws(" ", "puesto", "descripcion", "requisitos"))
    offer = {"seniority": "seniority", "months": "mesesExperiencia", "kind": "expTipo", "mode": "modalidad", "industrial_only": "ingIndustrialExclusiva", "english_level": "nivelIngles", "zone": "zona", "shift": "regimenTrabajo", "camp": "trabajoEnCampamento"}
    rows = rows.withColumn("_match", match(t, {k: F.col(c) for k, c in offer.items()}))
    return rows.withColumns({"matchScore": F.col("_match.score"), "razones": F.col("_match.reasons")})


STORE_COLUMNS = (
    "url portal puesto empresa ubicacion distrito departamento zona salario modalidad descripcion fechaPublicacion fechaEpoch matchScore mesesExperiencia expTipo expEvidencia nuevo estado area rubro "
    "requisitos salarioMin salarioMax salarioMoneda seniority nivelEducativo requiereIngles nivelIngles regimenTrabajo trabajoEnCampamento ingIndustrialExclusiva beneficios"
).split()


def refresh(raw: DataFrame, as_of: str, cached: DataFrame | None = None, details: DataFrame | None = None, portals: tuple[str, ...] = (), by_job: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted with all derived columns, rejected with motivo). Both read the gated rows; ``keep`` may write them and read them again, so that they are computed once."""
    early = prefilter(dedupe(raw), as_of)
    late = gate(choose_description(early.where("motivo is null"), cached, details, portals, by_job))
    late = late if keep is None else keep(late)
    accepted = enrich(late.where("motivo is null"), as_of)
    columns = ["portal", "puesto", "empresa", "motivo", "url", "descripcion", "ubicacion"]
    rejected = early.where("motivo is not null").select(*columns).unionByName(late.where("motivo is not null").select(*columns))
    return accepted, rejected


def ranked(accepted: DataFrame) -> DataFrame:
    """Best first. A sort over all rows samples what it sorts; dealt out before it, the rows are sampled from the shuffle and not derived twice."""
    return accepted.repartition("url").orderBy(F.desc("matchScore"), "url")
