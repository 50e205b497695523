"""Landed pages of a JSON search API: one row a page, its postings in ``content`` and facets in ``filters``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions.dates import days_since
from tamiz.functions.text import nonblank, norm, text


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def _named(v: str, key: str, name: str = "nombre") -> Column:
    """An object's name, or the plain value; "" if it's missing."""
    return F.coalesce(_get(v, f"$.{key}.{name}"), F.when(~F.coalesce(F.expr(f"schema_of_variant(variant_get({v}, '$.{key}'))"), F.lit("")).startswith("OBJECT"), _get(v, f"$.{key}")), F.lit(""))


def items(pages: DataFrame) -> DataFrame:
    """(page, item, v): every element of ``content``; unreadable pages have none."""
    parsed = pages.select("page", F.try_parse_json("body").alias("p"))
    content = F.expr("try_variant_get(p, '$.content', 'array<variant>')")
    return parsed.select("page", F.posexplode(content).alias("item", "v"))


def area_names(pages: DataFrame) -> DataFrame:
    """(area_id, area_name) from the facets of type area."""
    parsed = pages.select(F.try_parse_json("body").alias("p"))
    facets = parsed.select(F.explode(F.expr("try_variant_get(p, '$.filters', 'array<variant>')")).alias("f")).where(_get("f", "$.type") == "area")
    values = facets.select(F.explode(F.expr("try_variant_get(f, '$.facets', 'array<variant>')")).alias("x"))
    return values.select(_get("x", "$.id").alias("area_id"), _get("x", "$.name").alias("area_name")).where("area_id is not null").groupBy("area_id").agg(F.min("area_name").alias("area_name"))


def postings(pages: DataFrame, portal: str, base_url: str) -> DataFrame:
    """Postings with an id and a title; others are dropped."""
    first = lambda *paths: F.coalesce(*(nonblank(_get("v", p)) for p in paths), F.lit(""))
    rows = items(pages).withColumns({"id": text(_get("v", "$.id")), "puesto": text(_get("v", "$.titulo"))}).where("trim(id) != '' and trim(puesto) != ''")
    company = _named("v", "empresa")
    hidden = F.coalesce(_get("v", "$.confidencial", "boolean"), F.lit(False)) | (F.trim(company) == "")
    places = F.array_distinct(F.filter(F.array(text(_get("v", "$.localizacion.nombre")), text(_get("v", "$.localizacion.nombreSuperior"))), lambda x: F.trim(x) != ""))
    mode = norm(F.concat_ws(" ", _named("v", "modalidadTrabajo"), _named("v", "modalidad")))
    low, high = F.coalesce(_get("v", "$.salarioMinimo", "int"), F.lit(0)), F.coalesce(_get("v", "$.salarioMaximo", "int"), F.lit(0))
    slug = F.regexp_replace(F.regexp_replace(F.lower("puesto"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    described = first("$.detalle", "$.descripcion", "$.resumen", "$.descripcionBreve", "$.fichaAviso.descripcion")
    out = rows.select(
        "page", "item", "puesto", F.lit(portal).alias("portal"), F.when(hidden, "Confidencial").otherwise(company).alias("empresa"),
        F.when(F.size(places) > 0, F.array_join(places, ", ")).otherwise("Lima").alias("ubicacion"), F.coalesce(F.get(places, 0), F.lit("Lima")).alias("distrito"),
        F.when(mode.rlike("remot|teletrabajo"), "Remoto").when(mode.rlike("hibr|hybrid|semi"), "Hibrido").otherwise("Presencial").alias("modalidad"),
        F.when(low > 0, F.concat(F.lit("S/ "), low.cast("string"), F.lit(" - "), high.cast("string"))).otherwise("No especificado").alias("salario"),
        first("$.fechaHoraPublicacion", "$.fechaPublicacion", "$.fechaModificado").alias("fechaPublicacion"),
        F.trim(F.regexp_replace(described, "<[^>]+>", " ")).alias("descripcion"), nonblank(_named("v", "area")).alias("_area"), _get("v", "$.idArea").alias("_area_id"),
        F.concat(F.lit(base_url.rstrip("/") + "/"), slug, F.lit("-"), F.col("id"), F.lit(".html")).alias("url"),
    )
    # The facets of a search are a few dozen names; Spark broadcasts them if their size allows.
    named = out.join(area_names(pages), out["_area_id"] == F.col("area_id"), "left")
    return named.withColumn("area", F.coalesce("_area", "area_name", F.lit(""))).drop("_area", "_area_id", "area_id", "area_name")


def before_cutoff(rows: DataFrame, as_of: Column, max_days: int = 30, source: str = "portal") -> DataFrame:
    """What a scan returns that stops after the page whose last readable date is too old; older rows go, undated stay."""
    aged = rows.withColumn("_age", days_since("fechaPublicacion", as_of))
    pages = aged.groupBy(source, "page").agg(F.max(F.when(F.col("_age").isNotNull(), F.struct("item", "_age"))).alias("last"))
    earlier = Window.partitionBy(source).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("over", F.coalesce(F.max(F.col("last._age") > max_days).over(earlier), F.lit(False))).where("not over").select(source, "page")
    return aged.join(pages, [source, "page"]).where(F.col("_age").isNull() | (F.col("_age") <= max_days)).drop("_age")
