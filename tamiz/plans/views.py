"""What is shown of the store: facets, tabs, orders, the projection for cards and the CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import amount_label, norm, text, title_case
from tamiz.operators.experience import experience_label, known_kind
from tamiz.operators.extract import shift_kind, shift_text
from tamiz.operators.geo import known_zone, short_location
from tamiz.operators.requirements import labels, requirements


def facet_filter(rows: DataFrame, zones=(), portals=(), modes=()) -> DataFrame:
    """An empty facet filters nothing."""
    if zones:
        rows = rows.where(F.col("zona").isin(*zones))
    if portals:
        rows = rows.where(F.col("portal").isin(*portals))
    if modes:
        hit = F.lit(False)
        for m in modes:
            hit = hit | F.contains(norm("modalidad"), norm(F.lit(m)))
        rows = rows.where(hit)
    return rows


def with_tab(rows: DataFrame) -> DataFrame:
    # Whether a shift is atypical doesn't depend on the description, which so needn't be read.
    return rows.withColumn("tab", F.when(shift_kind(F.col("regimenTrabajo"), F.col("trabajoEnCampamento"), F.lit("")) == "ATIPICO", "atipico").otherwise("estandar"))


ORDERS = {
    "match": (F.desc, "matchScore"),
    "recent": (F.desc, "fechaEpoch", F.desc, "matchScore"),
    "experience": (F.asc_nulls_last, "mesesExperiencia", F.desc, "matchScore"),
}


def ordered(rows: DataFrame, order: str) -> DataFrame:
    spec = ORDERS[order]
    return rows.orderBy(*(f(c) for f, c in zip(spec[::2], spec[1::2])), "url")


def cards(rows: DataFrame) -> DataFrame:
    chips = F.slice(F.filter(F.transform(F.split(text("requisitos"), "[;|]"), lambda x: F.trim(x)), lambda x: x != ""), 1, 4)
    return rows.select(
        "url", title_case("puesto").alias("puesto"), title_case("empresa").alias("empresa"), "portal", "modalidad", "matchScore", "nuevo", "estado",
        short_location(F.col("distrito"), F.col("departamento"), known_zone(F.col("zona"))).alias("ubicacion"),
        amount_label(F.col("salarioMin"), F.col("salarioMax"), F.col("salarioMoneda"), F.col("salario")).alias("salario"),
        experience_label(F.col("mesesExperiencia"), F.col("expTipo")).alias("experiencia"),
        shift_kind(F.col("regimenTrabajo"), F.col("trabajoEnCampamento"), F.col("descripcion")).alias("jornada"),
        shift_text(F.col("regimenTrabajo"), F.col("trabajoEnCampamento"), F.col("descripcion")).alias("etiquetaJornada"),
        chips.alias("tags"),
    )


def _quoted(c: Column | str) -> Column:
    flat = F.replace(F.replace(text(c), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))


#: The header of the export and the names of zones in it.
CSV_HEADER = (
    "Portal,Puesto,Empresa,Ubicacion,Distrito,Departamento,Zona,Modalidad,Jornada,Regimen,Campamento,Seniority,ExperienciaTipo,ExperienciaMeses,ExperienciaEvidencia,"
    "NivelEducativo,Ingles,Salario,SalarioMin,SalarioMax,Moneda,Beneficios,MatchScore,FechaPublicacion,RequisitosIdentificados,Descripcion,URL"
)
ZONE_NAMES = {"LIMA_METROPOLITANA": "Lima Metropolitana", "CALLAO": "Callao", "LIMA_PROVINCIAS": "Provincias de Lima", "OTRO_DEPARTAMENTO": "Otros departamentos"}


def csv_lines(rows: DataFrame) -> DataFrame:
    """(url, atypical, matchScore, line): one rendered line a posting, text in quotes, numbers and SI/NO without; standard shifts stand before atypical ones."""
    whole = lambda c: F.coalesce(F.col(c).cast("int").cast("string"), F.lit(""))
    found = F.col("_req") if "_req" in rows.columns else requirements("puesto", "descripcion")
    zone = F.lit("Sin ubicación")
    for key, name in ZONE_NAMES.items():
        zone = F.when(F.col("zona") == key, name).otherwise(zone)
    kind = shift_kind(F.col("regimenTrabajo"), F.col("trabajoEnCampamento"), F.col("descripcion"))
    english = F.when(F.col("requiereIngles"), F.coalesce("nivelIngles", F.lit("Si"))).otherwise("No")
    fields = [
        *map(_quoted, ("portal", "puesto", "empresa", "ubicacion", "distrito", "departamento", zone, "modalidad", kind, "regimenTrabajo")), F.when(F.col("trabajoEnCampamento"), "SI").otherwise("NO"),
        *map(_quoted, ("seniority", known_kind(F.col("expTipo")))), whole("mesesExperiencia"), *map(_quoted, ("expEvidencia", "nivelEducativo", english, "salario")), whole("salarioMin"), whole("salarioMax"),
        *map(_quoted, ("salarioMoneda", F.array_join("beneficios", " | "))), whole("matchScore"), *map(_quoted, ("fechaPublicacion", F.array_join(labels(found, 10), " | "), "descripcion", "url")),
    ]
    return rows.select("url", (kind == "ATIPICO").alias("atypical"), "matchScore", F.concat_ws(",", *fields).alias("line"))


def write_csv(rows: DataFrame, folder: str) -> None:
    """The export as text files: the header in ``folder``/header, the lines in order in ``folder``/lines, so that no task holds them all."""
    lines = csv_lines(rows).orderBy("atypical", F.desc("matchScore"), "url").select("line")
    rows.sparkSession.createDataFrame([(CSV_HEADER,)], "line string").coalesce(1).write.mode("overwrite").text(f"{folder}/header")
    lines.write.mode("overwrite").text(f"{folder}/lines")
