"""Locations: district, department, zone and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import vocabulary as v
from tamiz.functions.text import bind, capitalized, contains_any, norm, text


def _clean(part: Column) -> Column:
    t = norm(part)
    for noise in v.LOCATION_NOISE:
        t = F.replace(t, F.lit(noise), F.lit(" "))
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def split_location(c: Column | str) -> Column:
    """struct<district, department>: the last part that is a department; the first part that isn't it."""
    return bind(F.filter(F.transform(F.split(text(c), ","), _clean), lambda p: p != ""), _split)


def _split(parts: Column) -> Column:
    department = F.try_element_at(F.filter(parts, lambda p: p.isin(*v.DEPARTMENTS)), F.lit(-1))
    rest = F.filter(parts, lambda p: ~F.coalesce(p == department, F.lit(False)))
    district = F.coalesce(F.get(rest, 0), F.get(parts, 0))
    return F.struct(F.when(~F.coalesce(district == department, F.lit(False)), district).alias("district"), department.alias("department"))


def district_center(c: Column) -> Column:
    """struct<name, lat, lon> of the longest district name that normalised text contains, or null."""
    return bind(c, _center)


def _center(c: Column) -> Column:
    out = None
    for name in sorted(v.DISTRICTS, key=len, reverse=True):
        lat, lon = v.DISTRICTS[name]
        point = F.struct(F.lit(name).alias("name"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
        hit = F.contains(c, F.lit(name))
        out = F.when(hit, point) if out is None else out.when(hit, point)
    return out


def gazetteer(spark: SparkSession) -> DataFrame:
    """(name, lat, lon) of the built-in districts, in the form of any other table of places."""
    return spark.createDataFrame([(name, *at) for name, at in v.DISTRICTS.items()], "name string, lat double, lon double")


#: Characters of a name that must be equal before the whole name is compared.
KEY_CHARS = 3
#: Names up to which a table of places is broadcast (about 100 bytes each).
BROADCAST_NAMES = 200_000


def centers(rows: DataFrame, place: str, names: DataFrame) -> DataFrame:
    """``rows`` with ``center``, struct<name, lat, lon> of the longest name of the table that normalised text in ``place`` contains; of equally long ones the first by letters.

    Every distinct place is cut into keys of three characters at each offset, which meet the names' first three, so that a name is compared only where it may
    stand, however many names there are. Names shorter than that are keyed by all of theirs. Null or empty places and places without a name have none.
    """
    known = names.where(F.length("name") > 0).groupBy("name").agg(F.min_by(F.struct("lat", "lon"), F.struct("lat", "lon")).alias("at"))
    known = known.select(F.col("name").alias("_name"), "at", F.substring("name", 1, KEY_CHARS).alias("_key")).persist()
    try:
        few = known.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
        widths = [r[0] for r in known.select(F.length("_key")).distinct().collect()]
    finally:
        known.unpersist()
    places = rows.select(F.col(place).alias("_place")).where(F.length("_place") > 0).distinct()
    offsets = F.explode(F.sequence(F.lit(1), F.length("_place")))
    keys = F.explode(F.array_distinct(F.array(*(F.substring("_place", F.col("_at"), F.lit(w)) for w in sorted(widths)))) if widths else F.array().cast("array<string>"))
    cut = places.select("_place", offsets.alias("_at")).select("_place", "_at", keys.alias("_key"))
    met = cut.join(F.broadcast(known) if few else known, "_key").where(F.substring("_place", F.col("_at"), F.length("_name")) == F.col("_name"))
    # The longest name and, of equally long ones, the first: the least of (-length, name).
    best = met.groupBy("_place").agg(F.min(F.struct((-F.length("_name")).alias("n"), F.col("_name").alias("name"), F.col("at"))).alias("_best"))
    center = F.when(F.col("_best").isNotNull(), F.struct("_best.name", "_best.at.lat", "_best.at.lon"))
    return rows.join(best, rows[place] == best["_place"], "left").withColumn("center", center).drop("_place", "_best")


ZONES = ("LIMA_METROPOLITANA", "CALLAO", "LIMA_PROVINCIAS", "OTRO_DEPARTAMENTO", "DESCONOCIDA")


def known_zone(name: Column) -> Column:
    """A stored zone; one that isn't known, or none, counts as unknown."""
    return F.when(name.isin(*ZONES), name).otherwise("DESCONOCIDA")


def zone(place: Column) -> Column:
    """The zone of a split location."""
    return bind(place, _zone)


def _zone(place: Column) -> Column:
    district, department = place["district"], place["department"]
    no = F.lit(False)
    near = F.when(contains_any(district, v.LIMA_PROVINCES), "LIMA_PROVINCIAS").when(contains_any(district, tuple(v.DISTRICTS)), "LIMA_METROPOLITANA")
    return (
        F.when(district.isNull() & department.isNull(), "DESCONOCIDA")
        .when(F.coalesce(department == "callao", no) | F.coalesce(district.isin("callao", *v.CALLAO_DISTRICTS), no), "CALLAO")
        .when(F.coalesce(department == "lima", F.lit(True)), F.coalesce(near, F.when(department == "lima", "LIMA_METROPOLITANA"), F.lit("DESCONOCIDA")))
        .otherwise("OTRO_DEPARTAMENTO")
    )


def shown_district(c: Column | str) -> Column:
    """The first part, as it is written, that is no department."""
    parts = F.filter(F.transform(F.split(text(c), ","), lambda p: F.trim(p)), lambda p: p != "")
    named = F.filter(parts, lambda p: (_clean(p) != "") & ~_clean(p).isin(*v.DEPARTMENTS))
    return F.coalesce(F.get(named, 0), F.get(parts, 0), F.lit("Sin especificar"))


def shown_department(place: Column) -> Column:
    return capitalized(place["department"])


def short_location(district: Column, department: Column, zone_name: Column) -> Column:
    blank_district, blank_department = F.trim(text(district)) == "", F.trim(text(department)) == ""
    return (
        F.when(blank_district & blank_department, "Sin especificar")
        .when(blank_district, department)
        .when(blank_department | (F.lower(district) == F.lower(department)) | zone_name.isin("LIMA_METROPOLITANA", "CALLAO"), district)
        .otherwise(F.concat(district, F.lit(", "), department))
    )
