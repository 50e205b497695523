"""Names found in places against plain loops; unknown stored names."""

import random

from pyspark.sql import functions as F

from tamiz.functions import vocabulary as v
from tamiz.operators import experience, geo


def test_longest_contained_name(spark, monkeypatch):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abc ñ") for _ in range(rng.randrange(1, 9))) for _ in range(60)} - {""})
    places = ["".join(rng.choice("abc ñ") for _ in range(rng.randrange(0, 30))) for _ in range(300)] + [None, "", "a", "zzzz"] * 2
    table = spark.createDataFrame([(n, float(i), 0.5) for i, n in enumerate(names)] + [(names[0], 99.0, 0.0), ("", 1.0, 1.0), (None, 1.0, 1.0)], "name string, lat double, lon double")
    rows = spark.createDataFrame(list(enumerate(places)), "k int, place string")

    def want(p):
        held = [n for n in names if p and n in p]
        return min(held, key=lambda n: (-len(n), n)) if held else None

    for limit in (geo.BROADCAST_NAMES, 0):
        monkeypatch.setattr(geo, "BROADCAST_NAMES", limit)
        got = geo.centers(rows, "place", table)
        assert got.columns == ["k", "place", "center"]
        got = {r.k: r.center for r in got.collect()}
        assert {k: c and c.name for k, c in got.items()} == {k: want(p) for k, p in enumerate(places)}
        assert all(c is None or (c.lat, c.lon) == (float(names.index(c.name)), 0.5) for c in got.values())
    assert geo.centers(rows, "place", table.limit(0)).where("center is not null").count() == 0
    assert geo.centers(rows.limit(0), "place", table).count() == 0


def test_table_and_expression_agree(spark):
    places = [*v.DISTRICTS, "san juan de miraflores, lima", "ate", "chosica lurigancho", "nada", "", "los olivos y comas", "avenida lima 12, surco"]
    rows = spark.createDataFrame(list(enumerate(places)), "k int, place string").withColumn("own", geo.district_center(F.col("place")))
    got = geo.centers(rows, "place", geo.gazetteer(spark)).collect()
    assert len(got) == len(places) and all(r.own == r.center for r in got)


def test_unknown_stored_names_have_a_fallback(spark):
    rows = spark.createDataFrame([("CALLAO", "CUANTIFICADA", 5), ("otra", "otra", 5), (None, None, 5)], "zona string, kind string, months int")
    got = rows.select(geo.known_zone(F.col("zona")).alias("z"), experience.known_kind(F.col("kind")).alias("k"), experience.experience_label(F.col("months"), F.col("kind")).alias("l")).collect()
    assert list(map(tuple, got)) == [("CALLAO", "CUANTIFICADA", "5 meses"), ("DESCONOCIDA", "NO_MENCIONADA", "Exp. no indicada"), ("DESCONOCIDA", "NO_MENCIONADA", "Exp. no indicada")]
