import csv

from pyspark.sql import functions as F

from tamiz.plans import pipeline, store, views
from tamiz.streaming import refresh

AS_OF = "2026-07-20 12:00:00"
SCHEMA = "src_ord int, page int, item int, portal string, puesto string, empresa string, ubicacion string, url string, fechaPublicacion string, salario string, modalidad string, area string, descripcion string"
TEXT = "Requisitos: Egresado de Ingeniería Industrial. Experiencia mínima de 1 año en puestos similares. Excel avanzado y SQL."


def raw(spark):
    rows = [
        (1, 0, 0, "a", "Analista de Logística", "x", "San Isidro, Lima", "http://j/1?a", "ayer", "", "", "", TEXT),
        (1, 0, 1, "a", "Analista repetido", "x", "San Isidro, Lima", "http://j/1/", "ayer", "", "", "", TEXT),
        (1, 0, 2, "a", "Practicante", "x", "", "http://j/2", "", "", "", "", TEXT),
        (1, 0, 3, "a", "Analista", "x", "", "http://j/3", "2026-01-01", "", "", "", TEXT),
        (1, 0, 4, "a", "Analista", "x", "", "http://j/4", "", "", "", "", "nada"),
        (1, 0, 5, "a", "Auxiliar", "x", "", "http://j/5", "", "", "", "", "Ingeniería industrial. 5 años de experiencia."),
        (1, 0, 6, "a", None, None, None, " ", None, None, None, None, None),
        (1, 0, 7, "a", None, None, None, "http://j/7", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_unique_posting_is_accepted_or_rejected_with_a_reason(spark):
    accepted, rejected = pipeline.refresh(raw(spark), AS_OF)
    assert [(r.puesto, r.zona, r.mesesExperiencia, r.expTipo) for r in accepted.collect()] == [("Analista de Logística", "LIMA_METROPOLITANA", 12, "CUANTIFICADA")]
    assert 0 < accepted.first().matchScore <= 100
    reasons = {r.url[-1]: r.motivo for r in rejected.collect()}
    assert set(reasons) == set("23457")
    assert reasons["2"] == "Puesto de practicante" and reasons["3"] == "Publicada hace 200 dias" and reasons["4"] == reasons["7"] == "No menciona Ingenieria Industrial"
    assert reasons["5"].startswith("Pide 60 meses de experiencia")


def test_descriptions_from_cache_and_details(spark):
    rows = raw(spark).where("item = 4")
    cached = spark.createDataFrame([("http://j/4", "y" * 400)], "url string, descripcion string")
    details = spark.createDataFrame([("http://j/4", "detail")], "url string, descripcion string")
    assert pipeline.choose_description(rows, cached, details, ("a",)).first().descripcion == "y" * 400
    assert pipeline.choose_description(rows, None, details, ("a",)).first().descripcion == "detail"
    assert pipeline.choose_description(rows, None, details, ("b",)).first().descripcion == "nada"


def test_store_keeps_states_and_is_idempotent(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    refresh.merge_batch(kept, raw(spark), AS_OF)
    first = kept.read().collect()
    assert [(r.estado, r.nuevo) for r in first] == [("pendiente", True)]
    kept.write(store.set_state(kept.read(), first[0].url, "postulada"))
    refresh.merge_batch(kept, raw(spark), AS_OF)
    refresh.merge_batch(kept, raw(spark), AS_OF)
    assert [(r.url, r.estado, r.nuevo) for r in kept.read().collect()] == [(first[0].url, "postulada", False)]


def test_purge(spark):
    rows = spark.createDataFrame([("a", 0, "pendiente"), ("b", 1, "pendiente"), ("c", 1, "postulada"), ("d", 10_000_000_000, "pendiente")], "url string, fechaEpoch long, estado string")
    left = lambda **k: sorted(r.url for r in store.purge(rows, 5_000_000_000, **k).collect())
    assert left() == ["a", "c", "d"]
    # The limit in seconds, 2,408,000 here, is below a date of today in milliseconds, but not below 1.
    assert left(legacy=True) == ["a", "c", "d"]


def test_stream_equals_batch(spark, tmp_path):
    raw(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    kept = store.Store(spark, str(tmp_path / "store"))
    refresh.start(spark, str(tmp_path / "in"), SCHEMA, kept, str(tmp_path / "log"), AS_OF).awaitTermination()
    accepted, _ = pipeline.refresh(raw(spark), AS_OF)
    assert {(r.url.rstrip("/").split("?")[0], r.matchScore) for r in kept.read().collect()} == {(r.url.rstrip("/").split("?")[0], r.matchScore) for r in accepted.collect()}


def test_last_of_repeated_urls_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "url string, n int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "url string, n int, at int")
    assert sorted(tuple(r) for r in store.upsert(old, new, order="at").collect()) == [("a", 1), ("b", 4), ("c", 5)]


def test_store_counts_clears_and_purges_before_a_refresh(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    assert kept.count() == 0
    assert refresh.merge_batch(kept, raw(spark), AS_OF)["accepted"] == 1 == kept.count()
    first = kept.read().first()
    states = [("x", lambda r: store.apply_or_undo(r, first.url)), ("y", lambda r: store.discard(r, first.url))]
    assert [use(kept.read()).first().estado for _, use in states] == ["postulada", "descartada"]
    assert store.apply_or_undo(store.apply_or_undo(kept.read(), first.url), first.url).first().estado == "pendiente"
    other = store.Store(spark, str(tmp_path / "other"))
    other.write(kept.read())
    other.clear()
    assert other.count() == 0 and set(other.read().columns) == set(pipeline.STORE_COLUMNS)
    nothing = raw(spark).limit(0)
    assert refresh.merge_batch(kept, nothing, "2026-09-30 12:00:00")["accepted"] == 0
    assert kept.count() == 0


def test_sources_come_in_task_order(spark):
    one, two = (spark.createDataFrame([(u, 0, 0)], "url string, page int, item int") for u in ("http://j/1", "http://j/1?x"))
    both = pipeline.in_task_order(None, two, one)
    assert [(r.url, r.src_ord) for r in pipeline.dedupe(both).collect()] == [("http://j/1?x", 1)]


def test_descriptions_by_job_id(spark):
    rows = spark.createDataFrame([("b", "http://j/jobs/view/77", "short"), ("b", "http://j/none", "short"), ("c", "http://j/jobs/view/77", "short")], "portal string, url string, descripcion string")
    by_job = spark.createDataFrame([("77", "detail")], "job_id string, descripcion string")
    got = {(r.portal, r.url[-2:]): r.descripcion for r in pipeline.choose_description(rows, None, None, ("b",), by_job).collect()}
    assert got == {("b", "77"): "detail", ("b", "ne"): "short", ("c", "77"): "short"}


def test_csv_export(spark, tmp_path):
    accepted, _ = pipeline.refresh(raw(spark), AS_OF)
    camp = accepted.withColumns({"url": F.lit("http://j/0"), "trabajoEnCampamento": F.lit(True), "puesto": F.lit('a "b"')})
    views.write_csv(accepted.unionByName(camp), str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv/lines")).collect()]
    header = spark.read.text(str(tmp_path / "csv/header")).first().value
    rows = list(csv.reader([header, *lines]))
    assert [len(r) for r in rows] == [27, 27, 27]
    by_name = [dict(zip(rows[0], r)) for r in rows[1:]]
    assert [(r["Puesto"], r["Campamento"], r["Jornada"], r["Zona"]) for r in by_name] == [("Analista de Logística", "NO", "NO_DETERMINADO", "Lima Metropolitana"), ('a "b"', "SI", "ATIPICO", "Lima Metropolitana")]


def test_texts_are_read_once_for_the_gate(spark):
    """A filter on the motivo that went down through the projections read each text anew for every part of it."""
    accepted, rejected = pipeline.refresh(raw(spark), AS_OF)
    for rows, gates in ((accepted.select("url"), 1), (rejected.select("url"), 1)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("<[^>]*>") == gates and plan.count("en adelante)?") <= 6


def test_sorted_rows_are_not_derived_twice(spark):
    """The sort samples its input; a shuffle below it keeps what was derived."""
    ranked = pipeline.ranked(pipeline.refresh(raw(spark), AS_OF)[0])
    assert "RepartitionByExpression" in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert [r.url for r in ranked.collect()] == ["http://j/1?a"]
