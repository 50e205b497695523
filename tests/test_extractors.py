"""Expected values of single extractors, derived by hand."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamiz.functions import dates, text
from tamiz.operators import experience, extract, geo, requirements
from tamiz.operators.match import match

AS_OF = "2026-07-20 12:00:00"


def one(spark, value, use):
    return spark.createDataFrame([(value,)], "x string").select(use(F.col("x")).alias("r")).first()["r"]


def many(spark, values, use):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", use(F.col("x")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_text_keys(spark):
    assert many(spark, ["  ÁÉ ñ \n Ç ", None, ""], text.norm) == ["ae n c", "", ""]
    assert one(spark, " Á  b ", lambda c: text.norm(text.norm(c))) == one(spark, " Á  b ", text.norm)
    assert many(spark, ["http://a/b/?x#y", None, " http://a/b// "], text.clean_url) == ["http://a/b", "", "http://a/b"]
    assert many(spark, ["ANALISTA DE DESARROLLO", "Analista SQL", "123", ""], text.title_case) == ["Analista de Desarrollo", "Analista SQL", "123", ""]
    assert many(spark, ["Inversiones Acme S.A.C.", "Empresa S.A.", "Perú"], text.company_key) == ["acme", "empresasa", "peru"]


def test_find_all_gives_offsets(spark):
    found = one(spark, "a1 b22 c333", lambda c: text.find_all(c, r"([a-z])(\d+)", 2))
    assert [(m["start"], m["end"], m["m"], m["g"]) for m in found] == [(0, 2, "a1", ["a", "1"]), (3, 6, "b22", ["b", "22"]), (7, 11, "c333", ["c", "333"])]
    assert one(spark, "xx", lambda c: text.find_all(c, r"(y)", 1)) == []


def test_dates(spark):
    days = many(spark, ["hace 2 semanas", "ayer", "hace 23 horas", "2026-07-15", "2026-07-15 extra", "05/07/2026", "", None, "nada", "1784246400000", "2026-07-10T08:30:00"], lambda c: dates.days_since(c, F.lit(AS_OF).cast("timestamp")))
    assert days == [14, 1, 0, 5, 5, 15, None, None, None, 3, 10]


def test_locations(spark):
    places = ["San Vicente de Cañete, Lima", "Lima, Lima Province, Peru", "Huaral, Lima", "Arequipa, Arequipa", "", "Bellavista, Callao", "Ate"]
    assert many(spark, places, lambda c: geo.zone(geo.split_location(c))) == ["LIMA_PROVINCIAS", "LIMA_METROPOLITANA", "LIMA_PROVINCIAS", "OTRO_DEPARTAMENTO", "DESCONOCIDA", "CALLAO", "LIMA_METROPOLITANA"]
    split = many(spark, places[:4], geo.split_location)
    assert [(s["district"], s["department"]) for s in split] == [("san vicente de canete", "lima"), (None, "lima"), ("huaral", "lima"), (None, "arequipa")]
    assert one(spark, "", geo.shown_district) == "Sin especificar"


def test_experience(spark):
    texts = [
        "experiencia minima de 3 meses", "excel intermedio.2 a 3 anios de experiencia", "1.5 anios de experiencia", "planilla luego de 3 a 6 meses de periodo de prueba", "con o sin experiencia",
        "experiencia comprobable", "somos una empresa con 20 anios de experiencia en el mercado", "", "mejor experiencia en compras",
    ]
    got = many(spark, texts, experience.experience)
    assert [(g["months_min"], g["months_max"], g["kind"]) for g in got] == [
        (3, None, "CUANTIFICADA"), (24, 36, "CUANTIFICADA"), (18, None, "CUANTIFICADA"), (None, None, "NO_MENCIONADA"), (0, None, "NO_REQUERIDA"),
        (None, None, "REQUERIDA_SIN_CUANTIFICAR"), (None, None, "REQUERIDA_SIN_CUANTIFICAR"), (None, None, "NO_MENCIONADA"), (None, None, "NO_MENCIONADA"),
    ]
    labels = many(spark, texts[:3], lambda c: experience.experience_label(experience.experience(c)["months_min"], experience.experience(c)["kind"]))
    assert labels == ["3 meses", "2+ años", "1.5+ años"]


def test_attributes(spark):
    assert many(spark, ["Analista Semi Senior", "Analista Sr.", "Operario", "Practicante", "Jefe"], extract.seniority) == ["Semi Senior", "Senior", "Operativo / Sin especificar", "Practicante", "Jefatura"]
    pay = many(spark, ["sueldo S/ 1,500 a S/ 2,000", "sueldo S/ 1,500.00", "S/ 1500", "salario US$ 900"], extract.salary)
    assert [(p["min"], p["max"], p["currency"]) for p in pay] == [(1500.0, 2000.0, "PEN"), (None, None, None), (None, None, None), (900.0, 900.0, "USD")]
    shift = many(spark, ["regimen 14x7 en campamento", "camioneta 4x4", "atencion 24x7", "turno 5x2"], extract.work_shift)
    assert [(s["shift"], s["camp"]) for s in shift] == [("14x7", True), (None, False), (None, False), ("5x2", False)]
    assert one(spark, "planilla y eps", extract.benefits) == ["Planilla", "EPS / Seguro"]


def test_requirements():
    first = lambda text: [(r["name"], r["level"], r["exigency"], r["confidence"]) for r in requirements.find_requirements("", text)]
    assert first("Requisitos: Excel a nivel intermedio - avanzado") == [("Excel", "INTERMEDIO", "NO_ESPECIFICADO", "ALTA")]
    assert [r[2] for r in first("Requisitos: Deseable manejo de Power BI y SAP")] == ["DESEABLE", "DESEABLE"]
    assert first("Beneficios: ingreso a planilla desde el primer dia") == []


def test_parents_and_children(spark):
    rows = spark.createDataFrame([(0, "Requisitos: SAP MM"), (1, "Requisitos: SAP MM y SAP PP"), (2, None)], "i int, x string")
    got = {r.i: r.names for r in rows.select("i", requirements.labels(requirements.requirements(F.lit(""), "x"), 6).alias("names")).collect()}
    assert got == {0: ["SAP MM"], 1: ["SAP"], 2: []}


def test_skill_counts_of_the_whole_catalogue(spark):
    from tamiz import queries

    texts = ["Manejo de Excel y SQL.", "Manejo de SQL y SAP.", "Manejo de Python, SQL y Excel.", "Sin nada de eso."]
    rows = spark.createDataFrame([("Puesto", x) for x in texts], "puesto string, descripcion string")
    got = {r.skill: r.n for r in queries._skill_counts(rows).collect()}
    assert {k: got.get(k) for k in ("Excel", "SQL", "SAP", "Python")} == {k: sum(k in x for x in texts) for k in ("Excel", "SQL", "SAP", "Python")}
    assert "all_skill_counts" in queries.QUERIES


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_every_match_of_a_skill_contains_one_of_its_stems(data):
    row, needs = data.draw(st.sampled_from(list(zip(requirements.catalogue(), map(lambda r: requirements.stems(r[1].pattern), requirements.catalogue())))))
    found = data.draw(st.from_regex(row[1], fullmatch=True))
    assert any(n in found for n in needs), row[0]


def test_find_all_of_very_many_matches(spark):
    value = "".join(f"{i} x" if i % 7 else " 14x7 y" for i in range(3000))
    import re

    want = [(m.start(), m.end(), m[0], [m[1], m[2]]) for m in re.finditer(r"(\d+) ?(x)", value)]
    got = one(spark, value, lambda c: text.find_all(c, r"(\d+) ?(x)", 2))
    assert [(r["start"], r["end"], r["m"], r["g"]) for r in got] == want and len(want) > 2 * text.RUN


def test_joined_texts_are_read_as_each_alone():
    raw = ["Analista. Excel y SQL", "", "x. Beneficios: power bi. Requisitos: SAP\r\n\r\ninglés", "ab. python", "&amp;nbsp;Excel &#8226; KPIs ⭐JavaScript", "́x. Σ", "y. R y C#, 5S" * 3]
    alone = [requirements.find_all_requirements([t])[0] for t in raw]
    assert requirements.find_all_requirements(raw) == alone and sum(map(len, alone)) >= 9
    run = requirements.JOINED_CHARS
    try:
        requirements.JOINED_CHARS = 30
        assert requirements.find_all_requirements(raw) == alone
    finally:
        requirements.JOINED_CHARS = run


def test_stems_are_found_with_and_without_the_automaton(monkeypatch):
    texts = ["excel sql", "", "sap", "nada", "power bi y excel"]
    ends = [9, 10, 14, 19, 36]
    joined = "".join(texts)
    with_it = requirements.candidates(joined, ends)
    monkeypatch.setattr(requirements, "_automaton", lambda: None)
    assert requirements.candidates(joined, ends) == with_it and with_it[1] == [] and len(with_it[0]) >= 2


def test_match_computes_its_text_once(spark):
    """Every rule reads the text; each reference to it used to normalise it anew."""
    offer = {k: F.lit(None).cast("string") for k in ("seniority", "kind", "mode", "english_level", "zone", "shift")} | {"months": F.lit(12), "industrial_only": F.lit(True), "camp": F.lit(False)}
    rows = spark.createDataFrame([("LAICOS OIRARELAS LQS Y IB REWOP",)], "t string").select(match(F.lower(F.reverse("t")), offer).alias("m"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
    found = rows.first()["m"]
    assert (found.score, found.reasons) == (10 + 7 + 10 + 2 + 4, ["Power BI", "SQL", "Pide ≤ 2 años", "Exclusiva Ing. Industrial"])
