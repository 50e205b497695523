"""The whole refresh against plain loops, over every posting of a data folder: dedupe, reasons, experience, requirements, score, cards, export."""

import csv
import math
import os
import re
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tamiz import queries
from tamiz.functions import skills as k
from tamiz.functions import vocabulary as v
from tamiz.operators import requirements
from tamiz.plans import pipeline, views
from tamiz.sources.offers import AS_OF, OFFERS_SQL, offers

FOLDER = "/root/testdata/sf0.01"
NOW = datetime.fromisoformat(AS_OF)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the data folder")


def found(pattern, t):
    return re.search(pattern, t, re.ASCII) is not None


def norm(s):
    return re.sub("[ \t\n\r\f\v ]+", " ", (s or "").lower().translate(str.maketrans(v.ACCENTED, v.PLAIN))).strip(" ")


def age(s):
    if not s:
        return None
    if s.isdigit():
        return (queries.AS_OF_MS - int(s)) // 86_400_000
    if s == "ayer":
        return 1
    if s.startswith("hace"):
        return 7 * int(s.split()[1])
    at = datetime.strptime(s, "%d/%m/%Y") if "/" in s else datetime.fromisoformat(s)
    return math.floor((NOW - at) / timedelta(days=1))


def amount(s):
    try:
        return float(s.replace(",", "."))
    except ValueError:
        return v.NUMBER_WORDS.get(s)


def months(n, unit):
    return math.floor(n * (1 if unit.startswith("mes") else 6 if unit.startswith("semestre") else 12) + 0.5)


def elsewhere(pre, m, post):
    whole = found(v.COMPANY_ANYWHERE, pre + m + post) or found(v.COMPANY_BEFORE, pre) or found(v.COMPANY_AFTER, post)
    return whole or any(x in pre for x in (*v.AGE_BEFORE, *v.TERM_BEFORE)) or post.lstrip(" ").startswith(v.TERM_AFTER)


def experience(t):
    """(months, top, evidence, kind)."""
    cut = min([i for x in v.PORTAL_FOOTERS if (i := t.find(x)) > 200], default=len(t))
    t = t[:cut].replace("anos", "anios").replace("ano ", "anio ")
    if not t.strip(" "):
        return None, None, None, "NO_MENCIONADA"
    candidates, top = [], None
    for m in re.finditer(v.EXPERIENCE_RANGE, t, re.ASCII):
        pre, post = t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 45]
        low, high = amount(m[1]), amount(m[2])
        if not any(x in pre for x in v.RANGE_BEFORE) and not any(x in post for x in v.RANGE_AFTER) or elsewhere(pre, m[0], post) or low is None or high is None or low > high:
            continue
        if 0 <= months(low, m[3]) <= v.MAX_EXPERIENCE_MONTHS:
            candidates.append((months(low, m[3]), m[0]))
            top = months(high, m[3])
    for pattern in v.EXPERIENCE_PATTERNS:
        for m in re.finditer(pattern, t, re.ASCII):
            pre = re.split("[.;:]", t[max(0, m.start() - 45) : m.start()])[-1]
            n = amount(m[1])
            if n is not None and not elsewhere(pre, m[0], t[m.end() : m.end() + 35]) and 0 <= months(n, m[2]) <= v.MAX_EXPERIENCE_MONTHS:
                candidates.append((months(n, m[2]), m[0]))
    if candidates:
        least, evidence = min(candidates, key=lambda c: c[0])
        return least, top, evidence, "CUANTIFICADA" if least else "NO_REQUERIDA"
    around = lambda m, a, b: t[max(0, m.start() - a) : m.end() + b]
    if any(not any(x in around(m, 60, 40) for x in v.NO_EXPERIENCE_NOISE) for m in re.finditer(v.NO_EXPERIENCE, t, re.ASCII)):
        return 0, None, "sin experiencia requerida", "NO_REQUERIDA"
    if any(not any(x in around(m, 25, 35) for x in v.CUSTOMER_EXPERIENCE) for m in re.finditer(v.UNQUANTIFIED, t, re.ASCII)):
        return None, None, "requerida sin cuantificar", "REQUERIDA_SIN_CUANTIFICAR"
    return None, None, None, "NO_MENCIONADA"


def level(title):
    t = f" {norm(title)} "
    return next((name for name, patterns in (v.SENIORITY[-1], *v.SENIORITY) if any(found(p, t) for p in patterns)), v.NO_SENIORITY)


def clean(url):
    return re.sub("/+$", "", re.sub(r"[?#][\s\S]*$", "", url).strip(" "))


def strip_html(s):
    return re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", s or ""), flags=re.ASCII).strip(" ")


def top_requirements(title, text, n):
    all_found = requirements.find_requirements(title, text)
    children = Counter(r["parent"] for r in all_found if r["parent"])
    kept = [r for r in all_found if children[r["parent"]] < 2 and children[r["name"]] != 1]
    kept.sort(key=lambda r: (-(r["relevance"] + k.CONFIDENCE[r["confidence"]]), r["position"], r["ordinal"]))
    return [r["name"] + (f" {r['level'].capitalize()}" if r["level"] else "") for r in kept[:n]]


def points(t, rules, cap):
    hits = [(p, label) for p, label, words in rules if any(w in t for w in words)]
    return min(sum(p for p, _ in hits), cap), [label for _, label in sorted(hits, key=lambda h: -h[0])]


def match(t, r):
    tools, tool_labels = points(t, v.TOOLS, v.TOOLS_CAP)
    lanes = sorted(((name, *points(t, rules, cap)) for name, cap, rules in v.LANES), key=lambda x: -x[1])
    reasons = tool_labels[:2] + ([lanes[0][0], *lanes[0][2][:2]] if lanes[0][1] else [])
    fit = {"Junior": 8, "Semi Senior": 8, v.NO_SENIORITY: 6, "Practicante": 3}.get(r.seniority, 0)
    m = r.mesesExperiencia
    fit += 10 if r.expTipo == "NO_REQUERIDA" else 4 if m is None else 10 if m <= 12 else 5 if m <= 24 else 0
    fit += 4 if r.modalidad in ("Remoto", "Hibrido") else 2
    asked = found(v.ASKS_CAREER, t)
    reasons += ["Pide ≤ 2 años"] * (m is not None and m <= 24) + ["Pide Ing. Industrial"] * asked + ["Exclusiva Ing. Industrial"] * r.ingIndustrialExclusiva
    less = [
        (10, "Inglés avanzado", "avanzado" in (r.nivelIngles or "").lower() or found(v.HIGH_ENGLISH, t)), (8, "Pide colegiatura/título", found(v.LICENSED, t)), (4, "Pide brevete", found(v.DRIVING, t)),
        (8, "Fuera de Lima", r.zona == "OTRO_DEPARTAMENTO"), (4, "Provincia de Lima", r.zona == "LIMA_PROVINCIAS"), (6, "Régimen atípico", r.trabajoEnCampamento or r.regimenTrabajo is not None),
    ]
    domain = min(lanes[0][1] + int(lanes[1][1] * 0.33), v.DOMAIN_CAP)
    score = tools + domain + min(fit, v.FIT_CAP) + 8 * asked + 4 * r.ingIndustrialExclusiva - sum(p for p, _, when in less if when)
    return min(max(score, 0), 100), [*list(dict.fromkeys(reasons))[:4], *(f"⚠ {label}" for _, label, when in less if when)][:6]


@pytest.fixture(scope="module")
def plain():
    """(accepted: url -> (raw row, experience), rejected: url -> reason) by loops."""
    con = duckdb.connect()
    for name in ("documents", "supplier"):
        con.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    rows = con.sql(OFFERS_SQL)
    rows = [dict(zip(rows.columns, x)) for x in rows.fetchall()]
    accepted, rejected, seen = {}, {}, set()
    for r in sorted(rows, key=lambda r: (r["src_ord"], r["page"], r["item"])):
        if clean(r["url"]) in seen or not r["url"].strip():
            continue
        seen.add(clean(r["url"]))
        days, senior = age(r["fechaPublicacion"]), level(r["puesto"])
        if found(v.TRAINEE_TITLE, norm(r["puesto"])):
            rejected[r["url"]] = "Puesto de practicante"
        elif senior in v.SENIOR_LEVELS:
            rejected[r["url"]] = f"Nivel {senior} en el titulo"
        elif days is not None and days > v.MAX_DAYS:
            rejected[r["url"]] = f"Publicada hace {days} dias"
        else:
            r["descripcion"] = strip_html(r["descripcion"])
            t = norm(r["puesto"] + " " + r["descripcion"])
            exp = experience(t)
            if not found(v.CAREER, t) or found(v.NOT_CAREER, t) and not found(v.CAREER_NAMED, t):
                rejected[r["url"]] = "No menciona Ingenieria Industrial"
            elif (exp[0] or 0) > v.MAX_MONTHS:
                rejected[r["url"]] = f"Pide {exp[0]} meses de experiencia (tope {v.MAX_MONTHS}) — {exp[2]}"
            else:
                accepted[r["url"]] = (r, exp)
    return accepted, rejected, rows


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """The same by Spark, written once."""
    at = str(tmp_path_factory.mktemp("run"))
    accepted, rejected = pipeline.refresh(offers(spark, FOLDER), AS_OF, keep=lambda rows: (rows.write.parquet(f"{at}/gated"), spark.read.parquet(f"{at}/gated"))[1])
    accepted.select(*(c for c in accepted.columns if not c.startswith("_"))).write.parquet(f"{at}/accepted")
    return spark.read.parquet(f"{at}/accepted"), rejected


def test_accepted_and_rejected(run, plain):
    accepted, rejected = run
    assert {r.url: r.motivo for r in rejected.select("url", "motivo").collect()} == plain[1] and len(plain[1]) > 300
    got = {r.url: (r.mesesExperiencia, r.expTipo, r.expEvidencia) for r in accepted.select("url", "mesesExperiencia", "expTipo", "expEvidencia").collect()}
    assert got == {url: (e[0], e[3], e[2] or "") for url, (_, e) in plain[0].items()}


def test_experience_of_every_posting(spark, plain):
    got = {r.doc_id: (r.months_min, r.months_max, r.evidence, r.kind) for r in queries.QUERIES["experience_read"](spark, FOLDER).collect()}
    assert got == {r["doc_id"]: experience(norm(r["puesto"] + " " + r["descripcion"])) for r in plain[2]}


def test_requirements_score_and_reasons(run, plain):
    rows = run[0].collect()
    assert rows and len({r.matchScore for r in rows}) > 3
    for r in rows:
        raw = plain[0][r.url][0]
        assert r.requisitos == "; ".join(top_requirements(raw["puesto"], raw["descripcion"], 6)), r.url
        assert (r.matchScore, r.razones) == match(norm(f"{r.puesto} {r.descripcion} {r.requisitos}"), r), r.url


def test_cards_and_export(run):
    rows = run[0].withColumns({"nuevo": F.lit(True), "estado": F.lit("pendiente")})
    by_url = {r.url: r for r in rows.collect()}
    kind = lambda r: "ATIPICO" if r.regimenTrabajo or r.trabajoEnCampamento else "NO_DETERMINADO" if len(r.descripcion) < v.DETAIL_FROM_CHARS else "ESTANDAR"
    label = lambda m: "Exp. no indicada" if m is None else "Sin exp." if m == 0 else f"{m} meses" if m < 12 else f"{m // 12}+ años" if m % 12 == 0 else f"{m // 12}.{m % 12 * 10 // 12}+ años"
    cards = views.cards(rows).collect()
    assert {c.url for c in cards} == by_url.keys()
    for c in cards:
        r = by_url[c.url]
        assert c.jornada == kind(r) and c.tags == [x.strip() for x in re.split("[;|]", r.requisitos) if x.strip()][:4]
        assert c.experiencia == ("Exp. sin precisar" if r.expTipo == "REQUERIDA_SIN_CUANTIFICAR" else label(r.mesesExperiencia))
        assert c.etiquetaJornada == {"NO_DETERMINADO": "Jornada s/d", "ESTANDAR": None}.get(kind(r), " · ".join(filter(None, [r.regimenTrabajo, "Campamento" if r.trabajoEnCampamento else None])))
    whole = lambda x: "" if x is None else str(int(x))
    for line in views.csv_lines(rows).collect():
        r = by_url[line.url]
        got = dict(zip(views.CSV_HEADER.split(","), next(csv.reader([line.line]))))
        want = {
            "Portal": r.portal, "Puesto": r.puesto, "Empresa": r.empresa, "Ubicacion": r.ubicacion, "Distrito": r.distrito, "Departamento": r.departamento, "Zona": views.ZONE_NAMES.get(r.zona, "Sin ubicación"), "Modalidad": r.modalidad,
            "Jornada": kind(r), "Regimen": r.regimenTrabajo or "", "Campamento": "SI" if r.trabajoEnCampamento else "NO", "Seniority": r.seniority, "ExperienciaTipo": r.expTipo, "ExperienciaMeses": whole(r.mesesExperiencia),
            "ExperienciaEvidencia": r.expEvidencia, "NivelEducativo": r.nivelEducativo, "Ingles": (r.nivelIngles or "Si") if r.requiereIngles else "No", "Salario": r.salario or "", "SalarioMin": whole(r.salarioMin), "SalarioMax": whole(r.salarioMax),
            "Moneda": r.salarioMoneda or "", "Beneficios": " | ".join(r.beneficios), "MatchScore": whole(r.matchScore), "FechaPublicacion": r.fechaPublicacion or "",
            "RequisitosIdentificados": " | ".join(top_requirements(r.puesto, r.descripcion, 10)), "Descripcion": r.descripcion.replace("\r", "").replace("\n", " "), "URL": r.url,
        }
        assert got == want


def naive_requirements(raw):
    """The skills of one text: every pattern over the whole text, character by character."""
    import unicodedata

    def number(m):
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 32 <= code <= 0x2FFF else " "

    for _ in range(2):
        for entity, char in k.ENTITIES.items():
            raw = re.sub(re.escape(entity), lambda _, c=char: c, raw, flags=re.IGNORECASE)
        raw = re.sub(r"&#x([0-9a-fA-F]{1,8});|&#([0-9]{1,9});", number, raw)
    raw = "".join(" " if c == "️" or unicodedata.category(c) in ("So", "Cn") else c for c in raw)
    raw = unicodedata.normalize("NFD", re.sub(k.GLUED, r"\1 \2", raw))
    t = re.sub(r"[ \t]{2,}", " ", re.sub(r"[\r\n]+", "\n", "".join(c for c in raw if unicodedata.category(c) != "Mn"))).lower()
    kinds, kind = [], "INTRO"
    heads = list(re.finditer(rf"¿?\s*\b({k.EXCLUDED_HEADING}|{k.REQUIRED_HEADING}|{k.DUTIES_HEADING}){k.HEADING_TAIL}", t, re.ASCII))
    for m in heads:
        kinds += [kind] * (m.end() - len(kinds))
        kind = next(name for name, p in (("EXCLUIDA", k.EXCLUDED_HEADING), ("REQUISITOS", k.REQUIRED_HEADING), ("FUNCIONES", k.DUTIES_HEADING)) if re.fullmatch(p, m[1], re.ASCII))
    kinds += [kind] * (len(t) + 1 - len(kinds))
    hits = []
    for ordinal, (name, pattern, category, leveled, parent, relevance) in enumerate(requirements.catalogue()):
        for m in pattern.finditer(t):
            if kinds[m.start()] != "EXCLUIDA":
                hits.append((m.start(), ordinal, m.end(), name, category, leveled, parent, relevance))
                break
    hits.sort()
    out, carried, carried_end = [], None, None
    for start, ordinal, end, name, category, leveled, parent, relevance in hits:
        stop = min([len(t), end + k.CHARS_AFTER, *(h[0] for h in hits if h[0] > end)])
        floor = max([0, start - k.CHARS_BEFORE, *[h[2] for h in hits if h[2] <= start][-1:]])
        post, pre = re.split(r"[.;\n]", t[end:stop])[0], re.split(r"[.;\n]", t[floor:start])[-1]
        grade = next((label for label, p in k.LEVELS if found(p, f"{pre} {post}")), None) if leveled else None
        exigency = next((word for w in (post, pre) for word, p in (("DESEABLE", k.DESIRABLE), ("INDISPENSABLE", k.MANDATORY)) if found(p, w)), None)
        if exigency is None and carried and carried_end <= start and re.fullmatch(k.CONNECTOR, t[carried_end:start], re.ASCII):
            exigency = carried
        carried, carried_end = exigency, end
        out.append({"name": name, "category": category, "level": grade, "exigency": exigency or "NO_ESPECIFICADO", "confidence": {"REQUISITOS": "ALTA", "FUNCIONES": "MEDIA"}.get(kinds[start], "BAJA"), "relevance": relevance, "position": start, "parent": parent, "ordinal": ordinal})
    return out


def test_skills_of_every_posting(plain):
    texts = [f"{r['puesto']}. {r['descripcion']}" for r in plain[2]]
    assert requirements.find_all_requirements(texts) == [naive_requirements(t) for t in texts]


def test_requirements_of_categories(spark, plain):
    wanted = ("OFIMATICA", "IDIOMA")
    some = plain[2][:200]
    rows = spark.createDataFrame([(r["doc_id"], r["puesto"], r["descripcion"]) for r in some], "doc_id long, puesto string, descripcion string")
    got = {r.doc_id: r.names for r in rows.select("doc_id", F.transform(requirements.of_categories(requirements.requirements("puesto", "descripcion"), wanted), lambda x: x["name"]).alias("names")).collect()}
    category = {row[0]: row[2] for row in requirements.catalogue()}
    for r in some:
        every = [name for name in top_requirements(r["puesto"], r["descripcion"], None)]
        named = [next(c for c in sorted(category, key=len, reverse=True) if name == c or name.startswith(f"{c} ")) for name in every]
        assert got[r["doc_id"]] == [name for name in named if category[name] in wanted]
