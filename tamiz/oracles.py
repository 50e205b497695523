"""The same results in plain SQL, for comparison. Formulas are written on their own; only fixed word lists are shared."""

from __future__ import annotations

from tamiz.functions import vocabulary as v
from tamiz.sources.offers import OFFERS_SQL

O = f"WITH o AS ({OFFERS_SQL})"
MS, DAY = 1784548800000, 86400000
D = "o.descripcion"


def n(x: str) -> str:
    return rf"trim(regexp_replace(translate(lower(coalesce({x}, '')), '{v.ACCENTED}', '{v.PLAIN}'), '[\s\x{{00A0}}]+', ' ', 'g'))"


def has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def pick(x: str, groups, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(x, words)} THEN '{label}'" for label, words in groups) + f" ELSE {otherwise} END"


def short(x: str) -> str:
    """1500 as 1.5k, 2000 as 2k, 900 as it is."""
    return f"CASE WHEN {x} < 1000 THEN CAST(trunc({x}) AS INTEGER)::VARCHAR WHEN {x} % 1000 = 0 THEN CAST(trunc({x} / 1000) AS INTEGER)::VARCHAR || 'k' ELSE printf('%.1fk', {x} / 1000) END"


def whole(x: str) -> str:
    return f"CAST(trunc({x}) AS INTEGER)"


URL = r"regexp_replace(trim(regexp_replace(o.url, '[?#].*$', '')), '/+$', '')"
DEDUPED = f"{O}, u AS (SELECT * FROM (SELECT o.*, {URL} AS clean_url, row_number() OVER (PARTITION BY {URL} ORDER BY src_ord, page, item) AS rn FROM o) WHERE rn = 1)"

AGE = """CASE WHEN o."fechaPublicacion" = '' THEN NULL
  WHEN regexp_matches(o."fechaPublicacion", '^[0-9]{12,}$') THEN CAST(trunc((%d - CAST(o."fechaPublicacion" AS BIGINT)) / 86400000.0) AS INTEGER)
  WHEN o."fechaPublicacion" LIKE 'hace %% semanas' THEN 7 * CAST(split_part(o."fechaPublicacion", ' ', 2) AS INTEGER)
  WHEN o."fechaPublicacion" = 'ayer' THEN 1
  WHEN o."fechaPublicacion" LIKE '__/__/____' THEN CAST(trunc((%d - epoch_ms(strptime(o."fechaPublicacion", '%%d/%%m/%%Y'))) / 86400000.0) AS INTEGER)
  ELSE CAST(trunc((%d - epoch_ms(CAST(replace(o."fechaPublicacion", 'T', ' ') AS TIMESTAMP))) / 86400000.0) AS INTEGER) END""" % (MS, MS, MS)

SENIORITY_NAMES = [(label, [p for p in patterns]) for label, patterns in v.SENIORITY]


def seniority(title: str) -> str:
    t = f"replace(' ' || {n(title)} || ' ', 'semi senior', 'semisenior')"
    ordered = [SENIORITY_NAMES[-1], *SENIORITY_NAMES]
    cases = " ".join(f"WHEN regexp_matches({t}, '{'|'.join(p.replace('(?<!semi )', '') for p in patterns)}') THEN '{label}'" for label, patterns in ordered)
    return f"CASE {cases} ELSE '{v.NO_SENIORITY}' END"


ZONE = "CASE WHEN o.ubicacion = '' THEN 'DESCONOCIDA' WHEN o.ubicacion LIKE '%Callao' THEN 'CALLAO' WHEN o.ubicacion LIKE 'Huaral%' THEN 'LIMA_PROVINCIAS' WHEN o.ubicacion LIKE '%Lima%' THEN 'LIMA_METROPOLITANA' ELSE 'OTRO_DEPARTAMENTO' END"
SHIFT_FOUND = r"regexp_matches(" + n(D) + r", '(^|[^0-9.,])14x7($|[^0-9])')"
CAMP = f"({has(n(D), v.CAMP_WORDS)} OR {SHIFT_FOUND})"

PAGE_STATUS = "CASE WHEN page % 10 = 3 THEN 'Blocked' WHEN page % 10 = 5 THEN 'Error' WHEN page % 20 = 7 THEN 'Blocked' WHEN page % 20 = 17 THEN 'Empty' ELSE 'Ok' END"

STORED = f"""{DEDUPED}, s AS (SELECT doc_id, clean_url AS url, portal, descripcion,
  CASE WHEN doc_id % 5 = 0 THEN 'descartada' WHEN doc_id % 5 = 1 THEN 'postulada' ELSE 'pendiente' END AS estado,
  CAST(CASE WHEN doc_id % 9 = 0 THEN 0 ELSE {MS} - (doc_id % 90) * {DAY} END AS BIGINT) AS "fechaEpoch", CAST(doc_id * 37 % 101 AS INTEGER) AS "matchScore",
  CAST(CASE WHEN doc_id % 4 <> 0 THEN doc_id * 7 % 60 END AS INTEGER) AS "mesesExperiencia", doc_id % 6 = 0 OR doc_id % 8 = 0 AS odd FROM u)"""


def sql() -> dict[str, str]:
    t = n(D)
    amounts = lambda pattern, low, high: f"list_filter(list_transform(regexp_extract_all({t}, '{pattern}', 1), lambda x: CAST(regexp_replace(x, '[.,]', '', 'g') AS DOUBLE)), lambda x: x BETWEEN {low} AND {high})"
    soles, dollars = amounts(v.SOLES, *v.SOLES_RANGE), amounts(v.DOLLARS, *v.DOLLARS_RANGE)
    spoken = has(t, v.SALARY_WORDS)
    pay = f"CASE WHEN {spoken} THEN CASE WHEN len({soles}) > 0 THEN {soles} WHEN len({dollars}) > 0 THEN {dollars} END END"
    both = n(f"o.puesto || ' ' || {D}")
    english = pick(t, v.ENGLISH, rf"CASE WHEN regexp_matches({t}, '\bingles\b') THEN 'Mencionado sin nivel' END")
    by_title = "CASE " + " ".join(rf"WHEN regexp_matches({n('c.puesto')}, '\b({'|'.join(words)})\b') THEN '{label}'" for label, words in v.AREAS_BY_TEXT) + f" ELSE '{v.DEFAULT_AREA}' END"
    by_text = "CASE " + " ".join(rf"WHEN regexp_matches({both}, '\b({'|'.join(words)})\b') THEN '{label}'" for label, words in v.AREAS_BY_TEXT) + f" ELSE '{v.DEFAULT_AREA}' END"
    return {
        "text_norm": f"{O} SELECT doc_id, {n(f"o.puesto || ' ' || {D}")} AS norm_text FROM o",
        "company_key": f"{O} SELECT doc_id, regexp_replace(lower(empresa), '[^a-z0-9]', '', 'g') AS company_key, regexp_replace(lower(empresa), '[^a-z0-9]', '', 'g') AS raw_key FROM o",
        "location_key": rf"{O} SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace({n('o.ubicacion')}, '.', ''), ',', ''), '\b(peru|lima metropolitana|provincia de|distrito de|region)\b', ' ', 'g'), '\s+', ' ', 'g')) AS location_key FROM o",
        "title_case": f"{O} SELECT doc_id, CASE WHEN puesto = 'ASISTENTE DE PLANEAMIENTO' THEN 'Asistente de Planeamiento' ELSE puesto END AS title FROM o",
        "days_since": f"{O}, a AS (SELECT doc_id, {AGE} AS days FROM o) SELECT doc_id, days, coalesce({MS} - CAST(days AS BIGINT) * {DAY}, 0) AS epoch FROM a",
        "salary": f"{O}, a AS (SELECT doc_id, {pay} AS p, {spoken} AND len({soles}) > 0 AS pen FROM o) SELECT doc_id, list_min(p) AS salary_min, list_max(p) AS salary_max, CASE WHEN p IS NULL THEN NULL WHEN pen THEN 'PEN' ELSE 'USD' END AS currency FROM a",
        "education": f"{O} SELECT doc_id, {pick(t, v.EDUCATION, "'No especificado'")} AS education FROM o",
        "english": f"{O}, a AS (SELECT doc_id, {english} AS level FROM o) SELECT doc_id, level IS NOT NULL AS required, level FROM a",
        "exclusivity": rf"{O} SELECT doc_id, NOT (regexp_matches({both}, '\b(y/?o\s*afines|carreras\s+afines|o\s+afines|y\s+afines)\b') OR {has(both, v.OTHER_CAREERS)}) AS only_industrial FROM o",
        "benefits": f"{O} SELECT doc_id, concat_ws('|', {', '.join(f"CASE WHEN {has(t, words)} THEN '{label}' END" for label, words in v.BENEFITS)}) AS benefits FROM o",
        "area": f"{O} SELECT doc_id, CASE WHEN area <> '' THEN {pick(n('o.area'), v.AREAS_BY_PORTAL, 'trim(area)')} ELSE {by_text} END AS area_label FROM o",
        "work_mode": f"{O} SELECT doc_id, CASE WHEN {has(t, v.ON_SITE)} THEN 'Presencial' WHEN modalidad = 'Remoto' OR {has(t, v.REMOTE)} THEN 'Remoto' WHEN modalidad = 'Hibrido' OR {has(t, v.HYBRID)} THEN 'Hibrido' ELSE 'Presencial' END AS mode FROM o",
        "location_parts": f"{O} SELECT doc_id, CASE WHEN ubicacion = '' THEN NULL WHEN ubicacion LIKE 'Arequipa%' OR ubicacion LIKE 'Lima,%' THEN NULL ELSE {n("split_part(o.ubicacion, ',', 1)")} END AS district, CASE WHEN ubicacion = '' THEN NULL WHEN ubicacion LIKE '%Peru' THEN 'lima' ELSE {n("split_part(o.ubicacion, ',', -1)")} END AS department, CASE WHEN ubicacion = '' THEN 'Sin especificar' ELSE trim(split_part(ubicacion, ',', 1)) END AS shown FROM o",
        "work_regime": f"{O} SELECT doc_id, CASE WHEN {SHIFT_FOUND} THEN '14x7' END AS shift, {CAMP} AS camp FROM o",
        "shift_label": f"{O} SELECT doc_id, CASE WHEN {CAMP} THEN 'ATIPICO' WHEN length({D}) < 400 THEN 'NO_DETERMINADO' ELSE 'ESTANDAR' END AS kind FROM o",
        "shift_text": f"{O} SELECT doc_id, CASE WHEN {CAMP} THEN concat_ws(' · ', CASE WHEN {SHIFT_FOUND} THEN '14x7' END, CASE WHEN {CAMP} THEN 'Campamento' END) WHEN length({D}) < 400 THEN 'Jornada s/d' END AS shown FROM o",
        "stored_count": f"{STORED} SELECT count(*) AS n FROM s",
        "html_page_status": f"{O}, p AS (SELECT page, count(*) AS n FROM o GROUP BY page) SELECT page, {PAGE_STATUS} AS page_status, CAST(CASE WHEN page % 20 IN (7, 17) THEN 0 ELSE n END AS INTEGER) AS n_cards FROM p",
        "html_listing": f"""{O}, c AS (SELECT o.*, trim(split_part(ubicacion, ',', 1)) AS d, lpad(doc_id::VARCHAR, 9, '1') AS k FROM o WHERE {PAGE_STATUS} = 'Ok')
            SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY doc_id) - 1 AS INTEGER) AS item, 'Ok' AS page_status, puesto, 'https://jobs.example.com' || CASE WHEN doc_id % 4 = 0 THEN '/jobs/view/' ELSE '/o/x-' END || k AS url,
            empresa, CASE WHEN ubicacion = '' THEN 'Lima' ELSE ubicacion END AS ubicacion, CASE WHEN d = '' THEN 'Lima' ELSE d END AS distrito, CASE WHEN salario = '' THEN 'No especificado' ELSE salario END AS salario,
            CASE WHEN area <> '' THEN {pick(n('c.area'), v.AREAS_BY_PORTAL, 'trim(area)')} ELSE {by_title} END AS area, "fechaPublicacion", k AS job_id FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY page, doc_id) = 1""",
        "details_by_job": f"{O} SELECT doc_id::VARCHAR AS job_id, puesto || ' en ' || empresa AS descripcion FROM o",
        "career_gate": f"{O} SELECT doc_id, regexp_matches({both}, '{v.CAREER}') AND NOT (regexp_matches({both}, '{v.NOT_CAREER}') AND NOT regexp_matches({both}, '{v.CAREER_NAMED}')) AS career FROM o",
        # The place is normalised once for each of its spellings.
        "district_center": f"{O}, g(name, lat) AS (VALUES {', '.join(f"('{k}', {lat}::DOUBLE)" for k, (lat, _) in v.DISTRICTS.items())}), w AS MATERIALIZED (SELECT DISTINCT ubicacion FROM o), x AS MATERIALIZED (SELECT ubicacion, {n('w.ubicacion')} AS p FROM w), m AS MATERIALIZED (SELECT x.ubicacion, arg_min(g.name, (-length(g.name), g.name)) AS name, arg_min(g.lat, (-length(g.name), g.name)) AS lat FROM x JOIN g ON contains(x.p, g.name) GROUP BY 1) SELECT o.doc_id, m.name, m.lat FROM o LEFT JOIN m ON o.ubicacion = m.ubicacion",
        "salary_label": f"""{O}, a AS (SELECT doc_id, salario, {pay} AS p, CASE WHEN {spoken} AND len({soles}) > 0 THEN 'PEN' ELSE 'USD' END AS cur FROM o), b AS (SELECT *, list_min(p) AS lo, list_max(p) AS hi FROM a)
            SELECT doc_id, CASE WHEN hi > lo THEN cur || ' ' || {short('lo')} || ' – ' || {short('hi')} WHEN lo IS NOT NULL THEN 'Desde ' || cur || ' ' || {short('lo')} WHEN trim(salario) <> '' AND NOT lower(salario) LIKE '%no especificado%' THEN salario END AS label FROM b""",
        "job_ids": f"{O} SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN right('77777777' || doc_id::VARCHAR, 8) END AS job_id FROM o",
        "stated_modes": f"{O} SELECT CASE WHEN modalidad = '' THEN 'Presencial' ELSE modalidad END AS mode, count(*) AS n FROM o GROUP BY 1",
        "url_dedupe": f"{DEDUPED} SELECT doc_id, clean_url FROM u",
        "portal_counts": f"{DEDUPED} SELECT portal, count(*) AS n FROM u GROUP BY portal",
        "distinct_portals": f"{O} SELECT DISTINCT portal FROM o ORDER BY portal",
        "seniority_hist": f"{O} SELECT {seniority('o.puesto')} AS seniority, count(*) AS n FROM o GROUP BY 1",
        "prefilter_reasons": f"{DEDUPED}, a AS (SELECT o.doc_id, o.puesto, {seniority('o.puesto')} AS s, {AGE} AS days FROM u o) SELECT doc_id, CASE WHEN regexp_matches({n('puesto')}, '{v.TRAINEE_TITLE}') THEN 'Puesto de practicante' WHEN s IN ('Dirección', 'Gerencia', 'Jefatura', 'Supervisión', 'Senior') THEN 'Nivel ' || s || ' en el titulo' WHEN days > 30 THEN 'Publicada hace ' || days || ' dias' END AS motivo FROM a",
        "zone_counts": f"{O} SELECT {ZONE} AS zona, count(*) AS n FROM o GROUP BY 1",
        "facet_filter": f"{O} SELECT * FROM (SELECT doc_id, {ZONE} AS zona, modalidad FROM o) WHERE zona IN ('LIMA_METROPOLITANA', 'CALLAO') AND modalidad IN ('Remoto', 'Hibrido')",
        "skill_counts": rf"{O}, a AS (SELECT regexp_replace({both}, '(beneficios[^:.\n]{{0,32}}:).*$', '\1') AS t FROM o) SELECT * FROM (SELECT 'Excel' AS skill, count(*) AS n FROM a WHERE regexp_matches(t, '\bexcel\b') UNION ALL SELECT 'Power BI', count(*) FROM a WHERE regexp_matches(t, '\bpower\s*bi\b') UNION ALL SELECT 'Python', count(*) FROM a WHERE regexp_matches(t, '\bpython\b') UNION ALL SELECT 'KPIs', count(*) FROM a WHERE regexp_matches(t, '\bkpis?\b')) WHERE n > 0",
        "live_list": f"""{STORED} SELECT url, "matchScore" FROM s WHERE estado <> 'descartada' ORDER BY "matchScore" DESC, url""",
        "discarded_count": f"{STORED} SELECT count(*) AS n FROM s WHERE estado = 'descartada'",
        "restored_states": f"{STORED} SELECT CASE WHEN estado = 'postulada' THEN estado ELSE 'pendiente' END AS estado, count(*) AS n FROM s GROUP BY 1",
        "stored_states": f"{STORED} SELECT url, estado FROM s WHERE estado <> 'pendiente'",
        "purge_old": f"""{STORED} SELECT url FROM s WHERE "fechaEpoch" = 0 OR "fechaEpoch" >= {MS - 30 * DAY} OR estado = 'postulada'""",
        "cached_descriptions": f"{STORED} SELECT url, descripcion FROM s WHERE length(descripcion) >= 400",
        "new_offers": f"{STORED} SELECT url, portal = 'portal_c' AS nuevo, CASE WHEN portal <> 'portal_c' THEN estado ELSE 'pendiente' END AS estado FROM s",
        "upsert_merge": f"""{STORED} SELECT url, CASE WHEN portal <> 'portal_c' THEN estado ELSE 'pendiente' END AS estado, CAST("matchScore" + CASE WHEN portal <> 'portal_a' THEN 2 ELSE 0 END AS INTEGER) AS "matchScore", doc_id, portal FROM s""",
        "sort_recent": f"""{STORED} SELECT url, "fechaEpoch", "matchScore" FROM s ORDER BY 2 DESC, 3 DESC, 1""",
        "sort_least_experience": f"""{STORED} SELECT url, "mesesExperiencia", "matchScore" FROM s ORDER BY 2 NULLS LAST, 3 DESC, 1""",
        "tab_counts": f"{STORED} SELECT CASE WHEN odd THEN 'atipico' ELSE 'estandar' END AS tab, count(*) AS n FROM s GROUP BY 1",
        "json_items": f"""{O} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY doc_id) - 1 AS INTEGER) AS item, puesto, CASE WHEN doc_id % 13 = 0 THEN 'Confidencial' ELSE empresa END AS empresa,
            CASE WHEN ubicacion = '' THEN 'Lima' WHEN ubicacion LIKE 'Arequipa%' THEN 'Arequipa' WHEN ubicacion LIKE '%Peru' THEN 'Lima, Lima Province' ELSE ubicacion END AS ubicacion,
            CASE WHEN modalidad = '' THEN 'Presencial' ELSE modalidad END AS modalidad, CASE WHEN doc_id % 3 = 1 THEN 'S/ 1500 - 2500' ELSE 'No especificado' END AS salario,
            CASE WHEN doc_id % 2 = 0 THEN 'Operaciones' ELSE 'Ventas' END AS area, "fechaPublicacion" FROM o""",
        "page_cutoff": f"""{O}, a AS (SELECT doc_id, portal, page, item, {AGE} AS age FROM o), p AS (SELECT portal, page, max_by(age, item) FILTER (WHERE age IS NOT NULL) > 30 AS old FROM a GROUP BY 1, 2),
            q AS (SELECT portal, page, coalesce(bool_or(old) OVER (PARTITION BY portal ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM p)
            SELECT a.doc_id, a.portal, a.page FROM a JOIN q USING (portal, page) WHERE NOT stopped AND (age IS NULL OR age <= 30)""",
        "jsonld_postings": f"""{O} SELECT doc_id, puesto AS descripcion, "fechaPublicacion", empresa FROM o""",
    }
