"""Queries of single steps over all postings: details, links, chips, labels, score, states; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz import oracles
from tamiz.functions import text as tx
from tamiz.functions import vocabulary as v
from tamiz.operators import experience, extract, geo
from tamiz.operators.match import match
from tamiz.plans import pipeline, store, views
from tamiz.plans import rows as rows_of
from tamiz.queries import _html_pages, _json_pages, _stored
from tamiz.sources import html_pages, json_pages
from tamiz.sources.offers import offers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_D = "descripcion"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query
def json_links(spark, sf_dir):
    """Links made of title and id, and descriptions without tags, some of which hold tags."""
    pages = _json_pages(spark, sf_dir).withColumn("body", F.replace("body", F.lit("Requisitos:"), F.lit("<b>Requisitos:</b><br/>")))
    return json_pages.postings(pages, "portal_a", "https://jobs.example.com/o/").select("url", _D)


@query
def card_modes(spark, sf_dir):
    """The mode that a card's whole text tells."""
    pages = _html_pages(spark, sf_dir).withColumn("body", F.replace("body", F.lit("Analista"), F.lit("Analista (trabajo HÍBRIDO o hybrid)"))).withColumn("body", F.replace("body", F.lit("Operario"), F.lit("Operario en teletrabajo")))
    return html_pages.listing(pages, "portal_b", "https://jobs.example.com").select("job_id", "puesto", "modalidad")


@query
def jsonld_extras(spark, sf_dir):
    """Places and months of JSON-LD postings, the months as a number, as text or missing."""
    k = F.col("doc_id")
    city, region = F.get(F.split("ubicacion", ", "), 0), F.get(F.split("ubicacion", ", "), 1)
    asked = F.when(k % 4 == 0, _text('{"monthsOfExperience": ', (k % 50).cast("string"), "}")).when(k % 4 == 1, _text('{"monthsOfExperience": "', (k % 50).cast("string"), '"}')).when(k % 4 == 2, F.lit('{"monthsOfExperience": "mucha"}')).otherwise(F.lit("{}"))
    place = F.to_json(F.struct(F.struct(city.alias("addressLocality"), region.alias("addressRegion")).alias("address")))
    html = _text('<script type="application/ld+json">{"@type": ["Thing", "jobposting"], "description": "<ul><li>a</li></ul>x", "experienceRequirements": ', asked, ', "jobLocation": ', place, "}</script>")
    rows = html_pages.json_ld_postings(offers(spark, sf_dir).select("doc_id", html.alias("html")))
    return rows.select("doc_id", "ubicacion", "meses", F.regexp_replace(_D, "\n", "|").alias("plano"))


@query
def details_longest(spark, sf_dir):
    """The longest marked block of a detail page, cut to 6,000 characters; JSON-LD goes before it."""
    k, title = F.col("doc_id"), F.col("puesto")
    block = lambda tag, css, text: _text(f'<{tag} class="{css}">', text, f"</{tag}>")
    ld = F.when(k % 5 == 0, _text('<script type="application/ld+json">{"@type": "JobPosting", "description": "<p>', title, '</p>"}</script>')).otherwise("")
    body = F.when(k % 7 == 0, F.repeat(_text(title, " "), 500)).otherwise(_text(title, " en <i>", F.col("empresa"), "</i>"))
    html = _text('<div class="otro">', F.repeat(F.lit("z"), 300), "</div>", ld, block("div", "bWord", title), block("section", "a box_detail b", body), block("div", "job_description", F.lit("corto")))
    return html_pages.detail_texts(offers(spark, sf_dir).select(k.cast("string").alias("url"), html.alias("html")))


@query
def chosen_description(spark, sf_dir):
    """Cached descriptions first, then detail pages by link and by job id on two portals, then the posting's own."""
    rows = offers(spark, sf_dir).select("doc_id", "portal", F.concat(F.lit("https://jobs.example.com/jobs/view/"), F.col("doc_id").cast("string")).alias("url"), F.substring(_D, 1, F.lit(300) + F.col("doc_id") % 3 * 100).alias(_D))
    k = F.col("doc_id")
    cached = rows.where(k % 4 == 0).select("url", F.repeat(F.lit("c"), (F.lit(398) + k % 5).cast("int")).alias(_D))
    details = rows.where(k % 3 != 0).select("url", F.when(k % 6 == 1, " ").otherwise(_text("detalle de ", k.cast("string"))).alias(_D))
    by_job = rows.where(k % 2 == 1).select(k.cast("string").alias("job_id"), _text("ficha ", k.cast("string")).alias(_D))
    out = pipeline.choose_description(rows, cached, details, ("portal_a", "portal_b"), by_job)
    return out.select("doc_id", F.sha2(_D, 256).alias("sha"))


@query
def task_order(spark, sf_dir):
    """Three sources in task order, one of which failed; of equal links the first source's stays."""
    rows = offers(spark, sf_dir).drop("src_ord")
    one, two = rows.where("portal != 'portal_a'"), rows.where("portal != 'portal_c'")
    return pipeline.dedupe(pipeline.in_task_order(two, None, one)).select("clean_url", "src_ord", "doc_id")


@query
def tag_chips(spark, sf_dir):
    rows = _stored(spark, sf_dir).withColumn("requisitos", F.concat_ws("; ", "portal", F.lit(""), "estado", F.concat("regimenTrabajo", F.lit(" | turno")), F.lit("ocho"), "url"))
    chips = {c: F.lit("").alias(c) for c in ("puesto", "empresa", "modalidad", "distrito", "departamento", "zona", "salarioMoneda", "salario", "expTipo")}
    rows = rows.select("*", *chips.values(), F.lit(None).cast("double").alias("salarioMin"), F.lit(None).cast("double").alias("salarioMax"), F.lit(True).alias("nuevo"))
    return views.cards(rows).select("url", F.array_join("tags", "/").alias("tags"))


@query
def experience_labels(spark, sf_dir):
    k = F.col("doc_id")
    months = F.when(k % 7 != 0, (k * 5 % 70).cast("int"))
    kind = F.when(k % 5 == 0, "REQUERIDA_SIN_CUANTIFICAR").when(k % 5 == 1, "NO_REQUERIDA").when(k % 5 == 2, "otra").when(k % 11 == 3, None).otherwise("CUANTIFICADA")
    return offers(spark, sf_dir).select("doc_id", experience.experience_label(months, kind).alias("label"))


@query
def match_points(spark, sf_dir):
    """The score of every posting and its reasons, for given level, experience, mode, zone and shift."""
    k = F.col("doc_id")
    given = {
        "seniority": F.when(k % 4 == 0, "Junior").when(k % 4 == 1, "Practicante").when(k % 4 == 2, v.NO_SENIORITY).otherwise("Senior"), "months": F.when(k % 3 != 0, (k % 40).cast("int")),
        "kind": F.when(k % 5 == 0, "NO_REQUERIDA").otherwise("CUANTIFICADA"), "mode": F.col("modalidad"), "industrial_only": k % 6 == 0, "english_level": F.when(k % 8 == 0, "Avanzado").when(k % 8 == 1, "Intermedio"),
        "zone": F.when(k % 9 == 0, "OTRO_DEPARTAMENTO").when(k % 9 == 1, "LIMA_PROVINCIAS").otherwise("CALLAO"), "shift": F.when(k % 10 == 0, "14x7"), "camp": k % 15 == 0,
    }
    rows = offers(spark, sf_dir).select("doc_id", match(tx.norm(F.concat_ws(" ", "puesto", _D)), given).alias("m"))
    return rows.select("doc_id", "m.score", F.array_join("m.reasons", " / ").alias("reasons"))


@query
def stored_urls(spark, sf_dir):
    return store.urls(_stored(spark, sf_dir))


@query
def changed_states(spark, sf_dir):
    """One posting applied to, one whose application is taken back, one discarded; all are in every data folder."""
    at = "https://jobs.example.com/o/"
    rows = store.apply_or_undo(store.apply_or_undo(store.discard(_stored(spark, sf_dir), f"{at}12"), f"{at}11"), f"{at}17")
    return rows.select("url", "estado")


@query
def stored_rows(spark, sf_dir):
    """Postings in the store's flat form and back: the text and the number of their benefits, defaults and names of what isn't known."""
    k = F.col("doc_id")
    rows = offers(spark, sf_dir).select("url", "puesto", "portal", extract.benefits(_D).alias("beneficios"), F.when(k % 3 == 0, "CALLAO").when(k % 3 == 1, "otra").alias("zona"), F.when(k % 2 == 0, 900.5).alias("salarioMin"))
    flat = rows_of.to_stored(rows)
    back = rows_of.to_offer(flat).select("url", F.size("beneficios").alias("n_benefits"))
    return flat.select("url", "puesto", "empresa", "zona", "expTipo", "estado", "nuevo", "matchScore", "salarioMin", "beneficios").join(back, "url")


@query
def plain_html(spark, sf_dir):
    """Pages with every tag as a space."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", tx.strip_html("html").alias("plain"))


@query
def card_places(spark, sf_dir):
    place = geo.split_location("ubicacion")
    rows = offers(spark, sf_dir).select("doc_id", geo.shown_department(place).alias("department"), geo.short_location(geo.shown_district("ubicacion"), geo.shown_department(place), geo.zone(place)).alias("shown"))
    return rows


def _sql() -> dict[str, str]:
    o, n, has = oracles.O, oracles.n, oracles.has
    t = n(f"o.puesto || ' ' || {oracles.D}")

    def rules(alias: str, spec, cap: int) -> str:
        """Points and the labels by points, of equal ones in order."""
        total = " + ".join(f"CASE WHEN {has('t', words)} THEN {p} ELSE 0 END" for p, _, words in spec)
        labels = ", ".join(f"CASE WHEN {has('t', words)} THEN '{label}' END" for p, label, words in sorted(spec, key=lambda r: -r[0]))
        return f"least({total}, {cap}) AS {alias}_p, list_filter([{labels}], lambda x: x IS NOT NULL) AS {alias}_l"

    lanes = ", ".join(rules(f"lane{i}", spec, cap) for i, (_, cap, spec) in enumerate(v.LANES))
    ranked = "list_sort([" + ", ".join(f"{{'p': -lane{i}_p, 'i': {i}, 'name': '{name}', 'l': lane{i}_l}}" for i, (name, _, _) in enumerate(v.LANES)) + "])"
    licensed = f"(regexp_matches(t, '{v.LICENSED.rpartition('|')[0]}') OR len(regexp_extract_all(t, 'titulado')) > len(regexp_extract_all(t, 'titulado\\s*y/?o')))"
    less = [
        (10, "Inglés avanzado", f"(doc_id % 8 = 0 OR regexp_matches(t, '{v.HIGH_ENGLISH}'))"), (8, "Pide colegiatura/título", licensed), (4, "Pide brevete", f"regexp_matches(t, '{v.DRIVING}')"),
        (8, "Fuera de Lima", "doc_id % 9 = 0"), (4, "Provincia de Lima", "doc_id % 9 = 1"), (6, "Régimen atípico", "(doc_id % 10 = 0 OR doc_id % 15 = 0)"),
    ]
    months = "CASE WHEN doc_id % 3 <> 0 THEN doc_id % 40 END"
    points = f"""{o}, a AS (SELECT doc_id, modalidad, {t} AS t FROM o), b AS (SELECT *, {rules('tool', v.TOOLS, v.TOOLS_CAP)}, {lanes}, regexp_matches(t, '{v.ASKS_CAREER}') AS asked, {months} AS m FROM a),
      c AS (SELECT *, {ranked} AS r FROM b),
      d AS (SELECT *, -r[1].p AS best, least(-r[1].p + floor(-r[2].p * 0.33)::INTEGER, {v.DOMAIN_CAP}) AS domain,
        least(CASE doc_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 10 WHEN m IS NULL THEN 4 WHEN m <= 12 THEN 10 WHEN m <= 24 THEN 5 ELSE 0 END + CASE WHEN modalidad IN ('Remoto', 'Hibrido') THEN 4 ELSE 2 END, {v.FIT_CAP}) AS fit,
        {' + '.join(f"CASE WHEN {when} THEN {p} ELSE 0 END" for p, _, when in less)} AS minus, list_filter([{', '.join(f"CASE WHEN {when} THEN '⚠ {label}' END" for _, label, when in less)}], lambda x: x IS NOT NULL) AS alerts,
        list_concat(tool_l[1:2], CASE WHEN r[1].p < 0 THEN list_concat([r[1].name], r[1].l[1:2]) ELSE [] END, CASE WHEN m <= 24 THEN ['Pide ≤ 2 años'] ELSE [] END, CASE WHEN asked THEN ['Pide Ing. Industrial'] ELSE [] END, CASE WHEN doc_id % 6 = 0 THEN ['Exclusiva Ing. Industrial'] ELSE [] END) AS why FROM c)
      SELECT doc_id, greatest(least(tool_p + domain + fit + CASE WHEN asked THEN 8 ELSE 0 END + CASE WHEN doc_id % 6 = 0 THEN 4 ELSE 0 END - minus, 100), 0)::INTEGER AS score,
        array_to_string(list_concat(list_filter(why, lambda x, i: list_position(why, x) = i)[1:4], alerts)[1:6], ' / ') AS reasons FROM d"""
    benefits = f"concat_ws('|', {', '.join(f"CASE WHEN {has(n(oracles.D), words)} THEN '{label}' END" for label, words in v.BENEFITS)})"
    slug = "regexp_replace(regexp_replace(lower(puesto), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    label = "CASE WHEN m < 12 THEN m || ' meses' WHEN m % 12 = 0 THEN m // 12 || '+ años' ELSE m // 12 || '.' || m % 12 * 10 // 12 || '+ años' END"
    flat = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gi'), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', '  ', 'g')"
    flat = f"regexp_replace(regexp_replace({flat}, '<(?:br|p|li|div|tr|h1|h2|h3)(?:[ /][^>]*)?>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        flat = f"replace({flat}, '{entity}', '{char}')"
    return {
        "html_pages_text": rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split({flat}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS plain FROM pages",
        "json_links": f"""{o} SELECT 'https://jobs.example.com/o/' || {slug} || '-' || doc_id || '.html' AS url, trim(regexp_replace(replace(descripcion, 'Requisitos:', '<b>Requisitos:</b><br/>'), '<[^>]+>', ' ', 'g')) AS descripcion FROM o""",
        "card_modes": f"""{o}, c AS (SELECT lpad(doc_id::VARCHAR, 9, '1') AS k, page, replace(replace(puesto, 'Analista', 'Analista (trabajo HÍBRIDO o hybrid)'), 'Operario', 'Operario en teletrabajo') AS puesto, doc_id FROM o WHERE {oracles.PAGE_STATUS} = 'Ok')
            SELECT k AS job_id, puesto, CASE WHEN puesto LIKE '%teletrabajo%' THEN 'Remoto' WHEN puesto LIKE '%hybrid%' THEN 'Hibrido' ELSE 'Presencial' END AS modalidad FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY page, doc_id) = 1""",
        "jsonld_extras": f"""{o} SELECT doc_id, CASE ubicacion WHEN 'Arequipa, Arequipa' THEN 'Arequipa' WHEN 'Lima, Lima Province, Peru' THEN 'Lima, Lima Province' ELSE ubicacion END AS ubicacion, CASE WHEN doc_id % 4 < 2 THEN (doc_id % 50)::INTEGER END AS meses, 'a x' AS plano FROM o""",
        "details_longest": f"""{o} SELECT doc_id::VARCHAR AS url, CASE WHEN doc_id % 5 = 0 THEN puesto WHEN doc_id % 7 = 0 THEN substr(rtrim(repeat(puesto || ' ', 500)), 1, 6000) ELSE puesto || ' en ' || empresa END AS descripcion FROM o""",
        "chosen_description": f"""{o}, a AS (SELECT doc_id, portal, substr(descripcion, 1, (300 + doc_id % 3 * 100)::INTEGER) AS own FROM o)
            SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 AND 398 + doc_id % 5 >= 400 THEN repeat('c', 398 + doc_id % 5) WHEN portal <> 'portal_c' AND length(own) < 400 THEN
              CASE WHEN doc_id % 3 <> 0 AND doc_id % 6 <> 1 THEN 'detalle de ' || doc_id WHEN doc_id % 2 = 1 THEN 'ficha ' || doc_id ELSE own END ELSE own END) AS sha FROM a""",
        "task_order": f"""{o}, a AS (SELECT *, 0 AS ord FROM o WHERE portal <> 'portal_c' UNION ALL SELECT *, 2 FROM o WHERE portal <> 'portal_a')
            SELECT {oracles.URL.replace('o.url', 'url')} AS clean_url, ord AS src_ord, doc_id FROM a QUALIFY row_number() OVER (PARTITION BY 1 ORDER BY ord, page, item) = 1""".replace("PARTITION BY 1", f"PARTITION BY {oracles.URL.replace('o.url', 'url')}"),
        "tag_chips": f"""{oracles.STORED} SELECT url, array_to_string((list_filter([portal, estado, CASE WHEN doc_id % 6 = 0 THEN '14x7' END, CASE WHEN doc_id % 6 = 0 THEN 'turno' END, 'ocho', url], lambda x: x IS NOT NULL))[1:4], '/') AS tags FROM s""",
        "experience_labels": f"""{o}, a AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id * 5 % 70 END AS m FROM o)
            SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Exp. sin precisar' WHEN doc_id % 5 = 1 THEN 'Sin exp.' WHEN doc_id % 5 = 2 OR doc_id % 11 = 3 OR m IS NULL THEN 'Exp. no indicada' WHEN m = 0 THEN 'Sin exp.' ELSE {label} END AS label FROM a""",
        "match_points": points,
        "stored_rows": f"""{o}, a AS (SELECT *, {benefits} AS b FROM o) SELECT url, puesto, '' AS empresa, CASE WHEN doc_id % 3 = 0 THEN 'CALLAO' ELSE 'DESCONOCIDA' END AS zona, 'NO_MENCIONADA' AS "expTipo", 'pendiente' AS estado, true AS nuevo, 0::INTEGER AS "matchScore",
            CASE WHEN doc_id % 2 = 0 THEN 900.5::DOUBLE END AS "salarioMin", b AS beneficios, CASE WHEN b = '' THEN 0 ELSE len(string_split(b, '|')) END::INTEGER AS n_benefits FROM a""",
        "plain_html": r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages",
        "card_places": f"""{o} SELECT doc_id, CASE WHEN ubicacion LIKE '%Lima%' THEN 'Lima' WHEN ubicacion LIKE '%Callao' THEN 'Callao' WHEN ubicacion LIKE 'Arequipa%' THEN 'Arequipa' WHEN ubicacion LIKE 'Trujillo%' THEN 'La Libertad' END AS department,
            CASE ubicacion WHEN 'San Isidro, Lima' THEN 'San Isidro' WHEN 'Huaral, Lima' THEN 'Huaral, Lima' WHEN 'Arequipa, Arequipa' THEN 'Arequipa' WHEN '' THEN 'Sin especificar' WHEN 'Bellavista, Callao' THEN 'Bellavista' WHEN 'Lima, Lima Province, Peru' THEN 'Lima' ELSE 'Trujillo, La Libertad' END AS shown FROM o""",
        "stored_urls": f"{oracles.STORED} SELECT url FROM s",
        "changed_states": f"""{oracles.STORED} SELECT url, CASE WHEN url LIKE '%/o/12' THEN 'descartada' WHEN url LIKE '%/o/11' OR url LIKE '%/o/17' THEN CASE WHEN estado = 'postulada' THEN 'pendiente' ELSE 'postulada' END ELSE estado END AS estado FROM s""",
    }


ORACLES = _sql()
