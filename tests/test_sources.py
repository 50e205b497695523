"""Landed pages: cards, their fields, page status and details."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tamiz.sources import html_pages as hp

PAGES = "page int, http_status int, body string"


def test_status_of_every_page(spark):
    card = '<article class="card"><h2><a href="/x">T</a></h2></article>'
    rows = [(0, 200, card), (1, 200, "  \n"), (2, 200, "x" * 1501), (3, 200, "x" * 1500), (4, 999, card), (5, 404, card), (6, 200, None), (7, None, card), (8, 200, "\n" * 2000)]
    got = {r.page: r.page_status for r in hp.page_statuses(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {0: "Ok", 1: "Empty", 2: "Blocked", 3: "Empty", 4: "Blocked", 5: "Error", 6: "Error", 7: "Error", 8: "Empty"}


def test_fields_of_cards(spark):
    body = (
        '<article class="card"><p class="dFlex"><a href="/empresas/acme">Acme</a></p><h2><a href="o/1">Analista Postulado</a></h2><p>4,5 Acme</p><p><span>San Isidro, Lima</span></p>'
        '<p><span class="i_salary"></span>S/ 1,500</p><p>Buscamos una persona ordenada para la planta</p><p>HACE 3 dias se busca gente para la planta</p><span class="tag">Ventas</span><p>Hace 2 dias</p></article>'
        '<article class="card" data-entity-urn="urn:li:jobPosting:42"><h3>Auxiliar</h3></article><article class="card"><h3>Sin enlace</h3></article><article class="card"><h2><a href="/z"> Vista </a></h2></article>'
    )
    rows = hp.listing(spark.createDataFrame([(0, 200, body)], PAGES), "p", "http://j").orderBy("item").collect()
    assert [(r.puesto, r.url, r.empresa, r.ubicacion, r.distrito, r.salario) for r in rows] == [
        ("Analista", "http://j/o/1", "Acme", "San Isidro, Lima", "San Isidro", "S/ 1,500"),
        ("Auxiliar", "http://j/jobs/view/42", "Confidencial", "Lima", "Lima", "No especificado"),
    ]
    assert rows[0].descripcion == "Buscamos una persona ordenada para la planta" and rows[0].fechaPublicacion == "HACE 3 dias se busca gente para la planta"


def test_scan_ends_at_a_page_without_new_ids(spark):
    card = lambda k: f'<article class="card"><h2><a href="/jobs/view/{k}">T{k}</a></h2></article>'
    pages = spark.createDataFrame([(0, 200, card(1) + card(2)), (1, 200, card(2) + card(3)), (2, 200, card(1) + card(3)), (3, 200, card(4))], PAGES)
    cards = hp.listing(pages, "p", "http://j")
    assert sorted(r.job_id for r in cards.collect()) == ["1", "2", "3", "4"]
    assert sorted(r.job_id for r in hp.until_nothing_new(pages, cards).collect()) == ["1", "2", "3"]
    assert hp.until_nothing_new(pages.where("page < 2"), cards.where("page < 2")).count() == 3


def test_details(spark):
    nested = '<div class="menu">aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa</div><div class="bWord"><div>uno</div><p>dos</p> tres<script>no</script></div><div class="job_description">x</div>'
    ld = '<script type="application/ld+json">{"@type": "JobPosting", "description": "<p>del guion</p>"}</script>' + nested
    rows = spark.createDataFrame([("a", nested), ("b", ld), ("c", "nada"), ("d", None), ("e", f'<div class="bWord">{"y" * 7000}</div>')], "url string, html string")
    got = {r.url: r.descripcion for r in hp.detail_texts(rows).collect()}
    assert got.pop("e") == "y" * 6000
    assert got == {"a": "uno dos tres", "b": "del guion", "c": "", "d": ""}
    first = '<div class="show-more-less-html__markup">corto<br>y</div><section class="description">mucho mas largo</section>'
    rows = spark.createDataFrame([("http://j/jobs/view/7", first), ("http://j/jobs/view/7?again", first), ("http://j/none", first), ("http://j/jobs/view/8", ld)], "url string, html string")
    assert {r.job_id: r.descripcion for r in hp.details_by_job(rows).collect()} == {"7": "corto y", "8": "del guion"}


def test_unclosed_tags_lose_no_card(spark):
    one = '<article class="card"><h2><a href="/jobs/view/{0}">Uno {0}</a></h2><p>Acme<p><span>San Isidro, Lima</span><p>Buscamos una persona ordenada para la planta<li>a<li>b{1}'
    closed, left_open = one.format(1, "</article>"), one.format(2, "")
    body = f'<div class="list">{closed}{left_open}{one.format(3, "</b></article>")}</div><p>Lima, fuera'
    rows = hp.listing(spark.createDataFrame([(0, 200, body), (1, 200, '<ul><li><article class="card"><h3>Dos</h3><a href="/jobs/view/9">x<time>ayer</ul><p>Otra, cosa</p>')], PAGES), "p", "http://j").orderBy("page", "item").collect()
    assert [(r.page, r.job_id, r.puesto, r.ubicacion, r.descripcion) for r in rows] == [(0, str(k), f"Uno {k}", "San Isidro, Lima", "Buscamos una persona ordenada para la planta") for k in (1, 2, 3)] + [(1, "9", "Dos", "Lima", "")]
    assert rows[-1].fechaPublicacion == "ayer"


def test_a_script_gives_its_first_posting(spark):
    ld = lambda *texts: '<script type="application/ld+json">[' + ",".join('{"@type": "JobPosting", "description": "%s"}' % t for t in texts) + "]</script>"
    rows = [("a", ld("zz", "aa")), ("b", ld(" ", "aa") + ld("cc", "bb")), ("c", ld("")), ("d", ld("x") + ld("a"))]
    got = {r.url: r.descripcion for r in hp.detail_texts(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"a": "zz", "b": "cc", "c": "", "d": "x"}


def longest_block(html):
    """The longest text of a div, section or p, with all that stands in it, by tokens."""
    import re
    from html import unescape

    void = set("area base br col embed hr img input link meta source track wbr".split())
    html = re.sub(r"(?s)<!--.*?-->|<![^>]*>", "", html or "")
    html = re.sub(r"(?si)<(script|style)\b[^>]*>.*?</\1\s*>", r"<\1></\1>", html)
    blocks, stack = [], []
    for m in re.finditer(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|([^<]+)", html):
        close, tag, text = m[1], (m[2] or "").lower(), m[3]
        piece = unescape(text) if text else " "
        if tag and not close and tag not in void:
            stack.append((tag, len(blocks) if tag in ("div", "section", "p") else None))
            if stack[-1][1] is not None:
                blocks.append([])
        if text or not close or tag in [t for t, _ in stack]:
            for _, at in stack:
                if at is not None:
                    blocks[at].append(piece)
        if close and tag in [t for t, _ in stack]:
            while stack.pop()[0] != tag:
                pass
    texts = [" ".join("".join(b).split()) for b in blocks]
    return max(texts, key=len, default="")[:6000]


def test_details_of_every_page(spark):
    import os

    import pytest

    from tamiz import queries

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the data folder")
    pages = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").select("url", "html").collect():
        pages[r.url] = min((x for x in (pages.get(r.url), r.html) if x is not None), default=None)
    got = {r.url: r.descripcion for r in queries.QUERIES["detail_texts"](spark, folder).collect()}
    assert got == {url: longest_block(html) for url, html in pages.items()} and len(got) > 100


def test_parsed_pages_are_handed_on_in_short_runs(spark):
    """A whole Arrow batch of parsed pages was held at once, up to 10,000 of them."""
    html = "<div><p>a</p><p>bb</p></div>"
    pages = spark.range(100).coalesce(1).select(F.col("id").cast("string").alias("url"), F.when(F.col("id") != 7, html).alias("html"))
    found = hp.with_block(pages, hp.ANY_BLOCK, longest=True)
    assert [r["_block"] for r in found.collect()] == [None if k == 7 else "a bb" for k in range(100)]

    made = []
    hp._with_parsed(SimpleNamespace(schema=[], mapInArrow=lambda f, _: made.append(f)), "html", "x", StringType(), pa.string(), str.upper)
    runs = list(made[0](iter([pa.RecordBatch.from_pydict({"html": ["a"] * 100})])))
    assert [b.num_rows for b in runs] == [32, 32, 32, 4] and runs[0].column("x").to_pylist() == ["A"] * 32
