"""Landed HTML pages: listing cards, page status, detail texts and JSON-LD postings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from tamiz.functions.text import nonblank, norm, text
from tamiz.operators.extract import area

DETAIL_CHARS, SOFT_BLOCK_CHARS, BLOCKED = 6000, 1500, (403, 429, 999)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Spelled out, since workers import this module without a session that could parse a string.
_CARD = ArrayType(StructType([StructField(n, ArrayType(StringType()) if n in ("dates", "paragraphs", "texts") else StringType()) for n in "title href id company salary area dates paragraphs texts whole".split()]))
_ARROW_CARD = pa.list_(pa.struct([(f.name, pa.list_(pa.string()) if isinstance(f.dataType, ArrayType) else pa.string()) for f in _CARD.elementType.fields]))
#: Where the details of the two portals stand, as (tag or none, class, whether a part of the class suffices).
LONGEST_OF = (("div", "bWord", False), ("div", "box_detail", False), ("section", "box_detail", False), ("div", "description", True))
FIRST_OF = (("div", "show-more-less-html__markup", False), ("div", "description__text", False), ("section", "description", False), ("", "decorated-job-posting__details", False))
#: Any block, for pages of no known portal.
ANY_BLOCK = (("div", "", True), ("section", "", True), ("p", "", True))


#: Elements that end an open paragraph, and elements that end an open one of their own kind.
_ENDS_P = set("address article aside blockquote dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
_ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements beyond which an end tag that HTML lets one leave out isn't supplied.
_P_SCOPE, _OWN_SCOPE = {"table", "td", "th", "button"}, {"table", "ul", "ol", "dl", "select", "section", "article"}


class _Cards(HTMLParser):
    """Collects, of every element whose tag and class mark a card, its texts, links and marked fields.

    An end tag closes all that was left open inside its element and is passed over if nothing matches; a card also ends where the next
    one begins, where an element around it ends and at the end of the page.
    """

    def __init__(self, tag: str, marker: str):
        super().__init__(convert_charrefs=True)
        #: stack: [tag, text, field] of the open elements; from ``base`` on they belong to the open card.
        self.tag, self.marker, self.cards, self.stack, self.base, self.outer_pay = tag, marker, [], [], -1, False

    @staticmethod
    def _field(tag: str, at: dict) -> str:
        """Which field of the card an element holds; a salary's mark stands inside the element that holds it."""
        classes, href = (at.get("class") or "").split(), at.get("href") or ""
        if tag == "a" and ("offer-grid-article-company-url" in at or "/empresas/" in href or "hidden-nested-link" in classes) or tag == "h4" and "base-search-card__subtitle" in classes:
            return "company"
        if tag == "span" and "Salario" in (at.get("title") or "") or "i_salary" in classes:
            return "pay"
        if tag == "span" and "tag" in classes or tag == "a" and "/empleos-de-" in href:
            return "area"
        return ""

    def _supply_ends(self, tag: str) -> None:
        """Closes what the beginning of an element ends."""
        for ended, scope in ((_ENDS_OWN.get(tag), _OWN_SCOPE), ({"p"} if tag in _ENDS_P else None, _P_SCOPE)):
            for k in range(len(self.stack) - 1, max(self.base, -1), -1):
                if ended and self.stack[k][0] in ended:
                    self._close_to(k)
                    break
                if self.stack[k][0] in scope:
                    break

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag == self.tag and self.marker in (at.get("class") or "").split():
            if self.base >= 0:
                self._close_to(self.base)
            new = dict.fromkeys("title href company salary area whole".split(), "") | {n: [] for n in ("dates", "paragraphs", "texts")}
            self.cards.append(new | {"id": at.get("data-id") or (at.get("data-entity-urn") or "").rpartition(":")[2]})
            self.base, self.outer_pay = len(self.stack), False
            self.stack.append([tag, "", ""])
            return
        self._supply_ends(tag)
        if self.base < 0:
            if tag not in _VOID:
                self.stack.append([tag, "", ""])
            return
        card, field = self.cards[-1], self._field(tag, at)
        if field == "pay":
            if len(self.stack) > self.base + 1:
                self.stack[-1][2] = "salary"
            else:
                self.outer_pay = True
        if tag not in _VOID:
            self.stack.append([tag, "", "" if field == "pay" else field])
        if tag == "a" and at.get("href") and not card["href"] and field not in ("company", "area"):
            card["href"] = at["href"]
        if tag == "time" and at.get("datetime"):
            card["dates"].append(at["datetime"])

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._close_to(k)
                return

    def _close_to(self, k: int) -> None:
        while len(self.stack) > k:
            name, own, field = self.stack.pop()
            at = len(self.stack)
            if at == self.base:
                card, self.base = self.cards[-1], -1
                if self.outer_pay:
                    card["salary"] = card["salary"] or " ".join(card["whole"].split())
            elif self.base >= 0:
                self._read(name, " ".join(own.split()), field)
                if at > self.base + 1:
                    self.stack[-1][1] += " " + " ".join(own.split())

    def _read(self, name: str, own: str, field: str) -> None:
        """What a closed element of the card tells."""
        if not own:
            return
        card = self.cards[-1]
        if name in ("h1", "h2", "h3") or name == "a" and not card["title"] and not field:
            card["title"] = card["title"] or own
        elif name == "time":
            card["dates"].append(own)
        if field:
            card[field] = card[field] or own
        if name == "p":
            card["paragraphs"].append(own)
        if name in ("p", "span"):
            card["texts"].append(own)

    def handle_data(self, data):
        if self.base >= 0:
            self.cards[-1]["whole"] += data
            if len(self.stack) > self.base + 1:
                self.stack[-1][1] += data

    def close(self):
        super().close()
        self._close_to(0)


class _Blocks(HTMLParser):
    """The texts of marked elements, with all that is nested in them, in the order of their beginnings."""

    def __init__(self, marks):
        super().__init__(convert_charrefs=True)
        self.marks, self.blocks, self.open, self.skip = marks, [], [], 0

    def _marked(self, tag: str, classes: str) -> bool:
        return any((not name or name == tag) and (mark in classes if part else mark in classes.split()) for name, mark, part in self.marks)

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in _VOID:
            self.handle_data(" ")
            return
        at = None
        if self._marked(tag, dict(attrs).get("class") or ""):
            at = len(self.blocks)
            self.blocks.append([])
        self.open.append((tag, at))
        self.handle_data(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if any(name == tag for name, _ in self.open):
            self.handle_data(" ")
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            for _, at in self.open:
                if at is not None:
                    self.blocks[at].append(data)

    def texts(self) -> list[str]:
        return [" ".join("".join(parts).split()) for parts in self.blocks]


#: Pages that are parsed at a time; what is made of a run is handed on before the next one, however many rows an Arrow batch holds.
RUN = 32


def _with_parsed(pages: DataFrame, body: str, name: str, kind: DataType, arrow: pa.DataType, parse: Callable[[str], object]) -> DataFrame:
    """``pages`` with what ``parse`` makes of each body, null ones as empty."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                found = pa.array([parse(x or "") for x in part.column(body).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    return pages.mapInArrow(parsed, StructType([*pages.schema, StructField(name, kind)]))


def _blocks(body: str, marks) -> list[str]:
    p = _Blocks(marks)
    p.feed(body)
    return p.texts()


def with_block(pages: DataFrame, marks, longest: bool) -> DataFrame:
    """``pages`` with ``_block``: the longest of a page's marked blocks, of equal ones the first, or the first of all; null if there is none."""

    def chosen(body: str) -> str | None:
        found = _blocks(body, marks)
        return None if not found else max(found, key=len) if longest else found[0]

    return _with_parsed(pages, "html", "_block", StringType(), pa.string(), chosen)


def with_cards(pages: DataFrame, tag: str, css_class: str) -> DataFrame:
    """``pages`` with the cards of each."""

    def cards(body: str) -> list[dict]:
        p = _Cards(tag, css_class)
        p.feed(body)
        p.close()
        return p.cards

    return _with_parsed(pages.select("page", "http_status", "body"), "body", "cards", _CARD, _ARROW_CARD, cards)


class _Flat(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.parts.append("\n" if tag in ("br", "p", "li", "div", "tr", "h1", "h2", "h3") else " ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


@F.pandas_udf(StringType())
def flat_text(html: pd.Series) -> pd.Series:
    """The text of HTML, line by line, without blank lines."""
    out = []
    for h in html:
        p = _Flat()
        p.feed(h or "")
        out.append("\n".join(x for x in (" ".join(line.split()) for line in "".join(p.parts).split("\n")) if x))
    return pd.Series(out)


def page_status(http_status: Column, body: Column, cards: Column) -> Column:
    """Ok, Empty (also blank pages), Blocked (also long pages without a card) or Error (also pages without body or code)."""
    return (
        F.when(http_status.isin(*BLOCKED), "Blocked")
        .when(~http_status.between(200, 299) | http_status.isNull() | body.isNull(), "Error")
        .when(F.size(cards) > 0, "Ok")
        .when(body.rlike(r"\S") & (F.length(body) > SOFT_BLOCK_CHARS), "Blocked")
        .otherwise("Empty")
    )


def pick_location(texts: Column, company: Column) -> Column:
    """The first short text with a comma that is neither rating, company, date, pay nor notice."""
    other = "(?i)hace|ayer|hoy|s/|valoracion|postul"
    fits = lambda x: (F.length(x) < 70) & x.contains(",") & ~x.rlike(r"^\d+[.,]\d+\b") & ~x.rlike(other) & ((company == "") | ~F.contains(F.lower(x), F.lower(company)))
    return text(F.get(F.filter(texts, fits), 0))


def pick_date(dates: Column, texts: Column) -> Column:
    spoken = F.filter(texts, lambda x: x.rlike("(?i)hace|hoy|ayer|dia|mes|semana"))
    return F.coalesce(F.get(dates, 0), F.get(spoken, 0), F.lit(""))


def job_id(url: Column) -> Column:
    """The id in a posting's link, by three spellings in turn."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text(url), p, 1), F.lit("")) for p in (r"currentJobId=(\d+)", r"/jobs/view/(\d+)", r"-(\d{8,})")))


def stated_mode(title: Column, location: Column) -> Column:
    t = norm(F.concat_ws(" ", title, location))
    return F.when(t.rlike(r"\b(remoto|remota|remote|teletrabajo|home office)\b"), "Remoto").when(t.rlike(r"\b(hibrido|hibrida|hybrid)\b"), "Hibrido").otherwise("Presencial")


def page_statuses(pages: DataFrame, tag: str = "article", css_class: str = "card") -> DataFrame:
    """(page, page_status, n_cards) of every landed page (page, http_status, body), those without cards too."""
    parsed = with_cards(pages, tag, css_class)
    return parsed.select("page", page_status(F.col("http_status"), F.col("body"), F.col("cards")).alias("page_status"), F.size("cards").alias("n_cards"))


def listing(pages: DataFrame, portal: str, base_url: str, tag: str = "article", css_class: str = "card") -> DataFrame:
    """Cards of landed pages (page, http_status, body), first of each id, in page order. A card without a link takes the one of its id."""
    parsed = with_cards(pages, tag, css_class)
    rows = parsed.select("page", page_status(F.col("http_status"), F.col("body"), F.col("cards")).alias("page_status"), F.posexplode("cards").alias("item", "c")).where("page_status = 'Ok'")
    title = F.trim(F.regexp_replace("c.title", "Postulado|Vista", ""))
    site = base_url.rstrip("/")
    linked = F.when(F.col("c.href").startswith("http"), F.col("c.href")).otherwise(F.concat(F.lit(site), F.when(F.col("c.href").startswith("/"), "").otherwise("/"), F.col("c.href")))
    url = F.when(F.trim("c.href") != "", linked).when(F.trim("c.id") != "", F.concat(F.lit(f"{site}/jobs/view/"), F.trim("c.id"))).otherwise("")
    company = text("c.company")
    place = pick_location(F.col("c.texts"), company)
    snippet = F.array_join(F.filter("c.paragraphs", lambda p: (F.length(p) > 30) & ~p.rlike("(?i)hace|s/") & ~p.contains(",")), " ")
    lowered = F.lower(F.concat_ws(" ", title, snippet, "c.whole"))
    mode = F.when(lowered.rlike("remot|teletrabajo"), "Remoto").when(lowered.rlike("hibrid|hybrid"), "Hibrido").otherwise("Presencial")
    or_else = lambda x, other: F.coalesce(nonblank(x), F.lit(other))
    rows = rows.select(
        "page", "item", "page_status", F.lit(portal).alias("portal"), title.alias("puesto"), url.alias("url"), or_else(company, "Confidencial").alias("empresa"), or_else(place, "Lima").alias("ubicacion"),
        or_else(F.trim(F.get(F.split(place, ","), 0)), "Lima").alias("distrito"), or_else(F.col("c.salary"), "No especificado").alias("salario"), area(title, snippet, F.col("c.area")).alias("area"),
        pick_date(F.col("c.dates"), F.col("c.texts")).alias("fechaPublicacion"), snippet.alias("descripcion"), mode.alias("modalidad"), F.coalesce(job_id(url), url).alias("job_id"),
    ).where("puesto != '' and url != ''")
    first = F.row_number().over(Window.partitionBy("job_id").orderBy("page", "item"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def until_nothing_new(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """The cards of ``listing`` before the first page of ``pages`` that brings no new id, where an offset scan ends.

    Of each page only its number meets the others: one row a page of a scan, a few dozen a query.
    """
    new = cards.groupBy("page").agg(F.count(F.lit(1)).alias("_new"))
    end = pages.select("page").distinct().join(new, "page", "left").where("_new is null").agg(F.min("page").alias("_end"))
    return cards.join(F.broadcast(end), F.col("_end").isNull() | (F.col("page") < F.col("_end"))).drop("_end")


_SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"


def _ld_nodes(pages: DataFrame, html: str) -> DataFrame:
    """The JobPosting nodes of a page's JSON-LD, blank descriptions too, with the number of their script and their place in it."""
    scripts = pages.select("*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_SCRIPT), F.lit(1))).alias("script_no", "script")).withColumn("_v", F.try_parse_json("script"))
    nested = F.expr("""coalesce(try_variant_get(_v, '$["@graph"]', 'array<variant>'), try_variant_get(_v, '$', 'array<variant>'), array(_v))""")
    rows = scripts.where("_v is not null").select("*", F.posexplode(nested).alias("place", "_o"))
    kinds = F.expr("""coalesce(try_variant_get(_o, '$["@type"]', 'array<string>'), array(try_variant_get(_o, '$["@type"]', 'string')))""")
    rows = rows.where(F.exists(kinds, lambda k: F.lower(k) == "jobposting"))
    get = lambda path, kind="string": F.expr(f"try_variant_get(_o, '{path}', '{kind}')")
    where = F.array_distinct(F.filter(F.array(get("$.jobLocation.address.addressLocality"), get("$.jobLocation.address.addressRegion")), lambda x: F.trim(x) != ""))
    months = F.coalesce(get("$.experienceRequirements.monthsOfExperience", "int"), get("$.experienceRequirements.monthsOfExperience").try_cast("int"))
    return rows.select(
        *[c for c in pages.columns if c != html], "script_no", "place", flat_text(get("$.description")).alias("descripcion"), text(get("$.datePosted")).alias("fechaPublicacion"),
        text(get("$.hiringOrganization.name")).alias("empresa"), F.array_join(where, ", ").alias("ubicacion"), months.alias("meses"),
    )


def json_ld_postings(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each JobPosting of a page's JSON-LD, whether it stands alone, in an array or in a graph."""
    return _ld_nodes(pages, html).where("trim(descripcion) != ''")


def _details(pages: DataFrame, key: str, marks, longest: bool) -> DataFrame:
    """A script's first posting counts; if it is blank, the next script's."""
    firsts = _ld_nodes(pages.select(key, "html"), "html").groupBy(key, "script_no").agg(F.min_by("descripcion", "place").alias("descripcion"))
    found = firsts.where("trim(descripcion) != ''").groupBy(key).agg(F.min_by("descripcion", "script_no").alias("_ld"))
    own = with_block(pages.select(key, "html"), marks, longest).select(key, "_block")
    return own.join(found, key, "left").select(key, F.substring(text(F.coalesce(nonblank(F.col("_ld")), F.col("_block"))), 1, DETAIL_CHARS).alias("descripcion"))


def detail_texts(pages: DataFrame, marks=LONGEST_OF) -> DataFrame:
    """(url, descripcion): a page's first JSON-LD description, else the longest of its marked blocks, of equal ones the first; cut to a limit."""
    return _details(pages, "url", marks, longest=True)


def details_by_job(pages: DataFrame, marks=FIRST_OF) -> DataFrame:
    """(job_id, descripcion) of (url, html): one page of each id that a link holds; its first JSON-LD description, else its first marked block."""
    by_id = pages.withColumn("job_id", job_id(F.col("url"))).where("job_id is not null and trim(html) != ''")
    one = by_id.groupBy("job_id").agg(F.min_by("html", "url").alias("html"))
    return _details(one, "job_id", marks, longest=False)
