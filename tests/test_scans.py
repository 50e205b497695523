"""Ends of scans against a plain loop; landed pages that aren't opened."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tamiz.plans.scans import Rules, page_facts, scan_ends, scanned
from tamiz.sources import landed

AS_OF = "2026-07-20 12:00:00"
PAGES, CARDS = "portal string, query string, page int, page_status string", "portal string, query string, page int, item int, job_id string, fechaPublicacion string"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def landing(seed):
    """Scans of several portals and queries, their pages interleaved."""
    rng, pages, cards = random.Random(seed), [], []
    for portal in "ab":
        for query in ("uno", "dos", "tres", "cuatro"):
            first = rng.choice([0, 1])
            for page in range(first, first + rng.randrange(1, 7)):
                if rng.random() < 0.07:
                    continue
                status = rng.choice(["Ok"] * 12 + ["Empty", "Blocked", "Error"])
                pages.append((portal, query, page, status))
                for item in range(rng.randrange(1, 5) if status == "Ok" else 0):
                    age = rng.choice([None, 1, 5, 20, 29, 30, 31, 45]) if page < first + 3 else rng.choice([None, 20, 31, 60])
                    date = rng.choice(["", "pronto"]) if age is None else f"hace {age} dias"
                    cards.append((portal, query, page, item, f"{portal}{rng.randrange(6 * (page + 1))}", date))
    rng.shuffle(pages)
    rng.shuffle(cards)
    return pages, cards


def loop(pages, cards, rules):
    out, reasons = set(), {}
    for scan in {p[:2] for p in pages}:
        own = {p[2]: p[3] for p in pages if p[:2] == scan}
        seen, page = set(), min(own)
        for asked in range(100):
            if page > max(own):
                break
            if rules.most_pages is not None and asked >= rules.most_pages:
                reasons[scan] = "limite"
                break
            if page not in own:
                reasons[scan] = "falta"
                break
            if own[page] != "Ok":
                reasons[scan] = own[page].lower()
                break
            here = sorted(c for c in cards if c[:3] == (*scan, page))
            new = [c for k, c in enumerate(here) if c[4] not in seen and c[4] not in {x[4] for x in here[:k]}] if rules.by_id else here
            if not new:
                reasons[scan] = "repetida"
                break
            seen |= {c[4] for c in here}
            age = lambda c: int(c[5].split()[1]) if c[5].startswith("hace") else None
            out |= {c for c in new if rules.max_days is None or age(c) is None or age(c) <= rules.max_days}
            ages = [a for c in here if (a := age(c)) is not None]
            if rules.max_days is not None and ages and ages[-1] > rules.max_days:
                reasons[scan] = "antigua"
                break
            page += 1
    return out, reasons


@pytest.mark.parametrize("rules", [Rules(), Rules(by_id=True, max_days=None), Rules(by_id=True, max_days=30, most_pages=3)])
def test_scans_end_as_a_loop_does(spark, rules):
    seen = set()
    for seed in range(3):
        pages, cards = landing(seed)
        p, c = spark.createDataFrame(pages, PAGES), spark.createDataFrame(cards, CARDS)
        want, reasons = loop(pages, cards, rules)
        got = scanned(p, c, as_of(), rules).select("portal", "query", "page", "item", "job_id", "fechaPublicacion").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
        ends = {(r.portal, r.query): r.reason for r in scan_ends(page_facts(p, c, as_of()), rules).where("reason is not null").collect()}
        assert {k: v for k, v in ends.items() if v != "falta"} == {k: v for k, v in reasons.items() if v != "falta"}
        seen |= set(reasons.values())
    assert len(seen) >= 4


def test_no_pages(spark):
    assert scanned(spark.createDataFrame([], PAGES), spark.createDataFrame([], CARDS), as_of()).count() == 0


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime.date(2026, 7, 20)
    rows = [(p, q, k, 200, day - datetime.timedelta(days=10 * k), f"{p} {q}\n{k}") for p in "ab" for q in ("x/y z", "ñ") for k in range(5)]
    rows += [("c", "q", 0, 200, day, "c0"), ("c", "q", 1, 200, None, " \n "), ("c", "q", 2, 200, day, "c2"), ("d", "q", 0, 429, None, "no"), ("d", "q", 1, 200, day, None)]
    landed.land(spark.createDataFrame(rows, landed.SCHEMA), str(tmp_path / "in"))
    return str(tmp_path / "in"), rows


def test_all_pages_come_back(spark, folder):
    where, rows = folder
    got = landed.landed(spark, where)
    assert got.columns == [*landed.KEYS, "body"]
    assert set(map(tuple, got.collect())) == {(*r[:5], r[5] or "") for r in rows}


def unopenable(where, ruled_out):
    """Puts links to what can't be read in place of the pages that a filter rules out."""
    n = 0
    for top, _, names in os.walk(where):
        for name in names:
            keys = landed._keys(f"{top}/{name}")
            if keys and not name.startswith((".", "_")) and ruled_out(keys):
                os.remove(f"{top}/{name}")
                os.symlink("/proc/self/mem", f"{top}/{name}")
                n += 1
    return n


@pytest.mark.parametrize("source", [landed.landed, landed.stopping])
def test_filters_decide_which_pages_are_opened(spark, folder, source):
    where, rows = folder
    limit = datetime.date(2026, 7, 20) - datetime.timedelta(days=20)
    wanted = lambda k: k[0] in ("a", "b") and k[1] != "ñ" and k[4] is not None and k[4] >= limit and k[2] < 2
    by_scan = lambda k: k[0] in ("a", "b") and k[1] != "ñ" and k[2] < 2
    assert unopenable(where, lambda k: not (wanted if source is landed.landed else by_scan)(k)) == len(rows) - 4
    pages = source(spark, where)
    got = pages.where(F.col("portal").isin("a", "b") & (F.col("query") == "x/y z") & (F.col("newest") >= F.lit(limit)) & (F.col("page") < 2))
    assert {(r.portal, r.query, r.page, r.body) for r in got.collect()} == {(r[0], r[1], r[2], r[5]) for r in rows if wanted(r)}
    if source is landed.stopping:
        with pytest.raises(Exception, match="Input/output|Errno 5"):
            source(spark, where).collect()


def test_a_plan_tells_what_is_pushed(spark, folder, capsys):
    landed.landed(spark, folder[0]).where("portal = 'a' and page <= 1 and length(body) > 3").explain("formatted")
    told = next(line for line in capsys.readouterr().out.split("\n") if "PartitionFilters" in line)
    assert "portal" in told and "page" in told


def test_filters_do_not_move_the_end_of_a_scan(spark, folder):
    rows = landed.stopping(spark, folder[0])
    assert rows.where("portal = 'c' and page >= 1").count() == 0
    assert rows.where("portal = 'd' and http_status = 200").count() == 0
    assert rows.where("portal = 'c' and page in (0, 2)").count() == 1


def test_pages_of_unknown_age_stay(spark, folder):
    where, _ = folder
    unopenable(where, lambda k: k[4] is not None and k[4] < datetime.date(2026, 7, 10))
    rows = landed.recent(landed.landed(spark, where), F.lit("2026-07-20").cast("date"), 10)
    got = rows.where("portal in ('a', 'c', 'd')").select("portal", "page", F.length("body")).distinct()
    assert sorted({(r.portal, r.page) for r in got.collect()}) == [("a", 0), ("a", 1), ("c", 0), ("c", 1), ("c", 2), ("d", 0), ("d", 1)]


def test_a_scan_that_stops_opens_nothing_more(spark, folder):
    where, _ = folder
    unopenable(where, lambda k: k[:3] == ("c", "q", 2) or k[0] == "d")
    got = landed.stopping(spark, where).where("portal in ('b', 'c', 'd')")
    assert sorted((r.portal, r.page) for r in got.collect()) == [("b", k) for k in range(5) for _ in range(2)] + [("c", 0)]
