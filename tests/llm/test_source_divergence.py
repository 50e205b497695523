"""Divergences of sources against plain loops."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from tamiz.llm import source_divergence as sd
from tamiz.llm.textscan import ASCII_LOWER

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, count long"


def brute(rows, least, top):
    docs, groups, counts = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall((text or "").translate(LOWER))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def weights(count):
            below = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + floor(Fraction(10**9 * (count[t] + 5), below)) for t in kept}

        q = weights(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: weights(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[r][t]) for t in kept), r.encode(), r) for r in sources if r != s)
            out |= {(lang, s, "pair", r, -v, k + 1) for k, (v, _, r) in enumerate(pairs)}
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:top])}
    return out


def corpus(n=400, n_sources=9):
    rng = random.Random(7)
    words = ["Uno", "dos", "TRES", "cuatro", "été", "ÉTÉ", "naïve", "日本", "a", "Ω", "x́y"] + [f"w{k}" for k in "abcdefghij"]
    rows = []
    for k in range(n):
        lang, s = rng.choice(["es", "fr", None, ""]), rng.randrange(n_sources)
        text = rng.choice([" ", ", ", "1"]).join(rng.choice(words[: 4 + s * 2]) for _ in range(rng.choice([0, 1, 5, 30])))
        rows.append((k, rng.choice([text, text, text, None, "", "42 !"]), lang, rng.choice([f"s{s}", "hot", None]), "clash", 1))
    return rows + rows[:20] + [(-1, "solo " * 50, "alone", "only", None, None), (-2, None, "none", "a", None, None), (-3, "Z" * 70_000 + " é" * 3000, "none", "b", None, None)]


@pytest.mark.parametrize("block, tile", [(1024, 128), (3, 2)])
def test_rows_equal_plain_loops(spark, monkeypatch, block, tile):
    monkeypatch.setattr(sd, "BLOCK_TERMS", block)
    monkeypatch.setattr(sd, "TILE_SOURCES", tile)
    rows = corpus()
    got = sd.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), least_docs=4, top_terms=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = list(map(tuple, got.collect()))
    assert set(got) == brute(rows, 4, 6) and len(got) == len(set(got))


def test_small_tables_may_be_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST_ROWS", 0)
    rows = corpus(120)
    assert set(map(tuple, sd.source_divergence(spark.createDataFrame(rows, SCHEMA), least_docs=2).collect())) == brute(rows, 2, 50)


def test_no_kept_term_and_no_rows(spark):
    rows = [(1, "a b", "x", "s", "", 1), (2, "", "x", "t", "", 1), (3, None, None, None, "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert set(map(tuple, sd.source_divergence(docs).collect())) == {("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)}
    assert sd.source_divergence(docs.limit(0)).count() == 0


def test_one_hash_for_all_slices_still_tells_terms_apart():
    texts = ["Ab cab ab", "ab ABC é", "", "ca,b"]
    data = [t.encode() for t in texts]
    raw = ASCII_LOWER[np.frombuffer(b"".join(data), np.uint8)]
    off = np.cumsum([0, *map(len, data)])
    start, end = sd.term_spans(raw, off)
    for hashed in (len, lambda _: 1):
        first, term = sd.grouped(raw, start, end, hashed)
        names = [raw[start[k] : end[k]].tobytes() for k in first]
        assert len(names) == len(set(names))
        assert [names[t].decode() for t in term] == [w for t in texts for w in TERM.findall(t.translate(LOWER))]


def test_weights_are_exact_beyond_64_bits(spark):
    row = spark.range(1).select(sd._weight(*[sd.F.lit(x).cast("long") for x in (70_000_000_000_000, 10**18 + 7, 12_345)], sd.SCALE, sd.ADD)).first()
    assert row[0] == 1 + floor(Fraction(10**9 * 70_000_000_000_005, 10**18 + 7 + 5 * 12_345))
