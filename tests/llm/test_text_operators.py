"""Row-wise operators against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tamiz.llm import forced_bpe, language_mixture, nbsvm, progressive_jpeg, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, score string"


def rows_of(texts):
    return [(i, t, None, None, "x", "y") for i, t in enumerate(texts)]


def odd_texts():
    rng = random.Random(3)
    words = ["Aa", "b", "é", "#x", "<|", "Σ", "ſ", "12", "don't"]
    made = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", " "]) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    return [*made, None, "", " \n\n ", "same line\n" * 30, "w " * 4000, "x" * 20000, "0", "0"]


def test_repetition_figures(spark):
    texts = odd_texts()
    got = {r.doc_id: r for r in quality_rules.repetition_quality(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = [False] * len(w)
        for k in range(len(w) - 7):
            if grams[tuple(w[k : k + 8])] > 1:
                inside[k : k + 8] = [True] * 8
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(inside))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * sum(inside) > 30 * len(w))
        assert not (r.base_failed and r.kept)
        for n in (5, 10):
            grams = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            cover = {j for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
            assert r[f"dup_{n}gram_chars"] == sum(len(w[j]) for j in cover)


def test_bpe_equals_the_library_and_round_trips(spark):
    tokenizers = pytest.importorskip("tokenizers")
    file = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(file)
    texts = [*odd_texts(), "a<|endoftext|>b", "ha" * 3000, "!?" * 300]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: r for r in forced_bpe.bpe_round_trip(docs, file).collect()}
    short = {r.doc_id: r for r in forced_bpe.bpe_round_trip(docs, file, digests=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert short[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_forced_cuts_change_nothing():
    bpe = forced_bpe.ForcedBpe(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    rng = random.Random(1)
    for _ in range(300):
        raw = bytes(rng.randrange(256) for _ in range(rng.randint(1, 90)))
        cut, begin = [], 0
        for k in range(1, len(raw)):
            if not bpe.joined[raw[k - 1] * 256 + raw[k]]:
                cut += bpe._fragment(raw[begin:k], False)
                begin = k
        assert cut + bpe._fragment(raw[begin:], True) == bpe._fragment(raw, True) == bpe._merge_short([*(bpe.inner[b] for b in raw[:-1]), bpe.last[raw[-1]]])


def test_media_round_trip(spark):
    texts = [*odd_texts(), "ÿ" * 500, "a" * 70000, "é😀\u0000"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: r for r in progressive_jpeg.media_columns(docs, full=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(-(-len(raw) // 64), 1) * 64 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.rgb) == r.height * r.width * 3
        (alone,) = (rgb for _, rgb in progressive_jpeg.Reader([bytes(r.media)]).tensors())
        assert alone.tobytes() == bytes(r.rgb)
    same = [got[i] for i, t in enumerate(texts) if t == "0"]
    assert same[0].media_sha256 == same[1].media_sha256 and same[0].feature == same[1].feature


def test_inverse_transform_equals_the_definition():
    rng = np.random.default_rng(0)
    coef = rng.integers(-60, 60, (4, 64))
    natural = np.zeros((4, 64))
    natural[:, progressive_jpeg.ZIGZAG] = coef
    c = np.array([[(np.sqrt(0.5) if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    want = np.clip(np.round(np.einsum("nuv,ux,vy->nxy", natural.reshape(4, 8, 8), c, c) + 128), 0, 255)
    assert np.abs(progressive_jpeg.inverse_transform(coef, np.ones(64)) - want).max() <= 1


def test_languages_of_held_out_rows(spark):
    rng = random.Random(2)
    words = {"aa": ["the", "and", "with", "thing"], "bb": ["der", "und", "nicht", "schön"], "cc": ["que", "une", "pour", "été"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang, rng.randint(3, 40)), lang, None, "", "") for i in range(300) for lang in [rng.choice(list(words))]]
    mixed = say("aa", 300) + " " + say("bb", 150)
    rows += [(900, None, "aa", None, "", ""), (901, "123 !", "aa", None, "", ""), (902, "", None, None, "", ""), (903, mixed, None, None, "", ""), (903, mixed, None, None, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language_mixture.language_mixture(docs).collect()
    truth = {r[0]: r[2] for r in rows[:300]}
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[903].lang_pred == "aa" and by_id[903].n_langs == 2 and 0.55 < by_id[903].score < 0.8
    assert {r.lang_pred for r in language_mixture.language_mixture(docs.where("lang is null")).collect()} == {"und"}
    assert language_mixture.language_mixture(docs.limit(0)).count() == 0


def test_quality_of_held_out_rows(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["a calm", "line of", "plain words", "and more"]) for _ in range(rng.randint(5, 40)))
    bad = lambda: " ".join(rng.choice(["BUY!!", "now$$$", "***win", "win"]) for _ in range(rng.randint(5, 40)))
    quality = [rng.random() < 0.8 for _ in range(400)]
    rows = [(i, good() if q else bad(), None, None, "", "") for i, q in enumerate(quality)]
    docs = spark.createDataFrame([*rows, (900, None, None, None, "", "")], SCHEMA)
    labels = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quality)] + [(0, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in nbsvm.quality_scores(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 900]
    assert held and all(r.predicted == int(quality[r.doc_id]) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and 900 in got
    assert nbsvm.keep_good(docs, labels).columns == docs.columns
    none = {r.score for r in nbsvm.quality_scores(docs, labels.limit(0)).collect()}
    assert none == {0.5}
