"""Operators over the whole corpus against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from tamiz.llm import bwt_repeats, hashmix, hyperminhash
from tamiz.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, registers string, th string"


def lowest(pairs, ids):
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = lowest(pairs, {x for p in pairs for x in p})
    assert got == {i: c for i, c in want.items() if i in got} and all(i in got for p in pairs for i in p if p[0] != p[1])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 120]))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            docs.append(" ".join(own).upper() if rng.random() < 0.2 else "  ".join(own))
    base = [rng.choice(vocab) for _ in range(90)]
    for _ in range(150):  # one large group of near copies
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(vocab)
        docs.append(" ".join(own))
    return [*docs, None, "", " \n", "w1", "W1", "w1 w2", "ÄW ä", "äw ä"]


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    texts = near_corpus()
    rows = [(i, t, None, "", "") for i, t in enumerate(texts)]
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    pairs = [(a, b) for a in sets for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = lowest(pairs, sets)
    for block in (1024, 16):
        monkeypatch.setattr(hyperminhash, "BLOCK", block)
        got = {r.doc_id: r for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_of_odd_tables(spark):
    docs = spark.createDataFrame([(7, "a b c d e f", None, "", ""), (7, "a b c d e f", None, "", ""), (None, "a b c d e f", None, "", ""), (9, "a b c d e f", None, "", "")], SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in hyperminhash.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert hyperminhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    text = lambda c, k=0: " ".join(f"{c}{i}" if i != k else "other" for i in range(60))
    rows = [(5, text("q")), (5, text("z")), (5, None), (7, text("q", 1)), (8, text("z", 1)), (3, text("y")), (9, text("y", 59)), (9, text("v")), (2, text("v", 1))]
    docs = spark.createDataFrame([(i, t, None, "", "") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in hyperminhash.near_duplicates(docs).collect())
    assert got == sorted((i, 56 if t else 0, {7: 5, 8: 5, 9: 3 if t and "y0" in t else 2}.get(i, i)) for i, t in rows)
    kept = hyperminhash.without_near_duplicates(docs.withColumn("id_of_gone", docs.doc_id))
    assert kept.columns == [*docs.columns, "id_of_gone"] and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 5, 5]


def test_transform_finds_what_a_table_of_substrings_finds():
    rng = np.random.default_rng(0)
    for _ in range(400):
        letters, length = int(rng.integers(1, 4)), int(rng.integers(1, 9))
        parts = [rng.integers(0, letters, rng.integers(0, 25)) for _ in range(rng.integers(1, 5))]
        text = np.concatenate([x for j, p in enumerate(parts) for x in (p + len(parts), [j])]).astype(np.int64)
        lengths = (max(1, length // 2), length)
        for length, got in zip(lengths, bwt_repeats.repeated_suffixes(text, lengths, [np.ones(len(text), bool)] * 2)):
            count = Counter(tuple(text[i : i + length]) for i in range(len(text) - length + 1))
            want = [i + length <= len(text) and count[tuple(text[i : i + length])] > 1 for i in range(len(text))]
            assert got.tolist() == want


def covered(raw, length):
    count = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        yield gone, list(zip(edge[::2], edge[1::2]))


def repeats(texts, length, passage, least_words):
    raw = [(t or "").encode() for t in texts]
    out = []
    for b, (gone, spans), (_, passages) in zip(raw, covered(raw, length), covered(raw, passage)):
        starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        n = sum(sum(i <= s < j for s in starts) >= least_words for i, j in passages)
        out.append((len(b), int(gone.sum()), len(spans), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), n))
    return out


def repeated_texts():
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [noise(n) for n in (40, 45, 60, 61, 90, 200)]
    texts = [noise(rng.randint(0, 150)) + rng.choice(shared) + noise(rng.randint(0, 150)) for _ in range(70)]
    for _ in range(30):  # near copies
        own = list(shared[-1])
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(200)] = rng.choice("xyz")
        texts.append("".join(own))
    return [*texts, texts[0], texts[0], None, "", "x" * 500, "x" * 59, "x" * 60, "x" * 61, "ab" * 300, "abc" * 70 + "abd" * 70, "short", shared[2] * 3, noise(40), noise(60)]


def test_repeats_equal_brute_force(spark, monkeypatch):
    texts = repeated_texts()
    docs = spark.createDataFrame([(i, t, None, "", "") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    monkeypatch.setattr(bwt_repeats, "PASSAGE_WORDS", 5)
    want = repeats(texts, 60, 40, 5)
    for split, piece in ((1 << 20, 1 << 12), (300, 1 << 12), (1, 16)):  # anchors in one task, or dealt out more finely, up to whole strings
        monkeypatch.setattr(bwt_repeats, "SPLIT_BYTES", split)
        monkeypatch.setattr(bwt_repeats, "PIECE", piece)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages) for r in bwt_repeats.remove_repeats(docs, digest=True, length=60, passage=40).collect()}
        assert [got[i] for i in range(len(texts))] == want
    same = {r.doc_id: r for r in bwt_repeats.remove_repeats(docs, digest=True, length=60, passage=60).collect()}
    assert all(same[i].n_removed == want[i][1] and same[i].n_passages <= same[i].n_spans for i in same)


def test_repeats_of_odd_tables(spark):
    long = "the quick brown fox jumps over the lazy dog and goes on " * 2
    rows = [(1, long, None, "", ""), (1, "other", None, "", ""), (1, None, None, "", ""), (None, long[:80], None, "", ""), (None, None, None, "", ""), (2, "y" * 79, None, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in bwt_repeats.remove_repeats(docs, length=50).collect())
    want = [r[:2] for r in repeats([r[1] for r in rows], 50, 50, 50)]
    assert got == sorted((r[0] or 0, *w) for r, w in zip(rows, want))
    assert bwt_repeats.remove_repeats(docs.limit(0)).count() == 0


def test_sieve_that_lets_all_pass_changes_no_result(spark, monkeypatch):
    texts = repeated_texts()
    docs = spark.createDataFrame([(i if i % 7 else None, t, None, "", "") for i, t in enumerate(texts)], SCHEMA)
    run = lambda: sorted(map(str, bwt_repeats.remove_repeats(docs, length=60, passage=40).collect()))
    want = run()
    monkeypatch.setattr(bwt_repeats, "SIEVE_MOST", 8)
    monkeypatch.setattr(bwt_repeats, "SIEVE_BLOCK", 8)
    assert run() == want


def shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_texts_that_repeat_nothing_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    noise = lambda: bytes(rng.randrange(33, 127) for _ in range(4000)).decode()
    texts = [noise() for _ in range(600)]
    for i in range(0, 8, 2):
        texts[i + 1] = texts[i + 1][:1000] + texts[i][1000:2000] + texts[i + 1][2000:]
    docs = spark.createDataFrame([(i, t, None, "", "") for i, t in enumerate(texts)], SCHEMA)
    for split in (1 << 20, 1):  # without hot anchors, and with them
        monkeypatch.setattr(bwt_repeats, "SPLIT_BYTES", split)
        before = shuffled(spark)
        got = {r.doc_id: r.n_removed for r in bwt_repeats.remove_repeats(docs, digest=True).collect()}
        assert got == {i: 1000 * (i < 8) for i in range(600)}
        assert shuffled(spark) - before < 0.75 * sum(map(len, texts))


def mix_by_sorting(rows, seed="mix"):
    """(doc_id, target, taken) by the plain rule."""
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    total = Counter()
    for i, _, source, *_ in rows:
        total[source] += size[i]
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * total[s] < level * weight[s]}
        for s in full or free:
            target[s] = 3.0 * total[s] if full else level * weight[s]
            left -= target[s] if full else 0
        free -= full or set(free)
    return size, total, target


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "ß", None, "tiny"] if i % 9 else ["big"]), "", "") for i in range(700)]
    rows += [(1000, None, "void", "", ""), (1001, "w " * 3000, "a", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    size, total, target = mix_by_sorting(rows)
    got = hashmix.hash_threshold_mix(docs).collect()
    again = {(r.doc_id, r.taken) for r in hashmix.hash_threshold_mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got} and len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[r.src] and abs(r.target - target[r.src]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.src] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max((size[i] for i, _, source, *_ in rows if source == s), default=0) / 2 + 1e-6
    assert hashmix.hash_threshold_mix(docs.limit(0)).count() == 0
