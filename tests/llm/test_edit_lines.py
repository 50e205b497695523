import random

from tamiz.llm.edit_lines import dedup_lines, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, times):
    text = list(text)
    for _ in range(times):
        at = rng.randint(0, max(0, len(text) - 1))
        text[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
    return "".join(text)


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = bytes(rng.randrange(3) for _ in range(rng.randint(0, 14)))
        b = bytes(rng.randrange(3) for _ in range(rng.randint(0, 14))) if rng.random() < 0.2 else edited(rng, a.decode(), rng.randint(0, 4)).encode()
        most = rng.randint(0, 4)
        assert within(a, b, most) == (distance(a, b) <= most)


def brute(docs, threshold, min_bytes):
    lines = [(i, k, x.encode()) for i, text in sorted(docs) if text is not None for k, x in enumerate(text.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= min_bytes]
    kinds = list(dict.fromkeys(x[2] for x in lines))
    lower = {k: k for k in kinds}

    def find(x):
        while lower[x] != x:
            x = lower[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                lower[find(a)] = find(b)
    seen, gone = set(), set()
    for i, k, x in lines:
        c = find(x)
        if c in seen:
            gone.add((i, k))
        seen.add(c)
    return {i: ("" if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)) for i, text in docs}


def corpus():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(12, 40))) for _ in range(25)]
    docs = []
    for i in range(150):
        own = [edited(rng, rng.choice(stems), rng.choice([0, 0, 1, 2, 3, 6])) for _ in range(rng.randint(0, 5))]
        docs.append((i, "\n".join(own)))
    return [*docs, (200, None), (201, ""), (202, "\n\n"), (203, "x" * 900), (204, "x" * 899), (205, "\n".join(["same line again here"] * 40))]


def test_same_as_comparing_all_pairs(spark):
    docs = corpus()
    for threshold in (1, 2):
        got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), threshold, 12).collect()}
        assert got == brute(docs, threshold, 12)


def test_one_large_group_of_variants_is_split(spark, monkeypatch):
    import tamiz.llm.edit_lines as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rng = random.Random(9)
    docs = [(i, edited(rng, "a common line with many variants of it", rng.randint(0, 5))) for i in range(120)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 2, 12).collect()}
    assert got == brute(docs, 2, 12)


def unlike_after_a_head(n, seed=3):
    """Lines of one length and head that differ otherwise; a few are near."""
    rng = random.Random(seed)
    docs = [(i, "Posted in category: " + "".join(rng.choice("abcdefghij") for _ in range(rng.choice([4, 9, 9, 9])))) for i in range(n)]
    return docs + [(n + i, edited(rng, docs[i][1], 2)) for i in range(0, n, 7)]


def test_keys_whose_members_are_unlike_are_split(spark, monkeypatch):
    import tamiz.llm.edit_lines as module

    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "SPREAD", 1)
    rng = random.Random(12)
    docs = unlike_after_a_head(60)
    docs += [(1000 + i, "ab" * 9 + "".join(rng.choice("abab-") for _ in range(8))) for i in range(40)]  # segments that repeat at other places
    docs += [(2000 + i, "=" * rng.randint(15, 19) + rng.choice(["", "x", "yy", "zz x"])) for i in range(30)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 2, 15).collect()}
    assert got == brute(docs, 2, 15)


def test_rows_of_unlike_lines_grow_with_the_lines(spark, monkeypatch):
    import tamiz.llm.edit_lines as module

    monkeypatch.setattr(module, "BLOCK", 16)
    plain, dealt = module._near_links, []

    def counted(rows, threshold):
        dealt.append(rows.count())
        return plain(rows, threshold)

    monkeypatch.setattr(module, "_near_links", counted)
    rows = []
    for n in (200, 400):
        dealt.clear()
        rng = random.Random(n)
        docs = [(i, "All of these lines begin alike: " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))) for i in range(n)]
        assert dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("n_removed > 0").count() == 0
        rows.append(sum(dealt))
    assert rows[1] < 2.6 * rows[0], rows


def test_lines_that_probe_their_own_segment(spark):
    # Pairs, each of its own length, that share only the run of dots; which line has the smaller hash differs.
    docs = []
    for i in range(16):
        x, dots = chr(65 + i), "." * (25 + 4 * i)
        docs += [(2 * i, f"{x}ka{dots}k{x}1c"), (2 * i + 1, f"{x}cka{dots}k{x}2c")]
    docs += [(100, "Chapter 1 ......................... p 12"), (101, "Chapter 10 ......................... p 13")]
    want = brute(docs, 2, 30)
    assert not any(want[i] for i in (*range(1, 32, 2), 101))
    assert {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 2, 30).collect()} == want


def test_short_lines(spark):
    docs = [(1, "Yes.\nAll rights reserved.\n\n  \n\u00fc"), (2, "Yes.\nAll rights reserved\n\n  \n\u00fc\nYet."), (3, "Click here to subscribe\nYes."), (4, "Click here, to subscribe!\n7")]
    got = {r.doc_id: (r.n_removed, r.n_near, r.text) for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0, docs[0][1]), 2: (3, 1, "\n  \nYet."), 3: (1, 0, "Click here to subscribe"), 4: (1, 1, "7")}


def test_empty_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "the very same line\nother", 5), (None, "the very same line", 6), (2, "the very same line", 7)], "doc_id long, text string, line int")
    assert {r.doc_id: r.text for r in dedup_lines(docs, 1, 8).collect()} == {1: "the very same line\nother", None: "the very same line", 2: ""}
    assert dedup_lines(docs.limit(0)).count() == 0


def test_rows_that_repeat_an_id_with_another_text(spark):
    one, near, alone = "the first of two lines that are near", "the first of two lines that are mear", "nothing like it is here at all"
    rows = [(1, one), (2, f"{near}\nsecond line, which no one else has"), (2, f"{alone}\nfourth line, of the second text of two"), (2, None), (2, ""), (3, f"short\n{near}")]
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 0, one), (2, 0, 0, ""), (2, 1, 0, ""), (2, 2, 0, rows[2][1]), (2, 2, 1, "second line, which no one else has"), (3, 2, 1, "short")]


def test_identical_rows_share_their_fate(spark):
    rows = [(1, "a line that comes twice in two rows\nx\na line that comes twice in two rows")] * 2
    assert [r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == ["a line that comes twice in two rows\nx"] * 2
