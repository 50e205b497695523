import hashlib
import random
import re
import time

from tamiz.llm.personal_data import find_personal_data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(5)
    parts = ["a@b.c", "_d@e.f", "1.2.3.4", ".5", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (620) 555-8424", "+", "é", "😀", " ", "\n", "9", "-", "@", ".", "x.y@z", "\u0001", "\u0003"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    return [*made, None, "", "7" * 30000, "1.2.3.4 " * 300, "a" * 40000 + "@", "4 " * 20000, "\u0001a@b.cd\u0001"]


def test_base_spans_equal_a_brute_force_search(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        spans = brute(text)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[2] == k for s in spans) for k in BASE], text
        written = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest(), text
        assert set(filter(None, written.split(","))) <= set(got[i].spans.split(",")), text


def test_added_kinds_need_checksum_or_context(spark):
    rows = [(0, "pay to DE89 3704 0044 0532 0130 00 now"), (1, "pay to DE89 3704 0044 0532 0130 01 now"), (2, 'token = "40d78a45c41832440d78a45c418324aa"'), (3, "plain 40d78a45c41832440d78a45c418324aa"), (4, "ssn 123-45-6789"), (5, "code 123-45-6789")]
    got = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "iban:7:34", 1: "", 2: "secret:9:41", 3: "", 4: "ssn:4:15", 5: ""}


def test_iban_before_capitals_and_numbers(spark):
    numbers = {"DE89370400440532013000": " EUR 500", "GB82 WEST 1234 5698 7654 32": " BIC NWBKGB2L", "DE89 3704 0044 0532 0130 00": " Euro 5 OR MORE CAPITAL WORDS AFTER IT"}
    rows = [(i, f"to {n}{after}") for i, (n, after) in enumerate(numbers.items())]
    rows += [(3, "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32"), (4, "DE89370400440532013000."), (5, "DE89 3704 0044 0532 0130 01 EUR 500")]
    check = 98 - int("370400440532013000" + "3535" + "00") % 97
    rows.append((6, f"ZZ{check:02d} 3704 0044 0532 0130 00 EUR 500"))
    got = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {i: [x for x in s.split(",") if x.startswith("iban")] for i, s in got.items()}
    assert got == {i: [f"iban:3:{3 + len(n)}"] for i, n in enumerate(numbers)} | {3: ["iban:0:27", "iban:28:55"], 4: ["iban:0:22"], 5: [], 6: ["iban:0:27"]}


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.c", "x", 2)], "doc_id long, text string, spans string, email int")
    assert find_personal_data(docs).first().spans == "email:0:5"
    assert find_personal_data(docs.limit(0)).count() == 0


def test_very_many_matches_and_labels(spark):
    many = " ".join(f"write to user{i}@mail.example.com or 10.0.0.{i % 256}" for i in range(100_000))
    rows = [(0, many), (1, "a@" + "b.c." * 500_000 + "d"), (2, "1." * 500_000), (3, "+1 " * 300_000), (4, "DE89 " * 200_000), (5, "9" * 1_000_000)]
    began = time.time()
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert time.time() - began < 60
    assert (got[0].n_email, got[0].n_ip, got[0].n_spans) == (100_000, 100_000, 200_000)
    base = sorted([(m.start(), rank, kind, m.end()) for rank, kind in enumerate(("email", "ip")) for m in re.finditer(BASE[kind], many)])
    assert got[0].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base).encode()).hexdigest()
    assert got[1].n_email == 1 and got[1].spans == f"email:0:{2 + 4 * 500_000 + 1}"
    assert all(f"email:{s}:{e}:1.0" in got[0].scored_spans for s, _, k, e in base[:600:2])
