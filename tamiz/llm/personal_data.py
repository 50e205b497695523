"""Personal data: proposed by regular expressions, confirmed by checksums, weighed by context.

Everything is a DataFrame expression. Matches and their code point offsets come from putting a mark on
both sides of every match, splitting at the marks and adding up the lengths of the parts. Texts
without an ``@``, a digit or a ``+`` skip the patterns that need one.

Base kinds (email, ip, card, phone) stay whatever their score. Added kinds (iban, secret, ssn) stay
from a score of ``LEAST_SCORE``: a prior, what a passed validator adds, and what context words in the
``CONTEXT_CHARS`` characters before the match add.

Defined results: null text is empty text, without spans; a proposed match that fails its check is dropped
and not searched again; rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import bind

MARK = "\u0001"
CONTEXT_CHARS = 40
LEAST_SCORE = 0.6
#: Stands for one space or hyphen between two digits; keeps the length.
JOINT = "\u0003"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(14, 19) & F.call_function("luhn_check", d)


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _iban_ok(m: Column) -> Column:
    """The number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    left = F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (left == 1)


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_KNOWN = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
_IBAN_EXACT = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
#: The country's length if it ends there, or else as many characters as can belong to one.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN_EXACT}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))"


def _iban_parts(m: Column) -> Column:
    """What may be the number: the match, and where the country's length isn't known also its parts up to a space, longest first."""
    words = F.split(m, " ")
    parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    return F.when(m.rlike(f"^(?:{_IBAN_KNOWN})"), F.array(m)).otherwise(parts)


def _secret_ok(m: Column) -> Column:
    return (F.regexp_count(m, F.lit("[0-9]")) >= 3) & (F.regexp_count(m, F.lit("[A-Za-z]")) >= 3)


def _always(m: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    needs: tuple[str, ...]
    prior: float
    context: str
    context_bonus: float
    base: bool = False
    joined: bool = False
    parts: Callable[[Column], Column] | None = None


# A pattern that begins at (?:\G|(?<!x)) finds what it would without: no match can begin inside a run of x
# unless it also does at the run's start or where the match before it ended.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _always, ("@",), 0.9, "mail|contact|write", 0.1, base=True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _ip_ok, ("digit",), 0.6, r"\bip\b|host|server|address|login", 0.3, base=True),
    Kind("card", rf"[0-9][0-9{JOINT}]+", _card_ok, ("digit",), 0.8, "card|visa|credit|pay|account", 0.2, base=True, joined=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone_ok, ("digit", "+"), 0.7, "phone|tel|call|mobile|fax", 0.3, base=True),
    Kind("iban", IBAN, _iban_ok, ("digit",), 0.8, "iban|bank|account|transfer", 0.2, parts=_iban_parts),
    Kind("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+", _secret_ok, ("digit",), 0.3, r"token|secret|passw|api.?key|access.?key|credential", 0.5),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _always, ("digit",), 0.3, r"\bssn\b|social security", 0.5),
)
_EMPTY = "array<struct<start:int,kind_rank:int,kind:string,end:int,score:double>>"


#: Parts of a split text that are put together at a time; even, so that a run of parts begins outside a match.
RUN = 256
_FOUND = "array<struct<start:int,end:int,m:string,before:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m, before>> of the leftmost non-overlapping matches; before: up to CONTEXT_CHARS characters.

    An array grows by copying, so a text of very many matches is put together in runs, whose first offsets are summed up beforehand.
    """
    return bind(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK), lambda parts: F.when(F.size(parts) <= RUN, _run(parts, F.lit(0), F.lit(""))).otherwise(_runs(parts)))


def _run(parts: Column, at: Column, before: Column) -> Column:
    def add(acc: Column, part: Column) -> Column:
        end = acc["pos"] + F.length(part)
        found = F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("start"), end.alias("end"), part.alias("m"), acc["before"].alias("before"))))
        tail = F.right(F.concat(acc["before"], part), F.lit(CONTEXT_CHARS))
        return F.struct(end.alias("pos"), (~acc["match"]).alias("match"), tail.alias("before"), F.when(acc["match"], found).otherwise(acc["out"]).alias("out"))

    start = F.struct(at.alias("pos"), F.lit(False).alias("match"), before.alias("before"), F.array().cast(_FOUND).alias("out"))
    return F.aggregate(parts, start, add, lambda acc: acc["out"])


def _runs(parts: Column) -> Column:
    numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int"))
    sizes = F.transform(numbers, lambda k: F.aggregate(F.slice(parts, k * RUN + 1, RUN), F.lit(0), lambda n, part: n + F.length(part)))
    begins = F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    # A match has a character at least, so twice as many parts hold enough of them.
    tail = lambda k: F.right(F.array_join(F.slice(parts, F.greatest(k * RUN - 2 * CONTEXT_CHARS, F.lit(0)) + 1, F.least(k * RUN, F.lit(2 * CONTEXT_CHARS))), ""), F.lit(CONTEXT_CHARS))
    return bind(begins, lambda at: F.flatten(F.transform(numbers, lambda k: _run(F.slice(parts, k * RUN + 1, RUN), F.get(at, k), tail(k)))))


def _spans(kind: Kind, rank: int) -> Column:
    text = F.regexp_replace("_t", r"(?<=[0-9])[\x20-](?=[0-9])", JOINT) if kind.joined else F.col("_t")
    found = _matches(text, kind.pattern)
    if kind.parts:

        def longest(x: Column) -> Column:
            m = F.get(F.filter(kind.parts(x["m"]), kind.confirm), 0)
            return F.struct(x["start"].alias("start"), (x["start"] + F.length(m)).alias("end"), m.alias("m"), x["before"].alias("before"))

        found = F.filter(F.transform(found, longest), lambda x: x["m"].isNotNull())
    else:
        found = F.filter(found, lambda x: kind.confirm(x["m"]))

    def scored(x: Column) -> Column:
        score = F.lit(kind.prior) + F.when(F.lower(x["before"]).rlike(kind.context), kind.context_bonus).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("kind_rank"), F.lit(kind.name).alias("kind"), x["end"].alias("end"), F.round(score, 2).alias("score"))

    out = F.transform(found, scored)
    if not kind.base:
        out = F.filter(out, lambda x: x["score"] >= LEAST_SCORE)
    needs = [F.col("_digit") if n == "digit" else F.contains(F.col("_t"), F.lit(n)) for n in kind.needs]
    possible = needs[0] if len(needs) == 1 else needs[0] & needs[1]
    return F.when(possible, out).otherwise(F.array().cast(_EMPTY))


def _written(spans: Column, with_score: bool = False) -> Column:
    def one(x: Column) -> Column:
        parts = [x["kind"], x["start"].cast("string"), x["end"].cast("string")]
        return F.concat_ws(":", *parts, *([x["score"].cast("string")] if with_score else []))

    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, base_sha256, all spans, their number, and the spans with their scores."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), MARK + JOINT, "\u0004\u0005")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t"))
    rows = rows.withColumn("_digit", F.col("_t").rlike("[0-9]"))
    rows = rows.select("doc_id", *(_spans(k, i).alias(k.name) for i, k in enumerate(KINDS)))
    base = [k.name for k in KINDS if k.base]
    every = F.concat(*(F.col(k.name) for k in KINDS))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_written(F.concat(*map(F.col, base))), 256).alias("base_sha256"),
        _written(every).alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
        _written(every, True).alias("scored_spans"),
    )
