"""Requirements of a posting: skills with level, exigency and confidence.

The body runs as a vectorised Arrow function: a hundred patterns with offsets, and context that depends on
the neighbouring matches, would make one expression too large to compile. Ranking, the rule on parents and
children, filters and labels are array expressions on its result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tamiz.functions import skills as k
from tamiz.functions.text import bind, text

# Spelled out, since workers import this module without a session that could parse a string.
_FOUND = ArrayType(StructType([StructField(n, IntegerType() if n in ("relevance", "position", "ordinal") else StringType()) for n in "name category level exigency confidence relevance position parent ordinal".split()]))


@lru_cache(maxsize=1)
def catalogue() -> list[tuple[str, re.Pattern, str, bool, str | None, int]]:
    """(name, pattern, category, has levels, parent, relevance) in order."""
    out = []
    for category, lines in k.SKILLS.items():
        for line in lines.strip().splitlines():
            head, pattern = line.split(" = ", 1)
            name = head.split(" [")[0]
            option = dict(re.findall(r"\[(level|parent|relevance) ?([^\]]*)\]", head))
            out.append((name, re.compile(pattern, re.ASCII), category, "level" in option, option.get("parent"), int(option.get("relevance", k.CATEGORIES[category]))))
    return out


def stems(pattern: str) -> tuple[str, ...]:
    """Of each alternative of a catalogue pattern, literal text that any match of it contains."""
    out = []
    simple = re.sub(r"\(\?!.*?\)", "", pattern)
    for alternative in re.split(r"\|(?![^()]*\))", simple):
        loose = lambda t: re.sub(r"\[[^\]]*\]|\\[bsw][*+?]?|.[?*]|\\", " ", t)
        outside = max(re.findall(r"[^ +]+", loose(re.sub(r"\([^)]*\)\??", " ", alternative))), key=len, default="")
        groups = re.findall(r"\(([^)]*)\)(?!\?)", alternative)
        out += [outside] if outside else [max(re.findall(r"[^ +]+", loose(x)), key=len) for x in groups[0].split("|")]
    return tuple(out)


@lru_cache(maxsize=1)
def _needs() -> list[tuple[str, ...]]:
    return [stems(row[1].pattern) for row in catalogue()]


@lru_cache(maxsize=1)
def _automaton():
    """All stems in one automaton, each with the places of its skills in the catalogue; none where the library is missing."""
    try:
        import ahocorasick
    except ImportError:
        return None
    skills: dict[str, list[int]] = {}
    for ordinal, needs in enumerate(_needs()):
        for stem in needs:
            skills.setdefault(stem, []).append(ordinal)
    found = ahocorasick.Automaton()
    for stem, ordinals in skills.items():
        found.add_word(stem, tuple(ordinals))
    found.make_automaton()
    return found


def candidates(joined: str, ends: list[int]) -> list[list[int]]:
    """Of each text, given where each ends in the joined ones, the skills of which it holds a stem, in catalogue order."""
    found = _automaton()
    if found is None:
        begins = [0, *(e + 1 for e in ends[:-1])]
        return [[n for n, needs in enumerate(_needs()) if any(joined.find(stem, b, e) >= 0 for stem in needs)] for b, e in zip(begins, ends)]
    out: list[set[int]] = [set() for _ in ends]
    k, end, here = 0, ends[0] if ends else 0, out[0] if ends else set()
    for at, ordinals in found.iter(joined):
        if at >= end:
            k = bisect_right(ends, at, k)
            end, here = ends[k], out[k]
        here.update(ordinals)
    return [sorted(x) for x in out]


#: A character of private use that stands between joined texts.
_BETWEEN = "\ue000"


def _without(t: str, drop: Callable[[str], bool], instead: str) -> str:
    """Each character of which ``drop`` holds replaced; ASCII ones stay."""
    for c in set(t):
        if c > "\x7f" and drop(c):
            t = t.replace(c, instead)
    return t


def _decoded(raw: str) -> str:
    """Entities decoded twice."""

    def numeric(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 32 <= code <= 0x2FFF else " "

    for _ in range(2 if "&" in raw else 0):
        for entity, char in k.ENTITIES.items():
            raw = re.sub(re.escape(entity), lambda _, c=char: c, raw, flags=re.IGNORECASE)
        raw = re.sub(r"&#x([0-9a-fA-F]{1,8});|&#([0-9]{1,9});", numeric, raw)
    return raw


#: The letter that begins a glued word, seen from the one before it.
_GLUED = re.compile(k.GLUED.replace("(", "(?<=", 1))


def _lowered(raw: str) -> str:
    """Symbols and glued words split, accents dropped, lower case; line breaks stay. Nothing here looks beyond a character of private use."""
    if not raw.isascii():
        raw = _without(raw, lambda c: c == "\ufe0f" or unicodedata.category(c) in ("So", "Cn"), " ")
    raw = _GLUED.sub(r" \1", raw)
    if not raw.isascii():
        raw = _without(unicodedata.normalize("NFD", raw), lambda c: unicodedata.category(c) == "Mn", "")
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"[\r\n]+", "\n", raw)).lower()


def plain(raw: str) -> str:
    """Entities decoded, symbols and glued words split, accents dropped, lower case; line breaks stay."""
    return _lowered(_decoded(raw))


_HEADING = re.compile(rf"\b({k.EXCLUDED_HEADING}|{k.REQUIRED_HEADING}|{k.DUTIES_HEADING}){k.HEADING_TAIL}", re.ASCII)


def sections(t: str) -> list[tuple[int, str]]:
    """(end, kind) of the stretches of a text; a heading belongs to the stretch before it."""
    out, kind = [], "INTRO"
    for m in _HEADING.finditer(t):
        out.append((m.end(), kind))
        kind = "EXCLUIDA" if re.fullmatch(k.EXCLUDED_HEADING, m[1], re.ASCII) else "REQUISITOS" if re.fullmatch(k.REQUIRED_HEADING, m[1], re.ASCII) else "FUNCIONES"
    return [*out, (len(t), kind)]


def _kind_at(parts: list[tuple[int, str]], position: int) -> str:
    return next((kind for end, kind in parts if position < end), "INTRO")


def _context(t: str, start: int, end: int, starts: list[int], ends: list[int]) -> tuple[str, str]:
    """What stands before and after a match, up to a separator or the neighbouring match."""
    stop = min([len(t), end + k.CHARS_AFTER, *[s for s in starts if s > end][:1]])
    post = re.split(r"[.;\n]", t[end:stop], maxsplit=1)[0]
    floor = max([0, start - k.CHARS_BEFORE, *[e for e in ends if e <= start][-1:]])
    return re.split(r"[.;\n]", t[floor:start])[-1], post


def find_requirements(title: str, description: str) -> list[dict]:
    """All skills of one posting in order of position, before parents and children are reconciled."""
    return find_all_requirements([f"{title}. {description}"])[0]


#: Characters of texts that are searched at a time.
JOINED_CHARS = 1 << 20


def find_all_requirements(raw: list[str]) -> list[list[dict]]:
    """The skills of each text. Texts are joined, normalised and searched for the stems of all patterns at once, in runs of bounded size."""
    out: list[list[dict]] = []
    run: list[str] = []
    size = 0
    for text_ in raw:
        run.append(_decoded(text_).replace(_BETWEEN, " "))
        size += len(text_)
        if size >= JOINED_CHARS:
            out += _searched(run)
            run, size = [], 0
    return out + _searched(run)


def _searched(run: list[str]) -> list[list[dict]]:
    if not run:
        return []
    joined = _lowered(_BETWEEN.join(run))
    texts = joined.split(_BETWEEN)
    ends = list(accumulate((len(t) + 1 for t in texts), initial=-1))[1:]
    return [_read(t, ordinals) for t, ordinals in zip(texts, candidates(joined, ends), strict=True)]


def _read(t: str, ordinals: list[int]) -> list[dict]:
    """The skills of a normalised text among those whose stems it holds."""
    parts = sections(t)
    found = []
    for ordinal in ordinals:
        name, pattern, category, leveled, parent, relevance = catalogue()[ordinal]
        m = next((m for m in pattern.finditer(t) if _kind_at(parts, m.start()) != "EXCLUIDA"), None)
        if m:
            found.append((m.start(), ordinal, m.end(), name, category, leveled, parent, relevance))
    found.sort()
    starts, ends = [f[0] for f in found], [f[2] for f in found]
    out, previous, previous_end = [], None, None
    for start, ordinal, end, name, category, leveled, parent, relevance in found:
        pre, post = _context(t, start, end, starts, ends)
        level = next((label for label, p in k.LEVELS if re.search(p, f"{pre} {post}", re.ASCII)), None) if leveled else None
        exigency = None
        for window in (post, pre):
            exigency = exigency or ("DESEABLE" if re.search(k.DESIRABLE, window, re.ASCII) else "INDISPENSABLE" if re.search(k.MANDATORY, window, re.ASCII) else None)
        # Overlapping matches have nothing between them that could connect them.
        if exigency is None and previous and previous_end <= start and re.fullmatch(k.CONNECTOR, t[previous_end:start], re.ASCII):
            exigency = previous
        previous, previous_end = exigency, end
        confidence = {"REQUISITOS": "ALTA", "FUNCIONES": "MEDIA"}.get(_kind_at(parts, start), "BAJA")
        out.append({"name": name, "category": category, "level": level, "exigency": exigency or "NO_ESPECIFICADO", "confidence": confidence, "relevance": relevance, "position": start, "parent": parent, "ordinal": ordinal})
    return out


@F.pandas_udf(_FOUND)
def _found(title: pd.Series, description: pd.Series) -> pd.Series:
    return pd.Series(find_all_requirements([f"{a or ''}. {b or ''}" for a, b in zip(title, description)]))


def requirements(title: Column | str, description: Column | str) -> Column:
    """array<struct>, best first: relevance plus confidence, then position."""
    return bind(_found(text(title), text(description)), _ranked)


def _ranked(found: Column) -> Column:
    parents = F.transform(found, lambda r: r["parent"])
    children = lambda name: F.size(F.filter(parents, lambda p: F.coalesce(p == name, F.lit(False))))
    # Two or more children stand for their parent's name; an only child replaces its parent.
    kept = F.filter(found, lambda r: ~(F.coalesce(children(r["parent"]) >= 2, F.lit(False)) | (children(r["name"]) == 1)))
    weight = lambda r: r["relevance"] + F.when(r["confidence"] == "ALTA", k.CONFIDENCE["ALTA"]).when(r["confidence"] == "MEDIA", k.CONFIDENCE["MEDIA"]).otherwise(0)
    ranked = F.array_sort(F.transform(kept, lambda r: F.struct((-weight(r)).alias("order"), r["position"].alias("position"), r["ordinal"].alias("ordinal"), r.alias("r"))))
    return F.transform(ranked, lambda x: x["r"])


def of_categories(found: Column, categories: tuple[str, ...]) -> Column:
    return F.filter(found, lambda r: r["category"].isin(*categories))


def labels(found: Column, n: int) -> Column:
    """Name and level of the first ``n``."""
    return F.transform(F.slice(found, 1, n), lambda r: F.concat_ws(" ", r["name"], F.initcap(F.lower(r["level"]))))
