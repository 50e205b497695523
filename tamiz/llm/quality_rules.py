"""Quality rules from repetition coverage.

Rolling hashes of several n-gram lengths measure how many of a text's characters lie inside
word n-grams, or lines, that the text repeats. Windows never cross documents.

Defined results: a null or empty text has no words and fails the base rule; other columns of the
input are left alone; rows are judged one by one, so repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.textscan import Scan, chunks, mix, ngram_hash, per_row, seen_twice

_U = np.uint64

#: Largest share of word characters that repeated n-grams of a length may cover.
NGRAM_LIMITS = {5: 0.34, 6: 0.32, 7: 0.30, 8: 0.28, 9: 0.26, 10: 0.25}
#: Largest share of word characters that one most frequent n-gram may take.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of word characters in lines equal to an earlier one.
LINE_LIMIT = 0.30
#: Shares of texts of fewer words are too coarse for the top n-gram rule.
TOP_MIN_WORDS = 50
BASE_WINDOW, BASE_MIN_WORDS, BASE_PERCENT = 8, 20, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, "
    + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)
    + ", "
    + ", ".join(f"top_{n}gram_chars long" for n in TOP_LIMITS)
)


def _covered(scan: Scan, at: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in one of the n-word windows that begin at the words ``at``."""
    step = np.zeros(len(scan.start) + 1, np.int32)
    np.add.at(step, at, 1) if len(at) < 64 else step.__iadd__(np.bincount(at, minlength=len(step)).astype(np.int32))
    np.subtract.at(step, at + n, 1) if len(at) < 64 else step.__isub__(np.bincount(at + n, minlength=len(step)).astype(np.int32))
    return np.cumsum(step[:-1]) > 0


def measure(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The figures of every document of a chunk."""
    s = Scan(raw, off)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    chars = points[s.end] - points[s.start]
    out = {"n_words": np.diff(s.word_off), "word_chars": per_row(chars, s.word_off), "n_symbols": per_row(_SYMBOL[raw], off)}
    # lines
    start, end, doc = s.lines()
    first, last = np.searchsorted(s.start, start), np.searchsorted(s.start, end)
    worded = np.flatnonzero(last > first)
    key = s.span_hash(start[worded], end[worded]) ^ mix(doc[worded].astype(_U))
    again = np.ones(len(worded), bool)
    again[np.unique(key, return_index=True)[1]] = False
    total = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    out["n_dup_lines"] = np.bincount(doc[worded], weights=again, minlength=s.n).astype(np.int64)
    line_chars = total[last[worded]] - total[first[worded]]
    out["dup_line_chars"] = np.bincount(doc[worded], weights=line_chars * again, minlength=s.n).astype(np.int64)
    # n-grams
    words, salt = s.word_hash(), mix(s.doc.astype(_U) + _U(1))
    for n in sorted({*NGRAM_LIMITS, *TOP_LIMITS, BASE_WINDOW}):
        at = s.windows(n)
        keys = ngram_hash(words, n)[at] ^ salt[at]
        if n in NGRAM_LIMITS or n == BASE_WINDOW:
            inside = _covered(s, at[seen_twice(keys)], n)
            if n in NGRAM_LIMITS:
                out[f"dup_{n}gram_chars"] = per_row(chars * inside, s.word_off)
            if n == BASE_WINDOW:
                out["n_repeat_words"] = per_row(inside, s.word_off)
        if n in TOP_LIMITS:
            top = np.zeros(s.n, np.int64)
            some = np.flatnonzero(seen_twice(keys))
            if len(some):
                _, one, times = np.unique(keys[some], return_index=True, return_counts=True)
                one = at[some[one]]
                np.maximum.at(top, s.doc[one], times * (total[one + n] - total[one]))
            out[f"top_{n}gram_chars"] = top
    out["base_failed"] = (out["n_words"] < BASE_MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"])
    bad = out["base_failed"] | (out["dup_line_chars"] > LINE_LIMIT * out["word_chars"])
    for n, most in NGRAM_LIMITS.items():
        bad |= out[f"dup_{n}gram_chars"] > most * out["word_chars"]
    for n, most in TOP_LIMITS.items():
        bad |= (out[f"top_{n}gram_chars"] > most * out["word_chars"]) & (out["n_words"] >= TOP_MIN_WORDS)
    out["kept"] = ~bad
    return out


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        ids = batch.column(0)
        for i, j, raw, off in chunks(batch.column(1)):
            got = measure(raw, off)
            yield pa.RecordBatch.from_arrays([ids[i:j], *(pa.array(got[x]) for x in names[1:])], names=names)


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, the base rule and the verdict ``kept``."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_measure_batches, SCHEMA)
