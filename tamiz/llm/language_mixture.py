"""Language identification by inference of language mixtures.

A document is taken for a mixture of languages. From hashed byte trigram likelihoods,
expectation-maximisation estimates its proportions; languages join the set one at a time, and one
stays only if it raises the log-likelihood by more than a penalty that grows with the logarithm of
the document's length; at the end, the least of three or more goes if it isn't worth the penalty any more.

The likelihoods are counted over all training rows: each task sums its rows into a table of
languages by ``BUCKETS`` counts, and these tables are added up by bucket. What the driver receives and
sends to the tasks is that one table, bounded by the number of languages, not by the corpus.

Defined results: null text, or text without a letter, is ``und`` with score 0; without any training row all
documents are ``und``; rows are judged one by one, so repeated rows agree; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.textscan import chunks, per_row

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.3
#: A trigram shares its letters with its neighbours, so three of them count as one observation.
OVERLAP = 3.0
#: Log-likelihood that each further language must gain, times log(observations).
PENALTY = 1.5
ROUNDS, SETTLED = 40, 1e-4
UNDETERMINED = "und"
#: A language takes 256 KB of the table that every task gets; more of them mean that the column holds something else.
MOST_LANGUAGES = 500

#: All ASCII but letters becomes a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = 32


def _trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every trigram of lower-cased text; runs of spaces count as one."""
    b = _FOLD[raw]
    n = len(off) - 1
    # Each document gets a space before and after it.
    size = np.diff(off) + 2
    to = np.concatenate([[0], np.cumsum(size)])
    full = np.full(to[-1], 32, np.uint8)
    place = np.arange(len(b)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))
    full[place] = b
    first = np.zeros(len(full), bool)
    first[to[:-1]] = True
    keep = (full != 32) | first
    keep[1:] |= full[:-1] != 32
    length = per_row(keep, to)
    full = full[keep].astype(np.uint32)
    doc = np.repeat(np.arange(n), length)
    if len(full) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (full[:-2] * np.uint32(0x9E3779B1) + full[1:-1] * np.uint32(0x85EBCA77) + full[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    inside = doc[:-2] == doc[2:]
    return doc[:-2][inside], (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)[inside]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        names, which = np.unique(langs, return_inverse=True)
        for i, j, raw, off in chunks(pc.utf8_lower(batch.column(0))):
            doc, bucket = _trigrams(raw, off)
            got = np.bincount(which[i:j][doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for k, name in enumerate(names):
                table[name] = table.get(name, 0) + got[k]
    for name, counts in sorted(table.items()):
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])


def learn(training: DataFrame, text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages in order and P(trigram bucket | language), one column a language; more than ``most_languages`` are refused before any text is read."""
    training = training.where(F.col(lang_col).isNotNull())
    if training.select(F.col(lang_col).cast("string")).distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages: their table would not stay small")
    counts = training.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    table = np.zeros((BUCKETS, len(langs)))
    table[got["bucket"].to_numpy(), np.searchsorted(np.array(langs), np.array(got["lang"].to_pylist(), str)) if langs else []] = got["n"].to_numpy()
    return langs, (table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * BUCKETS)


def _mixture(p: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions that expectation-maximisation settles on, and the likelihood of each bucket."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    total = count.sum()
    for _ in range(ROUNDS):
        new = share * ((count / (p @ share)) @ p) / total
        done = np.abs(new - share).max() < SETTLED
        share = new
        if done:
            break
    return share, p @ share


def infer(p: np.ndarray, count: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The chosen languages, most likely first, and their proportions."""
    total = count.sum()
    need = OVERLAP * PENALTY * np.log(2 + total / OVERLAP)
    single = count @ np.log(p)
    chosen = [int(np.argmax(single))]
    share, mixed, now = np.ones(1), p[:, chosen[0]], single[chosen[0]]
    while len(chosen) < p.shape[1]:
        slope = (count / mixed) @ p
        slope[chosen] = 0
        best = int(np.argmax(slope))
        if slope[best] - total <= need:  # the log-likelihood is concave, so no more than this can be gained
            break
        new_share, new_mixed = _mixture(p[:, [*chosen, best]], count)
        then = float(count @ np.log(new_mixed))
        if then - now <= need:
            break
        chosen, share, mixed, now = [*chosen, best], new_share, new_mixed, then
    # What came first may have stood for two that came later.
    while len(chosen) > 2:
        rest = np.delete(np.array(chosen), np.argmin(share))
        new_share, new_mixed = _mixture(p[:, rest], count)
        then = float(count @ np.log(new_mixed))
        if now - then > need:
            break
        chosen, share, now = rest.tolist(), new_share, then
    order = np.argsort(-share, kind="stable")
    return [chosen[k] for k in order], share[order]


def _predictor(langs: list[str], p: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score, count, mix = [UNDETERMINED] * len(text), np.zeros(len(text)), np.zeros(len(text), np.int32), [""] * len(text)
            for i, j, raw, off in chunks(pc.utf8_lower(text)) if langs else ():
                doc, bucket = _trigrams(raw, off)
                key = np.sort(doc * BUCKETS + bucket)
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(key))).astype(float)
                key = key[first]
                bounds = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)
                rows = p[key % BUCKETS]
                for k in np.flatnonzero(lettered[i:j] & (np.diff(bounds) > 0)):
                    own = slice(bounds[k], bounds[k + 1])
                    chosen, share = infer(rows[own], times[own])
                    pred[i + k], score[i + k], count[i + k] = langs[chosen[0]], min(1.0, float(share[0])), len(chosen)
                    mix[i + k] = ",".join(f"{langs[c]}:{s:.3f}" for c, s in zip(chosen, share))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(count), pa.array(mix, pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "n_langs", "mixture"],
            )

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def language_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the main language's proportion), n_langs, mixture."""
    langs, p = learn(docs.where(~held_out(id_col)), text_col, lang_col, most_languages)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predictor(langs, p), "doc_id long, held_out boolean, lang_pred string, score double, n_langs int, mixture string")
