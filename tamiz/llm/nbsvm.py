"""Quality classifier: naive Bayes features under a linear support vector machine.

Features are indicators of hashed byte trigrams and of one to three consecutive word shapes (case,
symbols, length, equality to the word before). Each is scaled by its class log-count ratio; dual
coordinate descent fits a hinge-loss linear model to the scaled vectors; a logistic curve, fitted to
documents kept apart, turns margins into scores.

The model is fitted on a bounded sample of labelled rows: the ``sample`` (default ``SAMPLE``) of
smallest id hash. Only that bounded set of ids is broadcast and only its features, of one row an id, meet in one task;
every document of the corpus is scored in place.

Defined results: null text is scored as empty text; labels without a quality are ignored, a document with
contradicting labels takes their larger half (ties: 1); without labels of both classes the score is the
smoothed share of label 1 (0.5 without any); repeated rows agree; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tamiz.llm.session import fresh
from tamiz.llm.textscan import Scan, chunks, mix

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SAMPLE = 12_000
COST, EPOCHS, TOLERANCE = 1.0, 12, 1e-3
#: Of the sample, one document in so many serves the curve instead of the margin.
CURVE_EVERY = 5
THRESHOLD = 0.3
_U = np.uint64

_UPPER, _LOWER, _SYMBOL, _DIGIT = (np.zeros(256, np.int32) for _ in range(4))
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_SYMBOL[[ord(c) for c in "#*$%&|<>!=_~^@\\/{}[]"]] = 1
_DIGIT[48:58] = 1


def _shapes(s: Scan) -> np.ndarray:
    """A small number for the shape of each word."""

    def within(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(s.raw) + 1, np.int32)
        np.cumsum(table[s.raw], out=total[1:])
        return total[s.end] - total[s.start]

    upper, lower, h = within(_UPPER), within(_LOWER), s.word_hash()
    case = np.where(upper == 0, 0, np.where(lower > 0, 1, np.where(upper > 1, 2, 3)))
    same = np.zeros(len(h), np.int64)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (s.doc[1:] == s.doc[:-1])
    size = np.digitize(s.end - s.start, [2, 4, 7, 13, 25, 60])
    symbols = np.minimum(within(_SYMBOL), 2)
    return (((case * 2 + same) * 7 + size) * 3 + symbols) * 2 + (within(_DIGIT) > 0)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds by document and the sorted distinct buckets of each."""
    s, found = Scan(raw, off), []
    if len(raw) >= 3:
        x = raw.astype(np.uint32)
        code = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        doc = np.repeat(np.arange(s.n), np.diff(off))
        inside = doc[:-2] == doc[2:]
        found.append(((doc[:-2] << BUCKET_BITS) | (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int64))[inside])
    shape = _shapes(s).astype(_U)
    for n in (1, 2, 3):
        at = s.windows(n)
        h = np.full(len(at), n, _U)
        for k in range(n):
            h = h * _U(0x9E3779B97F4A7C55) + shape[at + k]
        found.append((s.doc[at] << BUCKET_BITS) | (mix(h) >> _U(64 - BUCKET_BITS)).astype(np.int64))
    key = np.sort(np.concatenate(found))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return np.searchsorted(key, np.arange(s.n + 1) << BUCKET_BITS), key & (BUCKETS - 1)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, off in chunks(batch.column(2)):
            bounds, bucket = features(raw, off)
            packed = [bucket[bounds[k] : bounds[k + 1]].astype("<u2").tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(packed, pa.binary())], names=["doc_id", "label", "found"])


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """log((1 + p) / |1 + p|) - log((1 + q) / |1 + q|) by bucket, over documents of label 1 and 0."""
    sides = []
    for y in (1, 0):
        own = [rows[k] for k in np.flatnonzero(label == y)]
        n = 1.0 + np.bincount(np.concatenate(own), minlength=BUCKETS)
        sides.append(np.log(n / n.sum()))
    return sides[0] - sides[1]


def dual_descent(rows: list[np.ndarray], scaled: np.ndarray, norm: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularised hinge-loss model, one dual variable at a time."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at = rows[i]
            x = scaled[at] / norm[i]
            slope = y[i] * (w[at] @ x + bias) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])  # x has length 1 and the bias adds 1
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                bias += step
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < TOLERANCE:
            break
    return np.append(w, bias)


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method on smoothed targets."""
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((label == 0).sum() + 2))
    x, ab = np.column_stack([margin, np.ones(len(margin))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        ab += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


def _norm(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares, 1e-12))


def fit(rows: list[np.ndarray], label: np.ndarray) -> dict:
    """The model from distinct buckets and labels; rows in a fixed order."""
    if min((label == 1).sum(), (label == 0).sum()) < 2:
        share = (label.sum() + 1) / (len(label) + 2)
        return {"ratio": np.zeros(BUCKETS), "weight": np.zeros(BUCKETS + 1), "slope": 1.0, "offset": float(np.log(share / (1 - share)))}
    apart = np.arange(len(rows)) % CURVE_EVERY == 0
    if min((label[~apart] == 1).sum(), (label[~apart] == 0).sum(), (label[apart] == 1).sum(), (label[apart] == 0).sum()) == 0:
        apart = np.ones(len(rows), bool)
        main = apart
    else:
        main = ~apart
    own, y = [rows[k] for k in np.flatnonzero(main)], label[main]
    ratio = log_count_ratio(own, y)
    norm = lambda some: _norm(np.array([np.square(ratio[x]).sum() for x in some]))
    cost = COST * np.where(y == 1, 1.0, np.sqrt((y == 1).sum() / (y == 0).sum()))
    weight = dual_descent(own, ratio, norm(own), np.where(y == 1, 1.0, -1.0), cost)
    later = [rows[k] for k in np.flatnonzero(apart)]
    margin = np.array([weight[x] @ ratio[x] for x in later]) / norm(later) + weight[-1]
    slope, offset = _curve(margin, label[apart])
    return {"ratio": ratio, "weight": weight, "slope": slope, "offset": offset}


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, labels, rows = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
        rows += [np.frombuffer(x, "<u2") for x in batch.column(2).to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k], rows[k].tobytes()))
    m = fit([rows[k].astype(np.int64) for k in order], np.array([labels[k] for k in order], int))
    yield pa.RecordBatch.from_pydict({"ratio": [m["ratio"].tobytes()], "weight": [m["weight"].tobytes()], "slope": [m["slope"]], "bias": [m["offset"]]})


def _scorer(ratio: np.ndarray, weight: np.ndarray, slope: float, offset: float, names: tuple[str, str] = ("score", "predicted")) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    pull, square = weight[:-1] * ratio, np.square(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in chunks(batch.column(batch.num_columns - 1)):
                bounds, bucket = features(raw, off)
                sums = []
                for table in (pull, square):
                    total = np.concatenate([[0.0], np.cumsum(table[bucket])])
                    sums.append(total[bounds[1:]] - total[bounds[:-1]])
                margin = np.where(np.diff(bounds) > 0, sums[0] / _norm(sums[1]), 0.0) + weight[-1]
                # Rounded, so that the place of a document in its batch doesn't show.
                value = np.round(1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30))), 9)
                yield pa.RecordBatch.from_arrays(
                    [*(c[i:j] for c in batch.columns[:-1]), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names[:-1], *names]
                )

    return score


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Fits the model; returns its arrays."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.avg((F.col(label_col) > 0).cast("int")).alias("_share"))
    few = known.select("_id", (F.col("_share") >= 0.5).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(few), "_id")
    found = rows.select("_id", "_label", "_text").mapInArrow(_feature_batches, "doc_id long, label int, found binary")
    # One row an id, however often it is repeated: what meets in one task is bounded by the sample.
    found = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("found").alias("found"))
    got = found.repartition(1).mapInArrow(_fit_batches, "ratio binary, weight binary, slope double, bias double").first()
    return {"ratio": np.frombuffer(got["ratio"]), "weight": np.frombuffer(got["weight"]), "slope": got["slope"], "offset": got["bias"]}


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(**model), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    model = train(docs, labels, sample, id_col, text_col, label_col)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text, score, predicted = fresh(docs.columns, "text_to_score", "quality_score", "quality_predicted")
    rows = docs.select(*columns, F.col(f"`{text_col}`").cast("string").alias(text))
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType()), StructField(predicted, IntegerType())])
    return rows.mapInArrow(_scorer(**model, names=(score, predicted)), schema).where(F.col(predicted) == 1).select(*columns)
