"""Vectors as four bytes: product codes whose nearest entries are found through lower bounds of segment means.

Components become whole numbers, floor(1024 x). Each of ``PARTS`` equal parts of a vector gets the index of the nearest entry of its
position's codebook. For a part and an entry, cut into segments of equal length w, w * sum((mean - mean)^2) + (residual norm - residual norm)^2
never exceeds their squared distance. The bounds are taken for one segment, then two, four and so on; an entry goes when its bound, less a margin that exceeds all rounding, is above the
exact distance of the best candidate so far, which is the entry of least bound. What is left gets its exact integer
distance, ties to the lower index, so the filter changes no result.

Every pass reads the table anew (scan and codes are cheap beside a second copy of it); what a pass brings to the driver are the sums of ``ENTRIES``
entries a part, whatever the number of vectors: tasks sum what they assign, Spark sums that by entry. The codebooks are broadcast (256 entries of
the vector's length). The final codes are written to the checkpoint folder once and read for the sums by label.

Defined results: vectors that are null or hold null or non-finite components go. With fewer than 256 vectors the codebooks have so many
entries; equal vec_ids start entries in order of their vectors, a null vec_id comes last; equal entries go by the lower index. An empty table gives an empty result; other
columns aren't read. Vectors of unequal length, of a length that isn't a multiple of four, or with components beyond
+-``LARGEST`` / 1024 stop the job with a message, since their distances wouldn't be defined or exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.session import ensure_checkpoint_dir

PARTS, ENTRIES, ROUNDS, GRID = 4, 256, 4, 1024
#: Distances of parts of up to 2,048 components of this size stay below 2**63.
LARGEST = 1 << 24
#: Vectors that are compared at a time.
CHUNK_ROWS = 1024
#: Labels up to which the sums by label are broadcast (16 bytes each).
BROADCAST_LABELS = 1_000_000


def usable(vector: Column) -> Column:
    """Whether the vector has no null, NaN or infinite component; false for a null vector."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def whole(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of whole numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"a vector has {lengths[lengths != width][0]} components, the first one {width}")
    out = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * GRID)
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // GRID} have no exact distances")
    return out.astype(np.int64).reshape(len(lengths), width)


class Segments:
    """Segment means and residual norms of the rows of a matrix, coarse to fine."""

    def __init__(self, x: np.ndarray):
        n, d = x.shape
        self.x, self.levels = x, []
        f = x.astype(np.float64)
        square = np.einsum("ij,ij->i", f, f)
        k = 1
        while k < d:
            mean = f.reshape(n, k, d // k).mean(2)
            near = d // k * np.einsum("ij,ij->i", mean, mean)
            self.levels.append((d // k, mean, near, np.sqrt(np.maximum(square - near, 0))))
            k = k * 2 if d % (k * 2) == 0 else d
        #: More than any bound of these rows can be off by rounding.
        self.margin = 1e-9 * square.max(initial=0) + 1e-3


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two matrices, pair by pair."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def nearest(x: np.ndarray, entries: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, ties to the lower one, and its exact squared distance."""
    n, book = len(x), entries.x
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mine = Segments(x)
    margin = mine.margin + entries.margin
    best = distances(x, book[np.zeros(n, np.int64)])
    left = np.ones((n, len(book)), bool)
    for (width, mean, near, rest), (_, mean_e, near_e, rest_e) in zip(mine.levels, entries.levels):
        # The root of a residual near zero may be off by the root of the margin.
        gap = np.maximum(np.abs(rest[:, None] - rest_e) - margin**0.5, 0)
        bound = near[:, None] + near_e - (2 * width) * (mean @ mean_e.T) + gap * gap - margin
        np.minimum(best, distances(x, book[bound.argmin(1)]), out=best)
        left &= bound <= best[:, None]
    row, entry = np.nonzero(left)
    exact = distances(x[row], book[entry])
    begin = np.searchsorted(row, np.arange(n))
    best = np.minimum.reduceat(exact, begin)
    first = np.flatnonzero(exact == best[row])
    _, once = np.unique(row[first], return_index=True)
    return entry[first[once]], best


def _assigned(shared, width: int, columns: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Codes and errors of vectors; with no further columns, the number and sums of the parts of each entry instead."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Segments(book) for book in shared.value]
        d = width // PARTS
        count = np.zeros((PARTS, ENTRIES), np.int64)
        total = np.zeros((PARTS, ENTRIES, d), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                rows = batch.slice(at, CHUNK_ROWS)
                x = whole(rows.column(0), width)
                codes, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
                for p, book in enumerate(books):
                    part = np.ascontiguousarray(x[:, p * d : (p + 1) * d])
                    index, far = nearest(part, book)
                    codes[:, p] = index
                    error += far
                    if not columns:
                        order = np.argsort(index, kind="stable")
                        used, begin = np.unique(index[order], return_index=True)
                        count[p, used] += np.diff(np.append(begin, len(order)))
                        if d:
                            total[p, used] += np.add.reduceat(part[order], begin)
                if columns:
                    code = [codes[k].tobytes().hex() for k in range(len(x))]
                    yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(code, pa.string()), pa.array(error)], names=[*columns, "code", "error"])
        if not columns:
            part, entry = np.nonzero(count)
            sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], names=["part", "entry", "count", "sums"])

    return assign


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; a part's sums are added entry by entry in Spark."""
    d = books.shape[2]
    shared = rows.sparkSession.sparkContext.broadcast(books)
    sums = rows.select("_vector").mapInArrow(_assigned(shared, PARTS * d, ()), "part int, entry int, count long, sums array<long>")
    sums = sums.groupBy("part", "entry").agg(F.sum("count").alias("count"), F.array(*[F.sum(F.col("sums")[k]) for k in range(d)]).cast("array<long>").alias("sums"))
    out = books.copy()
    for r in sums.collect():
        out[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["count"]
    shared.unpersist()
    return out


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, position): the first vectors by id, moved to the floor of their parts' means ``rounds`` times."""
    first = rows.orderBy(F.asc_nulls_last("_id"), "_vector").select("_vector").limit(ENTRIES).toArrow()["_vector"].combine_chunks()
    lengths = first.value_lengths().to_pylist()
    width = lengths[0] if lengths else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    books = whole(first, width).reshape(len(lengths), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds if lengths else 0):
        books = _moved(rows, books)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256; one row for each usable vector."""
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("_vector"), F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where(usable(F.col("_vector")))
    books = train(rows)
    kind = dict(rows.dtypes)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    coded = rows.mapInArrow(_assigned(shared, PARTS * books.shape[2], ("_id", "_label")), f"_id {kind['_id']}, _label {kind['_label']}, code string, error long").checkpoint()
    of_label = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")).checkpoint()
    sums = F.broadcast(of_label) if of_label.count() <= BROADCAST_LABELS else of_label
    out = coded.join(sums, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by plain SQL over ``embeddings``: all distances of all rounds."""
    ctes = [
        "v as (select vec_id, label, [floor(1024 * x::double)::bigint for x in embedding] as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"p as (select vec_id, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] as x from v, range({PARTS}) r(part))",
        f"f as (select vec_id, (row_number() over (order by vec_id) - 1)::int as entry from v qualify entry < {ENTRIES})",
        "b0 as (select part, entry, x from p join f using (vec_id))",
    ]
    far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    for k in range(ROUNDS + 1):
        ctes.append(f"d{k} as (select vec_id, p.part, entry, {far} as far from p join b{k} b on p.part = b.part)")
        ctes.append(f"a{k} as (select vec_id, part, min(far) as far, arg_min(entry, (far, entry)) as entry from d{k} group by all)")
        if k < ROUNDS:
            ctes.append(f"e{k} as (select part, entry, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x from (select part, entry, unnest(range(len(x))) as pos, unnest(x) as x from a{k} join p using (vec_id, part)) group by all)")
            ctes.append(f"m{k} as (select part, entry, list(x order by pos) as x from e{k} group by all)")
            ctes.append(f"b{k + 1} as (select b.part, b.entry, coalesce(m.x, b.x) as x from b{k} b left join m{k} m using (part, entry))")
    ctes.append("c as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(far)::bigint as error from a4 group by all)")
    ctes.append("h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b4)")
    return f"with {', '.join(ctes)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from c join v using (vec_id), h"


ORACLE_SQL = _oracle()
