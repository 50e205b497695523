"""Removal of repeated byte passages, with a Burrows-Wheeler transform.

Every ``length``-byte string of the corpus that starts at two places is to go; passages of ``passage`` bytes or more
that repeat are counted on the way. Places are dealt out by content: of the seeds (substrings of a fixed size) in the
``passage`` bytes from a place on, the one of smallest hash is its anchor, so places where equal strings start have
equal anchors. The places of a document that follow each other and share their anchor make a segment, with
the bytes that their strings of ``length`` reach; segments of one anchor meet, and only anchors of two or more
segments matter. (Places that follow each other while the anchor is met again at another place are two segments.)

1. Segments with equal bytes are repeats as a whole; of these bytes one copy goes on.
2. The different segments of an anchor are joined to one text. Its Burrows-Wheeler transform is extended backwards,
   breadth first: intervals of suffixes that share a prefix of 1, 2, 3, ... bytes set the
   boundaries where the common prefix ends, in order of increasing length. At ``length`` the extension stops;
   suffixes without a boundary between them share ``length`` bytes or more.
3. An anchor with more than ``SPLIT_BYTES`` of different segments isn't given to one task. Its segments are the
   texts of the next level, where longer seeds deal their places out more finely. At the last level a seed is the whole string,
   so that all that meets is equal.

Bits at hashed places (``_sieve``) tell which anchors and documents may matter, so that of segments and texts only these are
shuffled; joins decide on what passes. The bits are bounded in number: more keys let more pass, results stay the same.

Defined results: null text is empty; texts of fewer than ``length`` bytes lose nothing; matches never cross documents;
rows that repeat a text are copies of each other, whatever their ids; rows with null doc_id take part
(rows are known by doc_id and a hash of their text); runs of one byte and other periodic texts repeat themselves
and go; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.session import forget
from tamiz.llm.textscan import _BYTE_VALUE, SPACE, chunks, mix, powers

LENGTH = 400
#: Repeated passages of so many bytes that hold ``PASSAGE_WORDS`` words are counted, removed or not.
PASSAGE, PASSAGE_WORDS = 250, 50
#: Different bytes of one anchor that one task takes together.
SPLIT_BYTES = 1 << 20
#: Bytes of segments that are put into one transform; an anchor isn't parted.
TEXT_BYTES = 1 << 19
#: Places that a segment may hold; long periodic texts are cut into segments of so many.
PIECE = 1 << 12
#: Bits of a sieve for each key, and at most (16 MB); and those of the blocks that it is gathered in.
SIEVE_BITS, SIEVE_MOST, SIEVE_BLOCK = 16, 1 << 27, 1 << 16
_U = np.uint64
_BIG = _U(0xFFFFFFFFFFFFFFFF)


def _prefix(raw: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE_VALUE[raw] * up[: len(raw)], out=out[1:])
    return out


def _span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U))


def _window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """The span hash of every window of ``size`` bytes."""
    _, down = powers(len(prefix))
    h = prefix[size:] - prefix[:-size]
    h *= down[: len(h)]
    h += _U(size)
    return mix(h)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, _BIG, _U)
    full[: len(x)] = x
    grid = full.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def _block_batches(size: int, block: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.unique(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)]) & (size - 1))
        for own in np.split(slots, np.flatnonzero(np.diff(slots // block)) + 1) if len(slots) else []:
            bits = np.zeros(block, bool)
            bits[own % block] = True
            yield pa.RecordBatch.from_arrays([pa.array(own[:1] // block), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    return gather


def _sieve(keys: DataFrame) -> Broadcast:
    """A table of bits, set at the places of all keys (one column of hashes, already written)."""
    size = max(SIEVE_BLOCK, min(SIEVE_MOST, 1 << (keys.count() * SIEVE_BITS).bit_length()))
    dealt = keys.repartition(F.floor(F.pmod(keys[0], F.lit(size)) / SIEVE_BLOCK))
    table = np.zeros(size // 8, np.uint8)
    for block, bits in dealt.mapInArrow(_block_batches(size, SIEVE_BLOCK), "block long, bits binary").collect():
        table[block * SIEVE_BLOCK // 8 :][: SIEVE_BLOCK // 8] |= np.frombuffer(bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def _passes(sieve: Broadcast, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the sieve; all of its own are."""
    slot = keys & (8 * len(sieve.value) - 1)
    return (sieve.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _passing_batches(sieve: Broadcast):
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passes(sieve, batch.column("key").to_numpy())))

    return sift


def segments(raw: np.ndarray, off: np.ndarray, places: np.ndarray, window: int, seed: int, reach: int) -> tuple[np.ndarray, ...]:
    """(document, first place, number of places, anchor, content hash) of every segment of a chunk."""
    count = np.clip(np.diff(off) - window + 1, 0, places)
    doc = np.repeat(np.arange(len(off) - 1), count)
    if not len(doc):
        return (np.zeros(0, np.int64),) * 5
    prefix = _prefix(raw)
    low = _U((1 << 32) - 1)
    # The leading half of a hash, then the place: among equal hashes the leftmost counts.
    key = _window_hash(prefix, seed)
    key &= ~low
    key |= np.arange(len(key), dtype=_U)
    least = _sliding_least(key, window - seed + 1)
    place = np.arange(len(doc)) + np.repeat(off[:-1] - (np.cumsum(count) - count), count)
    at = (least[place] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    anchor = _span_hash(prefix, at[first], at[first] + seed)
    # Neighbours with equal seeds, as in a run of one byte, become two segments, or more if there are many places.
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[first[1:]] != doc[first[:-1]])])
    if window > seed and not new.all():
        several = np.diff(np.append(np.flatnonzero(new), len(new))) > 1
        anchor, first = anchor[new], first[new]
        n = np.diff(np.append(first, len(doc)))
        parts = np.maximum(1 + several, -(-n // PIECE))
        size = np.repeat(-(-n // parts), parts)
        part = np.arange(len(size)) - np.repeat(np.cumsum(parts) - parts, parts)
        inside = part * size < np.repeat(n, parts)
        anchor, first = np.repeat(anchor, parts)[inside], (np.repeat(first, parts) + part * size)[inside]
    n = np.diff(np.append(first, len(doc)))
    doc, start = doc[first], place[first]
    content = _span_hash(prefix, start, np.minimum(start + n - 1 + reach, off[doc + 1])).view(np.int64)
    return doc, start - off[doc], n, anchor.view(np.int64), content


_SEGMENT = "k1 long, k2 long, start int, n int, anchor long, content long"


def _segment_batches(window: int, seed: int, reach: int, sieve: Broadcast | None = None):
    """Segments whose anchors pass the sieve."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places").to_numpy()
            for i, j, raw, off in chunks(batch.column("body")):
                doc, start, n, anchor, content = segments(raw, off, places[i:j], window, seed, reach)
                if sieve is not None:
                    doc, start, n, anchor, content = (x[_passes(sieve, anchor)] for x in (doc, start, n, anchor, content))
                doc = pa.array(doc)
                cols = [batch.column(0)[i:j].take(doc), batch.column(1)[i:j].take(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(content)]
                yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "start", "n", "anchor", "content"])

    return cut


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a sequence of small numbers, ordered by their first ``depth`` items at least.

    Doubling: suffixes ordered by some items are ordered by twice as many through the places of the
    suffixes so many items later. Only suffixes that are still tied are ordered again. What is sorted holds the suffix
    itself in its low bits, so that plain sorts of numbers do.
    """
    n = len(text)
    bits, width = n.bit_length(), (int(text.max()) + 1).bit_length()
    mask = (1 << bits) - 1
    known = max(1, min(depth, n, (63 - bits) // width))
    key = np.zeros(n, np.int64)
    for k in range(known):  # several items at once, to begin with
        key <<= width
        key[: n - k] |= text[k:].astype(np.int64) + 1
    key = np.sort((key << bits) | np.arange(n))
    tied, key = key & mask, key >> bits
    order, slot, place = np.empty(n, np.int64), np.arange(n), np.empty(n + 1, np.int64)
    place[n] = -1  # beyond the end
    while True:
        # Tied suffixes share the place of the first of them.
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        place[tied] = np.repeat(slot[first], size)
        order[slot] = tied
        left = np.repeat(size > 1, size)
        tied, slot = tied[left], slot[left]
        if known >= depth or not len(tied):
            return order
        later = place[np.minimum(tied + known, n)] + 1
        if 3 * bits < 64:
            key = np.sort((((place[tied] << bits) | later) << bits) | tied)
            tied, key = key & mask, key >> bits
        else:
            by = np.lexsort((later, place[tied]))
            key = place[tied[by]] * (n + 1) + later[by]
            tied = tied[by]
        known *= 2


def repeated_suffixes(text: np.ndarray, lengths: tuple[int, ...], own: list[np.ndarray]) -> list[np.ndarray]:
    """For each of the ascending lengths: which of its own positions begin a string of so many items that begins at another of them.

    The last item must be unique.
    """
    n = len(text)
    order = suffix_order(text, lengths[-1] + 1)
    head, before = text[order], text[order - 1]  # the text is read as a ring, which its unique last item allows
    # Suffixes with the same item before them keep their order when it is put in front.
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    # So a run of one item before neighbouring suffixes is extended as a whole.
    change = np.concatenate([[False], before[1:] != before[:-1]])
    run, edge = np.cumsum(change), np.concatenate([[0], np.flatnonzero(change), [n]])
    bound = np.zeros(n + 1, bool)  # bound[i]: suffixes i - 1 and i share fewer items than the length reached
    bound[0] = True
    lo, hi = np.array([0]), np.array([n])
    bits, out = n.bit_length(), []
    for depth in range(1, lengths[-1] + 1):
        a, size = run[lo], run[hi - 1] - run[lo] + 1
        one = size == 1
        to, till = step[lo[one]], step[hi[one] - 1] + 1
        if not one.all():
            lo, hi, a, size = lo[~one], hi[~one], a[~one], size[~one]
            which = np.repeat(np.arange(len(lo)), size)
            r = np.arange(len(which)) + np.repeat(a - (np.cumsum(size) - size), size)
            begin, end = np.maximum(edge[r], lo[which]), np.minimum(edge[r + 1], hi[which])
            # Runs of one item within an interval lead to neighbouring places: they are joined.
            first, last = step[begin], step[end - 1] + 1
            by = np.argsort((which << bits) | first)
            which, first, last = which[by], first[by], last[by]
            item = head[first]
            new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (item[1:] != item[:-1])]))
            to, till = np.concatenate([to, first[new]]), np.concatenate([till, last[np.append(new[1:], len(last)) - 1]])
        # Strings of one length have intervals of their own, so each end is met once.
        fresh = ~bound[till]
        bound[till] = True
        lo, hi = to[fresh], till[fresh]
        if depth in lengths or not len(lo):
            counted = own[len(out) : len(out) + lengths.count(depth)] if len(lo) else own[len(out) :]  # without an interval left, all longer strings are alone too
            out += [_shared(order, np.flatnonzero(bound[:-1]), o) for o in counted]
        if not len(lo):
            break
    return out


def _shared(order: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of the own positions stand with another one between two boundaries."""
    there = own[order]
    again = np.empty(len(order), bool)
    again[order] = there & np.repeat(np.add.reduceat(there, first, dtype=np.int64) > 1, np.diff(np.append(first, len(order))))
    return again


def _runs(flags: np.ndarray) -> np.ndarray:
    """(first, end) of every run of true flags, as one flat array."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)]).astype("<i4").ravel()


_MARKS = "anchor long, content long, start long, passages binary, repeats binary"


def _mark_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["anchor", "content", "start", "passages", "repeats"])


def _marked(anchors: list[int], contents: list[int], places: list[int], texts: list[bytes], lengths: tuple[int, ...]) -> pa.RecordBatch:
    """The repeated strings of whole anchors: runs of places within each segment, for each length."""
    size = np.array([len(t) for t in texts])
    off = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
    joined[off[1:] - 1] = 1  # strings that begin at a segment's places don't reach its end
    joined[-1] = 0
    # Segments overlap beyond their places, where they would repeat each other.
    within = np.arange(len(joined)) - np.repeat(off[:-1], size + 1)
    own = [within < np.repeat(np.minimum(places, size - n + 1), size + 1) for n in lengths]
    short, long = repeated_suffixes(joined, lengths, own)
    out = []
    for a, c, i, t in zip(anchors, contents, off[:-1], size):
        passages = _runs(short[i : i + t])
        if len(passages):
            out.append((a, c, 0, passages.tobytes(), _runs(long[i : i + t]).tobytes()))
    return _mark_rows(out)


def _transform_batches(lengths: tuple[int, ...]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; whole anchors are gathered up to TEXT_BYTES."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns)):
                if size >= TEXT_BYTES and row[0] != held[-1][0]:
                    yield _marked(*map(list, zip(*held)), lengths)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield _marked(*map(list, zip(*held)), lengths)

    return mark


def _whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All places of segments that have copies; ``far``: also for the longer strings."""
    for batch in batches:
        run = lambda n: np.array([0, n], "<i4").tobytes()
        yield _mark_rows([(a, c, 0, run(n), run(n) if far else b"") for a, c, n, far in zip(*(col.to_pylist() for col in batch.columns))])


def _cut_batches(reach: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, content, n, hot, bytes) of the segments asked for of each text."""
        for batch in batches:
            for raw, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cols = [pa.array([s[c] for s in asked], t) for c, t in (("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int32()), ("hot", pa.bool_()))]
                parts = [raw[s["start"] : s["start"] + s["n"] - 1 + reach] for s in asked]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(parts, pa.binary())], names=["anchor", "content", "n", "hot", "part"])

    return cut


def _levels(length: int, passage: int) -> list[tuple[int, int]]:
    """(bytes that an anchor is chosen from, seed bytes) of each level."""
    own = [(passage, max(1, passage // 4)), (passage, max(1, passage * 5 // 8)), (passage, passage)]
    return own + [(length, (passage + length) // 2), (length, length)] * (length > passage)


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.xxhash64("_k1", "_k2").alias("key"))


def _same(a: DataFrame, b: DataFrame) -> list:
    return [a["k1"].eqNullSafe(b["_k1"]) & (a["k2"] == b["_k2"])]


def _marks(texts: DataFrame, levels: list[tuple[int, int]], length: int, passage: int, written: list[DataFrame], sift: bool = True) -> DataFrame:
    """(k1, k2, start, passages, repeats): runs of places, counted from ``start``, in the texts (k1, k2, key, body, places).

    ``written`` takes what can be forgotten when the marks are written.
    """
    (window, seed), *deeper = levels
    found = texts.mapInArrow(_segment_batches(window, seed, length), _SEGMENT)
    # What is small is written before the joins with it, so that Spark can split the key that very many rows share.
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("anchor").checkpoint()
    if sift:
        found = texts.mapInArrow(_segment_batches(window, seed, length, _sieve(shared)), _SEGMENT)
    found = found.join(shared, "anchor", "left_semi").checkpoint()
    forget(shared)

    # Any one place of a content serves: its bytes are the same everywhere.
    one = [F.first(c).alias(c) for c in ("k1", "k2", "start", "n")]
    contents = found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), *one).checkpoint()
    kinds = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") + length - 1).alias("bytes")).where("kinds > 1")
    kinds = kinds.select("anchor", (F.col("bytes") > SPLIT_BYTES).alias("hot")).checkpoint()
    written += found, contents, kinds
    asked = contents.join(kinds, "anchor").select("k1", "k2", F.struct("anchor", "content", "n", "hot", "start").alias("segment"))
    asked = asked.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.collect_list("segment").alias("segments"))
    if sift:
        asked = asked.checkpoint()
        written.append(asked)
        texts = texts.mapInArrow(_passing_batches(_sieve(_keys(asked))), texts.schema)
    # Repeated rows give the same part twice; as copies they are repeats anyway.
    parts = texts.join(asked, _same(texts, asked)).select("body", "segments").mapInArrow(_cut_batches(length), "anchor long, content long, n int, hot boolean, part binary")
    any_hot = bool(deeper) and not kinds.where("hot").isEmpty()
    if any_hot:
        parts = parts.checkpoint()
        written.append(parts)
    few = parts.where("not hot").select("anchor", "content", "n", "part").repartition("anchor").sortWithinPartitions("anchor", "content")
    marks = few.mapInArrow(_transform_batches((passage, length)), _MARKS)
    whole = contents.where("copies > 1").select("anchor", "content", "n", F.lit(True).alias("far"))
    if any_hot:
        hot = parts.where("hot").select(F.col("anchor").alias("k1"), F.col("content").alias("k2"), F.xxhash64("anchor", "content").alias("key"), F.col("part").alias("body"), F.col("n").alias("places"))
        marks = marks.union(_marks(hot, deeper, length, passage, written, sift=False))
        if seed == window == passage < length:
            # All that meets has this passage in common; only how far it goes on differs.
            whole = whole.union(contents.join(kinds.where("hot"), "anchor", "left_semi").select("anchor", "content", "n", F.lit(False)))
    marks = marks.union(whole.mapInArrow(_whole_batches, _MARKS)).select("anchor", "content", F.col("start").alias("later"), "passages", "repeats")
    return found.select("k1", "k2", "start", "anchor", "content").join(marks, ["anchor", "content"]).select("k1", "k2", (F.col("start") + F.col("later")).alias("start"), "passages", "repeats")


def _covered(marks: list[dict], which: str, size: int, length: int) -> np.ndarray:
    """Which bytes are in a string of ``length`` that begins at a marked place."""
    runs = np.concatenate([np.frombuffer(m[which], "<i4").reshape(-1, 2) + m["start"] for m in marks])
    runs = np.minimum(runs, max(size - length + 1, 0))  # the last places of a text begin no string of this length
    runs = runs[runs[:, 0] < runs[:, 1]]
    step = np.bincount(runs[:, 0], minlength=size + 1) - np.bincount(runs[:, 1] + length - 1, minlength=size + 1)
    return np.cumsum(step[:size]) > 0


def _removed(length: int, passage: int, digest: bool, others: Broadcast | None = None):
    """Rows without what repeats; those that pass the sieve of ``others`` are left to another task."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if others is not None:
                batch = batch.filter(pa.array(~_passes(others, batch.column("key").to_numpy())))
            n_bytes, n_removed, n_spans, n_passages, kept = [], [], [], [], []
            for body, marks in zip(batch.column(1), batch.column(2).to_pylist()):
                left = raw = body.as_py()
                spans, passages = 0, 0
                if marks:
                    own = np.frombuffer(raw, np.uint8)
                    gone = _covered(marks, "repeats", len(raw), length)
                    spans = len(_runs(gone)) // 2
                    left = own[~gone].tobytes()
                    word = np.concatenate([[False], ~SPACE[own]])
                    begun = np.concatenate([[0], np.cumsum(word[1:] & ~word[:-1])])
                    run = _runs(_covered(marks, "passages", len(raw), passage)).reshape(-1, 2)
                    passages = int((begun[run[:, 1]] - begun[run[:, 0]] >= PASSAGE_WORDS).sum())
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(left))
                n_spans.append(spans)
                n_passages.append(passages)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.string() if digest else pa.binary()), pa.array(n_passages, pa.int64())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept", "n_passages"],
            )

    return remove


def remove_repeats(docs: DataFrame, digest: bool = False, length: int = LENGTH, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, what is kept, as bytes or as their SHA-256, and n_passages.

    n_passages counts the maximal runs of bytes in strings of ``passage`` bytes that begin elsewhere too, where
    ``PASSAGE_WORDS`` words or more begin in the run.
    """
    passage = min(passage, length)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Rows are known by their id and a hash of their text.
    texts = docs.select(F.col(id_col).cast("long").alias("k1"), F.xxhash64(text).alias("k2"), text.cast("binary").alias("body"), F.lit((1 << 31) - 1).alias("places"))
    texts = texts.select("k1", "k2", F.xxhash64("k1", "k2").alias("key"), "body", "places")
    written: list[DataFrame] = []
    marks = _marks(texts, _levels(length, passage), length, passage, written)
    back = marks.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.collect_list(F.struct("start", "passages", "repeats")).alias("marks")).checkpoint()
    forget(*written)
    marked = _sieve(_keys(back))
    some = texts.mapInArrow(_passing_batches(marked), texts.schema)
    rows = [(some.join(back, _same(some, back), "left").select("k1", "body", "marks"), None), (texts.select("k1", "body", F.lit(None).cast(back.schema["marks"].dataType).alias("marks"), "key"), marked)]
    kept = "kept_sha256 string" if digest else "kept binary"
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}, n_passages long"
    touched, untouched = (r.mapInArrow(_removed(length, passage, digest, others), schema) for r, others in rows)
    return touched.union(untouched)
