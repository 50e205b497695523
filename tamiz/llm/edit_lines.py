"""Near-duplicate lines: a segment-partition edit join.

Lines within ``threshold`` edits (over UTF-8 bytes) are linked; of each class of linked lines the first in
(doc_id, hash of the text, line number) order stays. A line is split into threshold + 1 segments. Whoever is within the threshold
has one of them unchanged, at a place that the difference in length bounds; so each line is
indexed by (length, segment number, segment) and probes the lengths up to the threshold below its own with the
substrings at those places. Candidates are verified by a banded bit-parallel edit distance.

Equal lines are one line with a count, so copies cost nothing. Keys with the same members count once. The members of a key
are dealt out in blocks of about ``BLOCK``, each with one leader, and compared within their block; a block returns only edges
that join two of its parts. Of keys of several blocks that are not one class by then, a few members outside the largest class
(``SPREAD`` blocks of them) are taken to all other blocks. If there are more, the key is split: what two linked members share is
cut out of both, what is left of them is again within the threshold, and so shares one of threshold-plus-one segments of itself. Each of
these is a key of fewer members, and is treated alike, until what is left is shorter than its segments. So no link is
lost, a large group of near copies isn't expanded into its pairs, and lines that merely begin alike aren't either.

Defined results: null text has no lines and gives an empty text; lines of fewer than ``min_bytes`` bytes are
linked only to equal ones, and blank ones of them stay; documents without removed lines keep their text as it is. Rows are
known by doc_id and a hash of their text: rows that repeat both share their fate line by line, rows that repeat a doc_id with
another text are documents of their own; rows with null doc_id are returned unchanged;
other columns are not read. Lines are known by 126 bits of hashes, and by a number of their own while links are sought.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.components import connected_components
from tamiz.llm.session import forget, fresh, settled
from tamiz.llm.textscan import SPACE, Scan, chunks, mix, powers

THRESHOLD = 2
#: Five bytes a segment; below, two edits mostly join lines that have nothing to do with each other.
MIN_BYTES = 15
#: Members of one key that one task compares with each other at a time.
BLOCK = 512
#: Up to so many blocks of members outside the largest class go to all blocks of their key; keys with more are split.
SPREAD = 2
PROBE = 1 << 62
#: Up to so many shared keys (8 bytes each) are broadcast; more meet their entries in a second shuffle.
BROADCAST_KEYS = 1_000_000
#: Up to so many lines to be fetched (16 bytes each, by document) are broadcast; more are joined by shuffle.
BROADCAST_LINES = 500_000
#: Bytes of rests that a task splits at a time.
SPLIT_CHUNK = 1 << 20
_U = np.uint64
_ID_BITS = _U((1 << 62) - 1)


def _lines(raw: np.ndarray, off: np.ndarray, min_bytes: int, shorter: bool = False):
    """The scan, and start, end, document, number and id of every line of ``min_bytes``, or also of shorter ones that aren't blank."""
    s = Scan(raw, off)
    start, end, doc = s.lines()
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    own = end - start >= min_bytes
    if shorter:
        inside = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(~SPACE[raw], out=inside[1:])
        own |= inside[end] > inside[start]
    own = np.flatnonzero(own)
    start, end = start[own], end[own]
    return s, start, end, doc[own], number[own], (s.span_hash(start, end) & _ID_BITS).astype(np.int64)


#: Of the second hash, which tells lines of one id apart.
_CHECK_VALUE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _checks(s: Scan, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each line that is independent of its id."""
    up, down = powers(len(s.raw) + 1)
    prefix = np.zeros(len(s.raw) + 1, _U)
    np.cumsum(_CHECK_VALUE[s.raw] * up[: len(s.raw)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] - (end - start).astype(_U)).view(np.int64)


def _line_batches(min_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in chunks(batch.column(2)):
                s, start, end, doc, number, ids = _lines(raw, off, min_bytes, shorter=True)
                at = pa.array(doc)
                cols = [batch.column(0)[i:j].take(at), batch.column(1)[i:j].take(at), pa.array(number), pa.array(ids), pa.array(_checks(s, start, end))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "number", "line", "check"])

    return cut


def places(start: np.ndarray, end: np.ndarray, threshold: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(length that is asked for less the own, segment number, line indices, begin, width, shift) of every segment at every place, a line's own one first."""
    size, parts = end - start, threshold + 1
    for less in range(threshold + 1):
        other = size - less  # the length whose index is probed
        for k in range(parts):
            short, longer = other // parts, parts - other % parts  # segments from `longer` on are one byte longer
            at = k * short + np.maximum(k - longer, 0)
            width = short + (k >= longer)
            for shift in sorted(range(max(-k, less - (threshold - k)), min(k, less + (threshold - k)) + 1), key=abs):
                ok = np.flatnonzero((width > 0) & (at + shift >= 0) & (at + shift + width <= size))
                yield less, k, ok, start[ok] + at[ok] + shift, width[ok], shift


def _key(s: Scan, begin: np.ndarray, width: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    return mix(s.span_hash(begin, begin + width) + length.astype(_U) * _U(0x9E3779B97F4A7C55) + _U(k))


def keys(s: Scan, start: np.ndarray, end: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(line indices, keys, whether they are index entries) for every segment, length and place.

    A probe that equals the line's own index entry is left out: two different entries of a key are two lines.
    """
    size = end - start
    for less, k, ok, begin, width, shift in places(start, end, threshold):
        own = less == 0 and shift == 0
        key = _key(s, begin, width, size[ok] - less, k)
        if own:
            index = np.zeros(len(size), _U)
            index[ok] = key
        elif less == 0:
            new = key != index[ok]
            ok, key = ok[new], key[new]
        yield ok, key, own


def _split_batches(threshold: int):
    """Of rows (key, node, rest): (parent, key, node, own, rest) for every segment of what is left of a line, which is cut out of it.

    What is shorter than its segments is many goes under one key without a rest: such keys aren't split again.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, node, rests = (c.to_pylist() for c in batch.columns)
            salt = mix(batch.column(0).to_numpy().view(_U))
            for i, j, raw, off in chunks(batch.column(2), SPLIT_CHUNK):
                s, size = Scan(raw, off), np.diff(off)
                found: set[tuple] = set()

                def rows() -> pa.RecordBatch:
                    at, key, own, rest = zip(*found) if found else ((), (), (), ())
                    cols = [pa.array([parent[r] for r in at], pa.int64()), pa.array(np.array(key, _U).view(np.int64)), pa.array([node[r] for r in at], pa.int64()), pa.array(own, pa.bool_()), pa.array(rest, pa.binary())]
                    return pa.RecordBatch.from_arrays(cols, names=["parent", "key", "node", "own", "rest"])

                for less, k, ok, begin, width, shift in places(off[:-1], off[1:], threshold):
                    key = mix(_key(s, begin, width, size[ok] - less, k) ^ salt[i:j][ok])
                    for r, h, b, w in zip((ok + i).tolist(), key.tolist(), (begin - off[ok]).tolist(), width.tolist()):
                        found.add((r, h, less == 0 and shift == 0, rests[r][:b] + rests[r][b + w :]))
                    if len(found) * max(1, len(raw) // max(1, j - i)) > SPLIT_CHUNK:
                        yield rows()
                        found.clear()
                for less in range(threshold + 1):
                    few = np.flatnonzero((size >= less) & (size - less <= threshold))
                    key = mix(mix((size[few] - less + threshold + 2).astype(_U)) ^ salt[i:j][few])
                    found.update((r, h, less == 0, None) for r, h in zip((few + i).tolist(), key.tolist()))
                yield rows()

    return split


def _key_batches(threshold: int, min_bytes: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, off in chunks(batch.column(0)):
                s, start, end, _, _, ids = _lines(raw, off, min_bytes)
                ids, one = np.unique(ids, return_index=True)
                start, end = start[one], end[one]
                for at, key, own in keys(s, start, end, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[at] + (0 if own else PROBE))], names=["key", "entry"])

    return emit


def _common(a: bytes, b: bytes) -> int:
    """How many bytes both begin with, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance is at most ``most``: a band of 2 * most + 1 diagonals as bits of one number."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    # What both begin and end with changes nothing.
    lo = _common(a, b)
    a, b = a[lo:], b[lo:]
    hi = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not b:
        return len(a) <= most
    # reach[d]: bit k is set if the diagonal k - most can be followed up to here with d edits.
    width = 2 * most + 1
    full = (1 << width) - 1
    reach = [0] * (most + 1)
    reach[0] = 1 << most
    for d in range(1, most + 1):  # b may begin with deletions from a
        reach[d] = reach[d - 1] | (reach[d - 1] << 1)
    where: dict[int, int] = {}
    n = len(a)
    for k in range(min(most + 1, n)):  # positions of a near the start of the band
        where[a[k]] = where.get(a[k], 0) | 1 << (k + most)
    for i, c in enumerate(b):
        # Bit k of `same`: a[i + k - most] equals b[i].
        same = (where.get(c, 0) >> i) & full
        before = 0
        rows = []
        for d in range(most + 1):
            now = reach[d] & same
            if d:
                now |= reach[d - 1]  # replace
                now |= reach[d - 1] >> 1  # b has one more
                now |= before << 1  # a has one more
            now &= full
            if d:
                # a has several more in a row
                now |= (rows[d - 1] << 1) & full
            rows.append(now)
            before = rows[d]
        reach = rows
        if not any(reach):
            return False
        k = i + most + 1
        if k < n:
            where[a[k]] = where.get(a[k], 0) | 1 << (k + most)
    last = 1 << (n - len(b) + most)
    return any(r & last for r in reach)


def block_links(ids: list[int], comp: list[int], probe: list[bool], parts: list[bytes], threshold: int) -> list[tuple[int, int]]:
    """What verified links join, as edges to the smallest id of each part. All pairs with a probe row count."""
    size = np.array([len(p) for p in parts])
    count = np.array([np.bincount(np.frombuffer(p, np.uint8), minlength=256) for p in parts], np.int32)
    name, part = np.unique(comp, return_inverse=True)
    first = part.copy()
    for y in np.flatnonzero(probe):
        if (part == part[0]).all():
            break
        near = np.flatnonzero((part != part[y]) & (np.abs(size - size[y]) <= threshold))
        # An edit changes the counts of bytes by two at most.
        near = near[np.abs(count[near] - count[y]).sum(axis=1) <= 2 * threshold]
        for x in near:
            if part[x] != part[y] and within(parts[x], parts[y], threshold):
                part[part == part[x]] = part[y]
    # One edge for each class that came in, from the smallest id of its part.
    ids = np.array(ids)
    order = np.lexsort((ids, first))
    ends = order[np.flatnonzero(np.diff(first[order], prepend=-1))]
    out = []
    for p in np.unique(part[ends]):
        own = np.sort(ids[ends[part[ends] == p]])
        out += [(int(own[0]), int(x)) for x in own[1:] if x != own[0]]
    return out


def _block_batches(threshold: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, block)."""
        a, b = [], []

        def settle(held: list[tuple]) -> None:
            if len(held) > 1:
                _, _, *cols = zip(*held)
                for x, y in block_links(*cols, threshold):
                    a.append(x)
                    b.append(y)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    settle(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
        settle(held)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def _wanted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, node, bytes) of the lines asked for of each text."""
    for batch in batches:
        lines, nodes, parts = [], [], []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            own = text.as_py().encode().split(b"\n")
            for w in wanted:
                lines.append(w["line"])
                nodes.append(w["node"])
                parts.append(own[w["number"]])
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(nodes, pa.int64()), pa.array(parts, pa.binary())], names=["line", "node", "part"])


def _broadcast_if_few(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= most else rows


def _same_row(a: DataFrame, b: DataFrame) -> list:
    return [a["doc_id"] == b["_id"], a["th"] == b["_th"]]


def _near_links(rows: DataFrame, threshold: int) -> DataFrame:
    """The links that blocks find; ``rows``: (key, block, node, comp, probe, part)."""
    rows = rows.select("key", "block", "node", "comp", "probe", "part")
    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_block_batches(threshold), "a long, b long")


def _components(docs: DataFrame, known: DataFrame, threshold: int, min_bytes: int) -> DataFrame:
    """(_line, _check, component) of every line that has links to different ones."""
    entries = docs.select("text").mapInArrow(_key_batches(threshold, min_bytes), "key long, entry long")
    shared = entries.groupBy("key").agg(F.min("entry").alias("least"), F.max("entry").alias("last"))
    shared = shared.where((F.col("least") != F.col("last")) & (F.col("least") < PROBE)).select("key")
    shared = shared.checkpoint()
    line = F.when(F.col("entry") < PROBE, F.col("entry")).otherwise(F.col("entry") - PROBE)
    found = entries.join(_broadcast_if_few(shared, BROADCAST_KEYS), "key").select("key", line.alias("line")).distinct().checkpoint()
    sets = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("leader"), F.bit_xor(F.xxhash64("line")).alias("x"), F.bit_xor(F.xxhash64("line", F.lit(1))).alias("y"))
    # Lines that share several keys share them with the same lines for the most part.
    sets = sets.where("n > 1").groupBy("n", "leader", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "leader").checkpoint()
    members = found.join(sets, "key").checkpoint()
    forget(shared, found, sets)

    # A line's number is fixed once it's written.
    numbered = members.select("line").distinct().join(known.select("line", "check", "first"), "line").withColumn("node", F.monotonically_increasing_id()).checkpoint()
    wanted = numbered.groupBy(F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th"))
    wanted = wanted.agg(F.collect_list(F.struct("line", "node", F.col("first.number").alias("number"))).alias("wanted")).checkpoint()
    few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_LINES
    # Repeated rows give the same line twice, which a block bears.
    asked = docs.join(F.broadcast(wanted) if few else wanted, _same_row(docs, wanted))
    texts = asked.select("text", "wanted").mapInArrow(_wanted_batches, "line long, node long, part binary").checkpoint()

    rows = members.join(texts, "line")
    dealt = rows.select("key", _own_blocks("line"), "node", F.col("node").alias("comp"), F.lit(True).alias("probe"), "part")
    links = _near_links(dealt, threshold).checkpoint()
    labels = connected_components(links).checkpoint()

    wide = members.where(F.col("n") > BLOCK)
    if not wide.isEmpty():
        once = texts.select("node", "part").dropDuplicates(["node"])
        wide = wide.join(numbered.select("line", "node"), "line").select("key", "n", "node")
        links, labels = _wide_links(wide, once, links, labels, threshold)
    near = numbered.join(labels, F.col("node") == F.col("id")).select(F.col("line").alias("_line"), F.col("check").alias("_check"), "component").checkpoint()
    forget(members, numbered, wanted, texts, links, labels)
    return near


def _blocks() -> F.Column:
    return F.ceil(F.col("n") / BLOCK).cast("int")


def _everywhere() -> F.Column:
    return F.sequence(F.lit(0), _blocks() - 1)


def _own_blocks(name: str) -> F.Column:
    """The block of a member; the leader's are all."""
    own = F.array(F.pmod(F.xxhash64(name, F.lit(2)), _blocks()).cast("int"))
    return F.explode(F.when(F.col(name) == F.col("leader"), _everywhere()).otherwise(own)).alias("block")


def _wide_links(wide: DataFrame, once: DataFrame, links: DataFrame, labels: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The links and classes with those that keys of several blocks lack; ``wide``: (key, n, node), ``once``: (node, part).

    Each round judges the keys that are not one class yet, and splits those with many members outside their largest one.
    A round's keys hold what is left of its members without the segments that they share, so that there are about as many
    rounds as a line can be cut to two thirds.
    """
    rests = None
    while True:
        classed = wide.join(labels, F.col("node") == F.col("id"), "left").select("key", "n", "node", F.coalesce("component", "node").alias("comp")).checkpoint()
        size = classed.groupBy("key", "n", "comp").agg(F.count(F.lit(1)).alias("m"))
        size = size.groupBy("key", "n").agg(F.max(F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
        largest = size.select("key", F.col("most.comp").alias("main"), (F.col("n") - F.col("most.m") > SPREAD * BLOCK).alias("many"))
        if rests is not None:
            largest = largest.join(rests.where("rest is null").select("key").distinct().withColumn("last", F.lit(True)), "key", "left")
            largest = largest.select("key", "main", (F.col("many") & F.col("last").isNull()).alias("many"))
        largest = largest.checkpoint()

        spread = classed.join(largest.where("not many"), "key").withColumn("probe", F.col("comp") != F.col("main"))
        own = F.array(F.pmod(F.xxhash64("node", F.lit(3)), _blocks()).cast("int"))
        spread = spread.select("key", F.explode(F.when(F.col("probe"), _everywhere()).otherwise(own)).alias("block"), "node", "comp", "probe")
        found = _near_links(spread.join(once, "node"), threshold)
        many = largest.where("many").select("key")
        if many.isEmpty():
            links = settled(links.union(found))
            return links, connected_components(links).checkpoint()

        if rests is None:  # the keys of whole lines, of which those with all members are wanted
            whole = classed.join(many, "key").join(once, "node").select("key", "node", F.col("part").alias("rest"))
            cut, groups = _split(whole, threshold)
            groups = groups.join(classed.select(F.col("key").alias("parent"), F.col("n").alias("n_parent")).distinct(), "parent").where("n >= n_parent")
        else:
            cut, groups = _split(rests.join(many, "key"), threshold)
            alike = groups.groupBy("n", "leader", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "leader")
            dealt = cut.select("key", "node").distinct().join(alike, "key").select("key", _own_blocks("node"), "node", F.col("node").alias("comp"), F.lit(True).alias("probe"))
            found = found.union(_near_links(dealt.join(once, "node"), threshold))
        links = settled(links.union(found))
        labels = connected_components(links).checkpoint()
        # Keys whose members have the same rests would be split alike.
        hot = groups.where(F.col("n") > BLOCK).groupBy("n", "leader", "x", "y", "r").agg(F.min("key").alias("key")).select("key", "n").checkpoint()
        rests = settled(cut.join(hot, "key").select("key", "n", "node", "rest"))
        wide = rests.select("key", "n", "node").distinct()
        rests = rests.drop("n")


def _split(rests: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(key, node, rest) cut further, and (parent, key, n, leader and hashes of its members and rests) of the keys that can hold links."""
    cut = rests.select("key", "node", "rest").mapInArrow(_split_batches(threshold), "parent long, key long, node long, own boolean, rest binary").distinct().checkpoint()
    members = cut.groupBy("parent", "key", "node").agg(F.max("own").alias("own"), F.bit_xor(F.xxhash64("rest", "own")).alias("r"))
    groups = members.groupBy("parent", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("own").alias("own"),
        F.min("node").alias("leader"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.bit_xor(F.xxhash64("node", "r")).alias("r"),
    )
    return cut.select("key", "node", "rest"), groups.where("own and n > 1").checkpoint()


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, th, text): every compared line (doc_id, th, number, line, check), and (line, check, copies, near, class_first) of those that repeat or have links.

    class_first is the place (doc_id, th, number) of the first line of the class; near tells whether the line has links to different lines.
    """
    docs = docs.where("doc_id is not null")
    lines = docs.mapInArrow(_line_batches(min_bytes), "doc_id long, th long, number long, line long, check long")
    known = lines.groupBy("line", "check").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "th", "number")).alias("first")).checkpoint()
    near = _components(docs, known, threshold, min_bytes)
    classed = known.join(near, (F.col("line") == F.col("_line")) & (F.col("check") == F.col("_check")), "left").where("copies > 1 or component is not null")
    first = classed.where("component is not null").groupBy("component").agg(F.min("first").alias("class_first"))
    classed = classed.join(first, "component", "left").select("line", "check", "copies", F.col("component").isNotNull().alias("near"), F.coalesce("class_first", "first").alias("class_first"))
    # Written first: then the join with all lines is of two plain shuffles, and Spark can split a line that very many rows hold.
    return lines, settled(classed)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose numbers come with them."""
    for batch in batches:
        n_lines, texts = [], []
        for text, gone in zip(batch.column(1), batch.column(2).to_pylist()):
            text = text.as_py()
            n_lines.append(0 if text is None else text.count("\n") + 1)
            if gone:
                gone = set(gone)
                text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
            texts.append(text or "")
        removed = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array([len(set(g or ())) for g in removed], pa.int64()), batch.column(3), pa.array(texts, pa.string())],
            names=["doc_id", "n_lines", "n_removed", "n_near", "text"],
        )


def _gone(docs: DataFrame, threshold: int, min_bytes: int) -> DataFrame:
    """(_id, _th, gone, n_near): the numbers of the lines that go, of (doc_id, th, text)."""
    lines, again = line_classes(docs, threshold, min_bytes)
    gone = lines.join(again, ["line", "check"]).where(F.struct("doc_id", "th", "number") != F.col("class_first"))
    return gone.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list("number").alias("gone"), F.count_if("near").alias("n_near"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_near (removed lines that differ from their class's first), text."""
    docs = _known_rows(docs, id_col, text_col)
    gone = _gone(docs, threshold, min_bytes)
    rows = docs.join(gone, _same_row(docs, gone), "left").select("doc_id", "text", "gone", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    return rows.mapInArrow(_rebuilt, "doc_id long, n_lines long, n_removed long, n_near long, text string")


def _known_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _replaced(at: int):
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All columns but the last, the numbers of the lines to go, with the text at ``at`` without these; texts left without a word go."""
        for batch in batches:
            texts, keep = [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if gone:
                    gone = set(gone)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
                texts.append(text)
                keep.append(not gone or bool(text.strip(" \t\n\v\f\r")))
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return replace


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their columns and cleaned texts; documents that lose all their words go."""
    by_id, by_text, numbers = fresh(docs.columns, "id_of_gone", "text_of_gone", "numbers_gone")
    gone = _gone(_known_rows(docs, id_col, text_col), threshold, min_bytes).select(F.col("_id").alias(by_id), F.col("_th").alias(by_text), F.col("gone").alias(numbers))
    same = (F.col(f"`{id_col}`").cast("long") == F.col(by_id)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(by_text))
    rows = docs.join(gone, same, "left").select(*(F.col(f"`{c}`") for c in docs.columns), numbers)
    return rows.mapInArrow(_replaced(docs.columns.index(text_col)), docs.schema)
