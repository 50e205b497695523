"""Near-duplicate documents by HyperMinHash.

A document's distinct five-word shingles fall into ``REGISTERS`` buckets by the leading bits of their
hash. A register keeps, of its bucket's smallest hash, the count of leading zeros and a few mantissa bits;
an empty bucket borrows from another along a fixed permutation. Bands of registers give candidate
buckets. Equal registers, less the share that collides by chance, estimate the Jaccard similarity;
what may reach the threshold is confirmed on the full sets.

Work that doesn't grow with the square of a group:

1. Documents with equal sets become one representative.
2. Every band bucket has a leader; the buckets of one leader form a group. A group is dealt out in blocks of about
   ``BLOCK`` members, each with the leader. A task compares the members of a block by their registers, confirms what may
   reach the threshold on the full sets, and returns only links that join two parts of the block.
3. Of groups of several blocks that the links haven't joined into one component, the members outside the largest one
   are taken to all other blocks, first by their registers alone, and with their sets only where these match some member.
   So no link is lost, and a large group of near copies isn't expanded into its pairs.

With 32 bands of 4 registers a pair at similarity 0.75 shares no band with probability 5e-6; the estimate's
cut lies 4.5 standard deviations below the threshold.

Defined results: texts without words, and null texts, have an empty set and are linked with nothing; fewer than
five words make one shingle; rows are known by doc_id and a hash of their text, so that rows which repeat an id with another
text have links of their own, and component_id is the smallest doc_id of what any of these reaches; rows with null
doc_id are returned unlinked, with null component_id, and kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.components import connected_components
from tamiz.llm.session import forget, fresh
from tamiz.llm.textscan import ASCII_LOWER, Scan, chunks, mix, ngram_hash

SHINGLE_WORDS = 5
PERCENT = 75
REGISTER_BITS, MANTISSA_BITS = 7, 10
REGISTERS = 1 << REGISTER_BITS
BAND_ROWS = 4
BANDS = REGISTERS // BAND_ROWS
#: Share of registers of unrelated sets that are equal by chance: equal zero counts in a third of them, then equal mantissas.
COLLISION = 1 / 3 / (1 << MANTISSA_BITS)
DEVIATIONS = 4.5
#: Members of one bucket that one task compares with each other at a time.
BLOCK = 1024
_U = np.uint64

#: Row i: the buckets from which an empty bucket i borrows, in order of trial.
_BORROW = np.argsort(np.random.default_rng(11).random((REGISTERS, REGISTERS)), axis=1)


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds by document, and each document's distinct shingle hashes in ascending order."""
    s = Scan(ASCII_LOWER[raw], off)
    words = s.word_hash()
    at = s.windows(SHINGLE_WORDS)
    hashes, doc = ngram_hash(words, SHINGLE_WORDS)[at], s.doc[at]
    count = np.diff(s.word_off)
    few = np.flatnonzero((count > 0) & (count < SHINGLE_WORDS))
    if len(few):
        own = []
        for d in few:
            h = _U(count[d])
            for w in words[s.word_off[d] : s.word_off[d + 1]]:
                h = _chain(h, w)
            own.append(h)
        hashes, doc = np.concatenate([hashes, np.array(own, _U)]), np.concatenate([doc, few])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(doc):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])
        hashes, doc = hashes[new], doc[new]
    return np.searchsorted(doc, np.arange(s.n + 1)), hashes


def _chain(h: np.uint64, w: np.uint64) -> np.uint64:
    return _U((int(h) * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF)


def registers(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One row of registers a document; rows of empty sets are 0."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    slot = doc * REGISTERS + (hashes >> _U(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    # Hashes ascend, so the first of a bucket is its smallest.
    fraction, exponent = np.frexp((hashes[first] << _U(REGISTER_BITS)).astype(np.float64))
    zeros = np.minimum(64 - exponent, 63).astype(np.int64)
    mantissa = np.clip((fraction - 0.5) * (2 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1).astype(np.int64)
    flat = np.full(n * REGISTERS, -1, np.int64)
    flat[slot[first]] = (zeros << MANTISSA_BITS) | mantissa
    full = flat.reshape(n, REGISTERS)
    own, trial = full.copy(), 0
    r, i = np.nonzero((full < 0) & (np.diff(bounds) > 0)[:, None])
    while len(r):
        lent = own[r, _BORROW[i, trial]]
        full[r, i] = lent
        left = lent < 0
        r, i, trial = r[left], i[left], trial + 1
    return np.maximum(full, 0).astype(np.uint16)


def estimate(same: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for collisions."""
    return (same / REGISTERS - COLLISION) / (1 - COLLISION)


#: Fewer equal registers than this can't belong to similar documents.
LEAST_SAME = int(np.floor(REGISTERS * (PERCENT / 100 - DEVIATIONS * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS)) * (1 - COLLISION) + REGISTERS * COLLISION))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, off in chunks(batch.column(2)):
            bounds, hashes = shingle_sets(raw, off)
            total = [np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes + _U(k)))]) for k in (1, 2)]
            lo, hi = (mix(t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
            regs = registers(bounds, hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.diff(bounds)), pa.array(lo), pa.array(hi), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc_id", "th", "n_shingles", "set_lo", "set_hi", "registers"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regs = _matrix(batch.column(1)).astype(_U)
        key = np.tile(np.arange(1, BANDS + 1, dtype=_U), (len(regs), 1))
        for k in range(BAND_ROWS):
            key = key * _U(0xD6E8FEB86659FD93) + mix(regs[:, k::BAND_ROWS] + _U(1))
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(mix(key).ravel().view(np.int64)), pa.array(ids)], names=["band", "id"])


def _dealt_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the full set for every group and block that a document goes to."""
    for batch in batches:
        dealt = batch.column(2).to_pylist()
        for i, j, raw, off in chunks(batch.column(1)):
            bounds, hashes = shingle_sets(raw, off)
            own = [hashes[bounds[k] : bounds[k + 1]].tobytes() for k in range(j - i)]
            rows = [(d["leader"], d["block"], doc, d["comp"], d["probe"], s) for doc, to, s in zip(batch.column(0)[i:j].to_pylist(), dealt[i:j], own) for d in to]
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            for k in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 2000], t) for c, t in zip(cols, kinds)], names=["leader", "block", "id", "comp", "probe", "shingles"])


def block_links(ids: np.ndarray, comp: np.ndarray, probe: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """What confirmed links join, as edges to the smallest id of each part.

    All pairs with a probe row count. Components are joined as links are found, so that a group of near copies needs
    no more edges than rows.
    """
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    values, item = np.unique(np.concatenate(sets), return_inverse=True)
    regs = registers(np.append(start, size.sum()), np.concatenate(sets))
    name, part = np.unique(comp, return_inverse=True)
    first, marked, out = part.copy(), np.zeros(len(values), bool), []
    for y in np.flatnonzero(probe):
        if (part == part[0]).all():
            break
        likely = np.flatnonzero(((regs == regs[y]).sum(axis=1) >= LEAST_SAME) & (part != part[y]))
        if not len(likely):
            continue
        own = item[start[y] : start[y] + size[y]]
        marked[own] = True
        for x in likely:
            if part[x] == part[y]:
                continue
            both = int(np.count_nonzero(marked[item[start[x] : start[x] + size[x]]]))
            if 100 * both >= PERCENT * (size[x] + size[y] - both):
                part[part == part[x]] = part[y]
        marked[own] = False
    # One edge for each component that came in, from the smallest id of its part.
    order = np.lexsort((ids, first))
    ends = order[np.flatnonzero(np.diff(first[order], prepend=-1))]
    for p in np.unique(part):
        own = np.sort(ids[ends[part[ends] == p]])
        out += [(int(own[0]), int(x)) for x in own[1:]]
    return out


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (leader, block); a block may go on in the next batch."""

    def links(held: list[tuple]) -> pa.RecordBatch:
        _, _, ids, comp, probe, sets = zip(*held)
        pairs = block_links(np.array(ids), np.array(comp), np.array(probe), [np.frombuffer(s, _U) for s in sets]) if len(held) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:2] != row[:2]:
                yield links(held)
                held = []
            held.append(row)
    if held:
        yield links(held)


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leader, block, id, comp, probe, registers) come sorted by (leader, block); yields those whose registers match some other component's, if one of both is a probe."""

    def matching(held: list[tuple]) -> pa.RecordBatch:
        leader, block, ids, comp, probe, regs = zip(*held)
        regs = np.frombuffer(b"".join(regs), np.uint16).reshape(-1, REGISTERS)
        part, hit = np.unique(comp, return_inverse=True)[1], np.zeros(len(ids), bool)
        for y in np.flatnonzero(probe):
            near = ((regs == regs[y]).sum(axis=1) >= LEAST_SAME) & (part != part[y])
            hit |= near
            hit[y] |= near.any()
        cols = zip((leader, block, ids, comp, probe), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array(c, t).filter(pa.array(hit)) for c, t in cols], names=["leader", "block", "id", "comp", "probe"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:2] != row[:2]:
                yield matching(held)
                held = []
            held.append(row)
    if held:
        yield matching(held)


def _links(rows: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The links that blocks find; ``rows``: (leader, block, id, comp, probe), ``nodes``: where the text of an id is."""
    dealt = rows.groupBy("id").agg(F.collect_list(F.struct("leader", "block", "comp", "probe")).alias("dealt"))
    dealt = dealt.join(nodes, "id").select("id", F.col("rep").alias("_doc"), F.col("rep_th").alias("_th"), "dealt")
    full = docs.join(dealt, (F.col("doc_id") == F.col("_doc")) & (F.col("th") == F.col("_th"))).select("id", "text", "dealt", "_doc", "_th").dropDuplicates(["_doc", "_th"])
    full = full.select("id", "text", "dealt").mapInArrow(_dealt_batches, "leader long, block int, id long, comp long, probe boolean, shingles binary")
    return full.repartition("leader", "block").sortWithinPartitions("leader", "block").mapInArrow(_link_batches, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked doc_id), kept."""
    return _judged(docs, id_col, text_col).drop("th")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their columns that are kept."""
    by_id, by_text = fresh(docs.columns, "id_of_gone", "text_of_gone")
    gone = _judged(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(by_id), F.col("th").alias(by_text)).distinct()
    return docs.join(gone, (F.col(f"`{id_col}`").cast("long") == F.col(by_id)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(by_text)), "left_anti")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sketched = docs.mapInArrow(_sketch_batches, "doc_id long, th long, n_shingles long, set_lo long, set_hi long, registers binary").checkpoint()
    some = sketched.where("n_shingles > 0 and doc_id is not null")
    # One node for each set, with any one text that has it; its number is fixed once it's written.
    groups = some.groupBy("set_lo", "set_hi").agg(F.min("doc_id").alias("low"), *(F.first(c).alias(n) for c, n in (("doc_id", "rep"), ("th", "rep_th"), ("registers", "registers"))))
    groups = groups.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    nodes = groups.select("id", "rep", "rep_th")

    banded = groups.select("id", "registers").mapInArrow(_band_batches, "band long, id long")
    leader = F.min(F.struct(F.xxhash64("id"), "id")).alias("leader")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), leader).where("n > 1").select("band", F.col("leader.id").alias("leader"))
    # What is small is written before the joins with it, so that Spark can split the key that very many rows share.
    members = banded.withColumnsRenamed({"id": "member"}).join(shared.checkpoint(), "band").select("leader", F.col("member").alias("id")).distinct().checkpoint()
    blocks = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).checkpoint()
    pairs = members
    members = members.join(blocks, "leader").withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))

    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.array("own")
    rows = members.select("leader", F.explode(F.when(F.col("id") == F.col("leader"), everywhere).otherwise(own)).alias("block"), "id", F.col("id").alias("comp"), F.lit(True).alias("probe"))
    links = _links(rows, nodes, docs).checkpoint()
    labels = connected_components(links).checkpoint()

    wide = members.where("blocks > 1")
    if not wide.isEmpty():
        wide = wide.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id"))
        largest = wide.groupBy("leader", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("leader").agg(F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        wide = wide.join(largest.select("leader", F.col("most.comp").alias("main")).checkpoint(), "leader").withColumn("probe", F.col("comp") != F.col("main"))
        rows = wide.select("leader", F.explode(F.when(F.col("probe"), everywhere).otherwise(own)).alias("block"), "id", "comp", "probe")
        rows = rows.join(groups.select("id", "registers"), "id").select("leader", "block", "id", "comp", "probe", "registers").repartition("leader", "block").sortWithinPartitions("leader", "block")
        rows = rows.mapInArrow(_near_batches, "leader long, block int, id long, comp long, probe boolean").checkpoint()
        if not rows.isEmpty():
            labels = connected_components(links.union(_links(rows, nodes, docs))).checkpoint()

    linked = labels.join(groups.select("id", "low", "set_lo", "set_hi"), "id")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    by_set = linked.join(lowest, "component").select("set_lo", "set_hi", "component_id")
    # Copies of one set fall together without a link.
    copies = groups.select("set_lo", "set_hi", "low").join(by_set, ["set_lo", "set_hi"], "left").select(F.col("set_lo").alias("_lo"), F.col("set_hi").alias("_hi"), F.coalesce("component_id", "low").alias("component_id")).checkpoint()
    forget(groups, pairs, blocks, links, labels)
    judged = sketched.join(copies, (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & (F.col("set_lo") == F.col("_lo")) & (F.col("set_hi") == F.col("_hi")), "left")
    component = F.coalesce("component_id", "doc_id")
    return judged.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
