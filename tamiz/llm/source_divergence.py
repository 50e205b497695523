"""How the words of each source differ from those of the other sources of its language.

Terms are runs of letters A-Z, a-z and of bytes from 0x80 on, A-Z lower-cased. Tasks find them in the joined UTF-8 bytes of a
chunk of documents with a lookup table; slices are grouped by xxhash, and every slice is compared byte by byte with its
group's first, so that a collision can't merge two terms. A sparse matrix of documents and terms (CSR) gives occurrences and
document counts of each (language, source), which Spark sums by shuffle. Terms stay that
``least_docs`` documents of the language hold.

Each group (and each language) gives each term t the weight 1 + floor(scale * (count + add) / (N + add * V)), exactly, in
decimals. Divergences are sums of absolute differences: the kept terms of a language are dealt out in blocks of about ``BLOCK_TERMS``,
and its sources in tiles of ``TILE_SOURCES``; a task has one block and two tiles, as CSR rows by source, and sums with ``reduceat``
what differs from the weight of an absent term. Terms absent from both sources of a pair are counted, not visited. Nothing is
dealt by language or source alone, so a hot one spreads over its blocks; a task holds at most 2 * TILE_SOURCES rows of a term.

Defined results: null text, lang and source are empty text. A group without any term has its rows of part ``pair``; where a language keeps
no term these have value 0; a language with one source has none. Equal rows count as documents each. Ties
rank by item. A text of any length is one document; one longer than a chunk is a chunk of its own. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.session import ensure_checkpoint_dir
from tamiz.llm.textscan import ASCII_LOWER, string_parts

#: Bytes of documents whose terms are grouped at a time.
CHUNK_BYTES = 1 << 21
BLOCK_TERMS, TILE_SOURCES = 1024, 128
#: Groups or languages beyond which their small table is joined by shuffle, not broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000
SCALE, ADD, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 5, 30, 50

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def term_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the terms in the joined bytes of documents; none crosses from one document to the next."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return start, end


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of the given sizes from a and from b hold equal bytes."""
    if not len(size):
        return np.zeros(0, bool)
    first = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(first, size)
    differ = raw[np.repeat(a, size) + step] != raw[np.repeat(b, size) + step]
    return np.add.reduceat(differ, first) == 0


def grouped(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(index of a span of each term, the term of each span). Spans of one hash but other bytes become terms of their own."""
    data = raw.tobytes()
    keys = np.fromiter((hashed(data[i:j]) for i, j in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    _, first, term = np.unique(keys, return_index=True, return_inverse=True)
    size = end - start
    alike = size == size[first[term]]
    alike[alike] = same_bytes(raw, start[alike], start[first[term[alike]]], size[alike])
    if not alike.all():
        first, own = first.tolist(), {}
        for k in np.flatnonzero(~alike).tolist():
            it = data[start[k] : end[k]]
            if it not in own:
                own[it] = len(first)
                first.append(k)
            term[k] = own[it]
        first = np.array(first)
    return first, term


def csr(row: np.ndarray, column: np.ndarray, n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and number of the cells that occur, in order of row."""
    key, count = np.unique(row * max(n_columns, 1) + column, return_counts=True)
    return key // max(n_columns, 1), key % max(n_columns, 1), count


def _spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    first = np.cumsum(size) - size
    picked = raw[np.repeat(start - first, size) + np.arange(int(size.sum()))]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.append(first, size.sum()).astype(np.int64)), pa.py_buffer(picked)).cast(pa.string())


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        code = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
        raw_all, off_all = string_parts(batch.column(2))
        n, i = batch.num_rows, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off_all, off_all[i] + CHUNK_BYTES, "right")) - 1)
            raw, off = ASCII_LOWER[raw_all[off_all[i] : off_all[j]]], off_all[i : j + 1] - off_all[i]
            groups, group_of = np.unique(code[i:j], return_inverse=True)
            start, end = term_spans(raw, off)
            first, term = grouped(raw, start, end)
            doc, doc_term, count = csr(np.searchsorted(off, start, "right") - 1, term, len(first))
            # Cells in order of group and term; what documents hold is summed over each run.
            order = np.lexsort((doc_term, group_of[doc]))
            key = group_of[doc][order] * max(len(first), 1) + doc_term[order]
            runs = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            docs = np.diff(np.append(runs, len(key)))
            total = np.add.reduceat(count[order], runs) if len(key) else np.zeros(0, np.int64)
            at, which = key[runs] // max(len(first), 1), key[runs] % max(len(first), 1)
            # A row without a term tells that the group occurs.
            of = groups[np.concatenate([at, np.arange(len(groups))])]
            terms = pa.concat_arrays([_spans(raw, start[first[which]], end[first[which]]), pa.nulls(len(groups), pa.string())])
            zero = np.zeros(len(groups), np.int64)
            width = max(len(source.dictionary), 1)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(of // width)), source.dictionary.take(pa.array(of % width)), terms, pa.array(np.concatenate([total, zero])), pa.array(np.concatenate([docs, zero]))],
                names=["lang", "source", "term", "count", "docs"],
            )
            i = j


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, count, lang_count, first) of the kept terms; one row with null term for every group, kept terms or not.

    ``first`` marks one row of each (lang, term).
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(_count_terms, "lang string, source string, term string, count long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    # The rows of a term in a language are its sources.
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_count": F.sum("count").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    return counts.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).select("lang", "source", "term", "count", "lang_count", "first")


def _weight(count: Column, total: Column, terms: Column, scale: int, add: int) -> Column:
    """1 + floor(scale * (count + add) / (total + add * terms)), exactly."""
    above = (count + add).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    below = (total + add * terms).cast("decimal(20,0)")
    return F.when(below > 0, F.call_function("div", above, F.when(below > 0, below)) + 1)


def _small(small: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if its rows are few."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _tiles(key: tuple, block: pa.Table) -> pa.Table:
    """Partial sums of all pairs of two tiles of sources over one block of terms.

    Rows without a term bring each source's weight of an absent term; all others are CSR cells.
    """
    tile_a, tile_b = key[2].as_py(), key[3].as_py()
    names = block.filter(pc.is_null(block["term"])).sort_by("place")
    cells = block.filter(pc.is_valid(block["term"]))
    place, base, tile = (names[c].to_numpy() for c in ("place", "base", "tile"))
    vocabulary = names["terms_all"].to_numpy()[0] if key[1].as_py() == 0 else 0
    row = np.searchsorted(place, cells["place"].to_numpy())
    column = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.lexsort((column, row))
    row, column, weight = row[order], column[order], cells["p"].to_numpy()[order]
    begin = np.searchsorted(row, np.arange(len(place) + 1))
    width = int(column.max(initial=-1)) + 1
    a, b = np.flatnonzero(tile == tile_a), np.flatnonzero(tile == tile_b)
    lo, hi = begin[a[0]], begin[a[-1] + 1]
    filled = a[begin[a] < begin[a + 1]]
    one, two, part = [], [], []
    for r in b.tolist():
        mine = slice(begin[r], begin[r + 1])
        dense = np.full(width, base[r])
        dense[column[mine]] = weight[mine]
        others = a[a < r]
        if not len(others):
            continue
        # Terms of the other source: |p - q| in place of |absent - q|; then terms of this one: |absent - q| in place of |absent - absent|.
        total = np.zeros(len(place), np.int64)
        if len(filled):
            there = dense[column[lo:hi]]
            cell = np.abs(weight[lo:hi] - there) - np.abs(base[row[lo:hi]] - there)
            total[filled] = np.add.reduceat(cell, begin[filled] - lo)
        apart = np.abs(base[others] - base[r])
        total[others] += np.abs(base[others][:, None] - weight[mine]).sum(1) - apart * len(weight[mine]) + vocabulary * apart
        one.append(others)
        two.append(np.full(len(others), r))
        part.append(total[others])
    one, two = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (one, two))
    source = names["source"].combine_chunks()
    values = pa.array(np.concatenate(part) if part else np.zeros(0, np.int64))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(one), pa.string()), "one": source.take(one).cast(pa.string()), "other": source.take(two).cast(pa.string()), "value": values})


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, scale: int = SCALE, add: int = ADD) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` for each other source of the language, ``term`` for the terms that a source uses more than its language."""
    ensure_checkpoint_dir(docs.sparkSession)
    cells = term_counts(docs, least_docs).checkpoint()
    langs = cells.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.coalesce(F.count_if(F.col("first") & F.col("term").isNotNull()), F.lit(0)).alias("terms_all"))
    groups = cells.groupBy("lang", "source").agg(F.sum("count").alias("total")).join(langs, "lang")
    # The window orders the sources of a language: one row each.
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("base", F.coalesce(_weight(F.lit(0).cast("long"), F.col("total"), F.col("terms_all"), scale, add), F.lit(0).cast("long")))
    groups = groups.checkpoint()
    rows = cells.where("term is not null").join(_small(groups), ["lang", "source"])
    rows = rows.withColumns({"p": _weight(F.col("count"), F.col("total"), F.col("terms_all"), scale, add), "q": _weight(F.col("lang_count"), F.col("lang_total"), F.col("terms_all"), scale, add)})

    over = rows.where("count > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    blocks = F.ceil(F.greatest(F.col("terms_all"), F.lit(1)) / BLOCK_TERMS)
    tile = F.floor(F.col("place") / TILE_SOURCES).cast("int")
    cell = rows.select("lang", F.pmod(F.xxhash64("term"), blocks).cast("long").alias("block"), "place", tile.alias("tile"), "term", "p", "terms_all")
    base = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"), "place", tile.alias("tile"), "source", "base", "terms_all")
    last = groups.groupBy("lang").agg(F.floor(F.max("place") / TILE_SOURCES).cast("int").alias("last"))
    dealt = cell.unionByName(base, allowMissingColumns=True).join(_small(last.checkpoint()), "lang")
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    dealt = dealt.withColumn("_other", other).withColumns({"tile_a": F.least("tile", "_other"), "tile_b": F.greatest("tile", "_other")})
    wide = dealt.select("lang", "block", "tile_a", "tile_b", "place", "tile", "term", "p", "source", "base", "terms_all")
    sums = wide.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(_tiles, "lang string, one string, other string, value long")
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    pairs = sums.select("lang", both.alias("_way"), "value").select("lang", "_way.source", "_way.item", "value").withColumn("rank", F.row_number().over(best))

    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


#: The same by plain SQL over ``documents``.
ORACLE_SQL = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n from t group by all),
kept as (select lang, term from t group by all having count(distinct k) >= 30),
v as (select lang, count(*) as v from kept group by all),
g as (select distinct d.lang, d.source, coalesce(v.v, 0) as v from d left join v using (lang)),
gc as (select g.lang, g.source, g.v, kept.term, coalesce(c.n, 0) as n from g join kept using (lang) left join c using (lang, source, term)),
gp as (select lang, source, term, n, v, sum(n) over (partition by lang, source) as total from gc),
p as (select lang, source, term, n, (1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v))::bigint as p from gp),
lc as (select lang, term, sum(n) as n, any_value(v) as v from gc group by all),
lq as (select lang, term, n, v, sum(n) over (partition by lang) as total from lc),
q as (select lang, term, (1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v))::bigint as q from lq),
pair as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pair.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, p.p - q.q as value from p join q using (lang, term) where p.n > 0 and p.p > q.q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from pairs union all from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
