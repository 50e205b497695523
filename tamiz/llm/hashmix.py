"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id. A source's budget is met by taking the documents whose
hash lies below a threshold. The threshold comes from nested histograms: tokens are summed by
(source, leading hash bits); the bucket in which the running sum passes the budget is the only one
that is looked into more finely, ``BITS`` more bits at a time. No documents are sorted, and a
larger budget takes a superset of the documents of a smaller one.

Defined results: null text has size 0; a null source is a source of its own and comes last; rows that
repeat a doc_id share its hash and are taken together; an empty table gives an empty mix; a source of
size 0 has target 0. Of the last undivided bucket (rows of equal hash) all or nothing is taken,
whichever ends nearer to the budget.

Only totals by source reach a window on one partition: its rows are the sources, not the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.session import fresh

BITS, HASH_BITS = 12, 60
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target stops at so many times its size.
MOST_REPEATS = 3
#: Sources up to this number are broadcast (a row is some 100 bytes); more are joined by shuffle.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def id_hash(doc_id: Column, seed: str) -> Column:
    """60 bits of md5, which any SQL engine can recompute."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, target): shares by weight, filled up to the sources' limits.

    The resharing of what exceeds a limit ends where every source has min(limit, level * weight); the
    level is found from running sums over the sources in order of limit / weight.
    """
    one = Window.orderBy(F.col("src").asc_nulls_last())
    totals = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(one) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * MOST_REPEATS)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    level = left / F.sum("weight").over(rest)
    # The first source in this order that its limit doesn't stop sets the level for all after it.
    free = ranked.withColumn("level", level).withColumn("level", F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level")))
    level = F.min(F.struct(F.col("limit") / F.col("weight"), "rank", "level")).over(all_rows)
    return free.withColumn("stop", F.min(F.when(F.col("level").isNotNull(), F.struct((F.col("limit") / F.col("weight")).alias("ratio"), "rank", "level"))).over(all_rows)).select(
        "src", "source_size", F.least(F.col("limit").cast("double"), F.coalesce(F.col("stop.level") * F.col("weight"), F.col("limit").cast("double"))).alias("target")
    )


def _with_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Joins what is known of each source; nulls match."""
    per_source = per_source.withColumnRenamed("src", "_src")
    return rows.join(F.broadcast(per_source) if few else per_source, F.col("src").eqNullSafe(F.col("_src"))).drop("_src")


def _thresholds(sized: DataFrame) -> tuple[DataFrame, int, bool]:
    """(src, source_size, target, whole, budget, stop), how many low bits of a hash ``stop`` leaves out, and whether these rows are few."""
    targets = source_targets(sized)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).checkpoint()
    few = targets.count() <= BROADCAST_SOURCES

    # edge: by source, the bucket that the budget ends in (its leading bits) and what is left for it.
    edge, shift = targets.select("src", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left")), HASH_BITS
    while shift > 0:
        width = min(BITS, shift)
        inside = _with_source(sized.where("size > 0"), edge, few).where(F.shiftright("h", shift) == F.col("prefix"))
        shift -= width
        bucket = F.shiftright("h", shift).alias("bucket")
        histogram = inside.groupBy("src", bucket, "left").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n"))
        below = F.coalesce(F.sum("tokens").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = histogram.withColumn("below", below).where((F.col("below") <= F.col("left")) & (F.col("left") < F.col("below") + F.col("tokens")))
        edge = found.select("src", F.col("bucket").alias("prefix"), (F.col("left") - F.col("below")).alias("left"), "tokens", "n").checkpoint()
        if edge.agg(F.max("n")).first()[0] in (None, 1):
            break
        edge = edge if shift == 0 else edge.drop("tokens", "n")
    # Documents below the edge bucket come in; those in it do if that ends nearer to the budget.
    last = edge.select("src", (F.col("prefix") + (F.col("left") > F.col("tokens") - F.col("left")).cast("long")).alias("stop"))
    per_source = targets.join(F.broadcast(last.withColumnRenamed("src", "_src")) if few else last.withColumnRenamed("src", "_src"), F.col("src").eqNullSafe(F.col("_src")), "left").drop("_src")
    return per_source, shift, few


def _copies(known: Column, h: Column, has_words: Column, shift: int) -> Column:
    """How often a document is taken; ``known``: the row of its source. One without words comes once."""
    extra = F.when(known["budget"] <= 0, 0).otherwise((F.shiftright(h, shift) < F.coalesce(known["stop"], F.lit(1 << 62))).cast("long"))
    return F.when(has_words, known["whole"] + extra).otherwise(F.lit(1).cast("long"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> DataFrame:
    """(doc_id, src, size, h): every pass reads these narrow rows instead of the texts."""
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("src"), word_count(F.col(text_col)).alias("size"))
    return sized.withColumn("h", F.coalesce(id_hash(F.col("doc_id"), seed), F.lit(0).cast("long"))).checkpoint()


def hash_threshold_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, src, size, source_size, target, copies, taken."""
    sized = _sized(docs, id_col, source_col, text_col, seed)
    per_source, shift, few = _thresholds(sized)
    known = F.struct(*("whole", "budget", "stop"))
    out = _with_source(sized, per_source, few).withColumn("copies", _copies(known, F.col("h"), F.col("size") > 0, shift))
    return out.select("doc_id", "src", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "h")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the texts aren't shuffled."""
    per_source, shift, few = _thresholds(_sized(docs, id_col, source_col, text_col, seed))
    own, source, known, copy = fresh(docs.columns, "src", "known_src", "known", "copy")
    per_source = per_source.select(F.col("src").alias(source), F.struct("whole", "budget", "stop").alias(known))
    name = lambda c: F.col(f"`{c}`")
    rows = docs.withColumn(own, name(source_col).cast("string")).join(F.broadcast(per_source) if few else per_source, F.col(own).eqNullSafe(F.col(source)))
    h = F.coalesce(id_hash(name(id_col).cast("long"), seed), F.lit(0).cast("long"))
    times = _copies(F.col(known), h, F.coalesce(name(text_col).rlike(WORD), F.lit(False)), shift)
    return rows.select(*map(name, docs.columns), F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias(copy)).drop(copy)


#: The same mix in SQL, by sorting; for comparison only.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
t AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
r AS (SELECT *, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS rnk FROM t),
w AS (SELECT *, (rnk % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM r),
l AS (SELECT *, cap::DOUBLE / weight AS ratio,
        ((SELECT sum(source_size) FROM t) - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
s AS (SELECT level FROM l WHERE cap >= level * weight ORDER BY ratio, rnk LIMIT 1),
g AS (SELECT src, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM s) * weight, cap::DOUBLE)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
c AS (SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
        sum(d.size) OVER (PARTITION BY d.src ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(d.size) OVER (PARTITION BY d.src, d.h) AS tied
      FROM d JOIN b ON d.src IS NOT DISTINCT FROM b.src)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN budget > 0 AND (upto <= budget OR (upto - tied <= budget AND budget - (upto - tied) > upto - budget)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
