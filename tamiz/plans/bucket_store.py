"""The store in buckets of hashed URLs: a batch reads and rewrites only the buckets that its URLs fall into.

A version is a small manifest that names each bucket's folder. A change writes the new form of the buckets it touches
beside the old one and publishes the next manifest, under a number that only one writer can take. A writer that
finds it taken keeps its files if the others touched different buckets, else it merges anew with what they wrote. So a failed
or late writer leaves nothing behind but files that no manifest names, which ``vacuum`` removes along with old versions.

The URL is the key: never null, never twice. What is written is checked before it is published.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamiz.plans.shared import Files
from tamiz.plans.store import STATES, last_of_each, purge, restore_discarded


class KeyViolation(ValueError):
    """A URL that is null or comes twice."""


class Conflict(RuntimeError):
    """Other writers were faster every time."""


def bucket_of(url: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def dealt_out(rows: DataFrame, buckets: int, touched: set[int]) -> DataFrame:
    return rows.withColumn("_bucket", bucket_of("url", buckets)).repartition(max(len(touched), 1), "_bucket")


def upsert_dealt(stored: DataFrame, incoming: DataFrame, deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keep_state`` and ``upsert`` in one shuffle: old and new rows are dealt out to their buckets and meet there.

    Rows of a URL that comes in go before the stored one and take its state. A URL that comes in twice stays so.
    """
    new = incoming.drop("nuevo", "estado").withColumns({"nuevo": F.lit(True), "estado": F.lit("pendiente")}).select(*stored.columns)
    both = deal(new.withColumn("_new", F.lit(True)).unionByName(stored.withColumn("_new", F.lit(False))))
    of_url = Window.partitionBy("_bucket", "url")
    both = both.withColumns({"_comes": F.max("_new").over(of_url), "_stays": F.min("_new").over(of_url), "_state": F.max(F.when(~F.col("_new"), F.col("estado"))).over(of_url)})
    rows = both.where(F.col("_new") == F.col("_comes"))
    rows = rows.withColumns({"nuevo": F.when(F.col("_new"), F.col("_stays")).otherwise(F.col("nuevo")), "estado": F.when(F.col("_new"), F.coalesce("_state", "estado")).otherwise(F.col("estado"))})
    return rows.drop("_new", "_comes", "_stays", "_state")


#: Bytes of a text beyond which its digest stands for it where rows are compared.
COMPARED_BYTES = 64


def _compared(c: str, kind: str) -> Column:
    """What tells a value from others: of a long text its length and SHA-256."""
    if kind != "string":
        return F.col(c)
    return F.struct(F.octet_length(c).alias("n"), F.when(F.octet_length(c) > COMPARED_BYTES, F.sha2(c, 256)).otherwise(F.col(c)).alias("text")).alias(c)


class BucketStore:
    """Versions of a table keyed by ``url`` under one folder. ``buckets`` holds for a new store and is kept from then on; about a gigabyte a bucket is a good size."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, attempts: int = 10):
        self.spark, self.folder, self.attempts, self._new = spark, folder.rstrip("/"), attempts, buckets
        self.files = Files(spark, self.folder)

    # Versions.

    def versions(self) -> list[int]:
        return sorted(int(name[2:-5]) for name in self.files.names() if name.startswith("m-") and name.endswith(".json"))

    def version(self) -> int:
        return max(self.versions(), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets (their number), paths and stats (by bucket), schema, transactions (the last of each writer) and time.

        The stats of a bucket are its rows and the oldest date in milliseconds of those that a purge may take, null if there is none.
        """
        version = self.version() if version is None else version
        if version < 0:
            return {"version": -1, "buckets": self._new, "paths": {}, "stats": {}, "schema": None, "transactions": {}, "at": 0}
        return json.loads(self.files.read(f"m-{version:012d}.json"))

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        paths = [f"{self.folder}/data/{p}" for b, p in sorted(manifest["paths"].items()) if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        return self._read(self.manifest(version))

    def near(self, rows: DataFrame) -> DataFrame | None:
        """What is stored in the buckets that the rows' URLs fall into."""
        manifest = self.manifest()
        return self._read(manifest, self._touched(rows, manifest["buckets"]))

    def count(self) -> int:
        """By the manifest alone."""
        return sum(rows for rows, _ in self.manifest()["stats"].values())

    # Changes.

    def _touched(self, rows: DataFrame, buckets: int) -> set[int]:
        """At most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(bucket_of("url", buckets)).distinct().collect()}

    def _write(self, rows: DataFrame, buckets: int, touched: set[int]) -> dict[str, tuple[str, list] | None]:
        """The touched buckets' new folders and stats, a bucket without rows has none. One pass over the keys checks them and sums up. Rows that aren't dealt out to their buckets yet are so here."""
        name = uuid.uuid4().hex
        target = f"{self.folder}/data/{name}"
        dealt = rows if "_bucket" in rows.columns else dealt_out(rows, buckets, touched)
        dealt.write.partitionBy("_bucket").parquet(target)
        written = {int(d.rpartition("=")[2]) for d in self.files.names(f"data/{name}") if d.startswith("_bucket=")}
        out: dict[str, tuple[str, list] | None] = dict.fromkeys(map(str, touched))
        if not written:
            return out
        kept = self.spark.read.schema(dealt.schema).parquet(target)
        dated = {"fechaEpoch", "estado"} <= set(rows.columns)
        old = F.when((F.col("fechaEpoch") > 0) & (F.col("estado") != "postulada"), F.col("fechaEpoch")) if dated else F.lit(None)
        by_url = kept.groupBy("_bucket", "url").agg(F.count(F.lit(1)).alias("n"), F.min(old.cast("bigint")).alias("oldest"))
        worst = F.max(F.struct(F.col("url").isNull().alias("missing"), "n", "url")).alias("worst")
        for r in by_url.groupBy("_bucket").agg(F.sum("n").alias("rows"), F.min("oldest").alias("oldest"), worst).collect():
            if r.worst.missing or r.worst.n > 1:
                raise KeyViolation(f"the url {r.worst.url!r} comes {r.worst.n} times")
            if r["_bucket"] not in touched:
                raise KeyViolation("a row left its bucket")
            out[str(r["_bucket"])] = f"{name}/_bucket={r['_bucket']}", [r.rows, r.oldest]
        return out

    def _publish(self, base: dict, changed: dict[str, tuple[str, list] | None], schema: StructType, transaction: tuple[str, int] | None) -> int | None:
        """The published version; none if another writer has changed one of the buckets since ``base``."""
        while True:
            last = self.manifest()
            if any(last["paths"].get(b) != base["paths"].get(b) for b in changed) or last["version"] >= 0 and last["buckets"] != base["buckets"]:
                return None
            if transaction and last["transactions"].get(transaction[0], -1) >= transaction[1]:
                return last["version"]
            paths, stats = ({b: x for b, x in (last[of] | {b: c and c[k] for b, c in changed.items()}).items() if x} for k, of in enumerate(("paths", "stats")))
            new = last | {"version": last["version"] + 1, "buckets": base["buckets"], "paths": paths, "stats": stats, "schema": schema.jsonValue(), "at": int(time.time() * 1000)}
            if transaction:
                new["transactions"] = last["transactions"] | {transaction[0]: transaction[1]}
            if self.files.publish(f"m-{new['version']:012d}.json", json.dumps(new)):
                return new["version"]

    def _change(self, touched: Callable[[dict], set[int]], make: Callable[[DataFrame | None, Callable[[DataFrame], DataFrame]], DataFrame], transaction: tuple[str, int] | None = None, create: bool = False) -> int:
        """Replaces the touched buckets by what ``make`` makes of them, given what deals rows out to their buckets; anew if another writer was faster."""
        for _ in range(self.attempts):
            base = self.manifest()
            if transaction and base["transactions"].get(transaction[0], -1) >= transaction[1]:
                return base["version"]
            of = touched(base)
            if not of and not (create and base["schema"] is None):
                return base["version"]
            rows = make(self._read(base, of), functools.partial(dealt_out, buckets=base["buckets"], touched=of))
            version = self._publish(base, self._write(rows, base["buckets"], of), rows.drop("_bucket").schema, transaction)
            if version is not None:
                return version
        raise Conflict(f"given up after {self.attempts} attempts")

    def merge(self, incoming: DataFrame, order: str | None = None, transaction: tuple[str, int] | None = None) -> int:
        """Upserts rows, whose stored state survives, and returns the version. Where URLs come repeatedly, ``order`` tells the arrival and the last wins; without it they are refused.

        ``transaction`` is a writer's name and the growing number of its batch: a batch that is already in the store is passed over.
        """
        if order is not None:
            incoming = last_of_each(incoming, order).drop(order)
        # Read twice and once more after a conflict, so it is computed once.
        staged = f"stage/{uuid.uuid4().hex}"
        incoming.write.parquet(f"{self.folder}/{staged}")
        rows = self.spark.read.parquet(f"{self.folder}/{staged}")

        def make(stored: DataFrame | None, deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
            if stored is None:
                return rows.drop("nuevo", "estado").withColumns({"nuevo": F.lit(True), "estado": F.lit("pendiente")})
            return upsert_dealt(stored, rows, deal)

        try:
            return self._change(lambda base: self._touched(rows, base["buckets"]), make, transaction, create=True)
        finally:
            self.files.delete(staged)

    def set_state(self, url: str, state: str) -> int:
        """Rewrites one bucket."""
        if state not in STATES:
            raise ValueError(f"unknown state {state}")
        one = self.spark.range(1).select(F.lit(url).alias("url"))
        return self._change(lambda base: self._touched(one, base["buckets"]) if base["schema"] else set(), lambda stored, _: stored.withColumn("estado", F.when(F.col("url") == url, state).otherwise(F.col("estado"))))

    def restore_discarded(self) -> int:
        """Rewrites the buckets that hold a discarded row."""

        def touched(base: dict) -> set[int]:
            stored = self._read(base)
            return set() if stored is None else self._touched(stored.where("estado = 'descartada'"), base["buckets"])

        return self._change(touched, lambda stored, _: restore_discarded(stored))

    def purge(self, as_of_ms: int, days: int = 30) -> int:
        """Rewrites the buckets that hold a row too old, as the manifest tells; no other bucket is read."""
        limit = as_of_ms - days * 86_400_000
        return self._change(lambda base: {int(b) for b, (_, oldest) in base["stats"].items() if oldest is not None and oldest < limit}, lambda stored, _: purge(stored, as_of_ms, days))

    def clear(self) -> int:
        return self._change(lambda base: {int(b) for b in base["paths"]}, lambda stored, _: stored.limit(0))

    def changes(self, since: int, until: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """(url, old, new) of all rows that differ between two versions; reads only buckets that were rewritten.

        With ``columns`` only those are read and compared. Long texts are compared by digest, so that none is shuffled that isn't asked for.
        """
        one, two = self.manifest(since), self.manifest(until)
        changed = {int(b) for b in one["paths"].keys() | two["paths"].keys() if one["paths"].get(b) != two["paths"].get(b)}
        new = self._read(two, changed)
        old = self._read(one, changed)
        old = new.limit(0) if old is None else old
        names = old.columns if columns is None else [c for c in old.columns if c == "url" or c in columns]

        def whole(rows: DataFrame, name: str) -> DataFrame:
            rows = rows.select(*names)
            return rows.select("url", F.struct(*names).alias(name), F.struct(*(_compared(c, t) for c, t in rows.dtypes)).alias(f"_{name}"))

        both = whole(old, "old").join(whole(new, "new"), "url", "full")
        return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("url", "old", "new")

    def vacuum(self, keep_ms: int, now_ms: int | None = None) -> list[str]:
        """Removes versions published longer ago than ``keep_ms``, but for the last, and files as old that no other version names. Returns what it removed."""
        limit = (int(time.time() * 1000) if now_ms is None else now_ms) - keep_ms
        manifests = {v: self.manifest(v) for v in self.versions()}
        last = max(manifests, default=-1)
        old = [v for v, m in manifests.items() if v < last and m["at"] < limit]
        used = {p.partition("/")[0] for v, m in manifests.items() if v not in old for p in m["paths"].values()}
        gone = [f"m-{v:012d}.json" for v in old] + [f"{top}/{n}" for top in ("data", "stage") for n, at in self.files.names(top).items() if n not in used and at < limit]
        for name in gone:
            self.files.delete(name)
        return gone
