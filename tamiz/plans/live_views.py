"""What is shown of the store, kept up from changes: counts by zone, portal, tab and state, and the best postings.

A refresh reads the rows that differ between the version it last saw and the current one (``BucketStore.changes``). A changed row takes its old
form out of the counts and puts its new one in. Of the best postings a reserve beyond the shown ones is kept in order, with the worst
of them as a floor: every row outside is below it. A row that leaves comes out of the reserve, a new one above the floor
goes in; only when fewer than the shown ones are left are they taken from the whole store again. Discarded postings count by state only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.operators.geo import known_zone
from tamiz.plans.bucket_store import BucketStore
from tamiz.plans.shared import Files
from tamiz.plans.views import with_tab


#: The columns that the views depend on; no text of a posting is among them.
SHOWN = ("url", "portal", "zona", "estado", "regimenTrabajo", "trabajoEnCampamento", "matchScore")


def counted(rows: DataFrame, sign: int) -> DataFrame:
    """(view, key, n): what each row adds to the counts, or takes from them."""
    live = F.col("estado") != "descartada"
    entry = lambda view, key: F.struct(F.lit(view).alias("view"), F.col(key).alias("key"))
    shown = F.when(live, F.array(entry("zona", "zona"), entry("portal", "portal"), entry("tab", "tab"))).otherwise(F.array().cast("array<struct<view:string,key:string>>"))
    every = F.concat(shown, F.array(entry("estado", "estado")))
    return with_tab(rows).withColumn("zona", known_zone(F.col("zona"))).select(F.explode(every).alias("e")).select("e.view", "e.key", F.lit(sign).cast("long").alias("n"))


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("view", "key").agg(F.sum("n").alias("n")).where("n != 0")


def counts_of(stored: DataFrame) -> DataFrame:
    return summed(counted(stored, 1))


def best_of(stored: DataFrame, k: int) -> DataFrame:
    """The first k of the live list."""
    return stored.where("estado != 'descartada'").select("url", "matchScore").orderBy(F.desc("matchScore"), "url").limit(k)


class LiveViews:
    """The views of one store under a folder of their own. ``shown`` postings are listed; ``reserve`` more are kept ready."""

    def __init__(self, store: BucketStore, folder: str, shown: int = 100, reserve: int = 300):
        self.store, self.spark, self.folder, self.shown, self.kept = store, store.spark, folder.rstrip("/"), shown, shown + reserve
        self.files = Files(self.spark, self.folder)
        #: How often the best postings were taken from the whole store.
        self.rebuilt = 0

    def _last(self) -> dict | None:
        names = [n for n in self.files.names() if n.startswith("p-")]
        return json.loads(self.files.read(max(names))) if names else None

    def version(self) -> int:
        """The version of the store that the views show."""
        last = self._last()
        return -1 if last is None else last["store"]

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self._last()['name']}/counts")

    def best(self) -> DataFrame:
        last = self._last()
        return self.spark.createDataFrame([tuple(x) for x in last["best"][: self.shown]], "url string, matchScore int")

    def refresh(self) -> int:
        """Brings the views to the store's current version, which is returned."""
        last, now = self._last(), self.store.version()
        if now < 0 or last is not None and last["store"] == now:
            return now
        if last is None or last["store"] not in self.store.versions():
            stored = self.store.read(now)
            counts, (best, floor) = counts_of(stored), self._rebuilt(stored)
        else:
            changes = self.store.changes(last["store"], now, list(SHOWN))
            old, new = (changes.where(F.col(x).isNotNull()).select(f"{x}.*") for x in ("old", "new"))
            before = self.spark.read.parquet(f"{self.folder}/{last['name']}/counts")
            counts = summed(before.unionByName(counted(old, -1)).unionByName(counted(new, 1)))
            best, floor = self._moved(last, old, new, now)
        name = uuid.uuid4().hex
        counts.coalesce(1).write.parquet(f"{self.folder}/{name}/counts")
        # One reader of changes at a time: the second finds the number taken and lets the first one's views stand.
        if self.files.publish(f"p-{now:012d}.json", json.dumps({"store": now, "name": name, "best": best, "floor": floor})) and last is not None:
            self.files.delete(f"p-{last['store']:012d}.json")
            self.files.delete(last["name"])
        return now

    def _rebuilt(self, stored: DataFrame) -> tuple[list, list | None]:
        self.rebuilt += 1
        best = [[r.url, r.matchScore] for r in best_of(stored, self.kept).collect()]
        return best, best[-1] if len(best) == self.kept else None

    def _moved(self, last: dict, old: DataFrame, new: DataFrame, now: int) -> tuple[list, list | None]:
        best, floor = last["best"], last["floor"]
        place = lambda x: (-x[1], x[0])
        kept = self.spark.createDataFrame([(x[0],) for x in best], "url string")
        # Of the changed rows only those come here that stand in the reserve or belong there, at most ``kept`` of either.
        gone = {r.url for r in old.join(F.broadcast(kept), "url", "left_semi").select("url").collect()}
        came = new if floor is None else new.where((F.col("matchScore") > floor[1]) | ((F.col("matchScore") == floor[1]) & (F.col("url") <= floor[0])))
        best = sorted([x for x in best if x[0] not in gone] + [[r.url, r.matchScore] for r in best_of(came, self.kept + 1).collect()], key=place)
        if len(best) > self.kept:
            best = best[: self.kept]
            floor = best[-1]
        if len(best) < self.shown and floor is not None:
            return self._rebuilt(self.store.read(now))
        return best, floor
