"""The refresh as a stream: new files of postings, cleaned and enriched, merged into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tamiz.plans.bucket_store import BucketStore
from tamiz.plans.live_views import LiveViews
from tamiz.plans.pipeline import STORE_COLUMNS, as_of_column, refresh
from tamiz.plans.store import Store, descriptions, purge
from tamiz.streaming.events import RunLog

_INCOMING = [c for c in STORE_COLUMNS if c not in ("nuevo", "estado")]


def _now_ms(spark: SparkSession, as_of: str) -> int:
    return spark.range(1).select(F.unix_millis(as_of_column(as_of))).first()[0]


def merge_batch(store: Store, raw: DataFrame, as_of: str) -> dict[str, int]:
    """Purges old postings and merges one batch; merging it again changes nothing but ``nuevo``. Returns how many rows were merged and their best score."""
    stored = store.read()
    if stored is not None:
        stored = purge(stored, _now_ms(raw.sparkSession, as_of))
    accepted, _ = refresh(raw, as_of, cached=None if stored is None else descriptions(stored))
    progress = Observation("refresh")
    accepted = accepted.observe(progress, F.count(F.lit(1)).alias("accepted"), F.max("matchScore").alias("best_score"))
    store.merge(accepted.select(*_INCOMING), stored)
    return progress.get


def merge_bucketed(store: BucketStore, raw: DataFrame, as_of: str, batch: int, run: str = "refresh", log: RunLog | None = None, views: LiveViews | None = None) -> int:
    """Purges old postings and merges one batch, touching only the buckets of its URLs; returns the store's version.

    A batch that the store holds already, as after a restart, is passed over; its events and the views are then brought up to date.
    """
    store.purge(_now_ms(raw.sparkSession, as_of))
    stored = store.near(raw.where("url is not null"))
    keep = None if log is None else lambda gated: log.gated(run, batch, gated)
    accepted, rejected = refresh(raw, as_of, cached=None if stored is None else descriptions(stored), keep=keep)
    if log is not None:
        accepted = log.write(run, batch, accepted.select(*_INCOMING), rejected)
    version = store.merge(accepted.select(*_INCOMING), transaction=(run, batch))
    if views is not None:
        views.refresh()
    return version


def start(spark: SparkSession, source: str, schema: str, store: Store | BucketStore, checkpoint: str, as_of: str, files_a_batch: int = 100, log: RunLog | None = None, views: LiveViews | None = None) -> StreamingQuery:
    """Reads what has landed in ``source`` and stops when that is done; start it again for what lands later."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        if isinstance(store, BucketStore):
            merge_bucketed(store, batch, as_of, number, checkpoint, log, views)
        else:
            merge_batch(store, batch, as_of)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
