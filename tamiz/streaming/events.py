"""What a run tells while it goes on: status messages, every posting found, and how it ended, as rows of a table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tamiz.plans.shared import Files

EVENTS = "run string, batch long, seq long, kind string, message string, url string, score int, active long, discarded long"


class RunLog:
    """Events by run and batch under one folder. A batch that is written again replaces its events, so that a restart repeats none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batch(self, run: str, batch: int) -> str:
        return f"{self.folder}/run={hashlib.sha256(run.encode()).hexdigest()[:16]}/batch={batch}"

    def gated(self, run: str, batch: int, rows: DataFrame) -> DataFrame:
        """The gated rows of a batch, written and read again; they go once its events are written."""
        rows.write.mode("overwrite").parquet(f"{self._batch(run, batch)}/gated")
        return self.spark.read.parquet(f"{self._batch(run, batch)}/gated")

    def write(self, run: str, batch: int, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
        """Writes a batch's postings and its events; returns the accepted postings as written."""
        at = self._batch(run, batch)
        accepted.write.mode("overwrite").parquet(f"{at}/accepted")
        rejected.select("portal", "url", "motivo").write.mode("overwrite").parquet(f"{at}/rejected")
        kept, gone = self.spark.read.parquet(f"{at}/accepted"), self.spark.read.parquet(f"{at}/rejected")
        ends = kept.select(F.lit(1).alias("ok")).unionByName(gone.select(F.lit(0).alias("ok"))).agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("active"), (F.count("ok") - F.coalesce(F.sum("ok"), F.lit(0))).alias("discarded"))
        found = kept.select(F.lit("OfferFound").alias("kind"), "url", F.col("matchScore").cast("int").alias("score"))
        by_portal = gone.groupBy("portal", "motivo").agg(F.count(F.lit(1)).alias("discarded"))
        status = by_portal.select(F.lit("Status").alias("kind"), F.concat(F.coalesce("portal", F.lit("")), F.lit(": "), F.col("motivo")).alias("message"), "discarded")
        message = F.when(F.col("active") == 0, F.concat(F.lit("Sin resultados. Descartadas: "), F.col("discarded"))).otherwise(F.concat(F.lit("Listo: "), F.col("active"), F.lit(" vacantes · "), F.col("discarded"), F.lit(" descartadas")))
        finished = ends.select(F.lit("Finished").alias("kind"), message.alias("message"), "active", "discarded")
        events = status.unionByName(found, allowMissingColumns=True).unionByName(finished, allowMissingColumns=True)
        place = {"Status": 0, "OfferFound": 1, "Finished": 2}
        order = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])[F.col("kind")]
        # Numbers tell the order of kinds and are otherwise only distinct, so that no task has to see all events.
        rows = events.withColumn("seq", order.cast("long") * F.lit(1 << 60) + F.monotonically_increasing_id())
        rows.select("seq", "kind", "message", "url", "score", "active", "discarded").write.mode("overwrite").parquet(f"{at}/events")
        Files(self.spark, at).delete("gated")
        return kept

    def read(self, run: str | None = None) -> DataFrame:
        """(batch, seq, kind, message, url, score, active, discarded) of one run, or of all of them."""
        which = "*" if run is None else f"run={hashlib.sha256(run.encode()).hexdigest()[:16]}"
        batch = F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("long").alias("batch")
        return self.spark.read.parquet(f"{self.folder}/{which}/batch=*/events").select(batch, "*")

    def totals(self, run: str | None = None) -> DataFrame:
        """(active, discarded) of all finished batches."""
        return self.read(run).where("kind = 'Finished'").agg(F.sum("active").alias("active"), F.sum("discarded").alias("discarded"))


class Progress(StreamingQueryListener):
    """The latest progress of each streaming query, by its id: batch, rows read and rows a second. Bounded by the number of queries."""

    def __init__(self):
        self.latest: dict[str, tuple[int, int, float]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.latest[str(event.id)] = (-1, 0, 0.0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        read = self.latest.get(str(p.id), (-1, 0, 0.0))[1] + p.numInputRows
        self.latest[str(p.id)] = (p.batchId, read, p.processedRowsPerSecond)

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception
