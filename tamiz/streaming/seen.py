"""What a stream of postings remembers: URLs seen before, until nothing was heard of them for thirty days.

State is keyed by cleaned URL, so no key grows with the stream; a timer in event time frees it. The watermark tells which rows come too late: Spark
drops them. A posting without a readable date counts as of the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tamiz.functions.dates import DAY_MS, epoch_of
from tamiz.functions.text import clean_url

RETENTION_DAYS = 30
EVENTS = StructType([StructField("clean_url", StringType()), StructField("event", StringType()), StructField("at_ms", LongType()), StructField("times", LongType())])
_STATE = StructType([StructField("last_ms", LongType()), StructField("times", LongType())])


def timed(raw: DataFrame, as_of: Column, delay: str = "1 day") -> DataFrame:
    """Postings with ``clean_url`` and ``seen_at``, the time their date tells, and the watermark on it."""
    dated = epoch_of("fechaPublicacion", as_of)
    at = F.timestamp_millis(F.when(dated > 0, dated).otherwise(F.unix_millis(as_of)))
    return raw.withColumns({"clean_url": clean_url("url"), "seen_at": at}).where("clean_url != ''").withWatermark("seen_at", delay)


def first_seen(rows: DataFrame) -> DataFrame:
    """The first row of each URL within the watermark's delay, inside Spark alone: a cheap filter before any work on descriptions."""
    return rows.dropDuplicatesWithinWatermark(["clean_url"])


class Lifecycle(StatefulProcessor):
    """Events of one URL: ``nueva`` at its first row, ``repetida`` at later ones, ``vencida`` when ``days`` have passed since the last."""

    def __init__(self, days: int = RETENTION_DAYS):
        self.keep_ms = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = sorted(t for batch in rows for t in batch["at_ms"].tolist())
        last, times = self.state.get() if self.state.exists() else (None, 0)
        if last is not None:
            self.handle.deleteTimer(last + self.keep_ms)
        events = []
        for t in at:
            events.append(("nueva" if times == 0 else "repetida", t, times + 1))
            last, times = t if last is None else max(last, t), times + 1
        self.state.update((last, times))
        self.handle.registerTimer(last + self.keep_ms)
        yield self._events(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, times = self.state.get()
        self.state.clear()
        yield self._events(key, [("vencida", expiredTimerInfo.getExpiryTimeInMs(), times)])

    def close(self) -> None:
        pass

    @staticmethod
    def _events(key, events) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *e) for e in events], columns=EVENTS.fieldNames())


def lifecycle(rows: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """(clean_url, event, at_ms, times) of ``timed`` rows. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    keyed = rows.select("clean_url", "seen_at", F.unix_millis("seen_at").alias("at_ms"))
    return keyed.groupBy("clean_url").transformWithStateInPandas(statefulProcessor=Lifecycle(days), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
