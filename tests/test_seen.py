"""The stream's memory against a plain loop over the same batches."""

import random

import pytest
from pyspark.sql import functions as F

from tamiz.functions.dates import DAY_MS
from tamiz.streaming import seen

START = 1_700_000_000_000
SCHEMA = "clean_url string, ms long"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def batches():
    """Batches in order of time with repeated URLs, some rows late, one batch far ahead."""
    rng, out, day = random.Random(3), [], 0
    for k in range(6):
        day += 40 if k == 4 else 5
        out.append([(f"u{rng.randrange(8)}", START + int((day + rng.uniform(-4, 4)) * DAY_MS)) for _ in range(6)])
        if k in (2, 5):
            out[-1].append(("late", START))
    return out


def run(spark, tmp_path, make):
    """Streams the batches, a file at a time, and returns the rows in order of batch."""
    source, got = str(tmp_path / "in"), []
    for k, rows in enumerate(batches()):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)
        stream = stream.withColumn("seen_at", F.timestamp_millis("ms")).withWatermark("seen_at", "3 days")
        out = []
        make(stream).writeStream.foreachBatch(lambda df, _, out=out: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(out))
    return got


def loop(on_time, end):
    """Rows later than the watermark of the batches before don't count; timers fire once the watermark has passed them."""
    watermark, newest, out = None, None, []
    for rows in batches():
        events = []
        on_time([r for r in rows if watermark is None or r[1] > watermark], events)
        end(watermark, events)
        newest = max([t for _, t in rows] + ([newest] if newest else []))
        watermark = newest - 3 * DAY_MS
        # A batch without data follows and fires what the new watermark frees.
        end(watermark, events)
        out.append(sorted(events))
    return out


def test_lifecycle_equals_a_plain_loop(rocks, tmp_path):
    state = {}

    def on_time(rows, events):
        for url in sorted({u for u, _ in rows}):
            for t in sorted(t for u, t in rows if u == url):
                last, times = state.get(url, (None, 0))
                events.append((url, "repetida" if times else "nueva", t, times + 1))
                state[url] = (t if last is None else max(last, t), times + 1)

    def end(watermark, events):
        for url, (last, times) in list(state.items()):
            if watermark is not None and last + 30 * DAY_MS <= watermark:
                events.append((url, "vencida", last + 30 * DAY_MS, times))
                del state[url]

    want = loop(on_time, end)
    assert run(rocks, tmp_path, seen.lifecycle) == want
    kinds = {e for rows in want for _, e, *_ in rows}
    assert kinds == {"nueva", "repetida", "vencida"} and sum(u == "late" for rows in want for u, *_ in rows) < 2


def test_first_seen_within_the_delay(spark, tmp_path):
    expiry = {}

    def on_time(rows, events):
        for url, t in rows:
            if url not in expiry:
                expiry[url] = None
                events.append(url)
        for url, _ in rows:
            if expiry.get(url, 0) is None:
                expiry[url] = min(t for u, t in rows if u == url) + 3 * DAY_MS

    def end(watermark, _):
        for url in [u for u, t in expiry.items() if watermark is not None and t <= watermark]:
            del expiry[url]

    want = [sorted(set(rows)) for rows in loop(on_time, end)]
    got = [sorted(u for u, *_ in rows) for rows in run(spark, tmp_path, seen.first_seen)]
    assert [len(x) == len(set(x)) for x in got] == [True] * len(got)
    assert got == want


def test_postings_get_a_time_and_a_key(spark):
    rows = spark.createDataFrame([("http://j/1?a", "ayer"), (" ", "ayer"), ("http://j/2/", "quien sabe")], "url string, fechaPublicacion string")
    got = {r.clean_url: r.ms for r in seen.timed(rows, F.lit("2026-07-20 12:00:00").cast("timestamp")).select("clean_url", F.unix_millis("seen_at").alias("ms")).collect()}
    assert got == {"http://j/1": 1784548800000 - DAY_MS, "http://j/2": 1784548800000}
