"""The store in buckets: what a batch touches, the key, writers at once, versions."""

import functools
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tamiz.plans import store as plain
from tamiz.plans.bucket_store import BucketStore, Conflict, KeyViolation, bucket_of, dealt_out, upsert_dealt

SCHEMA = "url string, portal string, matchScore int, fechaEpoch long"


def rows(spark, *urls, score=1, epoch=0):
    return spark.createDataFrame([(u, "p", score, epoch) for u in urls], SCHEMA)


def held(store):
    return {(r.url, r.matchScore, r.nuevo, r.estado) for r in store.read().collect()}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), buckets=8)
    assert store.version() == -1 and store.read() is None and store.count() == 0
    assert store.merge(rows(spark, *(f"u{k}" for k in range(100)))) == 0
    before = store.manifest()
    assert len(before["paths"]) == 8 and store.count() == 100
    touched = spark.createDataFrame([("u1",), ("x",)], "url string").select(bucket_of("url", 8)).distinct().count()
    store.merge(rows(spark, "u1", "x", score=9))
    after = store.manifest()
    assert sum(before["paths"][b] != p for b, p in after["paths"].items()) == touched <= 2
    got = {r.url: (r.matchScore, r.nuevo, r.estado) for r in store.read().collect()}
    assert got["u1"] == (9, False, "pendiente") and got["x"] == (9, True, "pendiente") and len(got) == 101
    assert store.read(0).count() == 100
    near = {r.url for r in store.near(rows(spark, "u1")).collect()}
    assert "u1" in near and len(near) < 100


def test_merges_equal_the_plain_store(spark, tmp_path):
    rng = random.Random(1)
    store, stored = BucketStore(spark, str(tmp_path), buckets=5), None
    for k in range(4):
        batch = spark.createDataFrame([(f"u{rng.randrange(30)}", "p", rng.randrange(100), 0, n) for n in range(25)], SCHEMA + ", arrival int")
        store.merge(batch, order="arrival")
        one = plain.last_of_each(batch, "arrival").drop("arrival")
        stored = one.withColumns({"nuevo": F.lit(True), "estado": F.lit("pendiente")}) if stored is None else plain.upsert(stored, plain.keep_state(one, stored).select(*stored.columns))
        stored = spark.createDataFrame(stored.collect(), stored.schema)
        if k == 1:
            url = stored.first().url
            store.set_state(url, "descartada")
            stored = plain.set_state(stored, url, "descartada")
        assert held(store) == {(r.url, r.matchScore, r.nuevo, r.estado) for r in stored.collect()}
    assert store.restore_discarded() == store.version()
    assert {s for *_, s in held(store)} == {"pendiente"}
    store.clear()
    assert store.count() == 0 and store.read().columns == stored.columns


def test_states_and_purge_touch_what_they_change(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), buckets=16)
    old, new = [f"o{k}" for k in range(3)], [f"n{k}" for k in range(60)]
    store.merge(rows(spark, *old, epoch=1).unionByName(rows(spark, *new, epoch=10**13)))
    store.set_state("o1", "postulada")
    before = store.manifest()["paths"]
    store.purge(10**12)
    after = store.manifest()["paths"]
    assert {u for u, *_ in held(store)} == {*new, "o1"}
    assert 1 <= sum(after.get(b) != p for b, p in before.items()) <= 2
    stats = store.manifest()["stats"]
    assert store.count() == sum(n for n, _ in stats.values()) == store.read().count()
    assert {oldest for _, oldest in stats.values()} <= {10**13, None}
    version = store.version()
    assert store.purge(10**12) == version and store.restore_discarded() == version
    with pytest.raises(ValueError):
        store.set_state("o1", "otro")


def test_a_repeated_or_missing_url_is_refused_and_a_failed_batch_changes_nothing(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), buckets=4)
    with pytest.raises(KeyViolation):
        store.merge(rows(spark, "a", "b", "a"))
    assert store.version() == -1
    store.merge(rows(spark, "a", "b"))
    for bad in (rows(spark, "c", "c"), rows(spark, "d", None), rows(spark, None)):
        with pytest.raises(KeyViolation):
            store.merge(bad)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.merge(rows(spark, "e").withColumn("matchScore", F.expr("cast(1 div (matchScore - 1) as int)")))
    assert store.version() == 0 and {u for u, *_ in held(store)} == {"a", "b"}


def test_batches_are_merged_once(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), buckets=4)
    assert store.merge(rows(spark, "a"), transaction=("stream", 0)) == 0
    assert store.merge(rows(spark, "b"), transaction=("stream", 0)) == 0 == store.version()
    assert store.merge(rows(spark, "b"), transaction=("stream", 1)) == 1
    assert store.merge(rows(spark, "c"), transaction=("other", 0)) == 2
    assert store.merge(rows(spark, "z"), transaction=("stream", 1)) == 2 and store.count() == 3


def test_writers_at_once_lose_nothing(spark, tmp_path):
    BucketStore(spark, str(tmp_path), buckets=3).merge(rows(spark, "start"))
    failed = []

    def write(k):
        try:
            for n in range(3):
                BucketStore(spark, str(tmp_path), attempts=40).merge(rows(spark, f"w{k}-{n}", "shared", score=k))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = BucketStore(spark, str(tmp_path))
    assert not failed
    assert sorted(u for u, *_ in held(store)) == sorted(["start", "shared", *(f"w{k}-{n}" for k in range(2) for n in range(3))])
    assert store.versions() == list(range(7))


def test_a_writer_redoes_its_merge_only_where_another_touched_its_buckets(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), buckets=64, attempts=1)
    store.merge(rows(spark, *(f"u{k}" for k in range(200))))
    base = store.manifest()
    where = {r.url: r.b for r in store.read().select("url", bucket_of("url", 64).alias("b")).collect()}
    other = next(u for u, b in where.items() if b != where["u0"])
    mine = store._write(rows(spark, "u0", score=5).withColumns({"nuevo": F.lit(False), "estado": F.lit("x")}), 64, {where["u0"]})
    store.set_state(other, "postulada")
    assert store._publish(base, mine, store.read().schema, None) == 2
    store.set_state("u0", "postulada")
    assert store._publish(base, mine, store.read().schema, None) is None
    monkey = BucketStore(spark, str(tmp_path), attempts=2)
    monkey._publish = lambda *_: None
    with pytest.raises(Conflict):
        monkey.merge(rows(spark, "u0"))


def test_old_versions_go_after_their_time(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), buckets=2)
    for k in range(3):
        store.merge(rows(spark, "a", "b", score=k))
    now = int(time.time() * 1000)
    assert store.vacuum(3_600_000, now) == [] and store.versions() == [0, 1, 2]
    gone = store.vacuum(1000, now + 60_000)
    assert {"m-000000000000.json", "m-000000000001.json"} <= set(gone) and sum(g.startswith("data/") for g in gone) == 2
    assert store.versions() == [2] and {s for _, s, *_ in held(store)} == {2}


def test_changes_between_versions(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), buckets=8)
    store.merge(rows(spark, "a", "b", "c", epoch=1))
    store.merge(rows(spark, "a", epoch=1).unionByName(rows(spark, "d", score=3, epoch=10**13)))
    store.set_state("b", "postulada")
    store.purge(10**12)
    got = {r.url: (r.old and (r.old.matchScore, r.old.estado), r.new and (r.new.matchScore, r.new.estado)) for r in store.changes(0).collect()}
    assert got == {"a": ((1, "pendiente"), None), "b": ((1, "pendiente"), (1, "postulada")), "c": ((1, "pendiente"), None), "d": (None, (3, "pendiente"))}
    assert store.changes(-1).count() == 2 and store.changes(store.version()).count() == 0


def test_merge_and_changes_shuffle_no_text_needlessly(spark, tmp_path):
    """Old and new rows met by URL in two more shuffles before they were dealt out; changes shuffled every text of both versions."""
    store = BucketStore(spark, str(tmp_path / "s"), buckets=4)
    text = lambda c: c * 500
    rows = lambda *r: spark.createDataFrame(r, "url string, descripcion string, matchScore int")
    store.merge(rows(("a", text("x"), 1), ("b", text("y"), 2), ("c", None, 3)))
    store.merge(rows(("a", text("x"), 1), ("b", text("z"), 2), ("c", "", 3)))
    stored = store.read()
    merged = upsert_dealt(stored, rows(("a", text("w"), 4)), functools.partial(dealt_out, buckets=4, touched={0, 1, 2, 3}))
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # Only nuevo differs in a; it does in all rows, so it is left out of the comparison.
    changes = store.changes(0, columns=["descripcion", "matchScore"])
    assert {r.url for r in changes.collect()} == {"b", "c"}
    plan = store.changes(0).select("url", "old.matchScore", "new.matchScore")._jdf.queryExecution().optimizedPlan().toString()
    above_files = plan[plan.index("Join") :]
    met = [line for line in above_files.splitlines() if "Project [url" in line]
    assert len(met) == 2 and all("sha2(" in line and "descripcion, descripcion" not in line for line in met)
