"""Views kept up from changes equal views made anew."""

import random

from tamiz.plans.bucket_store import BucketStore
from tamiz.plans.live_views import LiveViews, best_of, counts_of

SCHEMA = "url string, portal string, zona string, regimenTrabajo string, trabajoEnCampamento boolean, descripcion string, matchScore int, fechaEpoch long, arrival int"


def batch(spark, rng, n):
    day = 86_400_000
    rows = [(f"u{rng.randrange(60):02d}", rng.choice("abc"), rng.choice(["LIMA_PROVINCIAS", "CALLAO", "otra", None]), rng.choice([None, "14x7"]), rng.random() < 0.2, "x", rng.randrange(101), rng.randrange(90) * day, k) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_views_after_every_change(spark, tmp_path):
    rng = random.Random(5)
    store = BucketStore(spark, str(tmp_path / "store"), buckets=6)
    views = LiveViews(store, str(tmp_path / "views"), shown=5, reserve=4)
    assert views.refresh() == -1
    for k in range(10):
        store.merge(batch(spark, rng, rng.choice([0, 1, 8, 25])), order="arrival")
        for url in rng.sample(range(60), 1):
            store.set_state(f"u{url:02d}", rng.choice(["descartada", "postulada", "pendiente"]))
        if k == 4:
            store.purge(80 * 86_400_000)
        if k == 6:
            store.restore_discarded()
        if k == 8:
            store.clear()
        if k == 5:
            continue  # two batches at once
        assert views.refresh() == store.version() == views.version()
        assert sorted(map(tuple, views.counts().collect()), key=str) == sorted(map(tuple, counts_of(store.read()).collect()), key=str)
        assert list(map(tuple, views.best().collect())) == list(map(tuple, best_of(store.read(), 5).collect()))
    assert views.rebuilt < 9


def test_best_list_is_kept_without_the_store(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "store"), buckets=4)
    one = lambda *scores: spark.createDataFrame([(u, "a", "z", None, False, "x", s, 0) for u, s in scores], SCHEMA.rpartition(",")[0])
    store.merge(one(*((f"u{k}", k) for k in range(30))))
    views = LiveViews(store, str(tmp_path / "views"), shown=3, reserve=3)
    views.refresh()
    for change, want in [
        (lambda: store.set_state("u29", "descartada"), ["u28", "u27", "u26"]),
        (lambda: store.merge(one(("u5", 99), ("u0", 1))), ["u5", "u28", "u27"]),
        (lambda: store.merge(one(("u28", 0))), ["u5", "u27", "u26"]),
        (lambda: store.merge(one(("u27", 0), ("u99", 26))), ["u5", "u26", "u99"]),
    ]:
        change()
        views.refresh()
        assert [r.url for r in views.best().collect()] == want
    assert views.rebuilt == 1
    store.merge(one(("u26", 0), ("u99", 0), ("u5", 0), ("u25", 0), ("u24", 0)))
    views.refresh()
    assert [r.url for r in views.best().collect()] == ["u23", "u22", "u21"] and views.rebuilt == 2


def test_views_start_anew_where_their_version_is_gone(spark, tmp_path):
    rng = random.Random(2)
    store = BucketStore(spark, str(tmp_path / "store"), buckets=4)
    store.merge(batch(spark, rng, 20), order="arrival")
    views = LiveViews(store, str(tmp_path / "views"), shown=5)
    views.refresh()
    store.merge(batch(spark, rng, 20), order="arrival")
    store.vacuum(0, 1 << 60)
    assert views.refresh() == 1 and views.rebuilt == 2
    assert sorted(map(tuple, views.counts().collect()), key=str) == sorted(map(tuple, counts_of(store.read()).collect()), key=str)
