"""A streamed run: events, exactly one merge a batch, views after each batch."""

import time

from test_plans import AS_OF, SCHEMA, raw

from tamiz.plans import pipeline
from tamiz.plans.bucket_store import BucketStore
from tamiz.plans.live_views import LiveViews, counts_of
from tamiz.streaming import refresh
from tamiz.streaming.events import Progress, RunLog


def test_events_of_a_run(spark, tmp_path):
    raw(spark).where("item < 4").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    more = raw(spark).where("item >= 3").withColumn("url", pipeline.F.concat("url", pipeline.F.lit("z")))
    more.coalesce(1).write.parquet(str(tmp_path / "in/b"))
    store, log = BucketStore(spark, str(tmp_path / "store"), buckets=4), RunLog(spark, str(tmp_path / "events"))
    views, seen = LiveViews(store, str(tmp_path / "views"), shown=3), Progress()
    spark.streams.addListener(seen)
    try:
        query = refresh.start(spark, str(tmp_path / "in/*"), SCHEMA, store, str(tmp_path / "log"), AS_OF, 1, log, views)
        query.awaitTermination()
        for _ in range(50):
            if str(query.id) in seen.ended:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    assert seen.ended == {str(query.id): None} and seen.latest[str(query.id)][0] == 1
    assert seen.latest[str(query.id)][1] >= raw(spark).where("item < 4").count() + more.count()
    events = log.read().collect()
    assert {e.batch for e in events} == {0, 1}
    want = {}
    for part in (raw(spark).where("item < 4"), more):
        accepted, rejected = ([r.url for r in rows.select("url").collect()] for rows in pipeline.refresh(part, AS_OF))
        want[len(want)] = (len(accepted), len(rejected), sorted(accepted))
    got = {}
    for k in (0, 1):
        of = sorted((e for e in events if e.batch == k), key=lambda e: e.seq)
        assert of[-1].kind == "Finished" and [e.kind for e in of] == sorted((e.kind for e in of), key=["Status", "OfferFound", "Finished"].index)
        assert sum(e.discarded for e in of if e.kind == "Status") == of[-1].discarded
        got[k] = (of[-1].active, of[-1].discarded, sorted(e.url for e in of if e.kind == "OfferFound"))
    assert sorted(got.values()) == sorted(want.values())
    assert tuple(log.totals().first()) == tuple(sum(w[n] for w in want.values()) for n in (0, 1))
    assert {e.message for e in events if e.kind == "Finished"} == {"Listo: 1 vacantes · 2 descartadas", "Sin resultados. Descartadas: 5"}
    assert views.version() == store.version()
    assert sorted(map(tuple, views.counts().collect())) == sorted(map(tuple, counts_of(store.read()).collect()))


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store, log = BucketStore(spark, str(tmp_path / "store"), buckets=4), RunLog(spark, str(tmp_path / "events"))
    assert refresh.merge_bucketed(store, raw(spark), AS_OF, 0, log=log) == 0
    url = store.read().first().url
    store.set_state(url, "postulada")
    assert refresh.merge_bucketed(store, raw(spark), AS_OF, 0, log=log) == 1
    assert [(r.nuevo, r.estado) for r in store.read().collect()] == [(True, "postulada")]
    assert log.read().where("kind = 'Finished'").count() == 1
    assert refresh.merge_bucketed(store, raw(spark), AS_OF, 1) == 2
    assert [(r.nuevo, r.estado) for r in store.read().collect()] == [(False, "postulada")]
