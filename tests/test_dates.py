"""Ages from odd texts: none of them stops a job."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tamiz.functions import dates

AS_OF = "2026-07-20 12:00:00"
NOW = int(datetime(2026, 7, 20, 12, tzinfo=timezone.utc).timestamp() * 1000)
ODD = {
    "Ref 20260715 verano": 20260715 * 365 if 20260715 * 365 < 2**31 else None,
    "hace 999999999 anos": None,
    "hace 99999999999 dias": None,
    "hace 2147483647 dias": 2147483647,
    "hace 2147483648 dias": None,
    "hace 300000000 semanas": 2100000000,
    "1784246400000000000": None,
    "9223372036854775807": None,
    "9223372036854775808": None,
    "-9223372036854775808": None,
    "+1784246400": 3,
    "1784246400000.5": None,
    "17842464": None,
    "0": None,
    "9999-12-31": None,
    "0000-00-00": None,
    "2026-02-30": None,
    "99/99/9999": None,
    "1e999 dias": 1,
    "٣ dias": None,
    "hace dias": None,
    "4102444800000": (NOW - 4102444800000) // -86400000 * -1 if NOW > 4102444800000 else -((4102444800000 - NOW) // 86400000),
    "2026-07-25": None,
    "  ": None,
}


def test_odd_dates_give_null_or_a_number(spark):
    rows = spark.createDataFrame([(t,) for t in ODD] + [(None,)], "t string").select("t", dates.days_since("t", F.lit(AS_OF).cast("timestamp")).alias("n"), dates.epoch_of("t", F.lit(AS_OF).cast("timestamp")).alias("e"))
    got = {r.t: (r.n, r.e) for r in rows.collect()}
    assert {t: n for t, (n, _) in got.items()} == ODD | {None: None}
    assert all(e == (0 if n is None else NOW - n * 86400000) for n, e in got.values())
