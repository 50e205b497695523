"""The store's flat rows and back."""

from tamiz.plans import rows
from tamiz.plans.pipeline import STORE_COLUMNS


def test_flat_rows_and_back(spark):
    given = [("u", "t", ["a", "b"], "CALLAO", 3, None), (None, None, None, "?", None, 7.5), ("v", "x", [], None, 0, None)]
    flat = rows.to_stored(spark.createDataFrame(given, "url string, puesto string, beneficios array<string>, zona string, matchScore long, salarioMax double"))
    assert flat.columns == STORE_COLUMNS
    got = [(r.url, r.puesto, r.beneficios, r.zona, r.matchScore, r.salarioMax, r.estado, r.nuevo, r.regimenTrabajo, r.expTipo, r.fechaEpoch) for r in flat.collect()]
    assert got == [
        ("u", "t", "a|b", "CALLAO", 3, None, "pendiente", True, None, "NO_MENCIONADA", 0),
        ("", "", "", "DESCONOCIDA", 0, 7.5, "pendiente", True, None, "NO_MENCIONADA", 0),
        ("v", "x", "", "DESCONOCIDA", 0, None, "pendiente", True, None, "NO_MENCIONADA", 0),
    ]
    back = rows.to_offer(flat)
    assert "estado" not in back.columns and [r.beneficios for r in back.collect()] == [["a", "b"], [], []]
    odd = spark.createDataFrame([("a| |b|",), (" ",), (None,)], "s string").select(rows.benefit_list(rows.F.col("s")).alias("x"))
    assert [r.x for r in odd.collect()] == [["a", "b"], [], []]
