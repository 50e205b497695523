"""Product codes against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from tamiz.llm import segment_codes as sc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def brute(rows):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], l) for i, v, l, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return set()
    d = len(kept[0][1]) // 4
    part = lambda v, p: v[p * d : (p + 1) * d]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, [x / 1024 for x in r[1]]))[:256]
    books = [[part(v, p) for _, v, _ in start] for p in range(4)]
    assign = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(4):
        for p in range(4):
            of = [assign(v, p) for _, v, _ in kept]
            new = list(books[p])
            for e in set(of):
                own = [part(v, p) for (_, v, _), x in zip(kept, of) if x == e]
                new[e] = [sum(c) // len(own) for c in zip(*own)]
            books[p] = new
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        of = [assign(v, p) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for e in of), sum(far(part(v, p), books[p][e]) for p, e in enumerate(of)), label))
    total = {l: sum(e for _, _, e, m in out if m == l) for *_, l in out}
    return sorted((i, c, e, total[l], digest) for i, c, e, l in out)


def vectors(n, width, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width))
    rows = []
    for k in range(n):
        v = [float(np.float32(x)) for x in np.round(centres[k % 7] + rng.normal(size=width) * (k % 5) / 4, 3)]
        rows.append((k * 3 - 50, v, None if k % 11 == 0 else k % 4, "clash", None))
    odd = [None, [None] * width, [math.nan] + [0.0] * (width - 1), [0.0] * (width - 1) + [math.inf], [-math.inf] * width]
    return rows + [(10_000 + k, v, 1, "", "") for k, v in enumerate(odd)] + rows[:3] + [(-1, [0.0] * width, 9, "", ""), (-2, [-0.0005] * width, 9, "", "")]


@pytest.mark.parametrize("n, width", [(400, 16), (60, 4), (300, 24)])
def test_codes_equal_plain_loops(spark, n, width):
    rows = vectors(n, width)
    got = sc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_labels_may_be_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sc, "BROADCAST_LABELS", 0)
    rows = vectors(50, 8)
    assert sorted(map(tuple, sc.compress(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_no_rows_and_no_components(spark):
    empty = spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)
    assert sc.compress(empty).count() == 0 and sc.compress(empty.limit(0)).count() == 0
    bare = spark.createDataFrame([(1, [], 1, "", ""), (2, [], None, "", "")], SCHEMA)
    assert [tuple(r)[:4] for r in sc.compress(bare).orderBy("vec_id").collect()] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]


@pytest.mark.parametrize("second", [[1.0] * 8, [1e30] * 4])
def test_what_has_no_exact_distance_is_refused(spark, second):
    with pytest.raises(Exception, match="components"):
        sc.compress(spark.createDataFrame([(1, [1.0] * 4, 1, "", ""), (2, second, 1, "", "")], SCHEMA)).collect()
    with pytest.raises(ValueError, match="equal parts"):
        sc.compress(spark.createDataFrame([(1, [1.0] * 5, 1, "", "")], SCHEMA))


@pytest.mark.parametrize("d", [1, 2, 3, 5, 12, 16])
@pytest.mark.parametrize("scale", [1, 3, 300, 1 << 20, 1 << 24])
def test_bounds_never_drop_the_nearest(d, scale):
    rng = np.random.default_rng(d)
    x, book = rng.integers(-scale, scale + 1, (400, d)), rng.integers(-scale, scale + 1, (256, d))
    book[100:140], book[200], x[50:60] = x[:40], book[3], book[:10] + 1
    x[60], x[61] = scale, 0
    index, far = sc.nearest(x, sc.Segments(book))
    every = ((x[:, None] - book) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (far == every.min(1)).all()
