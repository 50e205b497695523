"""The fitted models against plain ways of reaching the same optimum."""

import itertools

import numpy as np

from tamiz.llm import language_mixture, nbsvm


def settled(p, count, rounds=3000):
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = share * ((count / (p @ share)) @ p) / count.sum()
    return share, float(count @ np.log(p @ share))


def test_mixtures_equal_all_subsets():
    rng = np.random.default_rng(3)
    for case in range(60):
        p = rng.dirichlet(np.full(80, 0.3), 3).T + 1e-4
        p /= p.sum(axis=0)
        share = rng.permutation([(1, 0, 0), (0.7, 0.3, 0), (0.5, 0.3, 0.2)][case % 3])
        count = rng.multinomial(1500, p @ share).astype(float)
        need = language_mixture.OVERLAP * language_mixture.PENALTY * np.log(2 + count.sum() / language_mixture.OVERLAP)
        subsets = [list(s) for k in (1, 2, 3) for s in itertools.combinations(range(3), k)]
        best = max(subsets, key=lambda s: settled(p[:, s], count)[1] - need * len(s))
        want = settled(p[:, best], count)[0]
        chosen, got = language_mixture.infer(p[count > 0], count[count > 0])
        assert sorted(chosen) == best and chosen[0] == best[int(np.argmax(want))]
        assert np.abs(got - np.sort(want)[::-1]).max() < 0.01


def test_descent_reaches_the_optimum_of_a_dense_solver(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(60, 12, replace=False)) for _ in range(50)]
    y = np.where(rng.random(50) < 0.6, 1.0, -1.0)
    scaled = rng.normal(size=nbsvm.BUCKETS)
    norm = np.array([np.sqrt(np.square(scaled[r]).sum()) for r in rows])
    cost = np.where(y == 1, 1.0, 1.3)
    x = np.zeros((50, 61))
    for i, r in enumerate(rows):
        x[i, r] = scaled[r] / norm[i]
    x[:, 60] = 1  # the bias
    z = x * y[:, None]
    alpha = np.zeros(50)
    step = 1 / np.linalg.eigvalsh(z @ z.T).max()
    for _ in range(40_000):  # projected gradient on the dual
        alpha = np.clip(alpha + step * (1 - z @ (z.T @ alpha)), 0, cost)
    loss = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - z @ w)
    want = loss(z.T @ alpha)
    own = lambda w: loss(np.append(w[:60], w[-1]))
    assert own(nbsvm.dual_descent(rows, scaled, norm, y, cost)) < 1.05 * want
    monkeypatch.setattr(nbsvm, "EPOCHS", 2000)
    monkeypatch.setattr(nbsvm, "TOLERANCE", 1e-10)
    w = nbsvm.dual_descent(rows, scaled, norm, y, cost)
    assert abs(own(w) - want) < 1e-4 * want and not w[60:-1].any()


def test_ratio_equals_counting():
    rows, label = [np.array([1, 2]), np.array([2, 3]), np.array([3])], np.array([1, 0, 1])
    got = nbsvm.log_count_ratio(rows, label)
    p, q = np.ones(nbsvm.BUCKETS), np.ones(nbsvm.BUCKETS)
    for r, side in zip(rows, (p, q, p)):
        for b in r:
            side[b] += 1
    assert np.allclose(got, np.log(p / p.sum()) - np.log(q / q.sum()))


def test_too_many_languages_are_refused_before_texts_are_read(spark):
    import pytest

    from tamiz.llm.language_mixture import language_mixture

    docs = spark.createDataFrame([(k, f"text {k}", f"lang{k}") for k in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 5 languages"):
        language_mixture(docs, most_languages=5)
    assert language_mixture(docs, most_languages=30).count() == 30
