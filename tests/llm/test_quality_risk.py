"""The risks of operator 1 from sums against literal sums over rows, and its estimate of the prior."""

import numpy as np
import pytest

from penmark.llm import quality

PRIOR = 0.6


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    good, bad, more = (rng.normal(m, 1, (k, 3)) for m, k in ((1.5, 900), (-1.5, 600), (1.5, 400)))
    x = np.concatenate([good, bad, more])
    trusted = np.arange(len(x)) >= 1500
    return np.column_stack([x, np.ones(len(x))]), trusted


def _literal(loss, z, trusted, prior):
    """Risk of negatives and of positives, row by row."""
    u = sum(loss(v, -1) for v in z) / len(z)
    p = [(loss(v, 1), loss(v, -1)) for v in z[trusted]]
    return u - prior * sum(b for _, b in p) / len(p), prior * sum(a for a, _ in p) / len(p)


def _slope(risk, w):
    step = 1e-6
    return np.array([[(a - b) / (2 * step) for a, b in zip(risk(w + step * e), risk(w - step * e))] for e in np.eye(len(w))]).T


def test_squared_risk_from_moments(rows):
    x, trusted = rows
    n = x.shape[1]
    u, p = quality.moments(x, trusted).reshape(2, n, n) / np.array([len(x), trusted.sum()])[:, None, None]
    w = np.array([0.3, -0.2, 0.5, 0.1])

    def literal(v):
        return _literal(lambda z, y: (1 - y * z) ** 2 / 4, x @ v, trusted, PRIOR)

    negative, down, rest = quality.squared_risk(w, u, p, PRIOR)
    assert negative == pytest.approx(literal(w)[0], abs=1e-12)
    assert np.allclose([down, rest], _slope(literal, w), atol=1e-6)


def test_logistic_risk_from_histograms(rows):
    x, trusted = rows
    margin = x @ np.array([0.3, 0.1, 0.2, 0.0])
    u, p = quality.histograms(margin, trusted).reshape(2, -1) / np.array([len(x), trusted.sum()])[:, None]
    assert u.sum() == pytest.approx(1) and p.sum() == pytest.approx(1)
    curve = np.array([1.7, -0.4])

    def literal(c):
        return _literal(lambda z, y: np.log1p(np.exp(-y * z)), c[0] * np.clip(margin, -quality.MARGIN, quality.MARGIN) + c[1], trusted, PRIOR)

    negative, down, rest = quality.logistic_risk(curve, u, p, PRIOR)
    assert negative == pytest.approx(literal(curve)[0], abs=1e-3)  # bins are 0.003 wide
    assert np.allclose([down, rest], _slope(literal, curve), atol=2e-3)


def test_negative_risk_is_climbed():
    def parts(w):  # risk of negatives w - 1 falls below zero at once; the rest would pull on
        return float(w[0] - 1), np.array([1.0]), np.array([5.0])

    assert abs(quality._minimised(parts, np.array([0.0]), 3000, 0.01)[0] - 1) < 0.1


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_of_a_mixture(share):
    rng = np.random.default_rng(11)
    n = 20_000
    good = rng.random(n) < share
    margin = np.concatenate([np.where(good, rng.normal(1.2, 0.4, n), rng.normal(-1.2, 0.4, n)), rng.normal(1.2, 0.4, 3000)])
    trusted = np.arange(len(margin)) >= n
    u = quality.histograms(margin[:n], trusted[:n]).reshape(2, -1)[0] / n
    p = quality.histograms(margin, trusted).reshape(2, -1)[1] / 3000
    assert quality.estimated_prior(u, p, n, 3000) == pytest.approx(share, abs=0.04)


def test_totals_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    x = rng.random((60, quality.N_FEATURES))
    df = spark.createDataFrame([(i % 3 == 0, list(map(float, r))) for i, r in enumerate(x)], "trusted boolean, x array<float>")
    want = np.append(x.sum(axis=0), 20)
    for parts in (1, 7, 100):  # with empty partitions too
        got = quality._totals(df.repartition(parts), quality.N_FEATURES + 1, lambda v, t: np.append(v.sum(axis=0), t.sum()))
        assert np.allclose(got, want, atol=1e-4)
    assert quality.fit(df.limit(0)) is None and quality.fit(df.where("NOT trusted")) is None
    # one trusted row alone, and equal rows, give a model all the same
    assert 0 <= quality.fit(df.limit(1))[0].score(x).min() <= 1
