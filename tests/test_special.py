"""Special functions against closed forms and exact fractions."""

import math

import numpy as np
import pytest

from abundix.functions import special


def test_gamma_family():
    x = np.array([0.5, 1.0, 2.5, 7.0, 40.0])
    assert np.allclose(special.lgamma(x, np.log), [math.lgamma(v) for v in x], atol=1e-12)
    assert special.digamma(np.array([1.0]), np.log)[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert special.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, abs=1e-12)
    assert special.trigamma(np.array([0.5]))[0] == pytest.approx(math.pi**2 / 2, abs=1e-12)
    h = 1e-5
    slope = (special.trigamma(x + h) - special.trigamma(x - h)) / (2 * h)
    assert np.allclose(special.tetragamma(x), slope, rtol=1e-6)


def test_inverse_trigamma():
    x = np.array([1e-3, 0.2, 1.0, 3.0, 50.0, 1e4])
    assert np.allclose(special.solve_trigamma(special.trigamma(x)), x, rtol=1e-8)


def test_t_tail():
    t = np.array([0.0, 1.0, 2.0, 12.706204736432095, 1.0, -2.0, 50.0, np.nan])
    df = np.array([3.0, 1.0, 2.0, 1.0, np.inf, 2.0, 30.0, 3.0])
    p = special.t_two_sided(t, df)
    assert p[0] == 1.0
    assert p[1] == pytest.approx(0.5)
    assert p[2] == pytest.approx(1 - 2 / math.sqrt(6))
    assert p[3] == pytest.approx(0.05)
    assert p[4] == pytest.approx(math.erfc(1 / math.sqrt(2)))
    assert p[5] == p[2]
    assert 0 < p[6] < 1e-28
    assert np.isnan(p[7])


def test_hypergeometric():
    cases = [(k, n, m, total) for total in (1, 12, 60) for n in range(0, total + 1, 7) for m in range(0, total + 1, 5) for k in range(0, n + 2)]
    k, n, m, total = (np.array(c, dtype=float) for c in zip(*cases))
    got = special.hypergeometric_upper(k, n, m, total)
    for value, (a, b, c, d) in zip(got, cases):
        exact = sum(math.comb(c, i) * math.comb(d - c, b - i) for i in range(a, min(b, c) + 1) if b - i <= d - c) / math.comb(d, b)
        assert value == pytest.approx(exact, rel=1e-8, abs=1e-12)
