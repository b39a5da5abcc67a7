"""Numeric kernels against plain definitions and published values."""

import numpy as np

from tickloom.functions import kernels as N
from tickloom.functions.stats import f_tail, normal_tail, t_two_sided


def test_tails_against_tables():
    assert abs(normal_tail(1.959964) - 0.025) < 1e-6
    assert abs(t_two_sided(np.array([2.228]), np.array([10.0]))[0] - 0.05) < 1e-4
    assert abs(f_tail(np.array([4.964603]), 1.0, 10.0)[0] - 0.05) < 1e-6
    assert abs(f_tail(np.array([3.325835]), 5.0, 10.0)[0] - 0.05) < 1e-6


def test_response_surface_near_published_critical_values():
    for stat, p in ((-3.90, 0.01), (-3.34, 0.05), (-3.04, 0.10)):
        assert abs(N.engle_granger_p(stat) - p) < 0.003


def test_cointegration_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=600).cumsum()
    assert N.cointegration_p(2 * x + rng.normal(size=600), x) < 0.01
    assert N.cointegration_p(rng.normal(size=600).cumsum(), x) > 0.05


def test_granger_direction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = np.r_[0, x[:-1]] + 0.1 * rng.normal(size=500)
    assert N.granger_p(y, x, 2)[0] < 1e-6 and N.granger_p(x, y, 2)[0] > 0.01


def test_dtw_against_full_table():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=30), rng.normal(size=25)
    d = np.full((31, 26), np.inf)
    d[0, 0] = 0
    for i in range(1, 31):
        for j in range(1, 26):
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    assert abs(N.dtw_distance(a, b) - np.sqrt(d[-1, -1])) < 1e-12


def test_ward_and_peaks():
    x = np.array([1.0, 1.1, 5.0, 5.2, 9.0])
    assert N.ward_labels(np.abs(x[:, None] - x[None, :]), 3).tolist() == [1, 1, 2, 2, 3]
    s = np.array([0, 2, 1, 3, 3, 0, 1, 0.5, 4, 0], dtype=float)
    assert N.local_maxima(s).tolist() == [1, 3, 6, 8]
    assert N.find_peaks(s, 1.0, 3).tolist() == [3, 8]
    assert N.find_peaks(s, 0.6, 1).tolist() == [1, 3, 8]
