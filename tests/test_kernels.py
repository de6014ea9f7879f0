"""Kernels against their definitions or known values."""

import math

import numpy as np
import pytest

from tideframe.functions import catch22, kernels
from tideframe.operators import matrix, series

RNG = np.random.default_rng(11)
X = RNG.normal(size=300)
WALK = np.cumsum(RNG.normal(size=400))


def test_entropies():
    assert kernels.sample_entropy(np.sin(np.arange(400) / 5)) < kernels.sample_entropy(X)
    assert kernels.approximate_entropy(np.tile([1.0, 2.0], 100)) == pytest.approx(0, abs=1e-2)
    assert kernels.lempel_ziv_complexity(np.array([0, 1, 0, 1, 0, 1, 0, 1.0]), 0.5, False) == 4
    assert kernels.binned_entropy(np.repeat([0.0, 1.0], 50), 2) == pytest.approx(math.log(2))


def test_unit_root_and_autoregression():
    assert kernels.augmented_dickey_fuller(X) < -5 < kernels.augmented_dickey_fuller(WALK)
    y = np.zeros(3000)
    e = np.random.default_rng(0).normal(size=3000)
    for t in range(1, 3000):
        y[t] = 0.6 * y[t - 1] + e[t]
    assert kernels.autoregressive_coefficients(y, 1)[0] == pytest.approx(0.6, abs=0.05)
    assert kernels.gph(WALK)[0] == pytest.approx(1, abs=0.5) and abs(kernels.local_whittle(X)) < 0.3


def test_bsadf_equals_all_windows():
    x = WALK[:40]
    got = kernels.bsadf(x, 10)
    for t in range(9, 40):
        assert got[t] == pytest.approx(max(kernels.augmented_dickey_fuller(x[s : t + 1], 0) for s in range(t - 8)), rel=1e-6)


def test_focus_equals_all_change_points():
    z = np.concatenate((X[:40], X[40:80] + 1.5))
    got, s = kernels.focus(z), np.concatenate(([0], np.cumsum(z)))
    for t in range(1, 81):
        assert got[t - 1] == pytest.approx(max((s[t] - s[k]) ** 2 / (t - k) / 2 for k in range(t)))


def test_spectra():
    x = np.sin(2 * np.pi * 0.125 * np.arange(1024))
    f, p = kernels.welch_density(x)
    assert f[p.argmax()] == pytest.approx(0.125)
    assert kernels.fft_coefficients(x)["abs"].argmax() == 128
    assert kernels.ricker(101, 4.0).sum() == pytest.approx(0, abs=1e-3)
    assert kernels.cwt_coefficients(x).shape == (4, 14)


def test_tails():
    pareto = np.random.default_rng(2).pareto(3, 20000) + 1
    assert kernels.hill_index(pareto, 500, "upper") == pytest.approx(3, rel=0.2)
    xi, *_ = kernels.gpd_fit(pareto, 0.9, "upper")
    assert xi == pytest.approx(1 / 3, abs=0.1)
    var, es = kernels.pot_var_es(pareto, 0.99, 0.9, "upper")
    assert var == pytest.approx(np.quantile(pareto, 0.99), rel=0.05) and es > var


def test_dependence():
    y = X**2
    assert kernels.pearson(X, 2 * X + 1) == pytest.approx(1)
    assert kernels.spearman(X, np.exp(X)) == pytest.approx(1)
    assert kernels.kendall(X, -X) == pytest.approx(-1)
    assert kernels.xi(X, y) > 0.8 > abs(kernels.pearson(X, y))
    z = np.random.default_rng(5).normal(size=300)
    for f in (kernels.hoeffding, kernels.distance_correlation, kernels.hsic, kernels.gcmi):
        assert f(X, X + 0.1 * z) > 5 * abs(f(X, z))
    assert kernels.normal_quantile(np.array([0.025, 0.5, 0.999])) == pytest.approx([-1.959964, 0, 3.090232], abs=1e-5)
    assert kernels.tail_dependence(X, X) == 1


def test_shapes():
    a = np.sin(np.arange(60) / 6)
    d, _ = kernels.sbd(a, np.roll(a, 5))
    assert d < 0.15
    rows = np.stack([np.sin(np.arange(60) / 6 + s) for s in (0, 0.1, 0.2)] + [np.sign(np.sin(np.arange(60) / 2 + s)) for s in (0, 0.1, 0.2)])
    label, _ = kernels.kshape(rows, 2, seed=1)
    assert len(set(label[:3])) == len(set(label[3:])) == 1 and label[0] != label[3]


def test_catch22():
    got = catch22.catch22_all(X, catch24=True)
    assert len(got) == 24 and all(np.isfinite(v) for v in got.values())
    assert got["DN_Mean"] == pytest.approx(X.mean())
    z = (X - X.mean()) / X.std(ddof=1)
    assert got["CO_trev_1_num"] == pytest.approx((np.diff(z) ** 3).mean())
    assert all(math.isnan(v) for v in catch22.catch22_all(np.array([1.0]), names=["CO_trev_1_num"]).values())


def test_matrix(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + 100
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    cov, m = matrix.covariance(df, ["a", "b", "c", "d"])
    np.testing.assert_allclose(cov, np.cov(x, rowvar=False), rtol=1e-9)
    for method in ("lw_identity", "lw_diagonal", "lw_constant_correlation", "oas", "mp_clip"):
        w = np.linalg.eigvalsh(matrix.covariance(df, m.names, method)[0])
        assert (w > -1e-9).all()
    s = np.cov(x, rowvar=False, ddof=0)
    z = x - x.mean(0)
    want = np.mean([((np.outer(r, r) - s) ** 2).sum() for r in z])
    assert matrix.fourth_moment(df, matrix.Moments(m.names, 500, x.mean(0), s)) == pytest.approx(want)
    p = matrix.pca(df, m.names, 2)
    scores = np.array([(r.pc1, r.pc2) for r in p.transform(df).collect()])
    assert np.var(scores[:, 0], ddof=1) == pytest.approx(p.eigenvalues[0])
    assert matrix.select_mrmr(m, "a", 1) == [max("bcd", key=lambda k: abs(np.corrcoef(x.T)[0, "abcd".index(k)]))]
    assert len(matrix.pivoted_columns(m, 3)) == 3 and len(matrix.select_pfa(m, 2)) == 2


def test_rolling_and_per_entity(spark):
    df = spark.createDataFrame([("a", i, float(v), float(v) ** 2) for i, v in enumerate(X[:60])] + [("b", 0, 1.0, None)], "e string, t long, x double, y double")
    got = {r.t: r.v for r in series.rolling_dependence(df.where("e = 'a'"), "e", "t", "x", "y", 20, "xi", "v").collect()}
    assert got[18] is None and got[30] == pytest.approx(kernels.xi(X[11:31], X[11:31] ** 2))
    one = {r.e: r.pearson for r in series.dependence(df, "e", ["t"], "x", "y", ["pearson"]).collect()}
    assert one["a"] == pytest.approx(kernels.pearson(X[:60], X[:60] ** 2)) and one["b"] is None


def test_kshape_labels_every_entity(spark):
    import numpy as np

    from tideframe.operators import series

    rng = np.random.default_rng(0)
    rows = []
    for e in range(24):
        n = 90 if e % 3 else 20  # some are shorter than the points
        t = np.linspace(0, 1, n)
        y = np.sin(2 * np.pi * 2 * t) if e % 2 else np.where(t < 0.5, t, -t)
        rows += [(e, i, float(v)) for i, v in enumerate(y + rng.normal(0, 0.05, n))]
    rows += [(100, i, 1.0) for i in range(9)] + [(101, 0, None)]
    got = {r.entity: r.cluster for r in series.kshape(spark.createDataFrame(rows, "entity long, time long, x double"), "entity", "time", "x", 2, 32).collect()}
    assert got[100] is None and got[101] is None and len(got) == 26
    assert len({got[e] for e in range(0, 24, 2)}) == 1 and len({got[e] for e in range(1, 24, 2)}) == 1 and got[0] != got[1]
