"""Tests and statistics by windows and aggregations, held against their definitions over arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.functions import inference as kernels
from tideframe.operators import inference as inf
from tideframe.operators import splits


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    return {e: rng.normal(size=(n, 3)).cumsum(axis=0) * 0.1 + rng.normal(size=(n, 3)) for e, n in (("a", 60), ("b", 41))}


@pytest.fixture(scope="module")
def panel(spark, table):
    rows = [(e, t, *map(float, r)) for e, m in table.items() for t, r in enumerate(m)]
    rows += [("a", 1000, None, 1.0, 1.0), ("a", 1001, math.nan, 1.0, 1.0), ("flat", 0, 1.0, 1.0, 1.0), ("flat", 1, 1.0, 1.0, 1.0), ("none", 0, None, None, None)]
    return spark.createDataFrame(rows, "e string, t long, y double, f double, g double").repartition(5)


def results(df):
    return {r.e: r for r in df.collect()}


def test_normal_cdf(spark):
    xs = [-40.0, -8.0, -7.08, -7.0, -1.5, -1e-9, 0.0, 0.3, 1.96, 6.0, 7.1, 12.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(inf.normal_cdf(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rtol=1e-9, atol=1e-15)


def test_tests_of_forecasts(panel, table):
    losses = panel.withColumns({"a": F.pow(F.col("y") - F.col("f"), 2), "b": F.pow(F.col("y") - F.col("g"), 2)})
    got = {
        "dm": results(inf.diebold_mariano_test(losses, "e", "t", "a", "b", 3)),
        "cw": results(inf.clark_west_test(panel, "e", "t", "y", "f", "g", 2)),
        "enc": results(inf.encompassing_test(panel, "e", "t", "y", "f", "g", 2)),
        "pt": results(inf.pesaran_timmermann_test(panel, "e", "y", "f")),
        "r2": results(inf.oos_r2(panel, "e", "y", "f", "g")),
        "nw": results(inf.newey_west_variance(panel, "e", "t", "y", 4)),
    }
    for e, m in table.items():
        y, f, g = m.T
        assert got["dm"][e].statistic == pytest.approx(kernels.diebold_mariano((y - f) ** 2, (y - g) ** 2, 3).statistic)
        for name, want in (("cw", kernels.clark_west(y, f, g, 2)), ("enc", kernels.encompassing(y, f, g, 2)), ("pt", kernels.pesaran_timmermann(y, f))):
            assert got[name][e].statistic == pytest.approx(want.statistic)
            assert got[name][e].estimate == pytest.approx(want.estimate)
        assert got["cw"][e].pvalue == pytest.approx(kernels.clark_west(y, f, g, 2).pvalue)
        assert got["r2"][e].oos_r2 == pytest.approx(kernels.oos_r2(y, f, g))
        assert got["nw"][e].variance == pytest.approx(kernels.newey_west(y, 4))
        assert got["nw"][e].n == len(y)
    assert got["dm"]["flat"].statistic is None
    assert "none" not in got["nw"]


def test_value_at_risk_and_sharpe(panel, table):
    both = results(inf.var_backtest(panel, "e", "t", "y", "f", 0.3))
    sharpe = results(inf.sharpe_ratio_test(panel, "e", "t", "y", 0.1, 3))
    psr = results(inf.probabilistic_sharpe_ratio(panel, "e", "y", -0.5))
    for e, m in table.items():
        hits = m[:, 0] < m[:, 1]
        uc, cc, ind = kernels.kupiec(hits, 0.3), kernels.christoffersen(hits, 0.3), kernels.christoffersen(hits, 0.3, "independence")
        assert (both[e].lr_uc, both[e].lr_ind, both[e].lr_cc) == pytest.approx((uc.statistic, ind.statistic, cc.statistic))
        assert (both[e].p_uc, both[e].p_ind, both[e].p_cc) == pytest.approx((uc.pvalue, ind.pvalue, cc.pvalue))
        y = m[:, 0]
        sr, z = y.mean() / y.std(ddof=1), (y - y.mean()) / y.std(ddof=1)
        psi = z - sr / 2 * (z * z - 1)
        assert sharpe[e].statistic == pytest.approx((sr - 0.1) / math.sqrt(kernels.newey_west(psi, 3) / len(y)))
        c = (y - y.mean()) / y.std()
        if sr > -0.5:
            want = kernels.minimum_track_record(sr, -0.5, 0.95, (c**3).mean(), (c**4).mean())
            assert psr[e].min_track_record == pytest.approx(want, rel=1e-6)
    assert both["flat"].hits == 0
    assert sharpe["flat"].statistic is None


def test_kpss_and_nexcp(panel, table):
    got, radius = results(inf.kpss(panel, "e", "t", "y", 5)), results(inf.nexcp_quantile(panel.withColumn("s", F.abs("y")), "e", "t", "s"))
    for e, m in table.items():
        y = m[:, 0]
        c = y - y.mean()
        assert got[e].statistic == pytest.approx((c.cumsum() ** 2).sum() / len(y) ** 2 / kernels.newey_west(y, 5))
        assert radius[e].radius == pytest.approx(kernels.nexcp_quantile(np.abs(y)))
    assert got["flat"].statistic is None


def test_wasserstein_and_gamma(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 12) * 1.0, rng.integers(0, 9, 7) * 1.0
    df = spark.createDataFrame([(t, float(v)) for t, xs in ((3, a), (8, b)) for v in xs] + [(8, None)], "t long, v double")
    grid = np.arange(0, 9)
    want = sum(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert {r.t: r.xs_w1 for r in inf.xs_wasserstein(df, "t", "v").collect()} == {3: None, 8: pytest.approx(want)}
    r, m, v = rng.normal(size=15), rng.normal(size=15), rng.uniform(1, 5, 15)
    df = spark.createDataFrame([("a", t, float(r[t]), float(m[t]), float(v[t])) for t in range(15)], "e string, t long, r double, m double, v double")
    got = inf.pastor_stambaugh_gamma(df, "e", "t", "r", "m", "v", 10, 1.0).orderBy("t").collect()
    e = r - m
    x = np.column_stack((np.ones(10), r[4:14], np.sign(e[4:14]) * v[4:14]))
    assert got[14].gamma == pytest.approx(np.linalg.lstsq(x, e[5:15], rcond=None)[0][2])
    assert got[9].gamma is None and got[10].gamma is not None


def test_unit_root_and_efficiency(panel, table):
    pp, mz = results(inf.phillips_perron(panel, "e", "t", "y", 4)), results(inf.mincer_zarnowitz_test(panel, "e", "y", "f"))
    for e, m in table.items():
        y, f = m[:, 0], m[:, 1]
        x = np.column_stack((y[:-1], np.ones(len(y) - 1)))
        b = np.linalg.lstsq(x, y[1:], rcond=None)[0]
        u, n = y[1:] - x @ b, len(y) - 1
        g, lam, s = u @ u / n, kernels.newey_west(u, 4), math.sqrt(u @ u / (n - 2))
        se = s * math.sqrt(np.linalg.inv(x.T @ x)[0, 0])
        assert pp[e].statistic == pytest.approx(math.sqrt(g / lam) * (b[0] - 1) / se - (lam - g) * n * se / (2 * math.sqrt(lam) * s))
        want = kernels.mincer_zarnowitz(y, f)
        assert (mz[e].statistic, mz[e].pvalue) == pytest.approx((want.statistic, want.pvalue))
    assert mz["flat"].statistic is None and pp["flat"].statistic is None


def test_splits(spark):
    df = spark.createDataFrame([("a", t) for t in range(10)] + [("b", 0), ("b", 1)], "e string, t long")
    test = splits.train_test_split(df, "e", "t", 0.25).where("is_test").collect()
    assert sorted((r.e, r.t) for r in test) == [("a", 7), ("a", 8), ("a", 9), ("b", 1)]
    got = splits.sliding_window_split(df, "e", "t", 2, 2, 3, 4).collect()
    side = lambda s, flag: sorted(r.t for r in got if (r.e, r.split, r.is_test) == ("a", s, flag))
    assert (side(1, False), side(1, True)) == ([1, 2, 3, 4], [5, 6])
    assert (side(2, False), side(2, True)) == ([4, 5, 6, 7], [8, 9])
    assert sorted((r.split, r.t, r.is_test) for r in got if r.e == "b") == [(2, 0, True), (2, 1, True)]
    wide = splits.expanding_window_split(df, "e", "t", 2, 2, 3).where("e = 'a' and split = 2 and not is_test").count()
    assert wide == 8
