"""Forecast reduction, embeddings and sampling against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.operators import embed, forecast, labels, sampling
from tideframe.sources.tables import generate_panel


@pytest.fixture(scope="module")
def panel(spark):
    return generate_panel(spark, 5, 60, seed=9, signal=True).withColumn("time", F.col("time").cast("long")).cache()


def test_recursive_forecast_equals_numpy(panel):
    f = forecast.LagForecaster("entity", "time", "value", 3).fit(panel)
    got = {(r.entity, r.step): r.yhat for r in f.predict(4).collect()}
    pdf = panel.toPandas().sort_values(["entity", "time"])
    rows = [(g.value.to_numpy()[t - 3 : t][::-1], g.value.to_numpy()[t]) for _, g in pdf.groupby("entity") for t in range(3, 60)]
    a = np.column_stack((np.ones(len(rows)), np.array([r[0] for r in rows])))
    b = np.linalg.lstsq(a, np.array([r[1] for r in rows]), rcond=None)[0]
    for e, g in pdf.groupby("entity"):
        lag = list(g.value.to_numpy()[-3:][::-1])
        for s in range(1, 5):
            v = b[0] + np.dot(b[1:], lag)
            assert got[e, s] == pytest.approx(v)
            lag = [v, *lag[:-1]]


def test_direct_by_entity_and_backtest(panel):
    make = lambda: forecast.LagForecaster("entity", "time", "value", 2, "direct", 2, ridge=0.1, by_entity=True)
    assert make().fit(panel).predict().count() == 10
    bt = forecast.backtest(panel, "entity", "time", "value", make, [40, 50], 2)
    assert bt.count() == 20 and bt.where("actual is null").count() == 0
    out = forecast.intervals(make().fit(panel).predict(), bt, "entity", [0.1, 0.9])
    assert out.count() == 20 and {r.quantile for r in out.collect()} == {10, 90}
    assert forecast.ensemble([make().fit(panel).predict(), make().fit(panel).predict()], "entity").count() == 10
    assert forecast.zero_inflated(panel, "entity", "time", "value", 2, 2).count() == 10


def test_embeddings(panel):
    e = embed.as_embedding(panel, ["value", "signal"], "v")
    assert embed.explode_embedding(e, "v", 2).columns[-2:] == ["v_0", "v_1"]
    x = np.random.default_rng(0).normal(size=(200, 48))
    for name, f in embed.COMPRESSORS.items():
        assert f(x, 16, 0).shape == (200, 16), name
    d = np.linalg.norm(x[:, None] - x[None], axis=2)[np.triu_indices(200, 1)]
    for f in (embed.COMPRESSORS["srp"], embed.srht):
        z = f(x, 256, 0) if f is not embed.srht else embed.srht(x, 48, 0)
        r = np.linalg.norm(z[:, None] - z[None], axis=2)[np.triu_indices(200, 1)] / d
        assert r.mean() == pytest.approx(1, abs=0.15)
    np.testing.assert_allclose(embed.fwht(np.eye(4))[1], [1, -1, 1, -1])
    out = embed.compress(e, "v", 4, "count_sketch", out="c").select("c").first().c
    assert len(out) == 4


def test_windows(panel):
    pdf = panel.where("entity = 'e000001'").toPandas().sort_values("time")
    x = pdf.value.to_numpy()
    row = lambda df, c: df.where("entity = 'e000001' and time = 20").first()[c]
    np.testing.assert_allclose(row(embed.delay(panel, "entity", "time", "value", 3, 2), "value_delay"), x[[20, 18, 16]])
    np.testing.assert_allclose(row(embed.paa(panel, "entity", "time", "value", 6, 3), "value_paa"), x[15:21].reshape(3, 2).mean(1))
    w = x[5:21]
    np.testing.assert_allclose(row(embed.spectral(panel, "entity", "time", "value", 16, 4), "value_spectral"), np.abs(np.fft.rfft(w - w.mean()))[1:5] / 16)
    assert embed.paa(panel, "entity", "time", "value", 6, 3).where("time < 5 and value_paa is not null").count() == 0


def test_frequent_directions(panel):
    df = panel.withColumn("c", F.col("value") + F.col("signal"))
    s = embed.frequent_directions(df, ["value", "signal", "c"], 3)
    x = df.select("value", "signal", "c").toPandas().to_numpy()
    assert np.linalg.norm(x.T @ x - s.T @ s, 2) <= np.linalg.norm(x, "fro") ** 2 / 3 + 1e-9


def test_tucker():
    t = np.einsum("i,j,k->ijk", np.arange(1.0, 4), np.arange(1.0, 5), np.arange(1.0, 6))
    core, u = embed.tucker(t, (1, 1, 1))
    back = np.einsum("abc,ia,jb,kc->ijk", core, *u)
    np.testing.assert_allclose(back, t, atol=1e-9)


def test_sequential_bootstrap(panel):
    start, end = np.array([0, 0, 0, 10]), np.array([5, 5, 5, 12])
    n = np.bincount(sampling.sequential_draws(start, end, 4000, 1), minlength=4)
    assert n[3] > 1.5 * n[:3].mean()
    df = labels.forward_return(panel.withColumn("p", F.exp("value")), "entity", "time", "p", horizon=5, end_time="t1")
    out = sampling.sequential_bootstrap(df, "entity", "time")
    assert out.agg(F.sum("n_drawn")).first()[0] == df.where("t1 is not null").count()


def test_fold_weights_and_nulls(panel):
    df = labels.forward_return(panel.withColumn("p", F.exp("value")), "entity", "time", "p", horizon=5, end_time="t1")
    w = sampling.fold_weights(df, "entity", "time", list(range(30)), price="p", decay=0.5)
    assert w.count() == 150 and w.agg(F.avg("weight")).first()[0] == pytest.approx(1)
    a = sampling.null_panel(panel, ["value"], "entity", "time")
    assert a.join(panel.select("entity", "time", F.col("value").alias("b")), ["entity", "time"]).where("abs(abs(value) - abs(b)) > 1e-12").count() == 0
    b = sampling.null_panel(panel, ["value"], "entity", "time", "shift", seed=3)
    assert b.count() == panel.count() and b.agg(F.sum("value")).first()[0] == pytest.approx(panel.agg(F.sum("value")).first()[0])
