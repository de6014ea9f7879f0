"""Operators that SQL cannot express, traps of null and tie handling, and the golden as-of case."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.functions.core import entity_window, ffd_weights, normal_cdf
from tideframe.operators import alpha, asof, bars, clean, econ, evaluation, labels, preprocess, quality, rolling, transform, xs
from tideframe.panel import PanelFrame, as_panel
from tideframe.sources.tables import generate_panel


@pytest.fixture(scope="module")
def panel(spark):
    return generate_panel(spark, 6, 40, seed=3, signal=True).withColumn("time", F.col("time").cast("long")).cache()


def series(df, column):
    pdf = df.toPandas().sort_values(["entity", "time"])
    return {e: g[column].to_numpy(dtype=float) for e, g in pdf.groupby("entity")}


def test_panel_frame_contract(spark, panel):
    p = as_panel(panel)
    assert (p.entity, p.time, p.n_entities()) == ("entity", "time", 6)
    assert p.select("value").columns == ["entity", "time", "value"]
    with pytest.raises(ValueError):
        p.with_columns(entity=F.lit("x"))
    with pytest.raises(ValueError):
        PanelFrame(panel, "entity", "nothing")
    p.assert_unique_keys()
    with pytest.raises(ValueError):
        PanelFrame(panel.unionAll(panel), "entity", "time").assert_unique_keys()


def test_prefix_invariance(panel):
    w = entity_window("entity", "time")
    f = lambda df: df.withColumns({"z": rolling.zscore("value", w, 5), "d": rolling.frac_diff("value", w, 0.4, 0.05), "r": alpha.OPS["ts_rank"].build(alpha.Context(w, (F.col("time"),)), F.col("value"), 5)})
    whole = f(panel).where("time < 25").toPandas().sort_values(["entity", "time"]).reset_index(drop=True)
    part = f(panel.where("time < 25")).toPandas().sort_values(["entity", "time"]).reset_index(drop=True)
    for c in ("z", "d", "r"):
        np.testing.assert_allclose(whole[c], part[c], rtol=1e-12)


def test_ffd_weights():
    w = ffd_weights(1.0, 1e-6)
    assert w == [1.0, -1.0]
    assert ffd_weights(0.5, 0.1)[:3] == [1.0, -0.5, -0.125]
    with pytest.raises(ValueError):
        ffd_weights(-1)


def test_neutralize_many_equals_lstsq(panel):
    df = panel.withColumn("b", F.col("signal") * F.col("signal"))
    got = xs.neutralize_many(df, "value", ["signal", "b"], "time", out="v").toPandas()
    for _, g in got.groupby("time"):
        a = np.column_stack([np.ones(len(g)), g.signal, g.b])
        want = g.value - a @ np.linalg.lstsq(a, g.value, rcond=None)[0]
        np.testing.assert_allclose(g.v, want, atol=1e-8)


def test_ranks_of_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, None), (1, 5.0), (2, 7.0)], "t long, x double")
    got = sorted((r.t, -1.0 if r.r is None else r.r, r.b) for r in df.select("t", xs.rank("x", "t").alias("r"), xs.quantile_bin("x", "t", 2).alias("b")).collect() if r.r is not None)
    assert got == [(1, 1.5, 0), (1, 1.5, 0), (1, 3.0, 1), (2, 1.0, 0)]
    nulls = df.select("x", xs.rank("x", "t").alias("r"), xs.quantile_bin("x", "t", 2).alias("b")).where("x is null").first()
    assert nulls.r is None and nulls.b is None
    assert df.select(xs.zscore("x", "t").alias("z")).where("z is not null").count() == 3  # one value has no deviation


def test_asof_golden(spark):
    vint = [("A", 1, 2, 1.0), ("A", 1, 4, 0.95), ("A", 5, 6, 1.1), ("A", 5, 8, 1.3), ("B", 3, 5, 2.0), ("Z", 1, 1, 9.0)]
    v = spark.createDataFrame(vint, "k string, ev long, kn long, eps double")
    p = spark.createDataFrame([(k, t, 0.0) for k in ("A", "B", "C") for t in range(1, 9)], "k string, t long, px double")
    got = asof.asof_join(p, v, entity="k", time="t", event_time="ev", knowledge_time="kn").toPandas().sort_values(["k", "t"])
    by = {k: [None if x != x else x for x in g.eps] for k, g in got.groupby("k")}
    assert by["A"] == [None, 1.0, 1.0, 0.95, 0.95, 1.1, 1.1, 1.3]
    assert by["B"] == [None] * 4 + [2.0] * 4
    assert by["C"] == [None] * 8
    with pytest.raises(ValueError):
        asof.asof_join(p, v.unionByName(v.withColumn("eps", F.col("eps") + 1)), entity="k", time="t", event_time="ev", knowledge_time="kn")


def test_cusum_filter_equals_loop(panel):
    got = series(bars.cusum_filter(panel.select("entity", "time", "value"), "entity", "time", "value", 1.5), "event")
    for e, x in series(panel, "value").items():
        up = down = 0.0
        want = [0.0]
        for d in np.diff(x):
            up, down = max(0.0, up + d), min(0.0, down + d)
            want.append(1.0 if up > 1.5 else -1.0 if down < -1.5 else 0.0)
            if want[-1]:
                up = down = 0.0
        np.testing.assert_array_equal(got[e], want)


def test_imbalance_bars_and_shiryaev_run_in_order(panel):
    out = bars.imbalance_bars(panel.select("entity", "time", "value"), "entity", "time", "value", expected_ticks=4.0).toPandas().sort_values(["entity", "time"])
    for _, g in out.groupby("entity"):
        assert (np.diff(g.bar_index) >= 0).all() and (np.diff(g.bar_index)[~g.closes.to_numpy()[:-1]] == 0).all()
    got = series(bars.shiryaev_roberts(panel.select("entity", "time", "value"), "entity", "time", "value", 0.5), "log_sr")
    for e, x in series(panel, "value").items():
        r = None
        for z, have in zip(x, got[e], strict=True):
            r = 0.5 * z - 0.125 + (0 if r is None else math.log1p(math.exp(r)))
            assert have == pytest.approx(r)


def test_normal_cdf(spark):
    got = spark.range(1).select(*[normal_cdf(F.lit(x)).alias(str(i)) for i, x in enumerate((-2.0, 0.0, 1.0, 3.0))]).first()
    assert list(got) == pytest.approx([0.022750132, 0.5, 0.841344746, 0.998650102], abs=2e-7)


def test_power_lambda_finds_the_maximum(spark):
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(size=400))
    df = spark.createDataFrame([("a", float(v)) for v in x], "entity string, x double")
    lam = preprocess.power_lambda(df, "entity", "x").first()["lambda"]

    def ll(k):
        y = np.log(x) if abs(k) < 1e-9 else (x**k - 1) / k
        return -len(x) / 2 * np.log(y.var()) + (k - 1) * np.log(x).sum()

    assert ll(lam) >= max(ll(k) for k in np.linspace(-2, 2, 401)) - 0.05


def test_splits():
    assert [len(f) for f in evaluation.folds(10, 3)] == [4, 3, 3]
    train, test = next(iter(evaluation.purged_kfold(20, 4, horizon=2, embargo=3)))
    assert list(test) == [0, 1, 2, 3, 4] and train[0] == 8
    assert all(max(t) < min(o) for t, o in evaluation.expanding_window(20, 3, 3))
    assert len(list(evaluation.combinatorial_purged(20, 4, 2))) == 6
    assert 0 < evaluation.deflated_sharpe(0.1, 250, 0.0, 3.0, 10, 0.01) < evaluation.probabilistic_sharpe(0.1, 250, 0.0, 3.0) < 1


def test_two_way_demeaning(panel):
    got = econ.demean_within(panel, ["value"], ["entity", "time"])
    m = got.groupBy("time").agg(F.abs(F.avg("value_within")).alias("m")).agg(F.max("m").alias("m")).first()["m"]
    n = got.groupBy("entity").agg(F.abs(F.avg("value_within")).alias("m")).agg(F.max("m").alias("m")).first()["m"]
    assert max(m, n) < 1e-8


def test_near_duplicates_are_exact_and_found(spark):
    base = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark wood again"
    rows = [(1, base), (2, base + " today"), (3, "something else entirely with other words in it"), (4, base), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r.a, r.b) for r in clean.near_duplicates(df, "id", "t", 0.7).collect()}
    assert (1, 4) in got and (1, 2) in got and not any(3 in p for p in got)


def test_string_similarity(spark):
    df = spark.createDataFrame([("MARTHA", "MARHTA"), ("abc", "abc"), ("a", None)], "a string, b string")
    got = [r.v for r in df.select(clean.jaro_winkler()(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[0] == pytest.approx(0.9611, abs=1e-4) and got[1] == 1.0 and got[2] is None
    assert df.select(clean.unicode_form()(F.lit("ﬁ")).alias("v")).first().v == "fi"


def test_transformers_must_declare_their_flags():
    with pytest.raises(TypeError):
        type("Bad", (transform.PanelTransformer,), {"transform": lambda self, p: p})


def test_impute_refuses_the_future(panel):
    with pytest.raises(ValueError):
        preprocess.impute(as_panel(panel), "bfill")


def test_scale_round_trip(panel):
    p = as_panel(panel)
    scaled, stats = preprocess.scale(p, columns=["value"])
    back = series(preprocess.unscale(scaled, stats, columns=["value"]).df, "value")
    for e, x in series(panel, "value").items():
        np.testing.assert_allclose(back[e], x, atol=1e-12)


def test_drift_and_straddle(panel):
    assert quality.drift(panel, panel, "value").first()["psi"] == pytest.approx(0, abs=1e-9)
    assert quality.train_test_straddle(panel.where("time < 5"), panel.where("time >= 3"), ["entity", "time"]).count() == 12


def test_labels_handle_short_series(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)], "e string, t long, p double")
    got = labels.triple_barrier(df, "e", "t", "p", 3).collect()
    assert all(r.label is None for r in got)
    assert labels.concurrency(labels.forward_return(df, "e", "t", "p", end_time="t1"), "e", "t").count() == 3


def test_pipeline_predicts(panel):
    p = as_panel(panel)
    train = p.filter("time < 30")
    model = transform.Pipeline([transform.TimeSeriesScaler(["signal"], suffix="_z"), transform.LinearModel("value", ["signal_z"])])
    out = model.fit(train).predict(p).toPandas()
    pdf = out[out.time < 30]
    b = np.linalg.lstsq(np.column_stack((np.ones(len(pdf)), pdf.signal_z)), pdf.value, rcond=None)[0]
    np.testing.assert_allclose(out.prediction, b[0] + b[1] * out.signal_z, atol=1e-9)
    assert [s for _, a, s in model.audit()] == [True, True] and len(model.named_steps) == 2
