"""Steps whose work must not grow faster than their input."""

import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tideframe.functions import catch22, kernels, regress
from tideframe.operators import clean, evaluation, labels


def test_shingles_split_a_text_once(spark):
    words = [f"w{i}" for i in range(20_000)]
    began = time.monotonic()
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(clean.shingles(F.col("t")).alias("s")).first().s
    assert time.monotonic() - began < 20  # the text split anew for each shingle takes minutes
    assert len(got) == 19_998 and got[0] == "w0 w1 w2" and got[-1] == "w19997 w19998 w19999"


def test_windows_are_measured_many_at_once():
    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(size=(3000, 20)), 1), np.round(rng.normal(size=(3000, 20)))
    x[0], y[1] = 1.0, 2.0
    began = time.monotonic()
    got = {name: f(x, y) for name, f in kernels.ROWS.items()}
    assert time.monotonic() - began < 3
    for name, f in kernels.ROWS.items():
        for i in (0, 1, *range(100, 130)):
            want = kernels.DEPENDENCE[name](x[i], y[i])
            if not (name == "gcmi" and i < 2):  # a column without variation: null, where rounding made a correlation of noise
                assert np.isclose(got[name][i], want, atol=1e-9, equal_nan=True)


def _distances(v):
    return np.abs(np.subtract.outer(v, v))


def test_dependence_needs_no_matrix_of_all_pairs():
    rng = np.random.default_rng(2)
    for n, kind in ((9, 0), (57, 1), (200, 0), (200, 1)):
        x = rng.normal(size=n)
        y = x + rng.normal(size=n)
        x, y = (np.round(x), np.round(y)) if kind else (x, y)
        sx, sy = (np.sign(np.subtract.outer(v, v)) for v in (x, y))
        assert np.isclose(kernels.kendall(x, y), (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum()))

        def centred(d, n=n):
            a = d - d.sum(1)[:, None] / (n - 2) - d.sum(1) / (n - 2) + d.sum() / ((n - 1) * (n - 2))
            return a - np.diag(np.diag(a))

        a, b = centred(_distances(x)), centred(_distances(y))
        assert np.isclose(kernels.distance_correlation(x, y), (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))
        d = _distances(x)
        assert np.isclose(kernels._median_square(x), np.median(d[d > 0] ** 2))
    x = rng.normal(size=20_000)
    y = x + rng.normal(size=20_000)
    tracemalloc.start()
    assert 0.3 < kernels.kendall(x, y) < 0.7 and 0.2 < kernels.distance_correlation(x, y) < 0.6
    assert np.isclose(kernels._median_square(x[:2048]), kernels._median_square(np.append(x[:2048], x[:2048].mean())), rtol=0.01)
    assert tracemalloc.get_traced_memory()[1] < 2e8  # a matrix takes 3.2e9
    tracemalloc.stop()


def test_bsadf_and_decomposition_work_on_whole_arrays():
    x = np.random.default_rng(3).gamma(2, 20, 1500)
    began = time.process_time()
    got = kernels.bsadf(x, 30)
    trend, seasonal, rest = regress.causal_decompose(np.tile(x, 40), 7)
    assert time.process_time() - began < 0.6
    for t in (29, 30, 61, 62, 700):
        every = [kernels.augmented_dickey_fuller(x[s : t + 1], 0) for s in range(t - 28)]
        assert np.isclose(got[t], np.nanmax(every), rtol=1e-6)
    assert np.isnan(got[:29]).all() and np.allclose(trend + seasonal + rest, np.tile(x, 40))
    short = regress.causal_decompose(x[:9], 7)[1]
    assert len(short) == 9 and np.isfinite(short).all()


def test_outlier_timing_is_by_places_that_fall_out():
    rng = np.random.default_rng(4)
    for n in (5, 40, 400):
        z = catch22._z(rng.gamma(2, 20, n))
        for sign in (1, -1):
            y, want = z * sign, []
            for level in np.arange(0, y.max() + 1e-12, 0.01):
                at = np.flatnonzero(y >= level)
                if len(at) < 2 or 100 * (len(at) - 1) / (y >= 0).sum() <= 2:
                    break
                want.append(np.median(at) / (n / 2) - 1 + 1 / (n / 2))
            assert catch22.outlier_timing(z, sign) == (np.median(want) if want else 0.0)
    assert catch22.catch22_all(np.ones(200))["SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1"] == 0  # was decided by rounding


def test_p_values_are_adjusted_over_many_tasks(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(3000) ** 3, 4)
    df = spark.createDataFrame([*enumerate(p.tolist()), (5000, None)], "id long, p double")
    order, n = np.argsort(p, kind="stable"), len(p)
    i = np.arange(1, n + 1)
    down = lambda v: np.minimum.accumulate(v[::-1])[::-1]
    want = {"bonferroni": p[order] * n, "holm": np.maximum.accumulate((n - i + 1) * p[order]), "bh": down(n * p[order] / i), "by": down((1 / i).sum() * n * p[order] / i)}
    for method, w in want.items():
        out = evaluation.adjust_p_values(df, "p", method)
        got = {r.id: r.p_adjusted for r in out.collect()}
        assert (got.pop(5000) is None or method == "bonferroni") and np.allclose([got[k] for k in order], np.minimum(w, 1))
        if method != "bonferroni":
            assert out.groupBy(F.spark_partition_id()).count().count() > 1  # one window held all rows in a task
    groups = spark.createDataFrame([(g, float(v)) for g in "ab" for v in p[:100]], "g string, p double")
    w = np.sort(p[:100])
    got = sorted(r.p_adjusted for r in evaluation.adjust_p_values(groups, "p", "by", by=["g"]).where("g = 'a'").collect())
    k = np.arange(1, 101)
    assert np.allclose(got, np.minimum(down((1 / k).sum() * 100 * w / k), 1))


def test_a_word_of_all_names_makes_no_pairs(spark):
    names = spark.range(20_000).select("id", F.format_string("Customer#%09d", "id").alias("n"))
    began = time.monotonic()
    assert clean.resolve_entities(names, "id", "n", 0.95).count() == 0
    words = names.select(F.col("id"), F.array(F.lit("customer"), F.format_string("%09d", "id")).alias("w")).select("id", F.col("id").alias("n"), F.lit(0).alias("k"), "w")
    keys = clean._prefix_tokens(words, 0.95)
    assert keys.count() == 20_000 == keys.select("x").distinct().count()  # the common word was a key of about half of them
    assert time.monotonic() - began < 90


def test_trend_scan_is_one_pass_over_arrays(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=40)
    df = spark.createDataFrame([("a", i, float(v) if i != 20 else None) for i, v in enumerate(x)], "e string, t long, x double")
    for forward in (False, True):
        out = labels.trend_scan(df, "e", "t", "x", 5, 11, 3, forward)
        assert "regr_" not in out._jdf.queryExecution().optimizedPlan().toString()  # twelve sliding aggregates
        got = {r.t: (r.trend_t, r.trend_window) for r in out.collect()}
        for i in range(40):
            best = None
            for n in (5, 8, 11):
                v = x[i : i + n] if forward else x[max(0, i - n + 1) : i + 1]
                if len(v) == n and 20 not in (range(i, i + n) if forward else range(i - n + 1, i + 1)):
                    at = np.arange(n)
                    b, a = np.polyfit(at, v, 1)
                    t = b / np.sqrt(((v - a - b * at) ** 2).sum() / (n - 2) / ((at - at.mean()) ** 2).sum())
                    best = (t, n) if best is None or abs(t) > abs(best[0]) else best
            assert got[i] == (None, None) if best is None else np.allclose(got[i], best)


def test_spans_take_one_grouping(spark):
    df = spark.createDataFrame([("a", i, i + 2 if i < 6 else None, float(i + 1)) for i in range(8)] + [("b", 0, -5, 1.0), ("b", 1, 1, 2.0)], "e string, t long, t1 long, x double")
    for out in (labels.concurrency(df, "e", "t"), labels.average_uniqueness(df, "e", "t"), labels.return_attribution(df, "e", "t", "x")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan  # several windows and joins held an entity's rows in one task at once
    held = {(r.e, r.t): r for r in labels.concurrency(df, "e", "t").collect()}
    assert [held["a", i].concurrency for i in range(8)] == [1, 2, 3, 3, 3, 3, 2, 1] and held["a", 7]["__e"] is None
    assert held["b", 0]["__e"] is None and (held["b", 1]["__s"], held["b", 1]["__e"]) == (2, 2)
    u = {(r.e, r.t): r.uniqueness for r in labels.average_uniqueness(df, "e", "t").collect()}
    assert np.isclose(u["a", 0], (1 + 1 / 2 + 1 / 3) / 3) and u["a", 6] is None and u["b", 1] == 1
    w = {(r.e, r.t): r.w_return for r in labels.return_attribution(df, "e", "t", "x").collect()}
    assert np.isclose(w["a", 0], np.log(2) / 2 + np.log(1.5) / 3) and w["a", 7] is None
