"""Market features: range-based volatility, spreads, liquidity, realised measures; panel regressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideframe.functions.core import clean, div, trailing

# fixed values: scales of the range estimators
PARKINSON, GK_CLOSE, YZ_ALPHA = 1 / (4 * math.log(2)), 2 * math.log(2) - 1, 1.34
PER_YEAR = 252


def _roll(x: Column, f, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return F.when(F.count(x).over(trailing(w, n)) >= (least or n), f(x).over(trailing(w, n)))


def range_volatility(df: DataFrame, entity: str, time: str, n: int, estimator: str = "parkinson", o: str = "open", h: str = "high", low: str = "low", c: str = "close", per_year: float = PER_YEAR, variance: bool = False, out: str = "vol") -> DataFrame:
    """Range-based volatility over n rows: parkinson, garman_klass, gk_overnight, rogers_satchell, yang_zhang, close_to_close.

    A bar whose prices are not positive or not in order counts as missing.
    """
    w = Window.partitionBy(entity).orderBy(time)
    p = {k: clean(F.col(x)) for k, x in (("o", o), ("h", h), ("l", low), ("c", c))}
    ok = (p["l"] > 0) & (p["h"] >= F.greatest(p["o"], p["c"])) & (p["l"] <= F.least(p["o"], p["c"]))
    df = df.withColumns({f"__{k}": F.when(ok, F.ln(v)) for k, v in p.items()})
    df = df.withColumn("__c1", F.lag("__c").over(w))
    O, H, L, C, C1 = (F.col(f"__{k}") for k in ("o", "h", "l", "c", "c1"))  # noqa: N806
    gk = 0.5 * (H - L) * (H - L) - GK_CLOSE * (C - O) * (C - O)
    rs = (H - O) * (H - C) + (L - O) * (L - C)
    if estimator == "yang_zhang":
        joint = F.when(C1.isNotNull() & rs.isNotNull(), F.lit(1))
        f, m = trailing(w, n), F.count(joint).over(trailing(w, n))
        k = (YZ_ALPHA - 1) / (YZ_ALPHA + div(m + 1, m - 1))
        one = lambda x: F.when(joint == 1, x)
        v = F.when(m >= n, F.var_samp(one(O - C1)).over(f) + k * F.var_samp(one(C - O)).over(f) + (1 - k) * F.avg(one(rs)).over(f))
    else:
        x, f = {
            "parkinson": (lambda: ((H - L) * (H - L) * PARKINSON, F.avg)),
            "garman_klass": (lambda: (gk, F.avg)),
            "gk_overnight": (lambda: (gk + (O - C1) * (O - C1), F.avg)),
            "rogers_satchell": (lambda: (rs, F.avg)),
            "close_to_close": (lambda: (C - C1, F.var_samp)),
        }[estimator]()
        v = _roll(x, f, w, n)
    v = F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)) * per_year)
    return df.withColumn(out, v if variance else F.sqrt(v)).drop("__o", "__h", "__l", "__c", "__c1")


def corwin_schultz(df: DataFrame, entity: str, time: str, n: int, h: str = "high", low: str = "low", out: str = "spread") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(time)
    H, L = clean(F.col(h)), clean(F.col(low))  # noqa: N806
    s = F.pow(F.ln(H / L), F.lit(2.0))
    df = df.withColumns({"__b": s + F.lag(s).over(w), "__g": F.pow(F.ln(F.greatest(H, F.lag(H).over(w)) / F.least(L, F.lag(L).over(w))), F.lit(2.0)), "__ok": F.lag(H).over(w).isNotNull()})
    k = 3 - 2 * math.sqrt(2)
    a = (math.sqrt(2) - 1) * F.sqrt("__b") / k - F.sqrt(F.col("__g") / k)
    spread = 2 * (F.exp(a) - 1) / (1 + F.exp(a))
    df = df.withColumn("__s", F.when(F.col("__ok") & spread.isNotNull(), F.greatest(spread, F.lit(0.0))))
    return df.withColumn(out, _roll(F.col("__s"), F.avg, w, n)).drop("__b", "__g", "__ok", "__s")


def abdi_ranaldo(df: DataFrame, entity: str, time: str, n: int, h: str = "high", low: str = "low", c: str = "close", out: str = "spread") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(time)
    mid = (F.ln(clean(F.col(h))) + F.ln(clean(F.col(low)))) / 2
    df = df.withColumns({"__m": mid, "__c": F.ln(clean(F.col(c)))})
    before, was = F.lag("__c").over(w), F.lag("__m").over(w)
    df = df.withColumn("__x", 4 * (before - was) * (before - F.col("__m")))
    m = _roll(F.col("__x"), F.avg, w, n)
    return df.withColumn(out, F.when(m.isNotNull(), F.sqrt(F.greatest(m, F.lit(0.0))))).drop("__m", "__c", "__x")


def amihud(df: DataFrame, entity: str, time: str, ret: str, dollar_volume: str, n: int, out: str = "amihud") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(time)
    x = F.when(F.col(dollar_volume) > 0, div(F.abs(clean(F.col(ret))), F.col(dollar_volume)))
    return df.withColumn("__x", x).withColumn(out, 1e6 * _roll(F.col("__x"), F.avg, w, n)).drop("__x")


def amivest(df: DataFrame, entity: str, time: str, ret: str, volume: str, n: int, out: str = "amivest") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(time)
    x = F.when(F.abs(clean(F.col(ret))) > 0, div(F.col(volume), F.abs(clean(F.col(ret)))))
    return df.withColumn("__x", x).withColumn(out, _roll(F.col("__x"), F.avg, w, n)).drop("__x")


def roll_spread(df: DataFrame, entity: str, time: str, price: str, n: int, clip: bool = True, out: str = "roll_spread") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(time)
    df = df.withColumn("__d", clean(F.col(price)) - F.lag(clean(F.col(price))).over(w))
    df = df.withColumn("__e", F.lag("__d").over(w))
    both = F.when(F.col("__d").isNotNull() & F.col("__e").isNotNull(), 1)
    f = trailing(w, n)
    avg = lambda c: F.avg(F.when(both == 1, c)).over(f)
    cov = F.when(F.count(both).over(f) >= n, avg(F.col("__d") * F.col("__e")) - avg(F.col("__d")) * avg(F.col("__e")))
    return df.withColumn(out, F.when(cov < 0, 2 * F.sqrt(-cov)).when(cov.isNotNull() & F.lit(clip), 0.0)).drop("__d", "__e")


def zero_return_share(df: DataFrame, entity: str, time: str, ret: str, n: int, tol: float = 0.0, out: str = "zeros") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(time)
    x = F.when(clean(F.col(ret)).isNotNull(), (F.abs(F.col(ret)) <= tol).cast("double"))
    return df.withColumn("__x", x).withColumn(out, _roll(F.col("__x"), F.avg, w, n)).drop("__x")


def price_impact(df: DataFrame, entity: str, time: str, ret: str, dollar_volume: str, n: int, out: str = "impact") -> DataFrame:
    """Slope of returns on signed root volume."""
    w = Window.partitionBy(entity).orderBy(time)
    r = clean(F.col(ret))
    df = df.withColumn("__x", F.signum(r) * F.sqrt(F.col(dollar_volume)))
    f = trailing(w, n)
    var = F.avg(F.col("__x") * F.col("__x")).over(f) - F.avg("__x").over(f) * F.avg("__x").over(f)
    cov = F.avg(r * F.col("__x")).over(f) - F.avg(r).over(f) * F.avg("__x").over(f)
    ok = (F.count("__x").over(f) >= n) & (var > 1e-12 * F.avg(F.col("__x") * F.col("__x")).over(f))
    return df.withColumn(out, F.when(ok, div(cov, var))).drop("__x")


def realized_variance(df: DataFrame, entity: str, time: str, ret: str, n: int) -> DataFrame:
    """Trailing ``rv``, bipower ``bv`` and the jump part of squared returns."""
    w = Window.partitionBy(entity).orderBy(time)
    r = clean(F.col(ret))
    df = df.withColumn("__y", F.abs(r) * F.abs(F.lag(r).over(w)))
    f, rows = trailing(w, n), F.count(F.lit(1)).over(trailing(w, n))
    df = df.withColumns({"rv": F.when(rows >= n, F.sum(r * r).over(f)), "bv": F.when(rows >= n, (math.pi / 2) * (n / (n - 1)) * F.sum("__y").over(f))})
    return df.withColumn("jump", F.when(F.col("rv").isNotNull() & F.col("bv").isNotNull(), F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0)))).drop("__y")


def har_features(df: DataFrame, entity: str, time: str, rv: str, lags: Sequence[int] = (1, 5, 22)) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(time)
    return df.withColumns({f"{rv}_har_{k}": F.when(F.count(F.col(rv)).over(trailing(w, k)) >= k, F.avg(rv).over(trailing(w, k))) for k in lags})


def intraday_measures(ticks: DataFrame, keys: Sequence[str], time: Sequence[str], ret: str) -> DataFrame:
    """Realised measures of each session (entity and day): rv, bv, medrv, minrv, semivariances, signed jump, quarticities."""
    w = Window.partitionBy(*keys).orderBy(*time)
    r = clean(F.col(ret))
    a = F.abs(r)
    held = ticks.select(*keys, r.alias("r"), F.lag(a).over(w).alias("a1"), F.lag(a, 2).over(w).alias("a2"), a.alias("a0"))
    a0, a1, a2, x = F.col("a0"), F.col("a1"), F.col("a2"), F.col("r")
    n = F.count(x)
    three = a2.isNotNull() & a1.isNotNull()
    median = F.when(three, a0 + a1 + a2 - F.greatest(a0, a1, a2) - F.least(a0, a1, a2))
    med = math.pi / (6 - 4 * math.sqrt(3) + math.pi)
    mu = 2 ** (2 / 3) * math.gamma(7 / 6) / math.gamma(1 / 2)
    out = held.groupBy(*keys).agg(
        n.alias("n_obs"),
        F.sum(x * x).alias("rv"),
        ((math.pi / 2) * div(n, n - 1) * F.sum(a0 * a1)).alias("bv"),
        (med * div(n, n - 2) * F.sum(median * median)).alias("medrv"),
        ((math.pi / (math.pi - 2)) * div(n, n - 1) * F.sum(F.when(a1.isNotNull(), F.pow(F.least(a0, a1), F.lit(2.0))))).alias("minrv"),
        F.sum(F.when(x > 0, x * x).otherwise(0.0)).alias("rs_pos"),
        F.sum(F.when(x < 0, x * x).otherwise(0.0)).alias("rs_neg"),
        ((n / 3) * F.sum(x * x * x * x)).alias("rq"),
        (mu**-3 * n * div(n, n - 2) * F.sum(F.when(three, F.pow(a0 * a1 * a2, F.lit(4 / 3))))).alias("tpq"),
    )
    return out.withColumn("sjv", F.col("rs_pos") - F.col("rs_neg"))


# --- regressions ----------------------------------------------------------------------------------------------------------


def demean_within(df: DataFrame, columns: Sequence[str], keys: Sequence[str], tol: float = 1e-10, rounds: int = 100) -> DataFrame:
    """Sweeps out the means of each key in turn until none is left (one key: a single sweep)."""
    from tideframe.sources.tables import checkpointed

    for c in columns:
        df = df.withColumn(f"{c}_within", clean(F.col(c)))
    names = [f"{c}_within" for c in columns]
    sweep = 1 if len(keys) == 1 else 4  # sweeps between two looks at what is left
    for _ in range(0, rounds, sweep):
        for k in list(keys) * sweep:
            over = Window.partitionBy(k)
            df = df.withColumns({n: F.col(n) - F.avg(n).over(over) for n in names})
        if len(keys) == 1:
            break
        df = checkpointed(df)
        per = df.groupBy(keys[0]).agg(*[F.avg(n).alias(n) for n in names], *[F.max(F.abs(F.col(n))).alias(f"{n}_max") for n in names])
        left = per.agg(F.greatest(*[F.max(F.abs(F.col(n))) for n in names], F.lit(0.0)).alias("m"), F.greatest(*[F.max(f"{n}_max") for n in names], F.lit(0.0)).alias("size")).first()
        if left["m"] <= tol * (1 + left["size"]):
            break
    return df


def ols(df: DataFrame, y: str, x: Sequence[str], intercept: bool = True) -> DataFrame:
    """Least squares from cross-products: one pre-aggregated pass, the small system solved on the driver; (term, coef, se, t)."""
    import numpy as np

    terms = (["const"] if intercept else []) + list(x)
    value = {t: F.lit(1.0) if t == "const" else clean(F.col(t)) for t in (*terms, y)}
    ok = F.lit(True)
    for t in (*x, y):
        ok &= value[t].isNotNull()
    pairs = [(a, b) for i, a in enumerate(terms) for b in terms[i:]] + [(a, y) for a in terms] + [(y, y)]
    r = df.where(ok).agg(F.count(F.lit(1)).alias("n"), *[F.sum(value[a] * value[b]).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    got = {p: r[str(i)] for i, p in enumerate(pairs)}
    g = np.array([[got[(a, b)] if (a, b) in got else got[(b, a)] for b in terms] for a in terms], float)
    h = np.array([got[(a, y)] for a in terms], float)
    inv = np.linalg.pinv(g)
    beta = inv @ h
    s2 = (got[(y, y)] - beta @ h) / max(1, r["n"] - len(terms))
    se = np.sqrt(np.maximum(np.diag(inv) * s2, 0))
    rows = [(t, float(b), float(s), float(b / s) if s > 0 else None) for t, b, s in zip(terms, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double")


def fama_macbeth(df: DataFrame, time: str, y: str, x: str, least: int = 3, lags: int = 0) -> DataFrame:
    """Cross-sectional slopes of each date, their mean, its Newey-West error and t: (term, coef, se, t, n_periods)."""
    a, b = clean(F.col(x)), clean(F.col(y))
    per = df.where(a.isNotNull() & b.isNotNull()).groupBy(time).agg(F.regr_intercept(b, a).alias("const"), F.regr_slope(b, a).alias(x), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).dropna()
    out = None
    w = Window.orderBy(time)
    n = F.count(F.lit(1))
    for term in ("const", x):
        m = per.agg(F.avg(term).alias("__m"))
        e = per.join(F.broadcast(m)).select(time, (F.col(term) - F.col("__m")).alias("e"), F.col(term))
        e = e.withColumns({f"l{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)})
        s = F.sum(F.col("e") * F.col("e"))
        for k in range(1, lags + 1):
            s = s + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0))
        # without lags: the sample variance of the slopes over their number
        var = div(s, n * (n - 1)) if lags == 0 else div(s, n * n)
        one = e.agg(F.lit(term).alias("term"), F.avg(term).alias("coef"), F.sqrt(var).alias("se"), n.alias("n_periods"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("t", div(F.col("coef"), F.col("se")))


def mean_group(df: DataFrame, entity: str, y: str, x: str, least: int = 3) -> DataFrame:
    """Mean of the entities' own slopes, with the error of that mean."""
    a, b = clean(F.col(x)), clean(F.col(y))
    per = df.groupBy(entity).agg(F.regr_slope(b, a).alias("s"), F.count(a + b).alias("n")).where(F.col("n") >= least)
    out = per.agg(F.avg("s").alias("coef"), (F.stddev_samp("s") / F.sqrt(F.count("s"))).alias("se"), F.count("s").alias("n_entities"))
    return out.withColumn("t", div(F.col("coef"), F.col("se")))
