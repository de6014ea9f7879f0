"""Tests and statistics of each entity or date as windows and aggregations: one shuffle by entity, nothing leaves the JVM.

Rows whose inputs are null or NaN do not count. Groups that are too short, or do not vary, get null statistics.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.core import average_rank, clean, div

# Coefficients of the rational approximation of the normal distribution (Hart 1968, as given by West 2005).
CDF_NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_FAR = 7.07106781186547


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """Distribution function of the normal law to about 15 digits, as a column expression."""
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    far = z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))
    tail = F.when(z < CDF_FAR, e * _horner(z, CDF_NUMERATOR) / _horner(z, CDF_DENOMINATOR)).otherwise(e / far / math.sqrt(2 * math.pi))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def crps_gaussian(y: Column, mu: Column, sigma: Column) -> Column:
    """Continuous ranked probability score of a normal forecast; null where sigma is not positive."""
    s = F.when(clean(sigma) > 0, clean(sigma))
    z = (clean(y) - clean(mu)) / s
    return s * (z * (2 * normal_cdf(z) - 1) + 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


def qlike_loss(realized: Column, forecast: Column) -> Column:
    x = div(clean(realized), clean(forecast))
    return F.when(x > 0, x - F.ln(F.when(x > 0, x)) - 1)


def fz0_loss(r: Column, var: Column, es: Column, level: float) -> Column:
    """Joint loss of value at risk and expected shortfall; both must be negative."""
    v, e = F.when(clean(var) < 0, clean(var)), F.when(clean(es) < 0, clean(es))
    return -F.when(clean(r) <= v, div(v - clean(r), level * e)).otherwise(0.0) + div(v, e) + F.ln(-e) - 1


def newey_west_variance(df: DataFrame, entity: str, time: str | Sequence[str], column: str, lags: int) -> DataFrame:
    """(entity, n, mean, variance): long-run variance with Bartlett weights over ``lags`` lags."""
    order = [time] if isinstance(time, str) else list(time)
    w = Window.partitionBy(entity)
    rows = df.select(entity, *order, clean(F.col(column)).alias("__d")).where("__d is not null")
    rows = rows.withColumn("__c", F.col("__d") - F.avg("__d").over(w))
    rows = rows.select(entity, "__d", "__c", *[F.lag("__c", k).over(w.orderBy(*order)).alias(f"__l{k}") for k in range(1, lags + 1)])
    total = F.sum(F.col("__c") * F.col("__c"))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("__c") * F.col(f"__l{k}")), F.lit(0.0))
    n = F.count(F.lit(1))
    return rows.groupBy(entity).agg(n.alias("n"), F.avg("__d").alias("mean"), (total / n).alias("variance"))


def _mean_test(df: DataFrame, entity: str, time, value: Column, horizon: int, sided: str) -> DataFrame:
    lrv = newey_west_variance(df.withColumn("__v", value), entity, time, "__v", horizon - 1)
    z = div(F.col("mean"), F.sqrt(F.when(F.col("variance") > 0, F.col("variance")) / F.col("n")))
    p = 2 * (1 - normal_cdf(F.abs(F.col("statistic")))) if sided == "two-sided" else 1 - normal_cdf(F.col("statistic"))
    return lrv.select(entity, "n", F.col("mean").alias("estimate"), z.alias("statistic")).withColumn("pvalue", p)


def diebold_mariano_test(df: DataFrame, entity: str, time, loss_a: str, loss_b: str, horizon: int = 1, correction: bool = True) -> DataFrame:
    """(entity, n, estimate, statistic, pvalue) of equal expected losses; the p-value is that of the normal law."""
    out = _mean_test(df, entity, time, clean(F.col(loss_a)) - clean(F.col(loss_b)), horizon, "two-sided")
    if not correction:
        return out
    n, h = F.col("n"), horizon
    out = out.withColumn("statistic", F.col("statistic") * F.sqrt(F.greatest(F.lit(0.0), (n + 1 - 2 * h + h * (h - 1) / n) / n)))
    return out.withColumn("pvalue", 2 * (1 - normal_cdf(F.abs(F.col("statistic")))))


def clark_west_test(df: DataFrame, entity: str, time, y: str, benchmark: str, forecast: str, horizon: int = 1) -> DataFrame:
    """Nested forecasts: squared errors, with what the noise of the larger model costs given back; one-sided."""
    y, b, f = (clean(F.col(c)) for c in (y, benchmark, forecast))
    return _mean_test(df, entity, time, (y - b) * (y - b) - ((y - f) * (y - f) - (b - f) * (b - f)), horizon, "greater")


def encompassing_test(df: DataFrame, entity: str, time, y: str, a: str, b: str, horizon: int = 1) -> DataFrame:
    """Whether forecast b adds to a: the mean of e_a (e_a - e_b); one-sided."""
    y, a, b = (clean(F.col(c)) for c in (y, a, b))
    return _mean_test(df, entity, time, (y - a) * ((y - a) - (y - b)), horizon, "greater")


def oos_r2(df: DataFrame, entity: str, y: str, forecast: str, benchmark: str) -> DataFrame:
    y, f, b = (clean(F.col(c)) for c in (y, forecast, benchmark))
    rows = df.where((y + f + b).isNotNull())
    return rows.groupBy(entity).agg((1 - div(F.sum((y - f) * (y - f)), F.sum((y - b) * (y - b)))).alias("oos_r2"))


def pesaran_timmermann_test(df: DataFrame, entity: str, y: str, forecast: str, threshold: float = 0.0) -> DataFrame:
    """Directional accuracy beyond that of independent directions: (entity, n, estimate, statistic, pvalue)."""
    up, said = (clean(F.col(c)) > threshold for c in (y, forecast))
    rows = df.select(entity, up.cast("double").alias("__y"), said.cast("double").alias("__f")).where("__y is not null and __f is not null")
    s = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("__y") == F.col("__f")).cast("double")).alias("estimate"), F.avg("__y").alias("__py"), F.avg("__f").alias("__pf"))
    n, py, pf = F.col("n"), F.col("__py"), F.col("__pf")
    e = py * pf + (1 - py) * (1 - pf)
    w = ((2 * py - 1) * (2 * py - 1) * pf * (1 - pf) + (2 * pf - 1) * (2 * pf - 1) * py * (1 - py)) / n + 4 * py * pf * (1 - py) * (1 - pf) / n / n
    left = e * (1 - e) / n - w
    out = s.withColumn("statistic", (F.col("estimate") - e) / F.sqrt(F.when(left > 1e-15, left)))
    return out.select(entity, "n", "estimate", "statistic", (1 - normal_cdf(F.col("statistic"))).alias("pvalue"))


def _log_like(k: Column, n: Column, p: Column) -> Column:
    return F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.ln(1 - p)).otherwise(0.0)


def var_backtest(df: DataFrame, entity: str, time, ret: str, var: str, level: float) -> DataFrame:
    """Coverage of a value at risk (a return below it is a hit): Kupiec's frequency, Christoffersen's independence, and both.

    (entity, n, hits, lr_uc, p_uc, lr_ind, p_ind, lr_cc, p_cc).
    """
    order = [time] if isinstance(time, str) else list(time)
    hit = (clean(F.col(ret)) < clean(F.col(var))).cast("long")
    rows = df.select(entity, *order, hit.alias("__h")).where("__h is not null")
    rows = rows.withColumn("__b", F.lag("__h").over(Window.partitionBy(entity).orderBy(*order)))
    case = lambda b, h: F.sum(F.when((F.col("__b") == b) & (F.col("__h") == h), 1).otherwise(0))
    s = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.sum("__h").alias("hits"), *[case(b, h).alias(f"__{b}{h}") for b in (0, 1) for h in (0, 1)])
    n, k = F.col("n"), F.col("hits")
    c = {x: F.col(f"__{x}") for x in ("00", "01", "10", "11")}
    m, turned = c["00"] + c["01"] + c["10"] + c["11"], c["01"] + c["11"]
    uc = -2 * (_log_like(k, n, F.lit(level)) - _log_like(k, n, k / n))
    apart = sum((_log_like(c[f"{b}1"], c[f"{b}0"] + c[f"{b}1"], div(c[f"{b}1"], c[f"{b}0"] + c[f"{b}1"])) for b in (0, 1)), F.lit(0.0))
    ind = F.greatest(F.lit(0.0), -2 * (_log_like(turned, m, div(turned, m)) - apart))
    out = s.select(entity, "n", "hits", F.greatest(F.lit(0.0), uc).alias("lr_uc"), ind.alias("lr_ind"))
    one = lambda x: 2 * (1 - normal_cdf(F.sqrt(F.col(x))))
    out = out.withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind"))
    return out.select(entity, "n", "hits", "lr_uc", one("lr_uc").alias("p_uc"), "lr_ind", one("lr_ind").alias("p_ind"), "lr_cc", F.exp(-F.col("lr_cc") / 2).alias("p_cc"))


def kupiec_test(df: DataFrame, entity: str, time, ret: str, var: str, level: float) -> DataFrame:
    out = var_backtest(df, entity, time, ret, var, level)
    return out.select(entity, "n", "hits", F.col("lr_uc").alias("statistic"), F.col("p_uc").alias("pvalue"))


def christoffersen_test(df: DataFrame, entity: str, time, ret: str, var: str, level: float, kind: str = "conditional_coverage") -> DataFrame:
    lr = {"independence": "ind", "conditional_coverage": "cc"}[kind]
    out = var_backtest(df, entity, time, ret, var, level)
    return out.select(entity, "n", "hits", F.col(f"lr_{lr}").alias("statistic"), F.col(f"p_{lr}").alias("pvalue"))


def sharpe_ratio_test(df: DataFrame, entity: str, time, ret: str, benchmark: float = 0.0, lags: int = 0) -> DataFrame:
    """Sharpe ratios with an error robust to skew, fat tails and autocorrelation (delta method, Bartlett weights)."""
    r, w = clean(F.col(ret)), Window.partitionBy(entity)
    sd = F.stddev_samp(r).over(w)
    z, sr = div(r - F.avg(r).over(w), sd), div(F.avg(r).over(w), sd)
    rows = df.withColumns({"__sr": sr, "__psi": F.when(r.isNotNull(), z - sr / 2 * (z * z - 1))})
    lrv = newey_west_variance(rows, entity, time, "__psi", lags)
    sharpe = df.where(r.isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("n"), div(F.avg(r), F.stddev_samp(r)).alias("sharpe"))
    out = sharpe.join(lrv.drop("n"), entity, "left").withColumn("statistic", (F.col("sharpe") - benchmark) / F.sqrt(F.when(F.col("variance") > 0, F.col("variance")) / F.col("n")))
    return out.select(entity, "n", "sharpe", "statistic", (1 - normal_cdf(F.col("statistic"))).alias("pvalue"))


def probabilistic_sharpe_ratio(df: DataFrame, entity: str, ret: str, benchmark: float = 0.0, quantile: float = 1.6448536269514722) -> DataFrame:
    """(entity, n, sharpe, psr, min_track_record): the probability that the ratio is above the benchmark, and the rows
    that would make it the probability of the given normal quantile; null where the ratio is not above the benchmark."""
    r = clean(F.col(ret))
    s = df.where(r.isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("n"), div(F.avg(r), F.stddev_samp(r)).alias("sharpe"), F.skewness(r).alias("__g"), F.kurtosis(r).alias("__k"))
    sr = F.col("sharpe")
    v = 1 - F.col("__g") * sr + (F.col("__k") + 2) / 4 * sr * sr
    psr = normal_cdf((sr - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(v > 0, v)))
    longer = F.when(sr > benchmark, 1 + v * F.pow(quantile / (sr - benchmark), F.lit(2)))
    return s.select(entity, "n", "sharpe", psr.alias("psr"), longer.alias("min_track_record"))


def kpss(df: DataFrame, entity: str, time, column: str, lags: int, least: int = 8) -> DataFrame:
    """(entity, n, statistic): stationarity around a level; null with fewer than ``least`` values."""
    order = [time] if isinstance(time, str) else list(time)
    x, w = clean(F.col(column)), Window.partitionBy(entity)
    rows = df.select(entity, *order, x.alias("__x")).where("__x is not null")
    rows = rows.withColumn("__c", F.col("__x") - F.avg("__x").over(w))
    rows = rows.withColumn("__s", F.sum("__c").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy(entity).agg(F.sum(F.col("__s") * F.col("__s")).alias("__ss"))
    lrv = newey_west_variance(df, entity, order, column, lags).join(sums, entity)
    stat = F.when(F.col("n") >= least, div(F.col("__ss"), F.col("n") * F.col("n") * F.when(F.col("variance") > 0, F.col("variance"))))
    return lrv.select(entity, "n", stat.alias("statistic"))


def normality_test(df: DataFrame, entity: str, column: str) -> DataFrame:
    """(entity, n, statistic, pvalue): D'Agostino and Pearson's K^2 from skew and kurtosis; null under 8 values."""
    x = clean(F.col(column))
    s = df.where(x.isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).cast("double").alias("n"), F.skewness(x).alias("__g"), F.kurtosis(x).alias("__k"))
    n, root = F.when(F.col("n") >= 8, F.col("n")), F.sqrt
    y = F.col("__g") * root((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w = root(2 * (b - 1)) - 1
    skew = F.asinh(y / root(2 / (w - 1))) / root(0.5 * F.ln(w))
    spread = root(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    k = (F.col("__k") + 3 - 3 * (n - 1) / (n + 1)) / spread
    q = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * root(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / q * (2 / q + root(1 + 4 / (q * q)))
    d = 1 + k * root(2 / (a - 4))
    tails = (1 - 2 / (9 * a) - F.signum(d) * F.cbrt(div(1 - 2 / a, F.abs(d)))) / root(2 / (9 * a))
    out = s.select(entity, F.col("n").cast("long").alias("n"), (skew * skew + tails * tails).alias("statistic"))
    return out.withColumn("pvalue", F.exp(-F.col("statistic") / 2))


def avg_skewness(df: DataFrame, entity: str, time: str, ret: str, window: int) -> DataFrame:
    """(time, avg_skew, n_entities): mean over entities of each one's skew over its own last ``window`` values."""
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(1 - window, 0)
    rows = df.select(entity, time, clean(F.col(ret)).alias("__r")).where("__r is not null")
    rows = rows.select(time, F.when(F.count(F.lit(1)).over(w) >= window, F.skewness("__r").over(w)).alias("__g"))
    return rows.groupBy(time).agg(F.avg("__g").alias("avg_skew"), F.count("__g").alias("n_entities"))


def breadth(df: DataFrame, time: str, statistic: str, critical: float, least: int = 1) -> DataFrame:
    """(time, breadth): the share of a date's entities whose statistic is above the critical value."""
    s = clean(F.col(statistic))
    share = F.avg((s > critical).cast("double"))
    return df.groupBy(time).agg(F.when(F.count(s) >= least, share).alias("breadth"))


def xs_wasserstein(df: DataFrame, time: str, value: str) -> DataFrame:
    """(time, xs_w1): area between the distribution functions of a date and of the date before it; null on the first.

    Each value takes part in two dates; the area is a sum over the gaps between the sorted values of both.
    """
    x = clean(F.col(value))
    rows = df.select(time, x.alias("__x")).where("__x is not null").groupBy(time, "__x").agg(F.count(F.lit(1)).alias("__k"))
    dates = rows.groupBy(time).agg(F.sum("__k").alias("__n"))  # one row per date: a window over the calendar
    dates = dates.withColumn("__next", F.lead(time).over(Window.orderBy(time)))
    rows = rows.join(dates, time).select(time, "__next", "__x", (F.col("__k") / F.col("__n")).alias("__p"))
    both = rows.select(time, "__x", "__p").unionAll(rows.where("__next is not null").select(F.col("__next").alias(time), "__x", (-F.col("__p")).alias("__p")))
    w = Window.partitionBy(time).orderBy("__x")
    both = both.select(time, F.sum("__p").over(w).alias("__f"), (F.lead("__x").over(w) - F.col("__x")).alias("__gap"))
    area = both.groupBy(time).agg(F.sum(F.abs(F.col("__f")) * F.coalesce("__gap", F.lit(0.0))).alias("__a"))
    first = dates.agg(F.min(time).alias("__first"))
    return area.join(F.broadcast(first)).select(time, F.when(F.col(time) > F.col("__first"), F.col("__a")).alias("xs_w1"))


def rank_turnover(df: DataFrame, entity: str, time: str, signal: str, least: int = 3) -> DataFrame:
    """One row, ``turnover``: 1 minus the mean over dates of the correlation of ranks with those of the date before."""
    rows = df.select(entity, time, clean(F.col(signal)).alias("__s")).where("__s is not null")
    dates = rows.select(time).distinct().withColumn("__d", F.row_number().over(Window.orderBy(time)))
    rows = rows.join(dates, time).withColumn("__r", average_rank(F.col("__s"), [F.col(time)]))
    w = Window.partitionBy(entity).orderBy(time)
    rows = rows.withColumn("__b", F.when(F.lag("__d").over(w) == F.col("__d") - 1, F.lag("__r").over(w)))
    each = rows.where("__b is not null").groupBy(time).agg(F.count(F.lit(1)).alias("__n"), F.covar_pop("__r", "__b").alias("__c"), (F.stddev_pop("__r") * F.stddev_pop("__b")).alias("__v"))
    return each.where(f"__n >= {least}").agg((1 - F.avg(div(F.col("__c"), F.col("__v")))).alias("turnover"))


def nexcp_quantile(df: DataFrame, entity: str, time, score: str, alpha: float = 0.1, rho: float = 0.99) -> DataFrame:
    """(entity, radius): the conformal quantile with weights that fall with age; null where the new point's weight is needed."""
    order = [time] if isinstance(time, str) else list(time)
    s, w = clean(F.col(score)), Window.partitionBy(entity)
    rows = df.select(entity, *order, s.alias("__s")).where("__s is not null")
    rows = rows.withColumn("__w", F.pow(F.lit(rho), F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))))
    rows = rows.withColumn("__c", F.sum("__w").over(w.orderBy("__s")) / (F.sum("__w").over(w) + 1))
    return rows.groupBy(entity).agg(F.min(F.when(F.col("__c") >= 1 - alpha, F.col("__s"))).alias("radius"))


def pastor_stambaugh_gamma(df: DataFrame, entity: str, time: str, ret: str, market: str, dollar_volume: str, n: int, scale: float = 1e-6, out: str = "gamma") -> DataFrame:
    """Liquidity gamma over the last n rows: excess return on the return and the signed volume of the row before."""
    w = Window.partitionBy(entity).orderBy(time)
    excess = clean(F.col(ret)) - clean(F.col(market))
    volume = F.when(clean(F.col(dollar_volume)) >= 0, clean(F.col(dollar_volume))) * scale
    rows = df.withColumns({"__y": excess, "__a": F.lag(clean(F.col(ret))).over(w), "__b": F.lag(F.signum(excess) * volume).over(w)})
    whole = (F.col("__y") + F.col("__a") + F.col("__b")).isNotNull()
    rows = rows.withColumns({c: F.when(whole, F.col(c)) for c in ("__y", "__a", "__b")})
    t = w.rowsBetween(1 - n, 0)
    cov = lambda p, q: F.covar_pop(p, q).over(t)
    rows = rows.withColumns({"__aa": cov("__a", "__a"), "__bb": cov("__b", "__b"), "__ab": cov("__a", "__b"), "__ay": cov("__a", "__y"), "__by": cov("__b", "__y"), "__n": F.count("__y").over(t)})
    det = F.col("__aa") * F.col("__bb") - F.col("__ab") * F.col("__ab")
    gamma = F.when((F.col("__n") >= n) & (det > 1e-12 * F.col("__aa") * F.col("__bb")), (F.col("__aa") * F.col("__by") - F.col("__ab") * F.col("__ay")) / F.when(det > 0, det))
    return rows.withColumn(out, gamma).drop(*[c for c in rows.columns if c.startswith("__")])


def phillips_perron(df: DataFrame, entity: str, time, column: str, lags: int, least: int = 8) -> DataFrame:
    """(entity, n, rho, statistic): Z_tau of a unit root, with a constant; null with fewer than ``least`` values."""
    order = [time] if isinstance(time, str) else list(time)
    w = Window.partitionBy(entity)
    rows = df.select(entity, *order, clean(F.col(column)).alias("__y")).where("__y is not null")
    rows = rows.withColumn("__l", F.lag("__y").over(w.orderBy(*order))).where("__l is not null")
    rho = div(F.covar_pop("__y", "__l").over(w), F.var_pop("__l").over(w))
    rows = rows.withColumns({"__rho": rho, "__my": F.avg("__y").over(w), "__ml": F.avg("__l").over(w)})
    rows = rows.withColumn("__u", F.col("__y") - F.col("__my") - F.col("__rho") * (F.col("__l") - F.col("__ml")))
    fit = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.first("__rho").alias("rho"), F.avg(F.col("__u") * F.col("__u")).alias("__g"), F.var_pop("__l").alias("__v"))
    out = fit.join(newey_west_variance(rows, entity, order, "__u", lags).drop("n"), entity, "left")
    n, g, positive = F.col("n"), F.col("__g"), lambda c: F.when(c > 1e-24, c)
    s = F.sqrt(positive(g) * n / F.when(n > 2, n - 2))
    se = s / F.sqrt(positive(n * F.col("__v")))
    long = positive(F.col("variance"))
    stat = F.sqrt(g / long) * (F.col("rho") - 1) / se - (long - g) * n * se / (2 * F.sqrt(long) * s)
    return out.select(entity, "n", "rho", F.when(n + 1 >= least, stat).alias("statistic"))


def mincer_zarnowitz_test(df: DataFrame, entity: str, y: str, forecast: str) -> DataFrame:
    """(entity, n, slope, statistic, pvalue): joint test of intercept 0 and slope 1 with errors robust to changing variance."""
    w = Window.partitionBy(entity)
    rows = df.select(entity, clean(F.col(y)).alias("__y"), clean(F.col(forecast)).alias("__f")).where("__y is not null and __f is not null")
    rows = rows.withColumns({"__slope": div(F.covar_pop("__y", "__f").over(w), F.var_pop("__f").over(w)), "__my": F.avg("__y").over(w), "__mf": F.avg("__f").over(w)})
    z = F.col("__f") - F.col("__mf")  # in terms of the centred forecast the two regressors are orthogonal
    u = F.col("__y") - F.col("__my") - F.col("__slope") * z
    s = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.first("__slope").alias("slope"), F.first("__my").alias("__my"), F.first("__mf").alias("__mf"), F.sum(z * z).alias("__zz"), F.sum(u * u).alias("__s0"), F.sum(u * u * z).alias("__s1"), F.sum(u * u * z * z).alias("__s2"))
    n, zz = F.col("n"), F.col("__zz")
    va, vab, vb = F.col("__s0") / (n * n), div(F.col("__s1"), n * zz), div(F.col("__s2"), zz * zz)
    a, b = F.col("__my") - F.col("__mf"), F.col("slope") - 1  # the hypothesis: mean of y is that of f, slope is 1
    det = va * vb - vab * vab
    out = s.withColumn("statistic", (vb * a * a - 2 * vab * a * b + va * b * b) / F.when(det > 1e-12 * va * vb, det))
    return out.select(entity, "n", "slope", "statistic").withColumn("pvalue", F.exp(-F.col("statistic") / 2))


def decile_monotonicity(df: DataFrame, time: str, signal: str, target: str, bins: int = 10) -> DataFrame:
    """One row, ``monotonicity``: rank correlation of the number of a bin with the mean over dates of the bin's mean target."""
    rows = df.select(time, clean(F.col(signal)).alias("__s"), clean(F.col(target)).alias("__t")).where("__s is not null and __t is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy(time))
    rank = average_rank(F.col("__s"), [F.col(time)])
    rows = rows.withColumn("__b", F.least(F.floor((rank - 1) * bins / n), F.lit(bins - 1)))
    each = rows.groupBy(time, "__b").agg(F.avg("__t").alias("__m")).groupBy("__b").agg(F.avg("__m").alias("__m"))  # at most one row per bin
    each = each.withColumns({"__x": F.row_number().over(Window.orderBy("__b")), "__y": average_rank(F.col("__m"), [F.lit(1)])})
    return each.agg(div(F.covar_pop("__x", "__y"), F.stddev_pop("__x") * F.stddev_pop("__y")).alias("monotonicity"))


def devolatilise(df: DataFrame, entity: str, time: str, column: str, n: int, out: str = "scaled") -> DataFrame:
    """The value over the standard deviation of the n rows before it; null where one of these is missing or they are equal."""
    x, w = clean(F.col(column)), Window.partitionBy(entity).orderBy(time).rowsBetween(-n, -1)
    return df.withColumn(out, F.when(F.count(x).over(w) >= n, div(x, F.stddev_samp(x).over(w))))
