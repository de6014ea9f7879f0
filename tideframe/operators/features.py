"""Bulk features of each entity's series: one window pass and one aggregation for all features asked for.

Order-dependent features read lags, leads and row numbers from columns that a single window makes; plain ones are
aggregates, with partial aggregation before the shuffle. Features over value counts add one two-level aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideframe.functions.core import clean, div

def _held(name: str) -> Callable[[], Column]:
    """A column of the window pass, made when it is used: there may be no session at import."""
    return lambda: F.col(name)


X, N, RN, MEAN, MIN, MAX, SD, SIDE = map(_held, ("__x", "__n", "__rn", "__mean", "__min", "__max", "__sd", "__side"))


def lag(k: int) -> Column:
    return F.col(f"__lag{k}")


def lead(k: int) -> Column:
    return F.col(f"__lead{k}")


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def _count(c: Column) -> Column:
    return F.sum(_flag(c)).cast("long")


def autocorrelation(k: int) -> Column:
    return div(F.sum((X() - MEAN()) * (lag(k) - MEAN())), F.max(N() - k) * F.var_pop(X()))


def c3(k: int) -> Column:
    return div(F.sum(X() * lag(k) * lag(2 * k)), F.max(N() - 2 * k))


def cid_ce(normalize: bool = False) -> Column:
    d = F.sqrt(F.sum((X() - lead(1)) * (X() - lead(1))))
    return div(d, F.stddev_pop(X())) if normalize else d


def number_peaks(support: int) -> Column:
    peak = F.lit(True)
    for i in range(1, support + 1):
        peak &= (X() > lag(i)) & (X() > lead(i))
    return _count(peak)


def time_reversal_asymmetry(k: int) -> Column:
    return F.avg(lead(2 * k) * lead(2 * k) * lead(k) - lead(k) * X() * X())


def benford_correlation() -> Column:
    digit = F.floor(F.abs(X()) / F.pow(F.lit(10.0), F.floor(F.log10(F.when(X() != 0, F.abs(X()))))))
    n = F.count(F.when(X() != 0, X()))
    share = [div(_count(digit == k), n) for k in range(1, 10)]
    law = [math.log10(1 + 1 / k) for k in range(1, 10)]
    mean = sum(share[1:], share[0]) / 9.0
    centre = sum(law) / 9
    cov = var = F.lit(0.0)
    for s, v in zip(share, law, strict=True):
        cov, var = cov + (s - mean) * (v - centre), var + (s - mean) * (s - mean)
    return div(cov, F.sqrt(var) * math.sqrt(sum((v - centre) ** 2 for v in law)))


#: Feature -> aggregate over the columns of the window pass.
FEATURES: dict[str, Callable[[], Column]] = {
    "absolute_energy": lambda: F.sum(X() * X()),
    "absolute_maximum": lambda: F.max(F.abs(X())),
    "absolute_sum_of_changes": lambda: F.sum(F.abs(X() - lag(1))),
    "autocorrelation_1": lambda: autocorrelation(1),
    "autocorrelation_2": lambda: autocorrelation(2),
    "root_mean_square": lambda: F.sqrt(F.avg(X() * X())),
    "benford_correlation": lambda: benford_correlation(),
    "c3_1": lambda: c3(1),
    "c3_2": lambda: c3(2),
    "cid_ce": lambda: cid_ce(),
    "cid_ce_normalized": lambda: cid_ce(True),
    "count_above_0": lambda: 100 * div(_count(X() >= 0), F.count(F.lit(1))),
    "count_below_0": lambda: 100 * div(_count(X() <= 0), F.count(F.lit(1))),
    "count_above_mean": lambda: _count(SIDE() > 0),
    "count_below_mean": lambda: _count(SIDE() < 0),
    "first_location_of_maximum": lambda: div(F.min(F.when(X() == MAX(), RN())) - 1, F.max(N())),
    "first_location_of_minimum": lambda: div(F.min(F.when(X() == MIN(), RN())) - 1, F.max(N())),
    "last_location_of_maximum": lambda: div(F.max(F.when(X() == MAX(), RN())), F.max(N())),
    "last_location_of_minimum": lambda: div(F.max(F.when(X() == MIN(), RN())), F.max(N())),
    "has_duplicate": lambda: F.count(X()) != F.count_distinct(X()),
    "has_duplicate_max": lambda: _count(X() == MAX()) > 1,
    "has_duplicate_min": lambda: _count(X() == MIN()) > 1,
    "large_standard_deviation": lambda: F.stddev_samp(X()) > 0.25 * (F.max(X()) - F.min(X())),
    "linear_trend_slope": lambda: F.regr_slope(X(), (RN() - 1).cast("double")),
    "linear_trend_intercept": lambda: F.regr_intercept(X(), (RN() - 1).cast("double")),
    "linear_trend_rss": lambda: F.regr_syy(X(), (RN() - 1).cast("double")) - F.regr_slope(X(), (RN() - 1).cast("double")) * F.regr_sxy(X(), (RN() - 1).cast("double")),
    "mean_abs_change": lambda: F.avg(F.abs(X() - lag(1))),
    "max_abs_change": lambda: F.max(F.abs(X() - lag(1))),
    "mean_change": lambda: div(F.max(F.when(RN() == N(), X())) - F.max(F.when(RN() == 1, X())), F.max(F.when(N() > 1, N() - 1))),
    "mean_second_derivative_central": lambda: div(F.max(F.when(RN() == N(), X())) - F.max(F.when(RN() == N() - 1, X())) - F.max(F.when(RN() == 2, X())) + F.max(F.when(RN() == 1, X())), 2 * F.max(N() - 2)),
    "number_crossings_0": lambda: _count((X() > 0) != (lag(1) > 0)),
    "number_peaks_1": lambda: number_peaks(1),
    "number_peaks_3": lambda: number_peaks(3),
    "range_count_0_1": lambda: _count((X() >= 0) & (X() < 1)),
    "ratio_beyond_1_sigma": lambda: div(_count(F.abs(X() - MEAN()) > SD()), F.count(F.lit(1))),
    "ratio_n_unique_to_length": lambda: div(F.count_distinct(X()), F.count(F.lit(1))),
    "symmetry_looking": lambda: F.abs(F.avg(X()) - F.percentile(X(), 0.5)) < 0.25 * (F.max(X()) - F.min(X())),
    "time_reversal_asymmetry_1": lambda: time_reversal_asymmetry(1),
    "variation_coefficient": lambda: div(F.stddev_samp(X()), F.avg(X())),
    "var_gt_std": lambda: F.var_samp(X()) > F.stddev_samp(X()),
    "harmonic_mean": lambda: div(F.count(X()), F.sum(div(F.lit(1.0), X()))),
    "range_over_mean": lambda: div(F.max(X()) - F.min(X()), F.avg(X())),
    "range_change": lambda: div(F.max(X()), F.min(X())) - 1,
    "realized_volatility": lambda: F.sqrt(F.sum(F.pow(F.when((X() > 0) & (lag(1) > 0), F.ln(X()) - F.ln(lag(1))), F.lit(2.0)))),
    "return_skew": lambda: F.skewness(div(X(), lag(1)) - 1),
    "return_kurtosis": lambda: F.kurtosis(div(X(), lag(1)) - 1),
    "num_direction_changes": lambda: _count((F.signum(X() - lag(1)) != F.signum(lag(1) - lag(2)))),
    "max_drawdown": lambda: F.min(div(X(), F.col("__top")) - 1),
}
#: Lags and leads that the pass holds.
LAGS, LEADS = 4, 4


def side_of_mean(x: Column, every: WindowSpec) -> Column:
    """1, 0 or -1: whether x is above, at or below the mean of its window; null for null.

    A floating-point mean depends on the order of its sum, and a value that equals the mean falls on either side of it. Values of up to
    8 decimals are therefore summed as decimals, which is exact; the others of a window are compared as doubles.
    """
    d = x.try_cast("decimal(24,8)")
    exact = F.coalesce(F.min(F.when(x.isNotNull(), F.coalesce(d.cast("double") == x, F.lit(False)))).over(every), F.lit(True))
    total, n = F.sum(d).over(every), F.count(x).over(every).try_cast("decimal(10,0)")
    known = exact & total.isNotNull() & n.isNotNull()
    return F.when(x.isNotNull(), F.when(known, F.signum(d * n - total)).otherwise((x > F.avg(x).over(every)).cast("int") - (x < F.avg(x).over(every)).cast("int")).cast("int"))


def window_pass(df: DataFrame, entity: str, time: Sequence[str], column: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns that the features read: the value, its place, its neighbours, and its entity's moments."""
    w = Window.partitionBy(entity).orderBy(*time)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.select(F.col(entity), *[F.col(t) for t in time if t != column], *[F.col(k) for k in keep], clean(F.col(column)).alias("__x"))
    new = {"__rn": F.row_number().over(w), "__n": F.count(F.lit(1)).over(every), "__mean": F.avg("__x").over(every), "__min": F.min("__x").over(every), "__max": F.max("__x").over(every), "__sd": F.stddev_samp("__x").over(every), "__top": F.max("__x").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__side": side_of_mean(X(), every)}
    new |= {f"__lag{k}": F.lag("__x", k).over(w) for k in range(1, LAGS + 1)} | {f"__lead{k}": F.lead("__x", k).over(w) for k in range(1, LEADS + 1)}
    return df.withColumns(new)


def extract_features(df: DataFrame, entity: str, time: str | Sequence[str], column: str, features: str | Sequence[str] = "all") -> DataFrame:
    """One row per entity with the features asked for."""
    names = list(FEATURES) if features == "all" else list(features)
    held = window_pass(df, entity, [time] if isinstance(time, str) else time, column)
    return held.groupBy(entity).agg(*[FEATURES[n]().alias(n) for n in names])


def value_count_features(df: DataFrame, entity: str, column: str) -> DataFrame:
    """Features of repeated values, from the counts of each value."""
    counts = df.groupBy(entity, clean(F.col(column)).alias("__x")).agg(F.count(F.lit(1)).alias("c"))
    many = F.col("c") > 1
    return counts.groupBy(entity).agg(
        (1 - div(_count(~many), F.sum("c"))).alias("percent_reoccurring_points"),
        div(_count(many), F.count(F.lit(1))).alias("percent_reoccurring_values"),
        F.coalesce(F.sum(F.when(many, X() * F.col("c"))), F.lit(0.0)).alias("sum_reoccurring_points"),
        F.coalesce(F.sum(F.when(many, X())), F.lit(0.0)).alias("sum_reoccurring_values"),
    )


def binned_entropy(df: DataFrame, entity: str, column: str, bins: int = 10) -> DataFrame:
    w = Window.partitionBy(entity)
    x = clean(F.col(column))
    held = df.select(entity, x.alias("__x"), F.min(x).over(w).alias("lo"), F.max(x).over(w).alias("hi")).where("__x is not null")
    place = F.least(F.floor(F.coalesce(div((X() - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1))
    counts = held.groupBy(entity, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(w)
    p = counts.select(entity, (F.col("c") / total).alias("p"))
    return p.groupBy(entity).agg((-F.sum(F.col("p") * F.ln("p"))).alias("binned_entropy"))


def energy_ratios(df: DataFrame, entity: str, time: Sequence[str], column: str, chunks: int = 10) -> DataFrame:
    held = window_pass(df, entity, time, column)
    size = F.ceil(N() / chunks)
    total = F.sum(X() * X())
    parts = [F.coalesce(div(F.sum(F.when(F.floor((RN() - 1) / size) == k, X() * X())), total), F.lit(0.0)) for k in range(chunks)]
    return held.groupBy(entity).agg(F.array(*parts).alias("energy_ratios"))


def index_mass_quantile(df: DataFrame, entity: str, time: Sequence[str], column: str, q: float) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(*time)
    mass = F.abs(clean(F.col(column)))
    held = df.select(entity, F.row_number().over(w).alias("rn"), F.sum(mass).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.sum(mass).over(Window.partitionBy(entity)).alias("t"), F.count(F.lit(1)).over(Window.partitionBy(entity)).alias("n"))
    return held.groupBy(entity).agg(div(F.min(F.when((F.col("t") > 0) & (F.col("s") >= q * F.col("t")), F.col("rn"))), F.max("n")).alias("index_mass_quantile"))


def mean_n_absolute_max(df: DataFrame, entity: str, column: str, n: int) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(F.abs(clean(F.col(column))).desc_nulls_last())
    held = df.select(entity, F.abs(clean(F.col(column))).alias("a"), F.row_number().over(w).alias("k")).where(F.col("k") <= n)
    return held.groupBy(entity).agg(F.avg("a").alias("mean_n_absolute_max"))


def permutation_entropy(df: DataFrame, entity: str, time: Sequence[str], column: str, dims: int = 3, tau: int = 1) -> DataFrame:
    """Entropy of the order patterns of ``dims`` values ``tau`` apart; equal values are ordered by place."""
    w = Window.partitionBy(entity).orderBy(*time)
    x = clean(F.col(column))
    at = [x if i == 0 else F.lead(x, i * tau).over(w) for i in range(dims)]
    held = df.select(entity, *[c.alias(f"v{i}") for i, c in enumerate(at)]).dropna()
    pattern = F.lit(0)
    for i in range(dims):
        place = F.lit(0)
        for j in range(dims):
            if j != i:
                before = F.col(f"v{j}") <= F.col(f"v{i}") if j < i else F.col(f"v{j}") < F.col(f"v{i}")
                place = place + _flag(before)
        pattern = pattern * dims + place
    counts = held.groupBy(entity, pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("c"))
    p = counts.select(entity, (F.col("c") / F.sum("c").over(Window.partitionBy(entity))).alias("p"))
    return p.groupBy(entity).agg((-F.sum(F.col("p") * F.ln("p"))).alias("permutation_entropy"))


def streaks(df: DataFrame, entity: str, time: Sequence[str], condition: Column, carry: Sequence[Column] = ()) -> DataFrame:
    """Lengths of the runs of rows that meet the condition: (entity, length), by gaps and islands."""
    w = Window.partitionBy(entity).orderBy(*time)
    held = df.select(entity, *time, condition.alias("__on")).withColumn("__rn", F.row_number().over(w))
    island = held.where("__on").withColumn("__island", F.col("__rn") - F.row_number().over(w))
    return island.groupBy(entity, "__island").agg(F.count(F.lit(1)).alias("length")).select(entity, "length")


def streak_features(df: DataFrame, entity: str, time: Sequence[str], column: str) -> DataFrame:
    """Longest runs above and below the mean, and of rises and falls (a rise or fall may be of nothing)."""
    held = window_pass(df, entity, time, column)
    # the one shuffle by entity serves the pass and all four island windows
    keys = held.select(entity).distinct()
    out = keys
    for name, condition in (("longest_streak_above_mean", SIDE() > 0), ("longest_streak_below_mean", SIDE() < 0), ("longest_winning_streak", X() - lag(1) >= 0), ("longest_losing_streak", X() - lag(1) <= 0)):
        best = streaks(held, entity, time, condition).groupBy(entity).agg(F.max("length").alias(name))
        out = out.join(best, entity, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))
    return out


def change_quantiles(df: DataFrame, entity: str, time: Sequence[str], column: str, low: float, high: float, absolute: bool = True) -> DataFrame:
    """Mean change between neighbours that are both inside the corridor of the two quantiles."""
    w = Window.partitionBy(entity).orderBy(*time)
    x, every = clean(F.col(column)), Window.partitionBy(entity)
    held = df.select(entity, x.alias("x"), F.lag(x).over(w).alias("b"), F.percentile(x, low).over(every).alias("lo"), F.percentile(x, high).over(every).alias("hi"))
    inside = F.col("x").between(F.col("lo"), F.col("hi")) & F.col("b").between(F.col("lo"), F.col("hi"))
    change = F.col("x") - F.col("b")
    return held.groupBy(entity).agg(F.avg(F.when(inside, F.abs(change) if absolute else change)).alias("change_quantiles"))


def longest_streak(df: DataFrame, entity: str, time: Sequence[str], column: str, threshold: float, above: bool = True) -> DataFrame:
    """Longest run of changes of at least (at most) the threshold; 0 for an entity without one."""
    held = window_pass(df, entity, time, column)
    change = X() - lag(1)
    best = streaks(held, entity, time, change >= threshold if above else change <= threshold).groupBy(entity).agg(F.max("length").alias("longest_streak"))
    return held.select(entity).distinct().join(best, entity, "left").select(entity, F.coalesce("longest_streak", F.lit(0)).cast("long").alias("longest_streak"))


def streak_length_stats(df: DataFrame, entity: str, time: Sequence[str], column: str, threshold: float, above: bool = True) -> DataFrame:
    """Statistics of the lengths of the runs of changes of at least (at most) the threshold."""
    held = window_pass(df, entity, time, column)
    change = X() - lag(1)
    runs = streaks(held, entity, time, change >= threshold if above else change <= threshold)
    n = F.col("length")
    return runs.groupBy(entity).agg(
        F.min(n).alias("min"),
        F.max(n).alias("max"),
        F.avg(n).alias("mean"),
        F.stddev_samp(n).alias("std"),
        F.percentile(n, 0.1).alias("p10"),
        F.percentile(n, 0.5).alias("median"),
        F.percentile(n, 0.9).alias("p90"),
        F.mode(n, True).alias("mode"),
    )


def signed_mci(trade: Column, bid: Column, ask: Column, side: Column) -> Column:
    """Cost that an aggressive order pays against the middle of the quotes."""
    return side * (trade - (bid + ask) / 2)


def marginal_cost_of_immediacy(bid: Column, ask: Column) -> Column:
    """Half of the quoted spread."""
    return (ask - bid) / 2


def count_threshold(df: DataFrame, entity: str, column: str, threshold: float, above: bool = True) -> DataFrame:
    """Per cent of an entity's rows at or above (below) a threshold."""
    x = clean(F.col(column))
    return df.groupBy(entity).agg((100 * div(_count(x >= threshold if above else x <= threshold), F.count(F.lit(1)))).alias("percent"))
