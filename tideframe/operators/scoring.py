"""Scores of forecasts as columns, losses per date, and the tests on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.core import clean, div

MOST_DATES = 1_000_000


def pinball(y: Column, q: Column, level: float) -> Column:
    d = clean(y) - clean(q)
    return F.when(d >= 0, level * d).otherwise((level - 1) * d)


def interval_score(y: Column, low: Column, high: Column, alpha: float) -> Column:
    y, low, high = clean(y), clean(low), clean(high)
    return (high - low) + 2 / alpha * F.when(y < low, low - y).otherwise(0.0) + 2 / alpha * F.when(y > high, y - high).otherwise(0.0)


def crps_from_quantiles(y: Column, quantiles: Sequence[Column], levels: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for q, p in zip(quantiles, levels, strict=True):
        total = total + pinball(y, q, p)
    return 2 * total / len(levels)


def exceedance(y: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    out = F.lit(False)
    out = out | (clean(y) < clean(lower)) if lower is not None else out
    return (out | (clean(y) > clean(upper)) if upper is not None else out).cast("int")


LOSSES = {
    "squared": lambda y, f: (y - f) * (y - f),
    "absolute": lambda y, f: F.abs(y - f),
    "qlike": lambda y, f: div(y, f) - F.ln(F.when(div(y, f) > 0, div(y, f))) - 1,
}


def loss_panel(df: DataFrame, time: str, target: str, forecasts: Sequence[str], loss: str = "squared") -> DataFrame:
    """(time, one mean loss per forecast) over the rows that have all of them: the series that tests compare."""
    y, ok = clean(F.col(target)), clean(F.col(target)).isNotNull()
    for f in forecasts:
        ok &= clean(F.col(f)).isNotNull()
    return df.where(ok).groupBy(time).agg(*[F.avg(LOSSES[loss](y, clean(F.col(f)))).alias(f) for f in forecasts])


def loss_series(losses: DataFrame, time: str, forecasts: Sequence[str]):
    """The losses in time order as a matrix: one row per date, so its size is that of the calendar."""
    pdf = losses.orderBy(time).limit(MOST_DATES + 1).toPandas()
    if len(pdf) > MOST_DATES:
        raise ValueError("too many dates")
    return pdf[list(forecasts)].to_numpy(float)


def pit_histogram(df: DataFrame, pit: str, bins: int = 10) -> DataFrame:
    x = clean(F.col(pit))
    return df.where(x.isNotNull()).groupBy(F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def murphy(df: DataFrame, y: str, forecast: str, thetas: Sequence[float]) -> DataFrame:
    """(theta, score): mean elementary scores of a mean forecast over a grid of thresholds, in one pass."""
    a, f = clean(F.col(y)), clean(F.col(forecast))
    one = lambda t: F.avg(F.when((F.least(a, f) <= t) & (t < F.greatest(a, f)), F.abs(a - t)).otherwise(0.0))
    row = df.where(a.isNotNull() & f.isNotNull()).agg(F.array(*[F.struct(F.lit(float(t)).alias("theta"), one(float(t)).alias("score")) for t in thetas]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def corp_bins(df: DataFrame, forecast: str, outcome: str, bins: int = 20) -> DataFrame:
    """Reliability: mean outcome against mean forecast in quantile bins of the forecast."""
    cuts = df.agg(F.percentile(forecast, [i / bins for i in range(1, bins)]).alias("__c"))
    b = F.size(F.filter("__c", lambda c: c < F.col(forecast)))
    return df.where(F.col(forecast).isNotNull() & F.col(outcome).isNotNull()).join(F.broadcast(cuts)).groupBy(b.alias("bin")).agg(F.avg(forecast).alias("forecast"), F.avg(outcome).alias("outcome"), F.count(F.lit(1)).alias("n"))


def baselines(df: DataFrame, entity: str, time: str, target: str, season: int | None = None, half_life: float = 20.0) -> DataFrame:
    """Naive forecasts of the next row: the last value, the trailing mean, and the last season."""
    w = Window.partitionBy(entity).orderBy(time)
    x = clean(F.col(target))
    new = {"naive_last": F.lag(x).over(w), "naive_mean": F.avg(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), "naive_zero": F.lit(0.0)}
    if season:
        new["naive_season"] = F.lag(x, season).over(w)
    return df.withColumns(new)
