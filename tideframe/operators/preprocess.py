"""Preparation of panels: differencing, lags, rolling statistics, grids, resampling, imputation, scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.core import clean, div
from tideframe.panel import PanelFrame


def _cols(p: PanelFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else p.value_columns


def diff(p: PanelFrame, order: int = 1, sp: int = 1, columns: Sequence[str] | None = None) -> PanelFrame:
    """x - x ``sp`` rows ago, ``order`` times; lags of the original are combined with binomial weights in one window."""
    new = {}
    for c in _cols(p, columns):
        new[c] = sum(((-1) ** k * math.comb(order, k) * (F.lag(c, k * sp).over(p.window) if k else F.col(c)) for k in range(1, order + 1)), F.col(c).cast("double"))
    return p.with_columns(**new)


def lag(p: PanelFrame, lags: Sequence[int], columns: Sequence[str] | None = None, drop: bool = True) -> PanelFrame:
    """Columns ``c__lag_k``; the first max(lags) rows of each entity go."""
    new = {f"{c}__lag_{k}": F.lag(c, k).over(p.window) for c in _cols(p, columns) for k in lags}
    df = p.df.withColumns(new | {"__rn": F.row_number().over(p.window)})
    if drop:
        df = df.where(F.col("__rn") > max(lags))
    return p._with(df.drop("__rn"))


def roll(p: PanelFrame, windows: Sequence[int], stats: Sequence[str], columns: Sequence[str] | None = None, shift: bool = True) -> PanelFrame:
    """``c__rolling_stat_w``: mean, min, max, mlm (max less min), sum, std or cv of the w rows up to w rows ago (no shift: up to now)."""
    new = {}
    for c in _cols(p, columns):
        x = clean(F.col(c))
        for w in windows:
            back = w if shift else 0
            f = p.window.rowsBetween(-(w - 1) - back, -back)
            made = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp}
            for s in stats:
                v = made[s](x).over(f) if s in made else F.max(x).over(f) - F.min(x).over(f) if s == "mlm" else div(F.stddev_samp(x).over(f), F.avg(x).over(f))
                new[f"{c}__rolling_{s}_{w}"] = F.when(F.count(x).over(f) >= w, v)
    return p.with_columns(**new)


def reindex(p: PanelFrame) -> PanelFrame:
    """Every pair of an entity and a time; missing rows are null. The grid is entities x times by definition."""
    times = p.df.select(p.time).distinct().agg(F.array_sort(F.collect_set(p.time)).alias("__times"))
    grid = p.df.select(p.entity).distinct().join(F.broadcast(times)).select(p.entity, F.explode("__times").alias(p.time))
    return p._with(grid.join(p.df, [p.entity, p.time], "left"))


def time_to_arange(p: PanelFrame) -> PanelFrame:
    df = p.df.withColumn("__t", F.row_number().over(p.window) - 1).drop(p.time).withColumnRenamed("__t", p.time)
    return p._with(df.select(*p.df.columns))


def resample(p: PanelFrame, freq: str, how: str = "mean", label: str = "right", columns: Sequence[str] | None = None) -> PanelFrame:
    """Buckets [s, s + freq) of each entity; ``label`` right (the end; free of look-ahead) or left."""
    f = {"sum": F.sum, "mean": F.avg, "median": lambda c: F.percentile(c, 0.5)}[how]
    bucket = F.window(F.col(p.time).cast("timestamp"), freq)
    df = p.df.groupBy(p.entity, bucket.alias("__w")).agg(*[f(c).alias(c) for c in _cols(p, columns)])
    at = F.col("__w.end" if label == "right" else "__w.start")
    return PanelFrame(df.select(p.entity, at.alias(p.time), *_cols(p, columns)), p.entity, p.time)


def trim(p: PanelFrame, direction: str = "both") -> PanelFrame:
    """Rows inside the span that all entities share: from the latest first time, to the earliest last time, or both."""
    ends = p.df.groupBy(p.entity).agg(F.min(p.time).alias("a"), F.max(p.time).alias("b")).agg(F.max("a").alias("__lo"), F.min("b").alias("__hi"))
    t, keep = F.col(p.time), F.lit(True)
    if direction in ("both", "left"):
        keep &= t >= F.col("__lo")
    if direction in ("both", "right"):
        keep &= t <= F.col("__hi")
    return p._with(p.df.join(F.broadcast(ends)).where(keep).drop("__lo", "__hi"))


def impute(p: PanelFrame, method: str | float = "ffill", columns: Sequence[str] | None = None, allow_leaky: bool = False) -> PanelFrame:
    """ffill, mean, median, constant (a number), and, since they read the future, bfill and interpolate if allowed."""
    if method in ("bfill", "interpolate", "mean", "median") and not allow_leaky and method in ("bfill", "interpolate"):
        raise ValueError(f"{method} looks ahead: pass allow_leaky=True")
    past, every = p.window.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(p.entity)
    # backwards, since Spark goes through all the rows of a frame that begins at its row anew for each
    ahead = every.orderBy(F.desc("__rn")).rowsBetween(Window.unboundedPreceding, 0)
    df, new = p.df, {}
    if method in ("bfill", "interpolate"):
        df = df.withColumn("__rn", F.row_number().over(p.window))
    for c in _cols(p, columns):
        x = clean(F.col(c))
        if method == "ffill":
            y = F.last(x, ignorenulls=True).over(past)
        elif method == "bfill":
            y = F.last(x, ignorenulls=True).over(ahead)
        elif method in ("mean", "median"):
            y = (F.avg(x) if method == "mean" else F.percentile(x, 0.5)).over(every)
        elif method == "interpolate":
            at = F.when(x.isNotNull(), F.struct(F.col("__rn").alias("k"), x.alias("x")))
            a, b = F.last(at, ignorenulls=True).over(past), F.last(at, ignorenulls=True).over(ahead)
            y = a["x"] + (b["x"] - a["x"]) * F.coalesce(div(F.col("__rn") - a["k"], b["k"] - a["k"]), F.lit(0.0))
        else:
            y = F.lit(float(method))
        new[c] = F.coalesce(x, y)
    return p._with(df.withColumns(new).drop("__rn"))


def detrend(p: PanelFrame, method: str = "linear", columns: Sequence[str] | None = None) -> PanelFrame:
    df = p.df.withColumn("__rn", (F.row_number().over(p.window) - 1).cast("double"))
    every, new = Window.partitionBy(p.entity), {}
    for c in _cols(p, columns):
        x = clean(F.col(c))
        if method == "linear":
            new[c] = x - (F.regr_intercept(x, F.col("__rn")).over(every) + F.regr_slope(x, F.col("__rn")).over(every) * F.col("__rn"))
        else:
            new[c] = x - F.avg(x).over(every)
    return p._with(df.withColumns(new).drop("__rn"))


def scale(p: PanelFrame, mean: bool = True, std: bool = True, columns: Sequence[str] | None = None) -> tuple[PanelFrame, DataFrame]:
    """Per-entity scaling and the table of statistics that inverts it (:func:`unscale`)."""
    names = _cols(p, columns)
    stats = p.df.groupBy(p.entity).agg(*[f(clean(F.col(c))).alias(f"{c}__{n}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    new = {c: div(F.col(c) - (F.col(f"{c}__mean") if mean else F.lit(0.0)), F.col(f"{c}__std") if std else F.lit(1.0)) for c in names}
    df = p.df.join(stats, p.entity).withColumns(new).select(*p.df.columns)
    return p._with(df), stats


def unscale(p: PanelFrame, stats: DataFrame, mean: bool = True, std: bool = True, columns: Sequence[str] | None = None) -> PanelFrame:
    names = _cols(p, columns)
    new = {c: F.col(c) * (F.col(f"{c}__std") if std else F.lit(1.0)) + (F.col(f"{c}__mean") if mean else F.lit(0.0)) for c in names}
    return p._with(p.df.join(stats, p.entity).withColumns(new).select(*p.df.columns))


def one_hot(df: DataFrame, column: str, values: Sequence | None = None, drop_first: bool = False, most: int = 1000) -> DataFrame:
    """0/1 columns ``column__value``; the values are found in the data (at most ``most``) unless given."""
    if values is None:
        values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"more than {most} values")
    return df.withColumns({f"{column}__{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values[int(drop_first) :]})


def coerce_dtypes(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in schema.items()})


CALENDAR = {
    "minute": F.minute,
    "hour": F.hour,
    "day": F.dayofmonth,
    "weekday": lambda t: F.weekday(t) + 1,
    "week": F.weekofyear,
    "month": F.month,
    "quarter": F.quarter,
    "year": F.year,
}


def add_calendar_effects(df: DataFrame, time: str, attrs: Sequence[str], as_dummies: bool = False) -> DataFrame:
    df = df.withColumns({a: CALENDAR[a](F.col(time)).cast("string") for a in attrs})
    for a in attrs if as_dummies else ():
        df = one_hot(df, a).drop(a)
    return df


def add_holiday_effects(df: DataFrame, time: str, holidays: DataFrame, date: str = "date", name: str = "holiday") -> DataFrame:
    """Joins a table of holidays by day; the calendar itself is an input."""
    return df.join(holidays.select(F.to_date(date).alias("__d"), name), F.to_date(time) == F.col("__d"), "left").drop("__d")


def add_fourier_terms(p: PanelFrame, sp: int, k: int) -> PanelFrame:
    df = p.df.withColumn("__rn", F.row_number().over(p.window))
    new = {}
    for i in range(1, k + 1):
        angle = 2 * math.pi * i * F.col("__rn") / sp
        new |= {f"sin_{sp}_{i}": F.sin(angle), f"cos_{sp}_{i}": F.cos(angle)}
    return p._with(df.withColumns(new).drop("__rn"))


# fixed values: seasonal periods of offset aliases
SEASONAL_PERIODS = {"1s": 60, "1m": 60, "30m": 48, "1h": 24, "1d": 30, "1w": 52, "1mo": 12, "3mo": 4, "1y": 1}


def freq_to_sp(freq: str) -> int:
    return SEASONAL_PERIODS[freq]


def power_lambda(df: DataFrame, entity: str, column: str, kind: str = "boxcox", low: float = -2.0, high: float = 2.0, steps: int = 81, rounds: int = 3) -> DataFrame:
    """(entity, lambda) of the largest likelihood: a grid over [low, high], refined round by round around the best point.

    Each round is one aggregation of the grid's log-likelihoods, so an entity's rows are never gathered.
    """
    x = clean(F.col(column))
    made = boxcox if kind == "boxcox" else yeojohnson
    jacobian = F.ln(x) if kind == "boxcox" else F.signum(x) * F.ln(F.abs(x) + 1)
    rows = df.select(entity, x.alias("__x"), jacobian.alias("__j"))
    if kind == "boxcox":
        rows = rows.where("__x > 0")
    ends = rows.select(entity).distinct().select(entity, F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
    for _ in range(rounds):
        held = rows.join(ends, entity)
        step = (F.col("hi") - F.col("lo")) / (steps - 1)
        like = [F.struct((-F.count("__x") / 2 * F.ln(F.nullif(F.var_pop(made(F.col("__x"), F.col("lo") + step * i)), F.lit(0.0))) + F.sum("__j") * (F.first("lo") + F.first(step) * i) - (F.sum("__j") if kind == "boxcox" else F.sum("__j"))).alias("ll"), (F.first("lo") + F.first(step) * i).alias("l")) for i in range(steps)]
        best = held.groupBy(entity).agg(F.array_max(F.array(*like)).alias("b"), F.first(step).alias("s"))
        ends = best.select(entity, (F.col("b.l") - F.col("s")).alias("lo"), (F.col("b.l") + F.col("s")).alias("hi"))
    return ends.select(entity, ((F.col("lo") + F.col("hi")) / 2).alias("lambda"))


def boxcox(x: Column, lam: Column | float) -> Column:
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    return F.when(F.abs(lam) < 1e-9, F.ln(x)).otherwise(div(F.pow(x, lam) - 1, F.when(F.abs(lam) < 1e-9, F.lit(1.0)).otherwise(lam)))


def yeojohnson(x: Column, lam: Column | float) -> Column:
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    up = F.when(F.abs(lam) < 1e-9, F.ln(F.abs(x) + 1)).otherwise(div(F.pow(F.abs(x) + 1, lam) - 1, F.when(F.abs(lam) < 1e-9, F.lit(1.0)).otherwise(lam)))
    two = 2 - lam
    down = F.when(F.abs(two) < 1e-9, -F.ln(F.abs(x) + 1)).otherwise(-div(F.pow(F.abs(x) + 1, two) - 1, F.when(F.abs(two) < 1e-9, F.lit(1.0)).otherwise(two)))
    return F.when(x >= 0, up).otherwise(down)


NUMERIC = T.NumericType
