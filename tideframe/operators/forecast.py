"""Forecasting by reduction to regression on lags: pooled or per entity, recursive or direct, with backtests and intervals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.core import clean
from tideframe.operators import panelreg


def make_reduction(df: DataFrame, entity: str, time: str, y: str, lags: int, x: Sequence[str] = (), ahead: int = 0) -> DataFrame:
    """Rows (entity, time, y, lags, x): the table a regression learns from; ``ahead`` steps lie between y and its nearest lag."""
    w = Window.partitionBy(entity).orderBy(time)
    new = {f"{y}__lag_{k}": F.lag(clean(F.col(y)), k + ahead).over(w) for k in range(1, lags + 1)}
    return df.select(entity, time, clean(F.col(y)).alias(y), *x).withColumns(new).dropna(subset=[y, *new])


@dataclass
class LagForecaster:
    """Linear model of ``lags`` lags, with a ridge penalty if asked for.

    strategy ``recursive`` feeds predictions back; ``direct`` fits one model per step. ``by_entity`` fits a model for each
    entity, else one for all. The fit is sums of products; nothing but those leaves the executors.
    """

    entity: str
    time: str
    y: str
    lags: int
    strategy: str = "recursive"
    horizon: int = 1
    ridge: float = 0.0
    by_entity: bool = False
    models: list[DataFrame] = field(default_factory=list)
    last: DataFrame | None = None

    def _solve(self, table: DataFrame) -> DataFrame:
        names = [f"{self.y}__lag_{k}" for k in range(1, self.lags + 1)]
        by = [self.entity] if self.by_entity else []
        g = panelreg.grams(table, by, [*names, self.y])
        k, ridge, key = len(names) + 2, self.ridge, self.entity
        fields = ([table.schema[self.entity]] if by else []) + [T.StructField("b", T.ArrayType(T.DoubleType()))]

        def solve(batches):
            import pandas as pd

            for pdf in batches:
                out = []
                for v in pdf.g:
                    m = panelreg._square(v, k)
                    a = m[:-1, :-1] + ridge * np.diag([0.0] + [1.0] * (k - 2))
                    out.append((np.linalg.pinv(a) @ m[:-1, -1]).tolist())
                yield pd.DataFrame({key: pdf[key], "b": out} if by else {"b": out})

        return g.mapInPandas(solve, T.StructType(fields))

    def fit(self, df: DataFrame) -> LagForecaster:
        steps = range(self.horizon) if self.strategy == "direct" else [0]
        self.models = [self._solve(make_reduction(df, self.entity, self.time, self.y, self.lags, ahead=h)) for h in steps]
        w = Window.partitionBy(self.entity).orderBy(F.col(self.time).desc())
        recent = df.select(self.entity, clean(F.col(self.y)).alias("v"), F.row_number().over(w).alias("k")).where(F.col("k") <= self.lags)
        last = recent.groupBy(self.entity).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("s"), F.count("v").alias("n")).where(F.col("n") == self.lags)
        self.last = last.select(self.entity, F.transform("s", lambda s: s.v).alias("lag"))
        return self

    def predict(self, horizon: int | None = None) -> DataFrame:
        """(entity, step, yhat) for the steps after each entity's last row, newest lag first."""
        horizon = horizon or self.horizon
        rows = self.last
        for h, m in enumerate(self.models):
            m = m.withColumnRenamed("b", f"b{h}")
            rows = rows.join(m, self.entity) if self.by_entity else rows.join(F.broadcast(m))
        dot = lambda b, lag: F.aggregate(F.zip_with(F.slice(b, 2, self.lags), lag, lambda p, q: p * q), b[0], lambda s, v: s + v)
        if self.strategy == "direct":
            out = F.array(*[F.struct(F.lit(h + 1).alias("step"), dot(F.col(f"b{h}"), F.col("lag")).alias("yhat")) for h in range(min(horizon, len(self.models)))])
        else:
            start = F.struct(F.col("lag").alias("lag"), F.array().cast("array<double>").alias("out"))

            def step(s, _):
                v = dot(F.col("b0"), s.lag)
                return F.struct(F.concat(F.array(v), F.slice(s.lag, 1, self.lags - 1)).alias("lag"), F.concat(s.out, F.array(v)).alias("out"))

            path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s.out)
            out = F.transform(path, lambda v, i: F.struct((i + 1).alias("step"), v.alias("yhat")))
        return rows.select(self.entity, F.explode(out).alias("p")).select(self.entity, F.col("p.step").cast("int").alias("step"), F.col("p.yhat").alias("yhat"))


def snaive(df: DataFrame, entity: str, time: str, y: str, horizon: int, sp: int) -> DataFrame:
    from tideframe.operators.evaluation import naive

    return naive(df, entity, time, y, horizon, sp)


def backtest(df: DataFrame, entity: str, time: str, y: str, make, cuts: Sequence, horizon: int) -> DataFrame:
    """(entity, cut, step, yhat, actual): each cut's forecaster is fitted on the rows up to it."""
    w = Window.partitionBy(entity).orderBy(time)
    out = None
    for cut in cuts:
        train, test = df.where(F.col(time) <= F.lit(cut)), df.where(F.col(time) > F.lit(cut))
        actual = test.select(entity, F.row_number().over(w).alias("step"), clean(F.col(y)).alias("actual")).where(F.col("step") <= horizon)
        one = make().fit(train).predict(horizon).join(actual, [entity, "step"]).select(entity, F.lit(cut).alias("cut"), "step", "yhat", "actual")
        out = one if out is None else out.unionByName(one)
    return out


def intervals(predictions: DataFrame, residuals: DataFrame, entity: str, alphas: Sequence[float]) -> DataFrame:
    """(entity, step, quantile, yhat): predictions plus the quantiles of each entity's backtest residuals."""
    q = residuals.groupBy(entity).agg(*[F.percentile(F.col("actual") - F.col("yhat"), a).alias(f"q{i}") for i, a in enumerate(alphas)])
    rows = F.array(*[F.struct(F.lit(int(round(a * 100))).cast("short").alias("quantile"), (F.col("yhat") + F.col(f"q{i}")).alias("yhat")) for i, a in enumerate(alphas)])
    return predictions.join(q, entity).select(entity, "step", F.explode(rows).alias("x")).select(entity, "step", "x.quantile", "x.yhat")


def ensemble(parts: Sequence[DataFrame], entity: str, how: str = "mean") -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    f = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5)}[how]
    return every.groupBy(entity, "step").agg(f("yhat").alias("yhat"))


def zero_inflated(df: DataFrame, entity: str, time: str, y: str, lags: int, horizon: int) -> DataFrame:
    """Recursive forecast of the size of non-zero values times each entity's share of them."""
    share = df.groupBy(entity).agg(F.avg((F.col(y) != 0).cast("double")).alias("__s"))
    size = LagForecaster(entity, time, y, lags).fit(df.where(F.col(y) != 0)).predict(horizon)
    return size.join(share, entity).select(entity, "step", (F.col("yhat") * F.col("__s")).alias("yhat"))
