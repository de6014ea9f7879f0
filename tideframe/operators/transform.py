"""Transformers of panels: fitted on training rows, applied anywhere. Statistics are small tables that are joined on."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.functions.core import clean, div
from tideframe.operators import rolling, xs
from tideframe.panel import PanelFrame


class PanelTransformer(ABC):
    """``fit`` learns from a panel and returns self; ``transform`` adds columns. Both safety flags must be declared."""

    panel_safe: bool
    leakage_safe: bool

    def __init_subclass__(cls, **kwargs) -> None:
        super().__init_subclass__(**kwargs)
        for flag in ("panel_safe", "leakage_safe"):
            if not isinstance(getattr(cls, flag, None), bool):
                raise TypeError(f"{cls.__name__} must declare {flag}")

    def fit(self, p: PanelFrame) -> PanelTransformer:
        return self

    @abstractmethod
    def transform(self, p: PanelFrame) -> PanelFrame: ...

    def fit_transform(self, p: PanelFrame) -> PanelFrame:
        return self.fit(p).transform(p)


class Apply(PanelTransformer):
    """A function of the panel as a step."""

    panel_safe, leakage_safe = True, True

    def __init__(self, f: Callable[[PanelFrame], PanelFrame]) -> None:
        self.f = f

    def transform(self, p: PanelFrame) -> PanelFrame:
        return self.f(p)


class TimeSeriesScaler(PanelTransformer):
    """zscore, minmax or robust scaling by the training rows' statistics, per entity or over all."""

    panel_safe, leakage_safe = True, True

    def __init__(self, columns: Sequence[str] | None = None, mode: str = "zscore", by_entity: bool = True, suffix: str = "") -> None:
        self.columns, self.mode, self.by_entity, self.suffix = columns, mode, by_entity, suffix
        self.stats: DataFrame | None = None

    def fit(self, p: PanelFrame) -> TimeSeriesScaler:
        made = {
            "zscore": lambda x: (F.avg(x), F.stddev_pop(x)),
            "minmax": lambda x: (F.min(x), F.max(x) - F.min(x)),
            "robust": lambda x: (F.percentile(x, 0.5), F.percentile(x, 0.75) - F.percentile(x, 0.25)),
        }[self.mode]
        self.names = list(self.columns or p.value_columns)
        aggs = []
        for c in self.names:
            centre, spread = made(clean(F.col(c)))
            aggs += [centre.alias(f"__{c}_c"), F.when(spread < 1e-12, 1.0).otherwise(spread).alias(f"__{c}_s")]
        self.stats = (p.df.groupBy(p.entity) if self.by_entity else p.df.groupBy()).agg(*aggs)
        return self

    def transform(self, p: PanelFrame) -> PanelFrame:
        df = p.df.join(self.stats, p.entity, "left") if self.by_entity else p.df.join(F.broadcast(self.stats))
        df = df.withColumns({f"{c}{self.suffix}": div(F.col(c) - F.col(f"__{c}_c"), F.col(f"__{c}_s")) for c in self.names})
        return p._with(df.drop(*[f"__{c}_{k}" for c in self.names for k in "cs"]))


class CrossSectionalScaler(PanelTransformer):
    panel_safe, leakage_safe = True, True

    def __init__(self, columns: Sequence[str] | None = None, mode: str = "zscore", suffix: str = "") -> None:
        self.columns, self.mode, self.suffix = columns, mode, suffix

    def transform(self, p: PanelFrame) -> PanelFrame:
        new = {}
        for c in self.columns or p.value_columns:
            x = clean(F.col(c))
            new[f"{c}{self.suffix}"] = {
                "zscore": lambda x=x: xs.zscore(x, p.time),
                "minmax": lambda x=x: div(x - F.min(x).over(p.dates), F.max(x).over(p.dates) - F.min(x).over(p.dates)),
                "robust": lambda x=x: div(x - xs.quantile(x, 0.5, p.time), xs.dispersion(x, p.time, "iqr")),
            }[self.mode]()
        return p.with_columns(**new)


class CrossSectionalRank(PanelTransformer):
    panel_safe, leakage_safe = True, True

    def __init__(self, columns: Sequence[str] | None = None, method: str = "average", descending: bool = False, normalize: str | bool = "uniform", suffix: str = "_rank") -> None:
        self.columns, self.options, self.suffix = columns, (method, normalize, descending), suffix

    def transform(self, p: PanelFrame) -> PanelFrame:
        return p.with_columns(**{f"{c}{self.suffix}": xs.rank(c, p.time, *self.options) for c in self.columns or p.value_columns})


class Neutralize(PanelTransformer):
    panel_safe, leakage_safe = True, True

    def __init__(self, target: str, factors: Sequence[str], add_intercept: bool = True, suffix: str = "_neutral") -> None:
        self.target, self.factors, self.add_intercept, self.suffix = target, list(factors), add_intercept, suffix

    def transform(self, p: PanelFrame) -> PanelFrame:
        out = f"{self.target}{self.suffix}"
        if len(self.factors) == 1:
            return p.with_columns(**{out: xs.neutralize(self.target, self.factors[0], p.time, self.add_intercept)})
        return p._with(xs.neutralize_many(p.df, self.target, self.factors, p.time, self.add_intercept, out))


class FracDiff(PanelTransformer):
    panel_safe, leakage_safe = True, True

    def __init__(self, columns: Sequence[str] | None = None, d: float = 0.5, threshold: float = 5e-4, suffix: str = "_fracdiff") -> None:
        self.columns, self.d, self.threshold, self.suffix = columns, d, threshold, suffix

    def transform(self, p: PanelFrame) -> PanelFrame:
        return p.with_columns(**{f"{c}{self.suffix}": rolling.frac_diff(c, p.window, self.d, self.threshold) for c in self.columns or p.value_columns})


class PanelEstimator(PanelTransformer):
    """A transformer whose last word is a prediction."""

    panel_safe, leakage_safe = True, True

    @abstractmethod
    def predict(self, p: PanelFrame) -> DataFrame: ...

    def transform(self, p: PanelFrame) -> PanelFrame:
        return p._with(self.predict(p))


class LinearModel(PanelEstimator):
    """Least squares (with a ridge if asked for) of a target on columns: one pass of sums of products, applied as an expression."""

    panel_safe, leakage_safe = True, True

    def __init__(self, target: str, features: Sequence[str], ridge: float = 0.0, out: str = "prediction") -> None:
        self.target, self.features, self.ridge, self.out = target, list(features), ridge, out

    def fit(self, p: PanelFrame) -> LinearModel:
        import numpy as np

        from tideframe.operators.panelreg import _square, grams

        r = grams(p.df, [], [*self.features, self.target]).first()
        m = _square(r["g"], len(self.features) + 2)
        a = m[:-1, :-1] + self.ridge * np.diag([0.0] + [1.0] * len(self.features))
        self.coef = (np.linalg.pinv(a) @ m[:-1, -1]).tolist()
        return self

    def predict(self, p: PanelFrame) -> DataFrame:
        v = F.lit(self.coef[0])
        for c, b in zip(self.features, self.coef[1:], strict=True):
            v = v + clean(F.col(c)) * b
        return p.df.withColumn(self.out, v)


class Pipeline(PanelTransformer):
    """Steps in a row; each is fitted on what the ones before it make of the training rows."""

    panel_safe, leakage_safe = True, True

    def __init__(self, steps: Sequence[PanelTransformer]) -> None:
        self.steps = list(steps)

    @property
    def named_steps(self) -> dict[str, PanelTransformer]:
        return {f"{i}_{type(s).__name__}": s for i, s in enumerate(self.steps)}

    def audit(self) -> list[tuple[str, bool, bool]]:
        """(step, panel_safe, leakage_safe) as each step declares."""
        return [(n, s.panel_safe, s.leakage_safe) for n, s in self.named_steps.items()]

    def predict(self, p: PanelFrame) -> DataFrame:
        for s in self.steps[:-1]:
            p = s.transform(p)
        return self.steps[-1].predict(p)

    def fit(self, p: PanelFrame) -> Pipeline:
        for s in self.steps:
            p = s.fit(p).transform(p)
        return self

    def transform(self, p: PanelFrame) -> PanelFrame:
        for s in self.steps:
            p = s.transform(p)
        return p
