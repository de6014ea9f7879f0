"""Checks of the three promises: entities do not mix, no row reads a later one, a prefix gives a prefix."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.panel import PanelFrame

Maker = Callable[[PanelFrame], PanelFrame]


def _differ(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tol: float) -> DataFrame:
    left = a.select(*keys, *[F.col(c).cast("double").alias(f"__a{i}") for i, c in enumerate(columns)])
    right = b.select(*keys, *[F.col(c).cast("double").alias(f"__b{i}") for i, c in enumerate(columns)])
    bad = F.lit(False)
    for i in range(len(columns)):
        x, y = F.col(f"__a{i}"), F.col(f"__b{i}")
        bad = bad | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol * (1 + F.abs(x)), F.lit(False))
    return left.join(right, list(keys)).where(bad)


def assert_prefix_invariant(make: Maker, p: PanelFrame, columns: Sequence[str], cuts: Sequence, tol: float = 1e-9) -> None:
    """Values up to a cut are the same whether or not the rows after it are there."""
    whole = make(p).df
    for cut in cuts:
        part = make(p.filter(F.col(p.time) <= F.lit(cut))).df
        bad = _differ(part, whole, [p.entity, p.time], columns, tol).limit(3).collect()
        if bad:
            raise AssertionError(f"values before {cut!r} change with what comes after: {bad}")


def assert_no_lookahead(make: Maker, p: PanelFrame, columns: Sequence[str], cut, tol: float = 1e-9) -> None:
    """Values up to the cut do not change when the input's numbers after it are replaced."""
    later = F.col(p.time) > F.lit(cut)
    other = p._with(p.df.withColumns({c: F.when(later, F.col(c) * -3 + 17).otherwise(F.col(c)) for c in p.value_columns}))
    before = lambda q: make(q).df.where(F.col(p.time) <= F.lit(cut))
    bad = _differ(before(p), before(other), [p.entity, p.time], columns, tol).limit(3).collect()
    if bad:
        raise AssertionError(f"rows up to {cut!r} read later ones: {bad}")


def assert_panel_safe(make: Maker, p: PanelFrame, columns: Sequence[str], entity, tol: float = 1e-9) -> None:
    """An entity's values are the same when it is alone."""
    mine = F.col(p.entity) == F.lit(entity)
    bad = _differ(make(p.filter(mine)).df, make(p).df.where(mine), [p.entity, p.time], columns, tol).limit(3).collect()
    if bad:
        raise AssertionError(f"{entity!r} reads other entities: {bad}")


def assert_no_train_test_leak(fit: Callable[[PanelFrame], object], apply: Callable[[object, PanelFrame], PanelFrame], p: PanelFrame, cut, columns: Sequence[str], tol: float = 1e-9) -> None:
    """What is fitted on rows up to the cut does not change with the numbers after it."""
    train = p.filter(F.col(p.time) <= F.lit(cut))
    a = apply(fit(train), train).df
    later = F.col(p.time) > F.lit(cut)
    other = p._with(p.df.withColumns({c: F.when(later, F.lit(1e6)).otherwise(F.col(c)) for c in p.value_columns}))
    again = other.filter(F.col(p.time) <= F.lit(cut))
    b = apply(fit(again), again).df
    bad = _differ(a, b, [p.entity, p.time], columns, tol).limit(3).collect()
    if bad:
        raise AssertionError(f"the fit reads rows after {cut!r}: {bad}")
