"""The grammar of alpha operators: element-wise, time-series (per entity) and cross-sectional (per date) building blocks.

Each operator is a function of columns, a window length where it has one, and the windows of the panel. Windows are
full: a time-series operator is null until its window holds ``d`` values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tideframe.functions.core import average_rank, corr, div, finite, full, trailing

UNITS = ("price", "volume", "ret", "ratio", "score", "any")
DELAYS, WINDOWS, HALF_LIVES = (1, 5, 10, 20, 40, 60), (5, 10, 20, 40, 60), (2, 5, 10, 20)


@dataclass(frozen=True)
class Context:
    """Windows of a panel: ``w`` of an entity in time order, ``by`` the columns of a date; the names behind ``w``."""

    w: WindowSpec
    by: tuple[Column, ...]
    entity: str = "entity"
    order: tuple[str, ...] = ("time",)

    @property
    def xs(self) -> WindowSpec:
        from pyspark.sql import Window

        return Window.partitionBy(*self.by)


@dataclass(frozen=True)
class AlphaOp:
    name: str
    kind: str  # elem, ts or xs
    arity: int
    build: Callable[..., Column] | None
    grid: tuple[float, ...] = ()
    frame: Callable | None = None  # (df, context, out, *inputs) for what one window cannot say


OPS: dict[str, AlphaOp] = {}


def _op(name: str, kind: str, arity: int, grid: tuple[float, ...] = (), frame: bool = False):
    def put(f):
        OPS[name] = AlphaOp(name, kind, arity, None, grid, f) if frame else AlphaOp(name, kind, arity, f, grid)
        return f

    return put


for _unit in ("price", "volume", "score"):
    _op(f"add_{_unit}", "elem", 2)(lambda c, a, b: a + b)
    _op(f"sub_{_unit}", "elem", 2)(lambda c, a, b: a - b)
    # unlike greatest and least these are null if either side is
    _op(f"max_{_unit}", "elem", 2)(lambda c, a, b: (a + b + F.abs(a - b)) / 2)
    _op(f"min_{_unit}", "elem", 2)(lambda c, a, b: (a + b - F.abs(a - b)) / 2)

_op("mul", "elem", 2)(lambda c, a, b: finite(a * b))
_op("div", "elem", 2)(lambda c, a, b: finite(div(a, b)))
_op("neg", "elem", 1)(lambda c, a: -a)
_op("abs", "elem", 1)(lambda c, a: F.abs(a))
_op("sign", "elem", 1)(lambda c, a: F.signum(a))
_op("log", "elem", 1)(lambda c, a: F.when(F.abs(a) > 1e-12, F.ln(F.abs(a))))
_op("sqrt", "elem", 1)(lambda c, a: F.sqrt(F.abs(a)))
_op("signed_power", "elem", 1, (0.5, 2.0))(lambda c, a, p: F.signum(a) * F.pow(F.abs(a), F.lit(float(p))))
_op("sigmoid", "elem", 1)(lambda c, a: F.when(a.isNotNull(), 1 / (1 + F.exp(-F.least(F.greatest(a, F.lit(-30.0)), F.lit(30.0))))))
_op("where_positive", "elem", 3)(lambda c, s, a, b: F.when(s > 0, a).otherwise(b))


def _lag(c: Context, a: Column, k: int) -> Column:
    return F.lag(a, k).over(c.w) if k else a


def _roll(f):
    return lambda c, a, d: full(f(a, trailing(c.w, int(d))), a, c.w, int(d))


_op("ts_delay", "ts", 1, DELAYS)(lambda c, a, d: _lag(c, a, int(d)))
_op("ts_delta", "ts", 1, DELAYS)(lambda c, a, d: a - _lag(c, a, int(d)))
_op("ts_pctchange", "ts", 1, DELAYS)(lambda c, a, d: finite(div(a, _lag(c, a, int(d))) - 1))
_op("ts_mean", "ts", 1, WINDOWS)(_roll(lambda a, f: F.avg(a).over(f)))
_op("ts_std", "ts", 1, WINDOWS)(_roll(lambda a, f: F.stddev_samp(a).over(f)))
_op("ts_sum", "ts", 1, WINDOWS)(_roll(lambda a, f: F.sum(a).over(f)))
_op("ts_min", "ts", 1, WINDOWS)(_roll(lambda a, f: F.min(a).over(f)))
_op("ts_max", "ts", 1, WINDOWS)(_roll(lambda a, f: F.max(a).over(f)))
_op("ts_median", "ts", 1, WINDOWS)(_roll(lambda a, f: F.percentile(a, 0.5).over(f)))
_op("ts_range", "ts", 1, WINDOWS)(_roll(lambda a, f: F.max(a).over(f) - F.min(a).over(f)))
_op("ts_skew", "ts", 1, WINDOWS)(_roll(lambda a, f: finite(F.skewness(a).over(f))))
_op("ts_kurt", "ts", 1, WINDOWS)(_roll(lambda a, f: finite(F.kurtosis(a).over(f))))
_op("ts_zscore", "ts", 1, WINDOWS)(_roll(lambda a, f: finite(div(a - F.avg(a).over(f), F.stddev_samp(a).over(f)))))
_op("ts_ir", "ts", 1, WINDOWS)(_roll(lambda a, f: finite(div(F.avg(a).over(f), F.stddev_samp(a).over(f)))))
_op("ts_rsv", "ts", 1, WINDOWS)(_roll(lambda a, f: finite(div(a - F.min(a).over(f), F.max(a).over(f) - F.min(a).over(f)))))
_op("ts_drawdown", "ts", 1, WINDOWS)(_roll(lambda a, f: finite(div(a, F.max(a).over(f)) - 1)))


@_op("ts_rank", "ts", 1, WINDOWS)
def _rank(c: Context, a: Column, d: int) -> Column:
    d, n = int(d), F.lit(0.0)
    for k in range(d):
        n = n + F.when(_lag(c, a, k) <= a, 1.0).otherwise(0.0)
    return full(n / d, a, c.w, d)


def _arg(best):
    def f(c: Context, a: Column, d: int) -> Column:
        d, out = int(d), F.lit(None).cast("double")
        top = best(a).over(trailing(c.w, d))
        for k in reversed(range(d)):
            out = F.when(_lag(c, a, k) == top, float(k)).otherwise(out)
        return full(out, a, c.w, d)

    return f


_op("ts_argmax", "ts", 1, WINDOWS)(_arg(F.max))
_op("ts_argmin", "ts", 1, WINDOWS)(_arg(F.min))


@_op("ts_decay_linear", "ts", 1, WINDOWS)
def _decay(c: Context, a: Column, d: int) -> Column:
    d, out = int(d), F.lit(0.0)
    for k in range(d):
        out = out + _lag(c, a, k) * (d - k)
    return out / (d * (d + 1) / 2)


@_op("ts_product", "ts", 1, WINDOWS)
def _product(c: Context, a: Column, d: int) -> Column:
    f = trailing(c.w, int(d))
    size = F.exp(F.sum(F.when(a != 0, F.ln(F.abs(a)))).over(f))
    minus = F.sum(F.when(a < 0, 1).otherwise(0)).over(f) % 2
    zero = F.max(F.when(a == 0, 1).otherwise(0)).over(f)
    return full(F.when(zero == 1, 0.0).otherwise(F.when(minus == 1, -size).otherwise(size)), a, c.w, int(d))


def ewm(x, half_life: float):
    """m = a x + (1 - a) m from the first value on; a gap of nulls ages the old mean by its length."""
    import numpy as np

    alpha = 1 - math.exp(-math.log(2) / half_life)
    out, m, old = np.full(len(x), np.nan), None, 1.0
    for i, v in enumerate(x):
        if m is not None:
            old *= 1 - alpha
        if v == v:
            m = v if m is None else (old * m + alpha * v) / (old + alpha)
            out[i], old = m, 1.0
    return out


@_op("ts_ewm_mean", "ts", 1, HALF_LIVES, frame=True)
def _ewm(df, c: Context, out: str, a: str, half_life: float):
    """A recursion: each entity's series passes through the kernel once."""
    from tideframe.operators.series import row_aligned

    return row_aligned(df, c.entity, list(c.order), a, lambda x: ewm(x, half_life), out)


def _paired(f):
    def g(c: Context, a: Column, b: Column, d: int) -> Column:
        d = int(d)
        both = a.isNotNull() & b.isNotNull()
        x, y = F.when(both, a), F.when(both, b)
        return full(finite(f(x, y, trailing(c.w, d))), x, c.w, d)

    return g


_op("ts_corr", "ts", 2, WINDOWS)(_paired(lambda x, y, f: corr(x, y, f)))
_op("ts_beta", "ts", 2, WINDOWS)(_paired(lambda x, y, f: div(F.covar_samp(x, y).over(f), F.var_samp(y).over(f))))

_op("cs_rank", "xs", 1)(lambda c, a: div(average_rank(finite(a), list(c.by)), F.count(finite(a)).over(c.xs)))
_op("cs_zscore", "xs", 1)(lambda c, a: finite(div(a - F.avg(a).over(c.xs), F.stddev_samp(a).over(c.xs))))
_op("cs_demean", "xs", 1)(lambda c, a: a - F.avg(a).over(c.xs))
_op("cs_scale", "xs", 1)(lambda c, a: finite(div(a, F.sum(F.abs(a)).over(c.xs))))


@_op("cs_winsor", "xs", 1, (2.0, 3.0))
def _winsor(c: Context, a: Column, k: float) -> Column:
    m, s = F.avg(a).over(c.xs), F.stddev_samp(a).over(c.xs)
    return F.when(a.isNotNull(), F.least(F.greatest(a, m - k * s), m + k * s))


@_op("cs_mad_zscore", "xs", 1, frame=True)
def _mad(df, c: Context, out: str, a: str):
    """The median first, then that of the distances: two windows over one partitioning."""
    df = df.withColumn("__m", F.percentile(F.col(a), 0.5).over(c.xs))
    df = df.withColumn("__d", F.abs(F.col(a) - F.col("__m")))
    return df.withColumn(out, finite(div(F.col(a) - F.col("__m"), 1.4826 * F.percentile("__d", 0.5).over(c.xs)))).drop("__m", "__d")


# --- programs ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """An operator over inputs (column names or nodes), with its parameter."""

    op: str
    args: tuple
    param: float | None = None


def apply(df, name: str, out: str, *inputs, context: Context):
    """Adds one operator's column; inputs are column names, then the parameter."""
    op = OPS[name]
    if op.frame:
        return op.frame(df, context, out, *inputs)
    return df.withColumn(out, op.build(context, *[F.col(x) if isinstance(x, str) else x for x in inputs]))


def compile_population(df, programs: dict[str, Node], w: WindowSpec, by: tuple[Column, ...], entity: str = "entity", order: tuple[str, ...] = ("time",)):
    """Adds a column for each program. Equal sub-programs are computed once, in stages: each stage holds all operators whose
    inputs are ready, so that Catalyst plans one window for all of a stage's operators over the same partitioning."""
    context, done, depth = Context(w, by, entity, order), {}, {}

    def level(n) -> int:
        if isinstance(n, str):
            return 0
        if n not in depth:
            depth[n] = 1 + max(level(a) for a in n.args)
        return depth[n]

    for root in programs.values():
        level(root)
    for stage in range(1, max(depth.values(), default=0) + 1):
        new, framed = {}, []
        for n in (n for n, k in depth.items() if k == stage):
            args = [done.get(a, a) if not isinstance(a, str) else a for a in n.args]
            extra = () if n.param is None else (n.param,)
            done[n] = f"__p{len(done)}"
            if OPS[n.op].frame:
                framed.append((n.op, done[n], *args, *extra))
            else:
                new[done[n]] = OPS[n.op].build(context, *map(F.col, args), *extra)
        df = df.withColumns(new)
        for name, out, *inputs in framed:
            df = apply(df, name, out, *inputs, context=context)
    out = df.withColumns({name: F.col(done[root]) for name, root in programs.items()})
    return out.drop(*done.values())
