"""Cross-sectional operators: every value is set against the values of its date. ``by`` names the date's columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.core import average_rank, clean, col, div


def _by(by: str | Sequence[str]) -> list[Column]:
    return [F.col(by)] if isinstance(by, str) else [col(b) for b in by]


def _over(by):
    return Window.partitionBy(*_by(by))


def count(x: Column | str, by) -> Column:
    return F.count(clean(col(x))).over(_over(by))


def rank(x: Column | str, by, method: str = "average", normalize: bool | str = False, descending: bool = False) -> Column:
    """Rank within the date: ``average``, ``min``, ``max``, ``dense`` or ``ordinal``.

    ``normalize``: True or ``uniform`` gives r/N, ``uniform_plus`` r/(N+1), ``unit`` 2(r-1)/(N-1)-1, ``centered`` r/(N+1)-0.5.
    """
    x = clean(col(x))
    order = Window.partitionBy(*_by(by)).orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*_by(by), x))
    r = {
        "average": lambda: average_rank(x, _by(by), descending),
        "min": lambda: F.rank().over(order).cast("double"),
        "max": lambda: (F.rank().over(order) + ties - 1).cast("double"),
        "dense": lambda: F.dense_rank().over(order).cast("double"),
        "ordinal": lambda: F.row_number().over(order).cast("double"),
    }[method]()
    r, n = F.when(x.isNotNull(), r), count(x, by)
    if not normalize:
        return r
    return {
        "uniform": lambda: div(r, n),
        "uniform_plus": lambda: div(r, n + 1),
        "unit": lambda: div(2 * (r - 1), n - 1) - 1,
        "centered": lambda: div(r, n + 1) - 0.5,
    }["uniform" if normalize is True else normalize]()


def demean(x: Column | str, by) -> Column:
    x = clean(col(x))
    return x - F.avg(x).over(_over(by))


def zscore(x: Column | str, by, ddof: int = 0) -> Column:
    x = clean(col(x))
    sd = F.stddev_pop(x) if ddof == 0 else F.stddev_samp(x)
    return div(x - F.avg(x).over(_over(by)), sd.over(_over(by)))


def quantile(x: Column, q: float, by) -> Column:
    return F.percentile(x, q).over(_over(by))


def winsorize(x: Column | str, by, limits: tuple[float, float]) -> Column:
    """x clipped to the date's quantiles ``limits[0]`` and 1 - ``limits[1]``, interpolated linearly; see also :func:`winsorize_nearest`."""
    x = clean(col(x))
    lo, hi = quantile(x, limits[0], by), quantile(x, 1 - limits[1], by)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def winsorize_nearest(df: DataFrame, x: str, by: str, limits: tuple[float, float], out: str) -> DataFrame:
    """x clipped to the values at the nearest ranks (of two equally near the upper one): one sort of the date, no array of it."""
    w = Window.partitionBy(*_by(by))
    v = clean(F.col(x))
    df = df.withColumns({"__v": v, "__k": F.row_number().over(w.orderBy(v.asc_nulls_last())), "__n": F.count(v).over(w)})
    at = lambda q: F.max(F.when(F.col("__k") == F.floor(q * (F.col("__n") - 1) + 0.5) + 1, F.col("__v"))).over(w)
    lo, hi = at(limits[0]), at(1 - limits[1])
    return df.withColumn(out, F.when(F.col("__v").isNotNull(), F.least(F.greatest(F.col("__v"), lo), hi))).drop("__v", "__k", "__n")


def standardize(df: DataFrame, x: str, by: str, winsor: tuple[float, float] | None = None, out: str | None = None) -> DataFrame:
    """Winsorised (if asked for), then z-scored: two windows over the same partitioning."""
    held = "__winsor"
    df = winsorize_nearest(df, x, by, winsor, held) if winsor else df.withColumn(held, clean(F.col(x)))
    return df.withColumn(out or f"{x}_std", zscore(held, by)).drop(held)


def quantile_bin(x: Column | str, by, q: int) -> Column:
    """Bucket 0 to q-1 from floor((average rank - 1) / N * q)."""
    r = rank(x, by)
    return F.when(r.isNotNull(), F.least(F.floor(div((r - 1) * q, count(x, by))), F.lit(q - 1))).cast("int")


def neutralize(x: Column | str, factor: Column | str, by, add_intercept: bool = True) -> Column:
    """Residual of the date's regression on one factor; see :func:`neutralize_many` for several."""
    x, f = clean(col(x)), clean(col(factor))
    if add_intercept:
        slope, base = F.regr_slope(x, f).over(_over(by)), F.regr_intercept(x, f).over(_over(by))
        return x - (base + slope * f)
    both = x.isNotNull() & f.isNotNull()
    return x - f * div(F.sum(F.when(both, x * f)).over(_over(by)), F.sum(F.when(both, f * f)).over(_over(by)))


def neutralize_many(df: DataFrame, target: str, factors: Sequence[str], by: str, add_intercept: bool = True, out: str | None = None) -> DataFrame:
    """Residuals of the date's least squares on several factors, from the date's cross-products alone.

    The products are summed by a pre-aggregated groupBy, the small systems are solved one for each date, and the
    coefficients are joined back: no date's rows are gathered in one task.
    """
    import numpy as np

    names, out = list(factors), out or f"{target}_neutral"
    ok = F.lit(True)
    for c in (target, *names):
        ok &= clean(F.col(c)).isNotNull()
    terms = ([F.lit(1.0)] if add_intercept else []) + [clean(F.col(c)) for c in names]
    k = len(terms)
    sums = [F.sum(F.when(ok, a * b)).alias(f"g{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    sums += [F.sum(F.when(ok, a * clean(F.col(target)))).alias(f"h{i}") for i, a in enumerate(terms)]
    gram = df.groupBy(by).agg(*sums)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                h = np.array([r[f"h{i}"] for i in range(k)], float)
                rows.append((np.linalg.pinv(g) @ h).tolist() if np.isfinite(g).all() else None)
            yield pdf[[by]].assign(__b=rows)

    from pyspark.sql import types as T

    schema = T.StructType([df.schema[by], T.StructField("__b", T.ArrayType(T.DoubleType()))])
    fit = F.lit(0.0)
    for i, t in enumerate(terms):
        fit = fit + t * F.col("__b")[i]
    return df.join(gram.mapInPandas(solve, schema), by, "left").withColumn(out, F.when(ok, clean(F.col(target)) - fit)).drop("__b")


def dispersion(x: Column | str, by, kind: str = "sd") -> Column:
    """``sd`` (sample), ``iqr`` or ``idr`` (linear quantiles); for ``mad`` see :func:`mad`."""
    x = clean(col(x))
    if kind == "sd":
        return F.stddev_samp(x).over(_over(by))
    lo, hi = {"iqr": (0.25, 0.75), "idr": (0.1, 0.9)}[kind]
    return quantile(x, hi, by) - quantile(x, lo, by)


def mad(df: DataFrame, x: str, by: str, out: str, scale: float = 1.4826) -> DataFrame:
    """Scaled median absolute deviation of each date: the median first, then that of the distances."""
    df = df.withColumn("__dev", F.abs(clean(F.col(x)) - quantile(clean(F.col(x)), 0.5, by)))
    return df.withColumn(out, scale * quantile(F.col("__dev"), 0.5, by)).drop("__dev")


def up_share(x: Column | str, by) -> Column:
    x = clean(col(x))
    return F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).over(_over(by))


def entropy_share(x: Column | str, by) -> Column:
    """Normalised entropy of the shares |x| / sum |x| of a date."""
    x = F.abs(clean(col(x)))
    p = div(x, F.sum(x).over(_over(by)))
    return p


def entropy(df: DataFrame, x: str, by: str, out: str) -> DataFrame:
    df = df.withColumn("__p", entropy_share(x, by))
    h = -F.sum(F.when(F.col("__p") > 0, F.col("__p") * F.ln("__p"))).over(_over(by))
    n = F.count("__p").over(_over(by))
    return df.withColumn(out, F.when(n > 1, div(h, F.ln(n)))).drop("__p")


def tail_index(df: DataFrame, x: str, by: str, out: str, q: float = 0.05, tail: str = "lower", least: int = 10) -> DataFrame:
    """Hill index of a date's lower or upper tail; null with too few exceedances or a threshold that is not positive."""
    loss = -clean(F.col(x)) if tail == "lower" else clean(F.col(x))
    df = df.withColumn("__loss", loss)
    n = F.count("__loss").over(_over(by))
    df = df.withColumns({"__k": F.floor(n * q), "__r": F.row_number().over(Window.partitionBy(*_by(by)).orderBy(F.col("__loss").desc_nulls_last()))})
    u = F.max(F.when(F.col("__r") == F.col("__k") + 1, F.col("__loss"))).over(_over(by))
    df = df.withColumn("__u", u)
    xi = F.avg(F.when((F.col("__r") <= F.col("__k")) & (F.col("__u") > 0) & (F.col("__loss") > 0), F.ln("__loss") - F.ln("__u"))).over(_over(by))
    df = df.withColumn("__xi", xi)
    ok = (F.col("__k") >= least) & (F.col("__u") > 0) & (F.col("__xi") > 0)
    return df.withColumn(out, F.when(ok, div(F.lit(1.0), F.col("__xi")))).drop("__loss", "__k", "__r", "__u", "__xi")


#: Kept here for callers that scale by it.
MAD_SCALE = 1.4826
LOG2 = math.log(2)
