"""Windows, safe arithmetic and ranks that the operators are built from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entity_window(entity: str | Sequence[str], time: str | Sequence[str]) -> WindowSpec:
    """Rows of an entity in time order; further time columns break ties."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    order = [time] if isinstance(time, str) else list(time)
    return Window.partitionBy(*keys).orderBy(*order)


def date_window(time: str | Sequence[str]) -> WindowSpec:
    """All rows of one date."""
    return Window.partitionBy(*([time] if isinstance(time, str) else time))


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def expanding(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


#: Bytes of input files for each task of :func:`dealt`.
SHARE = 4 << 20


def shares(*frames: DataFrame) -> int:
    """Number of partitions that grows with the files that the frames read: the default parallelism at least."""
    leaves = [f._jdf.queryExecution().optimizedPlan().collectLeaves() for f in frames]
    sizes = [int(str(x.apply(i).stats().sizeInBytes())) for x in leaves for i in range(x.size())]
    # what has no files says that it is endless
    return max(frames[0].sparkSession.sparkContext.defaultParallelism, sum(b for b in sizes if b < 1 << 60) // SHARE)


def dealt(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Rows dealt out by the keys, so that later groupings by them and more need no shuffle. A task's share of the rows does not grow
    with the input: partitions of a given number are not merged, as those of a plain grouping are, up to a size in compressed bytes."""
    return df.repartition(parts or shares(df), *keys)


def div(a: Column, b: Column) -> Column:
    """a / b; null where b is zero (ANSI division would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean(x: Column) -> Column:
    """x as a double with NaN as null."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def full(value: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """A rolling value where the frame has n values of x."""
    return F.when(F.count(x).over(trailing(w, n)) >= n, value)


def average_rank(x: Column, by: Sequence[Column], descending: bool = False) -> Column:
    """Rank from 1 among the non-null values of a group; ties share the mean of their ranks; null for null."""
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    first = F.rank().over(Window.partitionBy(*by).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), first + (ties - 1) / F.lit(2.0))


def corr(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation that is null, not an error, for a constant column."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    return div(over(F.covar_samp(a, b)), over(F.stddev_samp(a)) * over(F.stddev_samp(b)))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, within 1e-7 (rational approximation of the error function)."""
    # fixed values: coefficients of Abramowitz and Stegun 7.1.26
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / F.lit(2.0**0.5)
    t = 1 / (1 + p * z)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def ffd_weights(d: float, threshold: float = 5e-4, most: int = 100_000) -> list[float]:
    """Weights of fixed-width fractional differencing: w0 = 1, wk = -w(k-1) (d - k + 1) / k, down to the threshold."""
    if d < 0:
        raise ValueError("d must not be negative")
    out = [1.0]
    while True:
        k = len(out)
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < threshold:
            return out
        out.append(w)
        if len(out) > most:
            raise ValueError("too many weights: raise the threshold")
