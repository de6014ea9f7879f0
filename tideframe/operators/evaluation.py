"""Forecast metrics, baselines, residual statistics, splits of time, and corrections for many tests."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.core import clean, div
from tideframe.sources.tables import checkpointed

def A() -> Column:  # noqa: N802
    return F.col("__a")


def P() -> Column:  # noqa: N802
    return F.col("__p")


def E() -> Column:  # noqa: N802
    return P() - A()


METRICS: dict[str, Callable[[], Column]] = {
    "mae": lambda: F.avg(F.abs(E())),
    "mfe": lambda: F.avg(A() - P()),
    "mape": lambda: F.avg(div(F.abs(E()), F.abs(A()))),
    "mse": lambda: F.avg(E() * E()),
    "rmse": lambda: F.sqrt(F.avg(E() * E())),
    "smape": lambda: div(F.sum(F.abs(E())), F.sum(P() + A())),
    "smape_original": lambda: 100 * F.avg(2 * F.abs(E()) / (0.0001 + F.abs(A()) + F.abs(P()))),
    # sums of the predictions themselves, not of the differences
    "overforecast": lambda: F.coalesce(F.sum(F.when(P() > A(), P())), F.lit(0.0)),
    "underforecast": lambda: F.coalesce(F.sum(F.when(P() < A(), P())), F.lit(0.0)),
}


def joined(actual: DataFrame, predicted: DataFrame, entity: str, time: str, y: str, yhat: str) -> DataFrame:
    p = predicted.select(entity, time, clean(F.col(yhat)).alias("__p"))
    return actual.select(entity, time, clean(F.col(y)).alias("__a")).join(p, [entity, time])


def metrics(actual: DataFrame, predicted: DataFrame, entity: str, time: str, y: str, yhat: str, names: Sequence[str] | None = None) -> DataFrame:
    """One row per entity with the metrics asked for: one join and one aggregation."""
    return joined(actual, predicted, entity, time, y, yhat).groupBy(entity).agg(*[METRICS[n]().alias(n) for n in names or METRICS])


def scaled_metrics(actual: DataFrame, predicted: DataFrame, train: DataFrame, entity: str, time: str, y: str, yhat: str, sp: int = 1) -> DataFrame:
    """``mase`` and ``rmsse``: errors over those of the seasonal naive forecast in the training rows."""
    w = Window.partitionBy(entity).orderBy(time)
    x = clean(F.col(y))
    d = train.select(entity, (x - F.lag(x, sp).over(w)).alias("d")).groupBy(entity).agg(F.avg(F.abs(F.col("d"))).alias("__m1"), F.avg(F.col("d") * F.col("d")).alias("__m2"))
    e = joined(actual, predicted, entity, time, y, yhat).groupBy(entity).agg(F.avg(F.abs(E())).alias("__mae"), F.avg(E() * E()).alias("__mse"))
    return e.join(d, entity).select(entity, div(F.col("__mae"), F.col("__m1")).alias("mase"), F.sqrt(div(F.col("__mse"), F.col("__m2"))).alias("rmsse"))


def naive(df: DataFrame, entity: str, time: str, y: str, horizon: int, sp: int = 1) -> DataFrame:
    """(entity, step, yhat): the last value, or with ``sp`` the last season, repeated."""
    w = Window.partitionBy(entity).orderBy(F.col(time).desc())
    last = df.select(entity, clean(F.col(y)).alias("y"), F.row_number().over(w).alias("k")).where(F.col("k") <= sp)
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.where((F.col("step") - 1) % sp == sp - F.col("k")).select(entity, "step", F.col("y").alias("yhat"))


def acf(df: DataFrame, entity: str, time: str, column: str, lags: int) -> DataFrame:
    """(entity, lag, acf): correlations with the series' own lags; 1 at lag 0."""
    w = Window.partitionBy(entity).orderBy(time)
    x = clean(F.col(column))
    held = df.select(entity, x.alias("x"), *[F.lag(x, k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    one = lambda k: F.struct(F.lit(k).alias("lag"), (F.lit(1.0) if k == 0 else div(F.covar_samp(F.when(F.col(f"l{k}").isNotNull(), F.col("x")), F.col(f"l{k}")), F.stddev_samp(F.when(F.col(f"l{k}").isNotNull(), F.col("x"))) * F.stddev_samp(F.when(F.col("x").isNotNull(), F.col(f"l{k}"))))).alias("acf"))
    return held.groupBy(entity).agg(F.array(*[one(k) for k in range(lags + 1)]).alias("a"), F.count("x").alias("n")).select(entity, "n", F.explode("a").alias("a")).select(entity, "n", "a.lag", "a.acf")


def ljung_box(acfs: DataFrame, entity: str) -> DataFrame:
    """n (n + 2) times the running sum of acf^2 / (n - lag)."""
    w = Window.partitionBy(entity).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).over(w)
    return acfs.where("lag > 0").withColumn("ljung_box", q)


def conformal_radius(scores: DataFrame, entity: str, score: str, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score of each entity; infinite if there is none."""
    w = Window.partitionBy(entity).orderBy(score)
    held = scores.where(F.col(score).isNotNull()).select(entity, score, F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(entity)).alias("n"))
    at = F.ceil((F.col("n") + 1) * (1 - alpha))
    return held.groupBy(entity).agg(F.coalesce(F.max(F.when(F.col("k") == at, F.col(score))), F.lit(float("inf"))).alias("radius"))


def rank_forecasts(scores: DataFrame, by: str, entity: str, descending: bool = True) -> DataFrame:
    return scores.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), entity)


def elite(scores: DataFrame, entity: str, model: str, score: str, k: int) -> DataFrame:
    """The k best models of each entity."""
    w = Window.partitionBy(entity).orderBy(F.col(score).asc_nulls_last(), model)
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


# --- splits: over the distinct times, which are few beside the rows -----------------------------------------------------


def times_of(df: DataFrame, time: str, most: int = 1_000_000) -> list:
    got = [r[0] for r in df.select(time).distinct().orderBy(time).limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError("too many distinct times to split on the driver")
    return got


def expanding_window(n: int, test: int, splits: int, step: int | None = None) -> Iterator[tuple[range, range]]:
    step = step or test
    for i in reversed(range(splits)):
        cut = n - test - i * step
        if cut > 0:
            yield range(0, cut), range(cut, cut + test)


def sliding_window(n: int, test: int, splits: int, window: int, step: int | None = None) -> Iterator[tuple[range, range]]:
    for train, out in expanding_window(n, test, splits, step):
        yield range(max(0, train.stop - window), train.stop), out


def folds(n: int, splits: int) -> list[range]:
    """Blocks of nearly equal size, the longer ones first."""
    size, more = divmod(n, splits)
    cuts = [0]
    for i in range(splits):
        cuts.append(cuts[-1] + size + (i < more))
    return [range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def purged(n: int, test: Sequence[range], horizon: int, embargo: int = 0) -> list[int]:
    """Places outside the test blocks, at least ``horizon`` from them, and past the embargo after each."""
    blocked = set()
    for block in test:
        blocked.update(range(max(0, block.start - horizon), min(n, block.stop + horizon)))
        blocked.update(range(block.stop, min(n, block.stop + max(horizon, embargo))))
    return [i for i in range(n) if i not in blocked]


def purged_kfold(n: int, splits: int, horizon: int = 0, embargo: int = 0) -> Iterator[tuple[list[int], range]]:
    for block in folds(n, splits):
        yield purged(n, [block], horizon, embargo), block


def combinatorial_purged(n: int, splits: int, tests: int, horizon: int = 0, embargo: int = 0) -> Iterator[tuple[list[int], list[int]]]:
    for blocks in combinations(folds(n, splits), tests):
        yield purged(n, blocks, horizon, embargo), [i for b in blocks for i in b]


def take_times(df: DataFrame, time: str, times: Sequence) -> DataFrame:
    """The rows at the given times, by a semi-join with their table."""
    table = df.sparkSession.createDataFrame([(t,) for t in times], df.select(time).schema)
    return df.join(table, time, "left_semi")


# --- many tests --------------------------------------------------------------------------------------------------------


def adjust_p_values(df: DataFrame, p: str, method: str = "holm", out: str = "p_adjusted", by: Sequence[str] = ()) -> DataFrame:
    """bonferroni, holm, bh or by, within each group of tests."""
    if not by:
        return _adjust_all(df, p, method, out)
    w = Window.partitionBy(*by)
    m = F.count(p).over(w)
    up = w.orderBy(F.col(p).asc_nulls_last())
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.col(p) * m, F.lit(1.0)))
    df = df.withColumns({"__m": m, "__i": F.when(F.col(p).isNotNull(), F.row_number().over(up))})
    df = df.withColumn("__x", _scaled(F.col(p), F.col("__i"), F.col("__m"), method))
    v = F.max("__x").over(up.rowsBetween(Window.unboundedPreceding, 0)) if method == "holm" else F.min("__x").over(up.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(v, F.lit(1.0)))).drop("__m", "__i", "__x")


def _harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m, by its expansion beyond 64 terms (off by less than 1e-13)."""
    table = F.array(*[F.lit(sum(1 / k for k in range(1, n + 1))) for n in range(1, 65)])
    x = m.cast("double")
    far = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(m <= 64, F.get(table, F.greatest(m, F.lit(1)).cast("int") - 1)).otherwise(far)


def _scaled(p: Column, i: Column, m: Column, method: str) -> Column:
    if method == "holm":
        return (m - i + 1) * p
    return (_harmonic(m) if method == "by" else F.lit(1.0)) * m / i * p


def _adjust_all(df: DataFrame, p: str, method: str, out: str) -> DataFrame:
    """All rows as one group of tests: sorted over tasks by ranges of p, with places and extremes carried from slice to slice.

    Only a row for each slice comes together in one task.
    """
    total = F.broadcast(df.agg(F.count(p).alias("__m")))
    if method == "bonferroni":
        return df.join(total).withColumn(out, F.least(F.col(p) * F.col("__m"), F.lit(1.0))).drop("__m")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the slices are written: a second run of the sort could cut them elsewhere
    held = checkpointed(df.repartitionByRange(parts, F.col(p).asc_nulls_last()).withColumn("__s", F.spark_partition_id()))
    up, every = Window.partitionBy("__s").orderBy(F.col(p).asc_nulls_last()), Window.orderBy("__s")
    counts = held.groupBy("__s").agg(F.count(p).alias("__n"))
    before = counts.select("__s", (F.sum("__n").over(every) - F.col("__n")).alias("__before"))
    held = held.join(F.broadcast(before), "__s").join(total)
    held = held.withColumn("__x", F.when(F.col(p).isNotNull(), _scaled(F.col(p), F.row_number().over(up) + F.col("__before"), F.col("__m"), method)))
    extreme, pick = (F.max, F.greatest) if method == "holm" else (F.min, F.least)
    rest = every.rowsBetween(Window.unboundedPreceding, -1) if method == "holm" else every.rowsBetween(1, Window.unboundedFollowing)
    ends = held.groupBy("__s").agg(extreme("__x").alias("__e")).select("__s", extreme("__e").over(rest).alias("__e"))
    frame = up.rowsBetween(Window.unboundedPreceding, 0) if method == "holm" else up.rowsBetween(0, Window.unboundedFollowing)
    v = pick(extreme("__x").over(frame), F.col("__e"))
    return held.join(F.broadcast(ends), "__s").withColumn(out, F.when(F.col(p).isNotNull(), F.least(v, F.lit(1.0)))).select(*df.columns, out)


def sharpe_statistics(df: DataFrame, entity: str, ret: str) -> DataFrame:
    """Sharpe ratio per period with the moments that its tests need."""
    x = clean(F.col(ret))
    return df.groupBy(entity).agg(F.count(x).alias("n"), div(F.avg(x), F.stddev_samp(x)).alias("sharpe"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess_kurtosis"))


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _phi_inverse(p: float) -> float:
    lo, hi = -12.0, 12.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _phi(mid) < p else (lo, mid)
    return (lo + hi) / 2


def probabilistic_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, benchmark: float = 0.0) -> float:
    sd = math.sqrt(max(1e-12, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2) / (n - 1))
    return _phi((sharpe - benchmark) / sd)


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: int, variance: float) -> float:
    """Probability that a Sharpe ratio beats the best that so many trials give by chance."""
    if trials <= 1:
        return probabilistic_sharpe(sharpe, n, skew, kurtosis)
    euler = 0.5772156649015329
    best = math.sqrt(variance) * ((1 - euler) * _phi_inverse(1 - 1 / trials) + euler * _phi_inverse(1 - 1 / (trials * math.e)))
    return probabilistic_sharpe(sharpe, n, skew, kurtosis, best)
