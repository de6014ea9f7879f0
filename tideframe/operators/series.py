"""Kernels applied to each entity's series, to trailing windows of it, and to pairs of series.

An entity's series is one group in an Arrow batch: the kernel needs it whole. Only the columns that a kernel reads travel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions import catch22, kernels
from tideframe.sources.tables import checkpointed


def per_entity(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], f: Callable[..., dict], fields: str) -> DataFrame:
    """One row per entity: ``f`` of the ordered columns, without the rows that have a null or NaN in one, as a dict of ``fields``."""
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([df.schema[entity], *new.fields])
    rows = df.select(entity, *order, *[F.col(c).cast("double").alias(f"__{c}") for c in columns])

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in order])
        x = np.stack([table.column(f"__{c}").to_numpy(zero_copy_only=False).astype(float) for c in columns])
        x = x[:, np.isfinite(x).all(axis=0)]
        got = f(*x)
        return pa.table({entity: [key[0].as_py()], **{n.name: [got.get(n.name)] for n in new.fields}}).cast(_arrow(schema))

    return rows.groupBy(entity).applyInArrow(run, schema)


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def row_aligned(df: DataFrame, entity: str, order: Sequence[str], column: str, f: Callable[[np.ndarray], np.ndarray | Sequence[np.ndarray]], out: str | Sequence[str]) -> DataFrame:
    """Adds ``out``: ``f`` of each entity's ordered column, one value for each row (null for NaN); with several names, as many arrays."""
    names = [out] if isinstance(out, str) else list(out)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(table):
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in order])
        got = f(table.column(column).to_numpy(zero_copy_only=False).astype(float))
        for n, y in zip(names, [got] if isinstance(out, str) else got, strict=True):
            y = np.asarray(y, float)
            table = table.append_column(n, pa.array(y, mask=~np.isfinite(y)))
        return table

    return df.groupBy(entity).applyInArrow(run, schema)


def rolling_apply(df: DataFrame, entity: str, time: str, columns: Sequence[str], window: int, f: Callable[..., float], out: str, rows: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """Adds ``out``: ``f`` of the last ``window`` rows of the columns, which must be full and without nulls.

    The windows are arrays of a Spark frame, so rows of an entity may be in any number of batches. ``rows`` is ``f`` for many
    windows at once: of arrays (windows, points), one value for each window.
    """
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(-(window - 1), 0)
    many = rows or (lambda *a: np.array([f(*v) for v in zip(*a, strict=True)], float))

    def kernel(*cols):
        import pyarrow as pa
        import pyarrow.compute as pc

        full = np.logical_and.reduce([pc.fill_null(pc.equal(pc.list_value_length(c), window), False).to_numpy(zero_copy_only=False) for c in cols])
        a = [c.filter(pa.array(full)).flatten().to_numpy(zero_copy_only=False).reshape(-1, window) for c in cols]
        ok = np.logical_and.reduce([np.isfinite(x).all(axis=1) for x in a])
        y = np.full(len(full), np.nan)
        if ok.any():
            y[np.flatnonzero(full)[ok]] = many(*[x[ok] for x in a])
        return pa.array(y, mask=~np.isfinite(y))

    ok = F.lit(True)
    for c in columns:
        ok &= F.col(c).isNotNull()
    arrays = [F.collect_list(F.when(ok, F.col(c).cast("double"))).over(w) for c in columns]
    names = [f"__a{i}" for i in range(len(columns))]
    df = df.withColumns(dict(zip(names, arrays, strict=True)))
    v = F.arrow_udf(kernel, "double", F.ArrowUDFType.SCALAR)(*names)
    return df.withColumn(out, v).drop(*names)


# --- features ----------------------------------------------------------------------------------------------------------------------
SERIES = {
    "approximate_entropy": lambda x: kernels.approximate_entropy(x),
    "sample_entropy": lambda x: kernels.sample_entropy(x),
    "lempel_ziv_complexity": lambda x: kernels.lempel_ziv_complexity(x, float(np.mean(x)) if len(x) else 0.0),
    "augmented_dickey_fuller": lambda x: kernels.augmented_dickey_fuller(x, 1),
    "number_cwt_peaks": lambda x: float(kernels.number_cwt_peaks(x)) if len(x) > 20 else np.nan,
    "fourier_entropy": lambda x: kernels.fourier_entropy(x) if len(x) > 8 else np.nan,
    "hill_index": lambda x: kernels.hill_index(x, tail="upper"),
    "gph": lambda x: kernels.gph(x)[0] if len(x) > 30 else np.nan,
    "local_whittle": lambda x: kernels.local_whittle(x) if len(x) > 30 else np.nan,
}
ARRAYS = {
    "autoregressive_coefficients": lambda x: kernels.autoregressive_coefficients(x, 3) if len(x) > 8 else [],
    "cwt_coefficients": lambda x: kernels.cwt_coefficients(x).ravel() if len(x) > 20 else [],
    "friedrich_coefficients": lambda x: kernels.friedrich_coefficients(x) if len(x) > 30 else [],
    "welch_density": lambda x: kernels.welch_density(x)[1] if len(x) > 8 else [],
    "fft_coefficients": lambda x: kernels.fft_coefficients(x)["abs"] if len(x) else [],
}


def series_features(df: DataFrame, entity: str, order: Sequence[str], column: str, names: Sequence[str]) -> DataFrame:
    """One row per entity of the kernels named: numbers (null where undefined) or arrays."""
    def f(x):
        out = {n: float(SERIES[n](x)) if n in SERIES else [float(v) for v in ARRAYS[n](x)] for n in names}
        return {n: None if isinstance(v, float) and not np.isfinite(v) else v for n, v in out.items()}

    return per_entity(df, entity, order, [column], f, ", ".join(f"{n} {'double' if n in SERIES else 'array<double>'}" for n in names))


def catch22_features(df: DataFrame, entity: str, order: Sequence[str], column: str, which: Sequence[str] | str = "all", catch24: bool = False) -> DataFrame:
    names = list(catch22.FEATURES) if which == "all" else list(which)
    names_out = names + (["DN_Mean", "DN_Spread_Std"] if catch24 else [])
    return per_entity(df, entity, order, [column], lambda x: {k: v if np.isfinite(v) else None for k, v in catch22.catch22_all(x, catch24, names).items()}, ", ".join(f"{n} double" for n in names_out))


def evt_features(df: DataFrame, entity: str, order: Sequence[str], column: str, q: float = 0.99) -> DataFrame:
    def f(x):
        if len(x) < 20:
            return {}
        var, es = kernels.pot_var_es(x, q, tail="upper")
        shape, scale, u, n = kernels.gpd_fit(x, tail="upper")
        out = {"pot_var": var, "pot_es": es, "gpd_shape": shape, "gpd_scale": scale, "threshold": u}
        return {k: float(v) if np.isfinite(v) else None for k, v in out.items()} | {"n_exceed": int(n)}

    return per_entity(df, entity, order, [column], f, "pot_var double, pot_es double, gpd_shape double, gpd_scale double, threshold double, n_exceed long")


def bubbles(df: DataFrame, entity: str, time: str, column: str, min_window: int, out: str = "bsadf") -> DataFrame:
    return row_aligned(df, entity, [time], column, lambda x: kernels.bsadf(x, min_window), out)


def focus(df: DataFrame, entity: str, time: str, column: str, mean: float = 0.0, out: str = "focus") -> DataFrame:
    return row_aligned(df, entity, [time], column, lambda x: kernels.focus(np.nan_to_num(x), mean), out)


def dependence(df: DataFrame, entity: str, order: Sequence[str], x: str, y: str, names: Sequence[str]) -> DataFrame:
    """One row per entity with the dependence measures named between two columns."""
    def f(a, b):
        out = {n: float(kernels.DEPENDENCE[n](a, b)) if len(a) > 4 else np.nan for n in names}
        return {k: v if np.isfinite(v) else None for k, v in out.items()}

    return per_entity(df, entity, order, [x, y], f, ", ".join(f"{n} double" for n in names))


def rolling_dependence(df: DataFrame, entity: str, time: str, x: str, y: str, window: int, name: str, out: str) -> DataFrame:
    return rolling_apply(df, entity, time, [x, y], window, kernels.DEPENDENCE[name], out, kernels.ROWS.get(name))


def kshape(df: DataFrame, entity: str, time: str, column: str, k: int, points: int = 64, seed: int = 42, rounds: int = 20) -> DataFrame:
    """(entity, cluster): all entities by the shape of their series, each brought to ``points`` values first.

    A longer series is averaged over ``points`` stretches, a shorter one is interpolated between its values; one without a value
    or without variation gets a null cluster. Each round labels the entities on the executors and sums the products of the fitted
    shapes there; the driver gets k matrices of points x points, whatever the number of entities.
    """
    w = Window.partitionBy(entity).orderBy(time)
    held = df.select(entity, F.col(column).cast("double").alias("x"), (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(entity)).alias("n"))
    means = held.groupBy(entity, F.floor(F.col("i") * points / F.col("n")).cast("int").alias("b")).agg(F.avg("x").alias("m")).where("m is not null and not isnan(m)")
    means = means.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("b", "m"))).alias("a"))
    rows = df.select(entity).distinct().join(means, entity, "left").select(entity, F.transform("a", lambda s: s.b).alias("b"), F.transform("a", lambda s: s.m).alias("m"))
    rows = checkpointed(rows.select(entity, "b", "m", F.pmod(F.xxhash64(F.lit(seed), entity), F.lit(k)).cast("int").alias("start")))

    def shapes(b, m):
        """z-scored rows of the series with a shape, and where they are"""
        ok = np.array([len(y) > 1 if y is not None else False for y in m], dtype=bool)
        x = np.array([np.interp(np.arange(points), np.asarray(i), np.asarray(y, float)) for i, y, o in zip(b, m, ok, strict=True) if o]).reshape(-1, points)
        sd = x.std(axis=1)
        live = np.flatnonzero(ok)[sd > 0]
        return (x[sd > 0] - x[sd > 0].mean(axis=1, keepdims=True)) / sd[sd > 0, None], live

    def label(z, centre, start):
        return np.array([min(range(k), key=lambda j: kernels.sbd(centre[j], r)[0]) for r in z], dtype=np.int64) if centre is not None else start

    def grams(centre, fitted):
        def run(batches):
            total, count, marks = np.zeros((k, points, points)), np.zeros(k), 0
            mean = np.zeros((k, points))
            for batch in batches:
                z, live = shapes(batch["b"], batch["m"])
                own = label(z, centre, batch["start"].to_numpy()[live])
                for j in range(k):
                    fit = [kernels.sbd(fitted[j], r)[1] if fitted is not None and fitted[j].any() else r for r in z[own == j]]
                    if fit:
                        fit = np.stack(fit)
                        total[j] += fit.T @ fit
                        mean[j] += fit.sum(axis=0)
                        count[j] += len(fit)
            at = np.arange(k * points * points)
            yield pd.DataFrame({"i": np.concatenate((at, len(at) + np.arange(k * points), len(at) + k * points + np.arange(k))), "v": np.concatenate((total.ravel(), mean.ravel(), count))})

        got = rows.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # k * (points + 1) ** 2 rows at most
        flat = np.zeros(k * points * points + k * points + k)
        flat[got.i.to_numpy()] = got.v.to_numpy()
        return flat[: k * points * points].reshape(k, points, points), flat[k * points * points : -k].reshape(k, points), flat[-k:]

    import pandas as pd

    centre, inner = None, np.eye(points) - 1 / points
    for _ in range(rounds):
        total, mean, count = grams(centre, centre)
        new = np.zeros((k, points))
        for j in np.flatnonzero(count):
            c = np.linalg.eigh(inner @ total[j] @ inner)[1][:, -1]
            c = c if mean[j] @ c >= 0 else -c
            new[j] = (c - c.mean()) / (c.std() or 1)
        settled = centre is not None and np.abs(new - centre).max() < 1e-9
        centre = new
        if settled or not count.any():
            break

    def nearest(b, m):
        z, live = shapes(b, m)
        out = pd.Series([None] * len(b), dtype="Int32")
        out.iloc[live] = label(z, centre, None)
        return out

    return rows.select(entity, F.pandas_udf(nearest, "int", F.PandasUDFType.SCALAR)("b", "m").alias("cluster"))
