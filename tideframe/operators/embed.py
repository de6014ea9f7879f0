"""Embeddings and reshapings of panels: arrays, windows, random features, sketches."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.core import clean

# --- arrays --------------------------------------------------------------------------------------------------------------------------


def as_embedding(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("float") for c in columns])).drop(*columns)


def explode_embedding(df: DataFrame, name: str, width: int, prefix: str | None = None) -> DataFrame:
    return df.withColumns({f"{prefix or name}_{i}": F.get(F.col(name), F.lit(i)) for i in range(width)}).drop(name)


def _apply(df: DataFrame, name: str, out: str, f) -> DataFrame:
    """Adds ``out``: ``f`` of the matrix of a batch's vectors; null where the vector is null."""
    def run(s):
        import pandas as pd

        res = [None] * len(s)
        at = [i for i, v in enumerate(s) if v is not None]
        if at:
            for i, y in zip(at, f(np.stack([np.asarray(s.iloc[i], float) for i in at])), strict=True):
                res[i] = y
        return pd.Series(res, dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR)(name))


def sparse_projection(d: int, k: int, seed: int = 0) -> np.ndarray:
    rng, s = np.random.default_rng(seed), math.sqrt(d)
    return rng.choice([-1.0, 0.0, 1.0], p=[1 / (2 * s), 1 - 1 / s, 1 / (2 * s)], size=(d, k)) * math.sqrt(s / k)


def fwht(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, of a power of two."""
    x, h, n = np.array(x, float), 1, x.shape[-1]
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.concatenate((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-1).reshape(x.shape)
        h *= 2
    return x


def srht(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Subsampled randomised Hadamard transform of the rows."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    n = 1 << (d - 1).bit_length()
    z = np.zeros((len(x), n))
    z[:, :d] = x * rng.choice([-1.0, 1.0], d)
    return fwht(z)[:, rng.choice(n, k, replace=False)] / math.sqrt(k)


def count_sketch(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    rng, d = np.random.default_rng(seed), x.shape[1]
    h, s = rng.integers(0, k, d), rng.choice([-1.0, 1.0], d)
    out = np.zeros((len(x), k))
    np.add.at(out.T, h, (x * s).T)
    return out


def tensor_sketch(x: np.ndarray, k: int, degree: int = 2, seed: int = 0) -> np.ndarray:
    """Polynomial kernel features: the product of count sketches in the frequency domain."""
    f = np.ones((len(x), k), complex)
    for i in range(degree):
        f *= np.fft.fft(count_sketch(x, k, seed + i), axis=1)
    return np.fft.ifft(f, axis=1).real


def fourier_features(x: np.ndarray, k: int, scale: float = 1.0, seed: int = 0) -> np.ndarray:
    """Random features of a Gaussian kernel."""
    w = np.random.default_rng(seed).normal(size=(x.shape[1], k // 2)) * scale
    z = x @ w
    return np.concatenate((np.cos(z), np.sin(z)), axis=1) / math.sqrt(k // 2)


COMPRESSORS = {
    "srp": lambda x, k, seed: x @ sparse_projection(x.shape[1], k, seed),
    "srht": srht,
    "count_sketch": count_sketch,
    "tensor_sketch": lambda x, k, seed: tensor_sketch(x, k, 2, seed),
    "fourier": lambda x, k, seed: fourier_features(x, k, 1.0, seed),
    "truncate": lambda x, k, seed: x[:, :k] / np.maximum(np.linalg.norm(x[:, :k], axis=1, keepdims=True), 1e-12),
}


def compress(df: DataFrame, name: str, k: int, method: str = "srp", seed: int = 0, out: str | None = None) -> DataFrame:
    """Vectors brought to k numbers by a seeded method that needs no fit."""
    f = COMPRESSORS[method]
    return _apply(df, name, out or name, lambda x: f(x, k, seed))


# --- windows ------------------------------------------------------------------------------------------------------------------------------


def delay(df: DataFrame, entity: str, time: str, column: str, lags: int, dilation: int = 1, out: str | None = None) -> DataFrame:
    """Delay embedding: the value and its lags as an array, null until all are there."""
    w = Window.partitionBy(entity).orderBy(time)
    v = [F.lag(clean(F.col(column)), k * dilation).over(w) if k else clean(F.col(column)) for k in range(lags)]
    ok = v[-1].isNotNull()
    return df.withColumn(out or f"{column}_delay", F.when(ok, F.array(*v)))


def paa(df: DataFrame, entity: str, time: str, column: str, window: int, segments: int, out: str | None = None) -> DataFrame:
    """Means of equal segments of the trailing window, oldest first."""
    if window % segments:
        raise ValueError("segments must divide the window")
    w, size = Window.partitionBy(entity).orderBy(time), window // segments
    x = clean(F.col(column))
    means = [F.avg(x).over(w.rowsBetween(-(window - 1) + i * size, -(window - 1) + (i + 1) * size - 1)) for i in range(segments)]
    return df.withColumn(out or f"{column}_paa", F.when(F.count(x).over(w.rowsBetween(-(window - 1), 0)) == window, F.array(*means)))


def spectral(df: DataFrame, entity: str, time: str, column: str, window: int, k: int = 8, out: str | None = None) -> DataFrame:
    """Amplitudes of the first k frequencies of the full trailing window, mean removed."""
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(-(window - 1), 0)
    x = clean(F.col(column))
    df = df.withColumn("__w", F.when(F.count(x).over(w) == window, F.collect_list(x).over(w)))
    out = out or f"{column}_spectral"
    return _apply(df, "__w", out, lambda m: np.abs(np.fft.rfft(m - m.mean(1, keepdims=True), axis=1))[:, 1 : k + 1] / window).drop("__w")


# --- streaming sketches of a matrix -----------------------------------------------------------------------------------------------------------


def shrink(m: np.ndarray, ell: int) -> np.ndarray:
    """Frequent directions: at most ``ell`` rows that keep the cross-products best."""
    _, s, v = np.linalg.svd(m, full_matrices=False)
    cut = s[ell] ** 2 if len(s) > ell else 0.0
    return np.sqrt(np.maximum(s[:ell] ** 2 - cut, 0))[:, None] * v[:ell]


def frequent_directions(df: DataFrame, columns: Sequence[str], ell: int = 32) -> np.ndarray:
    """A sketch of ell rows: one for each partition, merged on the executors by pairs of groups and then on the driver."""
    names = list(columns)

    def sketch(batches):
        import pandas as pd

        held = np.zeros((0, len(names)))
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            x = x[np.isfinite(x).all(1)]
            for i in range(0, len(x), 1000):
                held = shrink(np.concatenate((held, x[i : i + 1000])), ell)
        yield pd.DataFrame(held, columns=names)

    fields = ", ".join(f"`{c}` double" for c in names)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(sketch, fields)
    # partitions' sketches meet in ever fewer tasks
    rows = rows.repartition(16).mapInPandas(sketch, fields).coalesce(1).mapInPandas(sketch, fields)
    return rows.toPandas().to_numpy(float)


def tucker(tensor: np.ndarray, ranks: Sequence[int], rounds: int = 10) -> tuple[np.ndarray, list[np.ndarray]]:
    """(core, factors) of a Tucker decomposition by alternating orthogonal iterations from the HOSVD."""
    unfold = lambda t, m: np.moveaxis(t, m, 0).reshape(t.shape[m], -1)
    dot = lambda t, a, m: np.moveaxis(np.tensordot(a, np.moveaxis(t, m, 0), axes=1), 0, m)
    u = [np.linalg.svd(unfold(tensor, m), full_matrices=False)[0][:, :r] for m, r in enumerate(ranks)]
    for _ in range(rounds):
        for m in range(tensor.ndim):
            t = tensor
            for k in range(tensor.ndim):
                if k != m:
                    t = dot(t, u[k].T, k)
            u[m] = np.linalg.svd(unfold(t, m), full_matrices=False)[0][:, : ranks[m]]
    core = tensor
    for m in range(tensor.ndim):
        core = dot(core, u[m].T, m)
    return core, u
