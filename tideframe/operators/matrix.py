"""What rests on the cross-products of columns: covariance estimators, factors, column selection, clusters, projections.

The rows are reduced to sums of products by one pre-aggregated pass (a table of k * k numbers, k the columns), and the rest is
linear algebra of that size on the driver; scores and labels are then computed as column expressions, on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions.core import clean

MOST_COLUMNS = 400


@dataclass(frozen=True)
class Moments:
    names: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray  # of the sample, n - 1

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    @property
    def corr(self) -> np.ndarray:
        d = np.where(self.sd > 0, self.sd, 1)
        c = self.cov / np.outer(d, d)
        np.fill_diagonal(c, 1)
        return c


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Means and covariances over the rows without a null in any column; shifted by a first estimate against cancellation."""
    names = list(columns)
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    x = [clean(F.col(c)) for c in names]
    ok = F.lit(True)
    for c in x:
        ok &= c.isNotNull()
    rows = df.where(ok)
    rough = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    shift = [rough[f"m{i}"] or 0.0 for i in range(len(x))]
    z = [c - F.lit(s) for c, s in zip(x, shift, strict=True)]
    aggs = [F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in z]).alias("s")]
    aggs += [F.array(*[F.sum(a * b) for b in z[i:]]).alias(f"g{i}") for i, a in enumerate(z)]
    r = rows.agg(*aggs).first()
    n, k = r["n"], len(names)
    s = np.array([v or 0.0 for v in r["s"]])
    g = np.zeros((k, k))
    for i in range(k):
        g[i, i:] = [v or 0.0 for v in r[f"g{i}"]]
    g = np.triu(g) + np.triu(g, 1).T
    mean = s / max(n, 1)
    return Moments(tuple(names), n, mean + shift, (g - n * np.outer(mean, mean)) / max(n - 1, 1))


# --- covariance ------------------------------------------------------------------------------------------------------------------------


def fourth_moment(df: DataFrame, m: Moments) -> float:
    """Mean over rows of the squared norm of x x' - S: what the intensity of shrinkage is made of."""
    z = [clean(F.col(c)) - float(a) for c, a in zip(m.names, m.mean, strict=True)]
    sq = z[0] * z[0]
    for c in z[1:]:
        sq = sq + c * c
    quad = F.lit(0.0)
    for i, a in enumerate(z):
        for j, b in enumerate(z):
            quad = quad + a * b * float(m.cov[i, j])
    s2 = float((m.cov**2).sum())
    return float(df.where(sq.isNotNull()).agg(F.avg(sq * sq - 2 * quad + s2).alias("v")).first()["v"] or 0.0)


def covariance(df: DataFrame, columns: Sequence[str], method: str = "sample") -> tuple[np.ndarray, Moments]:
    """sample, lw_identity, lw_diagonal, lw_constant_correlation, oas, mp_clip or detone."""
    m = moments(df, columns)
    s, k, n = m.cov * (m.n - 1) / max(m.n, 1), len(m.names), m.n
    if method == "sample":
        return m.cov, m
    if method in ("lw_identity", "lw_diagonal", "lw_constant_correlation"):
        if method == "lw_identity":
            target = np.eye(k) * np.trace(s) / k
        elif method == "lw_diagonal":
            target = np.diag(np.diag(s))
        else:
            r = (m.corr.sum() - k) / (k * (k - 1)) if k > 1 else 0.0
            target = r * np.outer(np.sqrt(np.diag(s)), np.sqrt(np.diag(s)))
            np.fill_diagonal(target, np.diag(s))
        gap = float(((s - target) ** 2).sum())
        intensity = min(1.0, fourth_moment(df, Moments(m.names, n, m.mean, s)) / n / gap) if gap > 0 else 1.0
        return (1 - intensity) * s + intensity * target, m
    if method == "oas":
        mu, tr2, t2 = np.trace(s) / k, float((s * s).sum()), np.trace(s) ** 2
        top, low = (1 - 2 / k) * tr2 + t2, (n + 1 - 2 / k) * (tr2 - t2 / k)
        rho = 1.0 if low <= 0 else min(1.0, top / low)
        return (1 - rho) * s + rho * mu * np.eye(k), m
    w, v = np.linalg.eigh(m.corr)
    if method == "mp_clip":
        noise = w < (1 + math.sqrt(k / n)) ** 2
        w = np.where(noise, w[noise].mean() if noise.any() else w, w)
    elif method == "detone":
        w = w.copy()
        w[-1] = 0.0
    else:
        raise ValueError(method)
    c = v @ np.diag(w) @ v.T
    d = np.sqrt(np.maximum(np.diag(c), 1e-12))
    return c / np.outer(d, d) * np.outer(m.sd, m.sd), m


# --- factors -----------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Components:
    """Loadings (columns x components) of standardised columns, with the eigenvalues of all components."""

    moments: Moments
    loadings: np.ndarray
    eigenvalues: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues[: self.loadings.shape[1]] / self.eigenvalues.sum()

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Scores as column expressions: no row leaves the JVM."""
        sd = np.where(self.moments.sd > 0, self.moments.sd, 1)
        z = [(clean(F.col(c)) - float(a)) / float(s) for c, a, s in zip(self.moments.names, self.moments.mean, sd, strict=True)]
        new: dict[str, Column] = {}
        for j in range(self.loadings.shape[1]):
            v = z[0] * float(self.loadings[0, j])
            for i in range(1, len(z)):
                v = v + z[i] * float(self.loadings[i, j])
            new[f"{prefix}{j + 1}"] = v
        return df.withColumns(new)


def pca(df: DataFrame, columns: Sequence[str], k: int) -> Components:
    """Principal components of the correlation matrix; signs are such that the largest loading is positive."""
    m = moments(df, columns)
    w, v = np.linalg.eigh(m.corr)
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return Components(m, v[:, :k], w)


def n_factors(eigenvalues: np.ndarray, n: int, method: str = "bai_ng", most: int | None = None) -> int:
    """bai_ng (IC_p2) or eigenvalue_ratio."""
    p = len(eigenvalues)
    most = most or max(1, min(p // 2, 8))
    if method == "eigenvalue_ratio":
        return int(np.argmax(eigenvalues[:most] / eigenvalues[1 : most + 1])) + 1
    penalty = (n + p) / (n * p) * math.log(min(n, p))
    ic = [math.log(max(eigenvalues[r:].sum() / p, 1e-12)) + r * penalty for r in range(most + 1)]
    return int(np.argmin(ic))


def random_projection(df: DataFrame, columns: Sequence[str], k: int, kind: str = "sparse", seed: int = 0, prefix: str = "rp") -> DataFrame:
    """Gaussian, sparse or count-sketch projections; the matrix is made from the seed, and applied as expressions."""
    rng, d = np.random.default_rng(seed), len(columns)
    if kind == "gaussian":
        r = rng.normal(size=(d, k)) / math.sqrt(k)
    elif kind == "sparse":
        s = math.sqrt(d)
        r = rng.choice([-1.0, 0.0, 1.0], p=[1 / (2 * s), 1 - 1 / s, 1 / (2 * s)], size=(d, k)) * math.sqrt(s / k)
    else:
        r = np.zeros((d, k))
        r[np.arange(d), rng.integers(0, k, d)] = rng.choice([-1.0, 1.0], d)
    new = {}
    for j in range(k):
        v = F.lit(0.0)
        for c, a in zip(columns, r[:, j], strict=True):
            if a:
                v = v + clean(F.col(c)) * float(a)
        new[f"{prefix}{j + 1}"] = v
    return df.withColumns(new)


# --- selection ----------------------------------------------------------------------------------------------------------------------------


def select_variance(m: Moments, k: int) -> list[str]:
    order = sorted(range(len(m.names)), key=lambda i: (-m.cov[i, i], i))[:k]
    return [m.names[i] for i in sorted(order)]


def select_correlation(m: Moments, threshold: float = 0.95) -> list[str]:
    """From the largest variance down, each column that is not too close to one already kept; in column order."""
    kept: list[int] = []
    for i in sorted(range(len(m.names)), key=lambda i: (-m.cov[i, i], i)):
        if all(abs(m.corr[i, j]) <= threshold for j in kept):
            kept.append(i)
    return [m.names[i] for i in sorted(kept)]


def select_mrmr(m: Moments, target: str, k: int) -> list[str]:
    """Greedy: largest correlation with the target less the mean correlation with those chosen."""
    t = m.names.index(target)
    c, left, out = np.abs(m.corr), [i for i in range(len(m.names)) if i != t], []
    while left and len(out) < k:
        best = max(left, key=lambda i: (c[i, t] - (c[i, out].mean() if out else 0.0), -i))
        out.append(best)
        left.remove(best)
    return [m.names[i] for i in out]


def select_pfa(m: Moments, k: int, explained: float = 0.95, seed: int = 0) -> list[str]:
    """Principal feature analysis: columns nearest to the centres of clusters of loadings."""
    w, v = np.linalg.eigh(m.corr)
    order = np.argsort(w)[::-1]
    q = int(np.searchsorted(np.cumsum(w[order]) / w.sum(), explained) + 1)
    rows = np.abs(v[:, order[:q]])
    label, centre = kmeans_points(rows, k, seed)
    return [m.names[i] for i in sorted({int(np.flatnonzero(label == j)[((rows[label == j] - centre[j]) ** 2).sum(1).argmin()]) for j in range(k) if (label == j).any()})]


def pivoted_columns(m: Moments, k: int) -> list[str]:
    """Column subset by pivoted elimination of the correlation matrix: each step takes the column that is explained least."""
    r, out = m.corr.copy(), []
    for _ in range(min(k, len(m.names))):
        d = np.diag(r).copy()
        d[out] = -1
        j = int(d.argmax())
        if d[j] <= 1e-12:
            break
        out.append(j)
        r = r - np.outer(r[:, j], r[j]) / r[j, j]
    return [m.names[j] for j in out]


# --- clusters -------------------------------------------------------------------------------------------------------------------------------


def kmeans_points(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    centre = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([((x - c) ** 2).sum(1) for c in centre], axis=0)
        centre.append(x[int(d.argmax())])
    centre = np.array(centre, float)
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for j in range(k):
            if (new == j).any():
                centre[j] = x[new == j].mean(0)
        if (new == label).all():
            break
        label = new
    return label, centre


def kmeans(df: DataFrame, columns: Sequence[str], k: int, seed: int = 0, rounds: int = 20) -> DataFrame:
    """Adds ``cluster``: k-means of standardised columns with the library's distributed implementation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=list(columns), outputCol="__v", handleInvalid="skip").transform(df)
    rows = StandardScaler(inputCol="__v", outputCol="__z", withMean=True).fit(rows).transform(rows)
    return KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__z", predictionCol="cluster").fit(rows).transform(rows).drop("__v", "__z")


# --- cross-sectional correlation --------------------------------------------------------------------------------------------------------------


def average_correlation(df: DataFrame, entity: str, time: str, column: str) -> DataFrame:
    """Mean correlation of all pairs of entities from two sums: (variance of the sum of z-scores - N) / (N (N - 1)); complete panels."""
    from pyspark.sql import Window

    z = (clean(F.col(column)) - F.avg(clean(F.col(column))).over(Window.partitionBy(entity))) / F.nullif(F.stddev_samp(clean(F.col(column))).over(Window.partitionBy(entity)), F.lit(0.0))
    per = df.select(time, entity, z.alias("z")).where("z is not null").groupBy(time).agg(F.sum("z").alias("s"), F.count("z").alias("n"))
    return per.agg(((F.var_samp("s") - F.max("n")) / F.nullif(F.max("n") * (F.max("n") - 1), F.lit(0))).alias("avg_correlation"), F.max("n").alias("n_entities"))


def pesaran_cd(df: DataFrame, entity: str, time: str, column: str) -> DataFrame:
    """Test of cross-sectional dependence of a balanced panel: sqrt(2 T / (N (N - 1))) times the sum of pair correlations."""
    a = average_correlation(df, entity, time, column)
    t = df.agg(F.count_distinct(time).alias("t"))
    n = F.col("n_entities")
    return a.join(F.broadcast(t)).select((F.sqrt(2 * F.col("t") / (n * (n - 1))) * F.col("avg_correlation") * n * (n - 1) / 2).alias("cd"), F.col("n_entities"))
