"""Panel regressions whose data pass is sums of products: per entity, per fold or per cluster."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions import regress
from tideframe.functions.core import clean
from tideframe.functions.inference import t_sf, two_sided
from tideframe.operators import econ, matrix, series


def grams(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by..., n, g): the upper triangle of the cross-products of 1 and the columns, for each group."""
    x = [F.lit(1.0)] + [clean(F.col(c)) for c in names]
    ok = F.lit(True)
    for c in x[1:]:
        ok &= c.isNotNull()
    sums = [F.sum(a * b) for i, a in enumerate(x) for b in x[i:]]
    return df.where(ok).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("g"))


def _square(g: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = g
    return out + np.triu(out, 1).T


def per_entity_ols(df: DataFrame, entity: str, y: str, x: Sequence[str], least: int = 5) -> DataFrame:
    """(entity, n, b): coefficients of 1 and x of each entity, from its cross-products; groups that are too short are left out."""
    k = len(x) + 2
    g = grams(df, [entity], [*x, y]).where(F.col("n") >= least)
    schema = T.StructType([df.schema[entity], T.StructField("n", T.LongType()), T.StructField("b", T.ArrayType(T.DoubleType()))])

    def solve(batches):
        for pdf in batches:
            yield pdf[[entity, "n"]].assign(b=[(np.linalg.pinv(m[:-1, :-1]) @ m[:-1, -1]).tolist() for m in (_square(v, k) for v in pdf.g)])

    return g.mapInPandas(solve, schema)


def _mean_of(slopes: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = None
    for i, n in enumerate(names):
        b = F.col("b")[i]
        one = slopes.agg(F.lit(n).alias("term"), F.avg(b).alias("coef"), (F.stddev_samp(b) / F.sqrt(F.count(b))).alias("se"), F.count(b).alias("n_entities"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("t", F.try_divide("coef", "se"))


def mean_group(df: DataFrame, entity: str, y: str, x: Sequence[str], least: int = 5) -> DataFrame:
    return _mean_of(per_entity_ols(df, entity, y, x, least), ["const", *x])


def cross_sectional_averages(df: DataFrame, time: str, columns: Sequence[str], suffix: str = "_csa") -> DataFrame:
    """Per-date means: proxies of common factors."""
    w = Window.partitionBy(time)
    return df.withColumns({f"{c}{suffix}": F.avg(clean(F.col(c))).over(w) for c in columns})


def cce_mg(df: DataFrame, entity: str, time: str, y: str, x: Sequence[str], least: int = 8) -> DataFrame:
    """Common correlated effects: the entities' regressions with the dates' averages of y and x, averaged."""
    held = cross_sectional_averages(df, time, [y, *x])
    slopes = per_entity_ols(held, entity, y, [*x, *[f"{c}_csa" for c in (y, *x)]], least)
    return _mean_of(slopes, ["const", *x])


def cce_pooled(df: DataFrame, entity: str, time: str, y: str, x: Sequence[str], least: int = 8) -> DataFrame:
    """Pooled slopes after each entity's regression on the averages is taken out of its cross-products."""
    held = cross_sectional_averages(df, time, [y, *x])
    names = [f"{c}_csa" for c in (y, *x)] + [*x, y]
    k, z = len(names) + 1, len(x) + 2
    g = grams(held, [entity], names).where(F.col("n") >= least)

    def partial(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for v in pdf.g:
                m = _square(v, k)
                out.append((m[z:, z:] - m[z:, :z] @ np.linalg.pinv(m[:z, :z]) @ m[:z, z:]).ravel().tolist())
            yield pd.DataFrame({"m": out})

    p = len(x) + 1
    parts = g.mapInPandas(partial, "m array<double>").agg(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(p * p)]).first()
    m = np.array([parts[f"m{i}"] for i in range(p * p)]).reshape(p, p)
    b = np.linalg.pinv(m[:-1, :-1]) @ m[:-1, -1]
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(x, b, strict=True)], "term string, coef double")


def hdfe(df: DataFrame, y: str, x: Sequence[str], absorb: Sequence[str], cluster: str | None = None) -> DataFrame:
    """Slopes with the absorbed effects swept out; errors clustered, or robust to unequal variances."""
    names = [f"{c}_within" for c in (y, *x)]
    held = econ.demean_within(df, [y, *x], absorb)
    g = grams(held, [], names[1:] + names[:1]).first()
    m = _square(g["g"], len(names) + 1)[1:, 1:]
    inv = np.linalg.pinv(m[:-1, :-1])
    b = inv @ m[:-1, -1]
    e = F.col(names[0])
    for c, v in zip(names[1:], b, strict=True):
        e = e - F.col(c) * float(v)
    scores = held.where(e.isNotNull()).select(*([cluster] if cluster else []), *[(F.col(c) * e).alias(f"s{i}") for i, c in enumerate(names[1:])])
    if cluster:
        scores = scores.groupBy(cluster).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(x))])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    r = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((len(x), len(x)))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = r[f"{i}_{j}"]
    se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
    rows = [(n, float(v), float(s), float(v / s) if s > 0 else None, two_sided(v / s) if s > 0 else None) for n, v, s in zip(x, b, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, p double")


def double_ml(df: DataFrame, time: str, y: str, d: str, controls: Sequence[str], folds: int = 5) -> DataFrame:
    """Cross-fitted partially linear effect: folds are blocks of time; each fold's regressions come from the others' cross-products."""
    names = [*controls, y, d]
    cuts = df.agg(F.percentile(F.col(time).cast("double"), [i / folds for i in range(1, folds)]).alias("c")).first()["c"]
    fold = F.lit(0)
    for c in cuts:
        fold = fold + F.when(F.col(time).cast("double") > c, 1).otherwise(0)
    held = df.withColumn("__f", fold)
    k, z = len(names) + 1, len(controls) + 1
    parts = {r["__f"]: _square(r["g"], k) for r in grams(held, ["__f"], names).collect()}
    total = sum(parts.values())
    ry, rd = F.lit(None).cast("double"), F.lit(None).cast("double")
    for f, m in parts.items():
        rest = total - m
        b = np.linalg.pinv(rest[:z, :z]) @ rest[:z, z:]
        fit = [F.lit(float(b[0, j])) for j in (0, 1)]
        for i, c in enumerate(controls, start=1):
            fit = [v + clean(F.col(c)) * float(b[i, j]) for j, v in enumerate(fit)]
        here = F.col("__f") == f
        ry, rd = F.when(here, clean(F.col(y)) - fit[0]).otherwise(ry), F.when(here, clean(F.col(d)) - fit[1]).otherwise(rd)
    s = held.select(ry.alias("a"), rd.alias("b")).where("a is not null and b is not null")
    r = s.agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.count(F.lit(1)).alias("n")).first()
    theta = r["ab"] / r["bb"]
    v = s.agg(F.sum(F.pow(F.col("b") * (F.col("a") - theta * F.col("b")), F.lit(2.0))).alias("v")).first()["v"]
    se = math.sqrt(v) / r["bb"]
    return df.sparkSession.createDataFrame([(d, float(theta), float(se), float(theta / se), float(two_sided(theta / se)), int(r["n"]))], "treatment string, theta double, se double, t double, p double, n long")


def post_double_selection(df: DataFrame, y: str, d: str, controls: Sequence[str]) -> DataFrame:
    """Effect of d with the controls that a lasso on the correlation matrix picks for y or for d."""
    m = matrix.moments(df, [*controls, y, d])
    p, n = len(controls), m.n
    from tideframe.functions.kernels import normal_quantile

    level = 1.1 / math.sqrt(n) * float(normal_quantile(np.array([1 - 0.1 / math.log(max(n, 3)) / (2 * p)]))[0])
    chosen: set[int] = set()
    for t in (p, p + 1):
        a, c, b = m.corr[:p, :p], m.corr[:p, t], np.zeros(p)
        for _ in range(500):
            old = b.copy()
            for j in range(p):
                z = c[j] - a[j] @ b + b[j]
                b[j] = math.copysign(max(abs(z) - level, 0.0), z)
            if np.abs(b - old).max() < 1e-10:
                break
        chosen |= set(np.flatnonzero(b).tolist())
    keep = [p + 1, *sorted(chosen)]
    s = m.cov[np.ix_(keep, keep)]
    b = np.linalg.pinv(s) @ m.cov[keep, p]
    rss = (m.cov[p, p] - b @ m.cov[keep, p]) * (n - 1)
    se = math.sqrt(max(rss, 0) / max(1, n - len(keep) - 1) * np.linalg.pinv(s * (n - 1))[0, 0])
    t = float(b[0]) / se
    return df.sparkSession.createDataFrame([(d, float(b[0]), se, t, float(2 * t_sf(abs(t), max(1, n - len(keep) - 1))), [controls[j] for j in sorted(chosen)])], "treatment string, theta double, se double, t double, p double, selected array<string>")


def unit_root_panel(df: DataFrame, entity: str, time: str, column: str, lags: int = 1) -> DataFrame:
    """Mean Dickey-Fuller statistic over the entities (t-bar) and its pieces."""
    one = series.series_features(df, entity, [time], column, ["augmented_dickey_fuller"])
    return one.agg(F.avg("augmented_dickey_fuller").alias("t_bar"), F.stddev_samp("augmented_dickey_fuller").alias("sd"), F.count("augmented_dickey_fuller").alias("n_entities"))


def decompose(df: DataFrame, entity: str, time: str, column: str, period: int) -> DataFrame:
    """Adds ``column_trend``, ``column_seasonal`` and ``column_remainder`` by trailing means."""
    parts = [f"{column}_{part}" for part in ("trend", "seasonal", "remainder")]
    return series.row_aligned(df, entity, [time], column, lambda x: regress.causal_decompose(x, period), parts)


def connectedness(df: DataFrame, time: str, columns: Sequence[str], lags: int = 1, horizon: int = 10, most: int = 100_000) -> DataFrame:
    """(name, to, from, net): spillovers in a system of series, one row per date."""
    pdf = df.select(time, *columns).dropna().orderBy(time).limit(most + 1).toPandas()
    if len(pdf) > most:
        raise ValueError("too many dates")
    r = regress.connectedness(pdf[list(columns)].to_numpy(float), lags, horizon)
    return df.sparkSession.createDataFrame([(c, float(r["to"][i]), float(r["from"][i]), float(r["net"][i])) for i, c in enumerate(columns)], "name string, to double, from double, net double")


def ivx_screen(df: DataFrame, entity: str, time: str, y: str, candidates: Sequence[str]) -> DataFrame:
    """(entity, candidate, wald, pvalue) of each predictor."""
    def f(*cols):
        out = {}
        for c, x in zip(candidates, cols[1:], strict=True):
            r = regress.ivx(cols[0], x) if len(x) > 20 else {"wald": None, "pvalue": None}
            out |= {f"{c}_wald": r["wald"], f"{c}_p": r["pvalue"]}
        return out

    wide = series.per_entity(df, entity, [time], [y, *candidates], f, ", ".join(f"{c}_wald double, {c}_p double" for c in candidates))
    rows = F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(f"{c}_wald").alias("wald"), F.col(f"{c}_p").alias("pvalue")) for c in candidates])
    return wide.select(entity, F.explode(rows).alias("x")).select(entity, "x.*")
