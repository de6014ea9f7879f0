"""Queries of kernels and matrix operators: no SQL expresses them, so tests hold them against their definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import matrix, series
from tideframe.plans.catalog import query
from tideframe.plans.panels import SQL_SUPPLIER, read, supplier_day, user_events

ORDER = ["ts", "event_id"]
KEYS = ["entity", "time"]


def _series(name: str) -> None:
    @query(f"feature_{name}")
    def run(spark, sf_dir):
        df = series.series_features(user_events(spark, sf_dir), "entity", ORDER, "x", [name])
        return df.select("entity", (F.round(name, 6) if name in series.SERIES else F.transform(name, lambda v: F.round(v, 6))).alias("v"))


for _name in (*series.SERIES, *series.ARRAYS):
    _series(_name)


@query("catch22")
def catch22(spark, sf_dir):
    df = series.catch22_features(supplier_day(spark, sf_dir), "entity", ["time"], "x", catch24=True)
    return df.select("entity", *[F.round(c, 6).alias(c) for c in df.columns[1:]])


@query("econ_evt")
def evt(spark, sf_dir):
    return series.evt_features(supplier_day(spark, sf_dir), "entity", ["time"], "x")


@query("monitor_focus")
def focus(spark, sf_dir):
    df = supplier_day(spark, sf_dir).withColumn("z", (F.col("x") - 35) / 25).select(*KEYS, "z")
    return series.focus(df, "entity", "time", "z").select(*KEYS, F.round("focus", 6).alias("focus"))


@query("monitor_bsadf")
def bsadf(spark, sf_dir):
    df = supplier_day(spark, sf_dir).select(*KEYS, "x")
    return series.bubbles(df, "entity", "time", "x", 30).select(*KEYS, F.round("bsadf", 6).alias("bsadf"))


@query("depend_measures")
def dependence(spark, sf_dir):
    df = supplier_day(spark, sf_dir)
    names = list(series.kernels.DEPENDENCE)
    out = series.dependence(df, "entity", ["time"], "x", "y", names)
    return out.select("entity", *[F.round(n, 6).alias(n) for n in names])


def _rolling(name: str) -> None:
    @query(f"ts_rolling_{name}")
    def run(spark, sf_dir):
        df = series.rolling_dependence(supplier_day(spark, sf_dir), "entity", "time", "x", "y", 20, name, "v")
        return df.select(*KEYS, F.round("v", 6).alias("v"))


for _name in ("xi", "dcor", "tail_dep", "gcmi"):
    _rolling(_name)


@query("cluster_kshape")
def kshape(spark, sf_dir):
    return series.kshape(supplier_day(spark, sf_dir), "entity", "time", "x", 3, 32)


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _table(spark, rows, fields):
    return spark.createDataFrame(rows, fields)


@query("covariance_sample", "SELECT round(COVAR_SAMP(l_quantity, l_extendedprice), 1) AS qp, round(COVAR_SAMP(l_quantity, l_discount), 5) AS qd, round(VAR_SAMP(l_tax), 7) AS tt FROM lineitem")
def covariance(spark, sf_dir):
    c, _ = matrix.covariance(read(spark, sf_dir, "lineitem"), COLUMNS)
    return _table(spark, [(float(c[0, 1]), float(c[0, 2]), float(c[3, 3]))], "qp double, qd double, tt double").select(F.round("qp", 1).alias("qp"), F.round("qd", 5).alias("qd"), F.round("tt", 7).alias("tt"))


def _cov(method: str) -> None:
    @query(f"covariance_{method}")
    def run(spark, sf_dir):
        c, m = matrix.covariance(read(spark, sf_dir, "lineitem"), COLUMNS, method)
        return _table(spark, [(a, b, float(c[i, j])) for i, a in enumerate(m.names) for j, b in enumerate(m.names)], "a string, b string, cov double")


for _method in ("lw_identity", "lw_diagonal", "lw_constant_correlation", "oas", "mp_clip", "detone"):
    _cov(_method)


@query("reduce_pca")
def pca(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *COLUMNS)
    return matrix.pca(df, COLUMNS, 2).transform(df).select("l_orderkey", "l_linenumber", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("reduce_random_projection")
def projection(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *COLUMNS)
    return matrix.random_projection(df, COLUMNS, 2, "gaussian").select("l_orderkey", "l_linenumber", F.round("rp1", 4).alias("rp1"), F.round("rp2", 4).alias("rp2"))


@query("reduce_n_factors")
def n_factors(spark, sf_dir):
    p = matrix.pca(read(spark, sf_dir, "lineitem"), COLUMNS, 2)
    return _table(spark, [(matrix.n_factors(p.eigenvalues, p.moments.n), matrix.n_factors(p.eigenvalues, p.moments.n, "eigenvalue_ratio"))], "bai_ng long, eigenvalue_ratio long")


@query("select_columns")
def select(spark, sf_dir):
    m = matrix.moments(read(spark, sf_dir, "lineitem"), COLUMNS)
    got = {"variance": matrix.select_variance(m, 2), "correlation": matrix.select_correlation(m, 0.5), "mrmr": matrix.select_mrmr(m, "l_extendedprice", 2), "pfa": matrix.select_pfa(m, 2), "interpolative": matrix.pivoted_columns(m, 2)}
    return _table(spark, [(k, c) for k, v in got.items() for c in v], "method string, feature string")


@query("cluster_cross_sectional")
def clusters(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return matrix.kmeans(df, ["p_size", "p_retailprice"], 4).select("p_partkey", "cluster")


@query("covariance_average_correlation", f"""WITH {SQL_SUPPLIER}, z AS (SELECT time, (x - AVG(x) OVER (PARTITION BY entity)) / NULLIF(STDDEV_SAMP(x) OVER (PARTITION BY entity), 0) AS z FROM sd), p AS (SELECT time, SUM(z) AS s, COUNT(z) AS n FROM z WHERE z IS NOT NULL GROUP BY 1)
SELECT round((VAR_SAMP(s) - MAX(n)) / NULLIF(MAX(n) * (MAX(n) - 1), 0), 6) AS avg_correlation FROM p""")
def avg_corr(spark, sf_dir):
    return matrix.average_correlation(supplier_day(spark, sf_dir), "entity", "time", "x").select(F.round("avg_correlation", 6).alias("avg_correlation"))
