"""Queries of the tests and statistics of each entity or date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import inference as inf
from tideframe.operators import splits
from tideframe.plans.catalog import query
from tideframe.plans.panels import SQL_SUPPLIER, SQL_W, W, r6, supplier_day

KEYS = ["entity", "time"]
_AS = f"AVG(x) OVER ({SQL_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p, AVG(x) OVER ({SQL_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS q"
_F = f"{SQL_SUPPLIER}, f0 AS (SELECT entity, time, x, {_AS} FROM sd), f AS (SELECT * FROM f0 WHERE p IS NOT NULL)"


def _forecasts(spark, sf_dir):
    """x with two forecasts: the means of the last 5 (p) and of the last 20 values (q)."""
    df = supplier_day(spark, sf_dir)
    df = df.select(*KEYS, "x", F.avg("x").over(W().rowsBetween(-5, -1)).alias("p"), F.avg("x").over(W().rowsBetween(-20, -1)).alias("q"))
    return df.where("p is not null")


def _rounded(df, *keys, digits: int = 5):
    return df.select(*keys, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keys])


def phi_sql(x: str) -> str:
    """The normal distribution function of a column, in SQL."""

    def horner(cs):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * ABS({x}) + {c!r})"
        return out

    far = f"(ABS({x}) + 1 / (ABS({x}) + 2 / (ABS({x}) + 3 / (ABS({x}) + 4 / (ABS({x}) + 0.65)))))"
    tail = f"(EXP(-{x} * {x} / 2) * CASE WHEN ABS({x}) < {inf.CDF_FAR!r} THEN {horner(inf.CDF_NUMERATOR)} / {horner(inf.CDF_DENOMINATOR)} ELSE 1 / {far} / SQRT(2 * PI()) END)"
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"


def _lrv(source: str, lags: int) -> str:
    """CTEs ending in ``lrv`` (entity, n, mean, variance) of the column d of a relation."""
    lag = "".join(f", LAG(c, {k}) OVER ({SQL_W}) AS l{k}" for k in range(1, lags + 1))
    total = "SUM(c * c)" + "".join(f" + 2 * {1 - k / (lags + 1)!r} * COALESCE(SUM(c * l{k}), 0)" for k in range(1, lags + 1))
    return f"c0 AS (SELECT entity, time, d, d - AVG(d) OVER (PARTITION BY entity) AS c FROM {source} WHERE d IS NOT NULL), c1 AS (SELECT *{lag} FROM c0), lrv AS (SELECT entity, COUNT(*) AS n, AVG(d) AS mean, ({total}) / COUNT(*) AS variance FROM c1 GROUP BY 1)"


def _mean_test(value: str, horizon: int, p: str, factor: str = "1") -> str:
    z = f"mean / SQRT(CASE WHEN variance > 0 THEN variance END / n) * {factor}"
    return f"WITH {_F}, v AS (SELECT entity, time, {value} AS d FROM f), {_lrv('v', horizon - 1)}, z AS (SELECT entity, n, mean AS estimate, {z} AS s FROM lrv) SELECT entity, n, round(estimate, 5) AS estimate, round(s, 5) AS statistic, round({p}, 5) AS pvalue FROM z"


_ABOVE = f"1 - ({phi_sql('s')})"


@query("infer_newey_west_variance", f"WITH {SQL_SUPPLIER}, v AS (SELECT entity, time, x AS d FROM sd), {_lrv('v', 4)} SELECT entity, n, round(mean, 5) AS mean, round(variance, 5) AS variance FROM lrv")
def newey_west(spark, sf_dir):
    return _rounded(inf.newey_west_variance(supplier_day(spark, sf_dir), "entity", "time", "x", 4), "entity", "n")


@query("infer_diebold_mariano", _mean_test("(x - p) * (x - p) - (x - q) * (x - q)", 3, f"2 * (1 - ({phi_sql('ABS(s)')}))", "SQRT(GREATEST(0, (n + 1 - 2 * 3 + 3 * 2 / n) / n))"))
def diebold_mariano(spark, sf_dir):
    df = _forecasts(spark, sf_dir).withColumns({"a": F.pow(F.col("x") - F.col("p"), 2), "b": F.pow(F.col("x") - F.col("q"), 2)})
    return _rounded(inf.diebold_mariano_test(df, "entity", "time", "a", "b", 3), "entity", "n")


@query("infer_clark_west", _mean_test("(x - p) * (x - p) - ((x - q) * (x - q) - (p - q) * (p - q))", 2, _ABOVE))
def clark_west(spark, sf_dir):
    return _rounded(inf.clark_west_test(_forecasts(spark, sf_dir), "entity", "time", "x", "p", "q", 2), "entity", "n")


@query("infer_encompassing", _mean_test("(x - p) * ((x - p) - (x - q))", 1, _ABOVE))
def encompassing(spark, sf_dir):
    return _rounded(inf.encompassing_test(_forecasts(spark, sf_dir), "entity", "time", "x", "p", "q"), "entity", "n")


@query("infer_oos_r2", f"WITH {_F} SELECT entity, round(1 - SUM((x - p) * (x - p)) / NULLIF(SUM((x - q) * (x - q)), 0), 5) AS oos_r2 FROM f GROUP BY 1")
def oos_r2(spark, sf_dir):
    return _rounded(inf.oos_r2(_forecasts(spark, sf_dir), "entity", "x", "p", "q"), "entity")


@query("infer_pesaran_timmermann", f"""WITH {_F}, b AS (SELECT entity, COUNT(*) AS n, AVG(CASE WHEN (x > 35) = (p > 35) THEN 1.0 ELSE 0 END)::DOUBLE AS hit, AVG(CASE WHEN x > 35 THEN 1.0 ELSE 0 END)::DOUBLE AS a, AVG(CASE WHEN p > 35 THEN 1.0 ELSE 0 END)::DOUBLE AS b FROM f GROUP BY 1),
e AS (SELECT *, a * b + (1 - a) * (1 - b) AS e FROM b), w AS (SELECT *, e * (1 - e) / n - ((2 * a - 1) * (2 * a - 1) * b * (1 - b) + (2 * b - 1) * (2 * b - 1) * a * (1 - a)) / n - 4 * a * b * (1 - a) * (1 - b) / n / n AS w FROM e),
z AS (SELECT *, (hit - e) / SQRT(CASE WHEN w > 1e-15 THEN w END) AS s FROM w) SELECT entity, n, round(hit, 5) AS estimate, round(s, 5) AS statistic, round({_ABOVE}, 5) AS pvalue FROM z""")
def pesaran_timmermann(spark, sf_dir):
    return _rounded(inf.pesaran_timmermann_test(_forecasts(spark, sf_dir), "entity", "x", "p", 35.0), "entity", "n")


def _ll(k: str, n: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * LN({k}::DOUBLE / {n}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - {k}) * LN(1 - {k}::DOUBLE / {n}) ELSE 0 END)"


_VAR = f"""{_F}, h AS (SELECT entity, time, CASE WHEN x < 0.5 * p THEN 1 ELSE 0 END AS h FROM f), l AS (SELECT *, LAG(h) OVER ({SQL_W}) AS b FROM h),
s AS (SELECT entity, COUNT(*) AS n, CAST(SUM(h) AS BIGINT) AS k, COUNT(*) FILTER (b = 0 AND h = 0) AS c00, COUNT(*) FILTER (b = 0 AND h = 1) AS c01, COUNT(*) FILTER (b = 1 AND h = 0) AS c10, COUNT(*) FILTER (b = 1 AND h = 1) AS c11 FROM l GROUP BY 1),
t AS (SELECT entity, n, k AS hits, GREATEST(0, -2 * (k * LN(0.2) + (n - k) * LN(0.8) - {_ll('k', 'n')})) AS uc,
  GREATEST(0, -2 * ({_ll('(c01 + c11)', '(c00 + c01 + c10 + c11)')} - {_ll('c01', '(c00 + c01)')} - {_ll('c11', '(c10 + c11)')})) AS ind FROM s),
u AS (SELECT *, SQRT(uc) AS s, SQRT(ind) AS i FROM t)"""


@query("infer_var_backtest", f"WITH {_VAR} SELECT entity, n, hits, round(uc, 5) AS lr_uc, round(2 * (1 - ({phi_sql('s')})), 5) AS p_uc, round(ind, 5) AS lr_ind, round(2 * (1 - ({phi_sql('i')})), 5) AS p_ind, round(uc + ind, 5) AS lr_cc, round(EXP(-(uc + ind) / 2), 5) AS p_cc FROM u")
def var_backtest(spark, sf_dir):
    df = _forecasts(spark, sf_dir).withColumn("v", 0.5 * F.col("p"))
    return _rounded(inf.var_backtest(df, "entity", "time", "x", "v", 0.2), "entity", "n", "hits")


@query("infer_kupiec", f"WITH {_VAR} SELECT entity, n, hits, round(uc, 5) AS statistic, round(2 * (1 - ({phi_sql('s')})), 5) AS pvalue FROM u")
def kupiec(spark, sf_dir):
    df = _forecasts(spark, sf_dir).withColumn("v", 0.5 * F.col("p"))
    return _rounded(inf.kupiec_test(df, "entity", "time", "x", "v", 0.2), "entity", "n", "hits")


@query("infer_christoffersen", f"WITH {_VAR} SELECT entity, n, hits, round(ind, 5) AS statistic, round(2 * (1 - ({phi_sql('i')})), 5) AS pvalue FROM u")
def christoffersen(spark, sf_dir):
    df = _forecasts(spark, sf_dir).withColumn("v", 0.5 * F.col("p"))
    return _rounded(inf.christoffersen_test(df, "entity", "time", "x", "v", 0.2, "independence"), "entity", "n", "hits")


_R = f"{_F}, r AS (SELECT entity, time, x - p AS r FROM f)"
_M = "m AS (SELECT entity, COUNT(*) AS n, AVG(r) / NULLIF(STDDEV_SAMP(r), 0) AS sr FROM r GROUP BY 1)"


@query("infer_sharpe_ratio_test", f"""WITH {_R}, {_M}, z AS (SELECT entity, time, (r - AVG(r) OVER e) / NULLIF(STDDEV_SAMP(r) OVER e, 0) AS z, AVG(r) OVER e / NULLIF(STDDEV_SAMP(r) OVER e, 0) AS sr FROM r WINDOW e AS (PARTITION BY entity)), v AS (SELECT entity, time, z - sr / 2 * (z * z - 1) AS d FROM z), {_lrv('v', 3)},
t AS (SELECT lrv.entity, lrv.n, m.sr, (m.sr - 0.05) / SQRT(CASE WHEN variance > 0 THEN variance END / lrv.n) AS s FROM lrv JOIN m ON lrv.entity = m.entity) SELECT entity, n, round(sr, 5) AS sharpe, round(s, 5) AS statistic, round({_ABOVE}, 5) AS pvalue FROM t""")
def sharpe_test(spark, sf_dir):
    df = _forecasts(spark, sf_dir).withColumn("r", F.col("x") - F.col("p"))
    return _rounded(inf.sharpe_ratio_test(df, "entity", "time", "r", 0.05, 3), "entity", "n")


_SHAPE = "SELECT entity, COUNT(*) AS n, AVG(c * c) AS m2, AVG(c * c * c) AS m3, AVG(c * c * c * c) AS m4"


@query("infer_probabilistic_sharpe", f"""WITH {_R}, {_M}, d AS (SELECT entity, r - AVG(r) OVER (PARTITION BY entity) AS c FROM r), g AS ({_SHAPE} FROM d GROUP BY 1),
v AS (SELECT m.entity, m.n, sr, 1 - m3 / NULLIF(POW(m2, 1.5), 0) * sr + (m4 / NULLIF(m2 * m2, 0) - 1) / 4 * sr * sr AS v FROM m JOIN g ON m.entity = g.entity), t AS (SELECT *, (sr + 0.1) * SQRT(n - 1) / SQRT(CASE WHEN v > 0 THEN v END) AS s FROM v)
SELECT entity, n, round(sr, 5) AS sharpe, round({phi_sql('s')}, 5) AS psr, round(CASE WHEN sr > -0.1 THEN 1 + v * POW(1.6448536269514722 / (sr + 0.1), 2) END, 3) AS min_track_record FROM t""")
def probabilistic_sharpe(spark, sf_dir):
    df = _forecasts(spark, sf_dir).withColumn("r", F.col("x") - F.col("p"))
    out = inf.probabilistic_sharpe_ratio(df, "entity", "r", -0.1)
    return out.select("entity", "n", F.round("sharpe", 5).alias("sharpe"), F.round("psr", 5).alias("psr"), F.round("min_track_record", 3).alias("min_track_record"))


@query("econ_kpss", f"""WITH {SQL_SUPPLIER}, v AS (SELECT entity, time, x AS d FROM sd), {_lrv('v', 5)}, s AS (SELECT entity, SUM(c) OVER ({SQL_W} ROWS UNBOUNDED PRECEDING) AS s FROM c0), t AS (SELECT entity, SUM(s * s) AS ss FROM s GROUP BY 1)
SELECT lrv.entity, n, round(CASE WHEN n >= 8 THEN ss / (n::DOUBLE * n * CASE WHEN variance > 0 THEN variance END) END, 5) AS statistic FROM lrv JOIN t ON lrv.entity = t.entity""")
def kpss(spark, sf_dir):
    return _rounded(inf.kpss(supplier_day(spark, sf_dir), "entity", "time", "x", 5), "entity", "n")


@query("metric_normality", f"""WITH {_R}, d AS (SELECT entity, r - AVG(r) OVER (PARTITION BY entity) AS c FROM r), g AS ({_SHAPE} FROM d GROUP BY 1), a AS (SELECT entity, n, CASE WHEN n >= 8 THEN n::DOUBLE END AS o, m3 / NULLIF(POW(m2, 1.5), 0) AS g, m4 / NULLIF(m2 * m2, 0) AS k FROM g),
b AS (SELECT *, g * SQRT((o + 1) * (o + 3) / (6 * (o - 2))) AS y, SQRT(2 * (3 * (o * o + 27 * o - 70) * (o + 1) * (o + 3) / ((o - 2) * (o + 5) * (o + 7) * (o + 9)) - 1)) - 1 AS w,
  (k - 3 * (o - 1) / (o + 1)) / SQRT(24 * o * (o - 2) * (o - 3) / ((o + 1) * (o + 1) * (o + 3) * (o + 5))) AS x, 6 * (o * o - 5 * o + 2) / ((o + 7) * (o + 9)) * SQRT(6 * (o + 3) * (o + 5) / (o * (o - 2) * (o - 3))) AS q FROM a),
e AS (SELECT *, ASINH(y / SQRT(2 / (w - 1))) / SQRT(0.5 * LN(w)) AS z1, 6 + 8 / q * (2 / q + SQRT(1 + 4 / (q * q))) AS a FROM b), h AS (SELECT *, 1 + x * SQRT(2 / (a - 4)) AS d FROM e),
i AS (SELECT *, (1 - 2 / (9 * a) - SIGN(d) * CBRT((1 - 2 / a) / NULLIF(ABS(d), 0))) / SQRT(2 / (9 * a)) AS z2 FROM h)
SELECT entity, CASE WHEN n >= 8 THEN n END AS n, round(z1 * z1 + z2 * z2, 5) AS statistic, round(EXP(-(z1 * z1 + z2 * z2) / 2), 5) AS pvalue FROM i""")
def normality(spark, sf_dir):
    df = _forecasts(spark, sf_dir).withColumn("r", F.col("x") - F.col("p"))
    return _rounded(inf.normality_test(df, "entity", "r"), "entity", "n")


def _loss(name: str, sql: str, make) -> None:
    @query(f"score_{name}", f"WITH {_F}, z AS (SELECT *, (x - p) / 10.0 AS s FROM f) SELECT entity, time, round({sql}, 6) AS v FROM z")
    def run(spark, sf_dir):
        return _forecasts(spark, sf_dir).select(*KEYS, r6(make()).alias("v"))


_loss("qlike", "CASE WHEN x / NULLIF(p, 0) > 0 THEN x / p - LN(x / p) - 1 END", lambda: inf.qlike_loss(F.col("x"), F.col("p")))
_loss("fz0", "-CASE WHEN x - q <= -0.5 * p THEN (-0.5 * p - (x - q)) / (0.1 * -p) ELSE 0 END + 0.5 + LN(p) - 1", lambda: inf.fz0_loss(F.col("x") - F.col("q"), -0.5 * F.col("p"), -F.col("p"), 0.1))
_loss("crps_gaussian", f"10 * (s * (2 * ({phi_sql('s')}) - 1) + 2 * EXP(-s * s / 2) / SQRT(2 * PI()) - 1 / SQRT(PI()))", lambda: inf.crps_gaussian(F.col("x"), F.col("p"), F.lit(10.0)))




@query("xs_avg_skewness", f"""WITH {SQL_SUPPLIER}, w AS (SELECT time, COUNT(x) OVER t AS k, list(x) OVER t AS xs FROM sd WINDOW t AS ({SQL_W} ROWS 20 PRECEDING)), c AS (SELECT time, k, list_transform(xs, lambda v: v - list_avg(xs)) AS c FROM w),
s AS (SELECT time, CASE WHEN k >= 21 THEN list_avg(list_transform(c, lambda v: v * v * v)) / POW(list_avg(list_transform(c, lambda v: v * v)), 1.5) END AS g FROM c)
SELECT time, round(AVG(g), 5) AS avg_skew, COUNT(g) AS n_entities FROM s GROUP BY 1""")
def avg_skewness(spark, sf_dir):
    return _rounded(inf.avg_skewness(supplier_day(spark, sf_dir), "entity", "time", "x", 21), "time", "n_entities")


@query("monitor_breadth", f"WITH {SQL_SUPPLIER} SELECT time, round(AVG(CASE WHEN x > 50 THEN 1.0 ELSE 0 END), 6) AS breadth FROM sd GROUP BY 1")
def breadth(spark, sf_dir):
    return _rounded(inf.breadth(supplier_day(spark, sf_dir), "time", "x", 50.0), "time", digits=6)


@query("xs_wasserstein", f"""WITH {SQL_SUPPLIER}, d AS (SELECT time, COUNT(*) AS n, LAG(time) OVER (ORDER BY time) AS b, LEAD(time) OVER (ORDER BY time) AS a FROM sd GROUP BY 1),
u AS (SELECT sd.time, x, 1.0::DOUBLE / d.n AS p FROM sd JOIN d ON sd.time = d.time UNION ALL SELECT d.a, x, -1.0::DOUBLE / d.n FROM sd JOIN d ON sd.time = d.time WHERE d.a IS NOT NULL),
g AS (SELECT time, SUM(p) OVER (PARTITION BY time ORDER BY x ROWS UNBOUNDED PRECEDING) AS f, LEAD(x) OVER (PARTITION BY time ORDER BY x) - x AS gap FROM u), s AS (SELECT time, SUM(ABS(f) * COALESCE(gap, 0)) AS w FROM g GROUP BY 1)
SELECT s.time, round(CASE WHEN d.b IS NOT NULL THEN w END, 5) AS xs_w1 FROM s JOIN d ON s.time = d.time""")
def wasserstein(spark, sf_dir):
    return _rounded(inf.xs_wasserstein(supplier_day(spark, sf_dir), "time", "x"), "time")


@query("factor_rank_turnover", f"""WITH {SQL_SUPPLIER}, r AS (SELECT entity, time, DENSE_RANK() OVER (ORDER BY time) AS d, RANK() OVER (PARTITION BY time ORDER BY x) + (COUNT(*) OVER (PARTITION BY time, x) - 1) / 2.0::DOUBLE AS r FROM sd),
b AS (SELECT n.time, n.r, o.r AS b FROM r n JOIN r o ON n.entity = o.entity AND o.d = n.d - 1), c AS (SELECT time, COUNT(*) AS n, COVAR_POP(r, b) / NULLIF(STDDEV_POP(r) * STDDEV_POP(b), 0) AS c FROM b GROUP BY 1)
SELECT round(1 - AVG(c), 6) AS turnover FROM c WHERE n >= 3""")
def turnover(spark, sf_dir):
    return inf.rank_turnover(supplier_day(spark, sf_dir), "entity", "time", "x").select(F.round("turnover", 6).alias("turnover"))


@query("conformal_nexcp", f"""WITH {_F}, a AS (SELECT entity, ABS(x - p) AS s, POW(0.99::DOUBLE, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY time DESC)) AS w FROM f),
c AS (SELECT entity, s, SUM(w) OVER (PARTITION BY entity ORDER BY s) / (SUM(w) OVER (PARTITION BY entity) + 1) AS c FROM a) SELECT entity, round(MIN(CASE WHEN c >= 1 - 0.1::DOUBLE THEN s END), 5) AS radius FROM c GROUP BY 1""")
def nexcp(spark, sf_dir):
    df = _forecasts(spark, sf_dir).withColumn("s", F.abs(F.col("x") - F.col("p")))
    return _rounded(inf.nexcp_quantile(df, "entity", "time", "s"), "entity")


_T = "OVER t"


@query("econ_pastor_stambaugh", f"""WITH {SQL_SUPPLIER}, r AS (SELECT entity, time, LN(x / LAG(x) OVER ({SQL_W})) AS r, y FROM sd), m AS (SELECT *, r - AVG(r) OVER (PARTITION BY time) AS e FROM r),
l AS (SELECT entity, time, e, LAG(r) OVER ({SQL_W}) AS a, LAG(SIGN(e) * y * 0.01) OVER ({SQL_W}) AS b FROM m), k AS (SELECT entity, time, CASE WHEN ok THEN e END AS y, CASE WHEN ok THEN a END AS a, CASE WHEN ok THEN b END AS b FROM (SELECT *, e + a + b IS NOT NULL AS ok FROM l)),
w AS (SELECT entity, time, COUNT(y) {_T} AS n, COVAR_POP(a, a) {_T} AS aa, COVAR_POP(b, b) {_T} AS bb, COVAR_POP(a, b) {_T} AS ab, COVAR_POP(a, y) {_T} AS ay, COVAR_POP(b, y) {_T} AS b_y FROM k WINDOW t AS ({SQL_W} ROWS 20 PRECEDING))
SELECT entity, time, round(CASE WHEN n >= 21 AND aa * bb - ab * ab > 1e-12 * aa * bb THEN (aa * b_y - ab * ay) / (aa * bb - ab * ab) END, 5) AS gamma FROM w""")
def pastor_stambaugh(spark, sf_dir):
    from pyspark.sql import Window

    df = supplier_day(spark, sf_dir).withColumn("r", F.ln(F.col("x") / F.lag("x").over(W())))
    df = df.withColumn("m", F.avg("r").over(Window.partitionBy("time")))
    return inf.pastor_stambaugh_gamma(df, "entity", "time", "r", "m", "y", 21, 0.01).select(*KEYS, F.round("gamma", 5).alias("gamma"))


@query("econ_phillips_perron", f"""WITH {SQL_SUPPLIER}, a AS (SELECT entity, time, x AS y, LAG(x) OVER ({SQL_W}) AS l FROM sd), b AS (SELECT * FROM a WHERE l IS NOT NULL),
r AS (SELECT *, COVAR_POP(y, l) OVER e / NULLIF(VAR_POP(l) OVER e, 0) AS rho, AVG(y) OVER e AS my, AVG(l) OVER e AS ml FROM b WINDOW e AS (PARTITION BY entity)), v AS (SELECT entity, time, l, rho, y - my - rho * (l - ml) AS d FROM r), {_lrv('v', 4)},
g AS (SELECT entity, COUNT(*) AS n, ANY_VALUE(rho) AS rho, AVG(d * d) AS g, VAR_POP(l) AS v FROM v GROUP BY 1), s AS (SELECT g.entity, g.n, rho, g, variance AS lam, SQRT(g * g.n / CASE WHEN g.n > 2 THEN g.n - 2 END) AS s, SQRT(g * g.n / CASE WHEN g.n > 2 THEN g.n - 2 END) / SQRT(g.n * v) AS se FROM g LEFT JOIN lrv ON g.entity = lrv.entity)
SELECT entity, n, round(rho, 5) AS rho, round(CASE WHEN n >= 7 THEN SQRT(g / lam) * (rho - 1) / se - (lam - g) * n * se / (2 * SQRT(lam) * s) END, 5) AS statistic FROM s""")
def phillips_perron(spark, sf_dir):
    return _rounded(inf.phillips_perron(supplier_day(spark, sf_dir), "entity", "time", "x", 4), "entity", "n")


@query("infer_mincer_zarnowitz", f"""WITH {_F}, a AS (SELECT entity, x, COVAR_POP(x, p) OVER e / NULLIF(VAR_POP(p) OVER e, 0) AS slope, AVG(x) OVER e AS my, AVG(p) OVER e AS mf, p - AVG(p) OVER e AS z FROM f WINDOW e AS (PARTITION BY entity)), b AS (SELECT *, x - my - slope * z AS u FROM a),
s AS (SELECT entity, COUNT(*) AS n, ANY_VALUE(slope) AS slope, ANY_VALUE(my) - ANY_VALUE(mf) AS a, SUM(u * u) / COUNT(*) / COUNT(*) AS va, SUM(u * u * z) / (COUNT(*) * SUM(z * z)) AS vab, SUM(u * u * z * z) / (SUM(z * z) * SUM(z * z)) AS vb FROM b GROUP BY 1),
w AS (SELECT entity, n, slope, (vb * a * a - 2 * vab * a * (slope - 1) + va * (slope - 1) * (slope - 1)) / (va * vb - vab * vab) AS w FROM s) SELECT entity, n, round(slope, 5) AS slope, round(w, 5) AS statistic, round(EXP(-w / 2), 5) AS pvalue FROM w""")
def mincer_zarnowitz(spark, sf_dir):
    return _rounded(inf.mincer_zarnowitz_test(_forecasts(spark, sf_dir), "entity", "x", "p"), "entity", "n")


@query("factor_decile_monotonicity", f"""WITH {_F}, r AS (SELECT time, x, LEAST(FLOOR((RANK() OVER (PARTITION BY time ORDER BY p) + (COUNT(*) OVER (PARTITION BY time, p) - 1) / 2.0::DOUBLE - 1) * 10 / COUNT(*) OVER (PARTITION BY time)), 9) AS b FROM f),
m AS (SELECT b, AVG(m) AS m FROM (SELECT time, b, AVG(x) AS m FROM r GROUP BY 1, 2) GROUP BY 1), k AS (SELECT ROW_NUMBER() OVER (ORDER BY b) AS x, RANK() OVER (ORDER BY m) AS y FROM m) SELECT round(CORR(x, y), 6) AS monotonicity FROM k""")
def decile_monotonicity(spark, sf_dir):
    return inf.decile_monotonicity(_forecasts(spark, sf_dir), "time", "p", "x").select(F.round("monotonicity", 6).alias("monotonicity"))


@query("depend_devolatilise", f"WITH {SQL_SUPPLIER} SELECT entity, time, round(CASE WHEN COUNT(x) OVER w >= 20 THEN x / NULLIF(STDDEV_SAMP(x) OVER w, 0) END, 6) AS scaled FROM sd WINDOW w AS ({SQL_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def devolatilise(spark, sf_dir):
    return inf.devolatilise(supplier_day(spark, sf_dir), "entity", "time", "x", 20).select(*KEYS, r6(F.col("scaled")).alias("scaled"))


_N = f"{SQL_SUPPLIER}, a AS (SELECT entity, time, ROW_NUMBER() OVER ({SQL_W}) - 1 AS i, COUNT(*) OVER (PARTITION BY entity) AS n FROM sd)"


@query("cv_train_test_split", f"WITH {_N} SELECT entity, time, i >= FLOOR(n * 0.75::DOUBLE) AS is_test FROM a")
def train_test(spark, sf_dir):
    return splits.train_test_split(supplier_day(spark, sf_dir), "entity", "time", 0.25).select(*KEYS, "is_test")


_SPLIT = f"WITH {_N}, s AS (SELECT a.*, CAST(g.s AS INTEGER) AS split, n - 7 - (3 - g.s) * 5 AS b FROM a, generate_series(1, 3) g(s)) SELECT entity, time, split, i >= b AS is_test FROM s WHERE b >= 0 AND i < b + 7"


@query("cv_expanding_window_split", _SPLIT)
def expanding(spark, sf_dir):
    return splits.expanding_window_split(supplier_day(spark, sf_dir), "entity", "time", 7, 3, 5).select(*KEYS, "split", "is_test")


@query("cv_sliding_window_split", f"{_SPLIT} AND i >= b - 30")
def sliding(spark, sf_dir):
    return splits.sliding_window_split(supplier_day(spark, sf_dir), "entity", "time", 7, 3, 5, 30).select(*KEYS, "split", "is_test")
