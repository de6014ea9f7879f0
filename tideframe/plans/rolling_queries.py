"""Queries of the rolling, cross-sectional and alpha operators, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.functions.core import ffd_weights
from tideframe.operators import alpha, rolling, xs
from tideframe.plans.catalog import query
from tideframe.plans.panels import SQL_SUPPLIER, SQL_W, W, r6, supplier_day

KEYS = ["entity", "time"]


def _put(name: str, expr, sql: str, ctes: str = "") -> None:
    """A query of one column ``v`` over the supplier panel; ``expr`` makes a column, or the frame with the column, when the query runs."""

    def run(spark, sf_dir):
        df = supplier_day(spark, sf_dir)
        made = expr(df)
        df = made if isinstance(made, DataFrame) else df.withColumn("v", made)
        return df.select(*KEYS, r6(F.col("v")).alias("v"))

    query(name, f"WITH {SQL_SUPPLIER}{ctes} SELECT entity, time, round(CAST({sql} AS DOUBLE), 6) AS v FROM {'t' if ctes else 'sd'}")(run)


def _frame(n: int) -> str:
    return f"({SQL_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(sql: str, n: int, x: str = "x") -> str:
    return f"CASE WHEN COUNT({x}) OVER {_frame(n)} >= {n} THEN {sql} END"


# --- per entity ----------------------------------------------------------------------------------------------------------
_put("panel_zscore", lambda df: rolling.zscore("x", W(), 21), _full(f"(x - AVG(x) OVER {_frame(21)}) / NULLIF(STDDEV_SAMP(x) OVER {_frame(21)}, 0)", 21))
_put("panel_rolling_vol", lambda df: rolling.rolling_vol("x", W(), 21), _full(f"STDDEV_SAMP(x) OVER {_frame(21)}", 21))
_put("panel_rs_vol", lambda df: rolling.rs_vol("x", W(), 5), _full(f"STDDEV_SAMP(x) OVER {_frame(5)}", 5))
_w = ffd_weights(0.5, 0.01)
_put("panel_frac_diff", lambda df: rolling.frac_diff("x", W(), 0.5, 0.01), " + ".join(f"({v!r}) * {f'LAG(x, {k}) OVER ({SQL_W})' if k else 'x'}" for k, v in enumerate(_w)))
_put("panel_rolling_corr", lambda df: rolling.rolling_corr("x", "y", W(), 10), _full(f"COVAR_SAMP(x, y) OVER {_frame(10)} / NULLIF(STDDEV_SAMP(x) OVER {_frame(10)} * STDDEV_SAMP(y) OVER {_frame(10)}, 0)", 10))

# --- per date -------------------------------------------------------------------------------------------------------------
D = "(PARTITION BY time)"
RANK = "(RANK() OVER (PARTITION BY time ORDER BY x) + (COUNT(*) OVER (PARTITION BY time, x) - 1) / 2.0)"
N = f"COUNT(x) OVER {D}"
_put("xs_rank", lambda df: xs.rank("x", "time"), RANK)
_put("xs_rank_uniform", lambda df: xs.rank("x", "time", normalize=True), f"{RANK} / {N}")
_put("xs_rank_uniform_plus", lambda df: xs.rank("x", "time", normalize="uniform_plus"), f"{RANK} / ({N} + 1)")
_put("xs_rank_unit", lambda df: xs.rank("x", "time", normalize="unit"), f"2 * ({RANK} - 1) / NULLIF({N} - 1, 0) - 1")
_put("xs_rank_centered", lambda df: xs.rank("x", "time", normalize="centered"), f"{RANK} / ({N} + 1) - 0.5")
_put("xs_rank_min", lambda df: xs.rank("y", "time", "min"), "RANK() OVER (PARTITION BY time ORDER BY y)")
_put("xs_rank_max", lambda df: xs.rank("y", "time", "max"), "RANK() OVER (PARTITION BY time ORDER BY y) + COUNT(*) OVER (PARTITION BY time, y) - 1")
_put("xs_rank_dense", lambda df: xs.rank("y", "time", "dense"), "DENSE_RANK() OVER (PARTITION BY time ORDER BY y)")
_put("xs_demean", lambda df: xs.demean("x", "time"), f"x - AVG(x) OVER {D}")
_put("xs_zscore", lambda df: xs.zscore("x", "time"), f"(x - AVG(x) OVER {D}) / NULLIF(STDDEV_POP(x) OVER {D}, 0)")
_put("xs_winsorize_linear", lambda df: xs.winsorize("x", "time", (0.1, 0.1)), f"LEAST(GREATEST(x, QUANTILE_CONT(x, 0.1) OVER {D}), QUANTILE_CONT(x, 0.9) OVER {D})")
NEAREST = "LIST_SORT(LIST(x) OVER (PARTITION BY time))[CAST(FLOOR({q} * (COUNT(x) OVER (PARTITION BY time) - 1) + 0.5) AS BIGINT) + 1]"
_put("xs_winsorize", lambda df: xs.winsorize_nearest(df, "x", "time", (0.1, 0.1), "v"), f"LEAST(GREATEST(x, {NEAREST.format(q='0.1::DOUBLE')}), {NEAREST.format(q='(1 - 0.1::DOUBLE)')})")
_put("xs_standardize", lambda df: xs.standardize(df, "x", "time", None, "v"), f"(x - AVG(x) OVER {D}) / NULLIF(STDDEV_POP(x) OVER {D}, 0)")
_put("xs_quantile_bin", lambda df: xs.quantile_bin("x", "time", 5), f"LEAST(FLOOR(({RANK} - 1) * 5 / {N}), 4)")
_put("xs_neutralize", lambda df: xs.neutralize("x", "y", "time"), f"x - (REGR_INTERCEPT(x, y) OVER {D} + REGR_SLOPE(x, y) OVER {D} * y)")
_put("xs_neutralize_no_intercept", lambda df: xs.neutralize("x", "y", "time", False), f"x - y * SUM(x * y) OVER {D} / NULLIF(SUM(y * y) OVER {D}, 0)")
_put("xs_dispersion_sd", lambda df: xs.dispersion("x", "time"), f"STDDEV_SAMP(x) OVER {D}")
_put("xs_dispersion_iqr", lambda df: xs.dispersion("x", "time", "iqr"), f"QUANTILE_CONT(x, 0.75) OVER {D} - QUANTILE_CONT(x, 0.25) OVER {D}")
_put("xs_dispersion_idr", lambda df: xs.dispersion("x", "time", "idr"), f"QUANTILE_CONT(x, 0.9) OVER {D} - QUANTILE_CONT(x, 0.1) OVER {D}")
_put("xs_dispersion_mad", lambda df: xs.mad(df, "x", "time", "v"), f"1.4826 * QUANTILE_CONT(d, 0.5) OVER {D}", f", t AS (SELECT *, ABS(x - QUANTILE_CONT(x, 0.5) OVER {D}) AS d FROM sd)")
_put("xs_up_share", lambda df: df.withColumn("z", F.col("x") - 35).withColumn("v", xs.up_share("z", "time")), f"AVG(CASE WHEN x - 35 > 0 THEN 1.0 ELSE 0.0 END) OVER {D}")
_put("xs_entropy", lambda df: xs.entropy(df, "x", "time", "v"), f"CASE WHEN {N} > 1 THEN -SUM(CASE WHEN p > 0 THEN p * LN(p) END) OVER {D} / NULLIF(LN({N}), 0) END", f", t AS (SELECT *, ABS(x) / NULLIF(SUM(ABS(x)) OVER {D}, 0) AS p FROM sd)")
_put(
    "xs_tail_index",
    lambda df: xs.tail_index(df, "x", "time", "v", 0.3, "upper", 3),
    f"CASE WHEN k >= 3 AND u > 0 AND xi > 0 THEN 1 / xi END",
    f""", a AS (SELECT *, FLOOR({N} * 0.3::DOUBLE) AS k, ROW_NUMBER() OVER (PARTITION BY time ORDER BY x DESC NULLS LAST) AS r FROM sd),
    b AS (SELECT *, MAX(CASE WHEN r = k + 1 THEN x END) OVER {D} AS u FROM a),
    t AS (SELECT *, AVG(CASE WHEN r <= k AND u > 0 AND x > 0 THEN LN(x) - LN(u) END) OVER {D} AS xi FROM b)""",
)


@query("xs_neutralize_many")
def neutralize_many(spark, sf_dir):
    """Residuals on two factors: a matrix solve for each date, so there is no SQL; tests hold it against lstsq."""
    df = supplier_day(spark, sf_dir).withColumn("z", F.col("y") * F.col("y"))
    return xs.neutralize_many(df, "x", ["y", "z"], "time", out="v").select(*KEYS, F.round("v", 4).alias("v"))


# --- alpha grammar ---------------------------------------------------------------------------------------------------------


def _context() -> alpha.Context:
    return alpha.Context(W(), (F.col("time"),))


def X():  # noqa: N802
    return F.col("x")


def Y():  # noqa: N802
    return F.col("y")


ELEM = {
    "add": "x + y",
    "sub": "x - y",
    "max": "(x + y + ABS(x - y)) / 2",
    "min": "(x + y - ABS(x - y)) / 2",
}
for _unit in ("price", "volume", "score"):
    for _k, _sql in ELEM.items():
        _put(f"alpha_{_k}_{_unit}", lambda df, k=f"{_k}_{_unit}": alpha.OPS[k].build(_context(), X(), Y()), _sql)
for _k, _args, _sql in (
    ("mul", lambda: (X(), Y()), "x * y"),
    ("div", lambda: (X(), Y()), "x / NULLIF(y, 0)"),
    ("neg", lambda: (X(),), "-x"),
    ("abs", lambda: (X() - 35,), "ABS(x - 35)"),
    ("sign", lambda: (X() - 35,), "SIGN(x - 35)"),
    ("log", lambda: (X() - 35,), "CASE WHEN ABS(x - 35) > 1e-12 THEN LN(ABS(x - 35)) END"),
    ("sqrt", lambda: (X() - 35,), "SQRT(ABS(x - 35))"),
    ("signed_power", lambda: (X() - 35, 0.5), "SIGN(x - 35) * POW(ABS(x - 35), 0.5)"),
    ("sigmoid", lambda: (X() - 35,), "1 / (1 + EXP(-LEAST(GREATEST(x - 35, -30.0), 30.0)))"),
    ("where_positive", lambda: (X() - 35, X(), Y()), "CASE WHEN x - 35 > 0 THEN x ELSE y END"),
    ("cs_rank", lambda: (X(),), f"{RANK} / {N}"),
    ("cs_zscore", lambda: (X(),), f"(x - AVG(x) OVER {D}) / NULLIF(STDDEV_SAMP(x) OVER {D}, 0)"),
    ("cs_demean", lambda: (X(),), f"x - AVG(x) OVER {D}"),
    ("cs_scale", lambda: (X(),), f"x / NULLIF(SUM(ABS(x)) OVER {D}, 0)"),
    ("cs_winsor", lambda: (X(), 2.0), f"LEAST(GREATEST(x, AVG(x) OVER {D} - 2 * STDDEV_SAMP(x) OVER {D}), AVG(x) OVER {D} + 2 * STDDEV_SAMP(x) OVER {D})"),
):
    _put(f"alpha_{_k}", lambda df, k=_k, args=_args: alpha.OPS[k].build(_context(), *args()), _sql)
_put("alpha_cs_mad_zscore", lambda df: alpha.apply(df, "cs_mad_zscore", "v", "x", context=_context()), f"(x - m) / NULLIF(1.4826 * QUANTILE_CONT(d, 0.5) OVER {D}, 0)", f", s AS (SELECT *, QUANTILE_CONT(x, 0.5) OVER {D} AS m FROM sd), t AS (SELECT *, ABS(x - m) AS d FROM s)")

n = 5
f = _frame(n)
_lagged = lambda k: f"LAG(x, {k}) OVER ({SQL_W})" if k else "x"
TS = {
    "ts_delay": _lagged(n),
    "ts_delta": f"x - {_lagged(n)}",
    "ts_pctchange": f"x / NULLIF({_lagged(n)}, 0) - 1",
    "ts_mean": _full(f"AVG(x) OVER {f}", n),
    "ts_std": _full(f"STDDEV_SAMP(x) OVER {f}", n),
    "ts_sum": _full(f"SUM(x) OVER {f}", n),
    "ts_min": _full(f"MIN(x) OVER {f}", n),
    "ts_max": _full(f"MAX(x) OVER {f}", n),
    "ts_median": _full(f"QUANTILE_CONT(x, 0.5) OVER {f}", n),
    "ts_range": _full(f"MAX(x) OVER {f} - MIN(x) OVER {f}", n),
    "ts_zscore": _full(f"(x - AVG(x) OVER {f}) / NULLIF(STDDEV_SAMP(x) OVER {f}, 0)", n),
    "ts_ir": _full(f"AVG(x) OVER {f} / NULLIF(STDDEV_SAMP(x) OVER {f}, 0)", n),
    "ts_rsv": _full(f"(x - MIN(x) OVER {f}) / NULLIF(MAX(x) OVER {f} - MIN(x) OVER {f}, 0)", n),
    "ts_drawdown": _full(f"x / NULLIF(MAX(x) OVER {f}, 0) - 1", n),
    "ts_rank": _full("(" + " + ".join(f"CASE WHEN {_lagged(k)} <= x THEN 1.0 ELSE 0 END" for k in range(n)) + f") / {n}", n),
    "ts_argmax": _full("CASE " + " ".join(f"WHEN {_lagged(k)} = MAX(x) OVER {f} THEN {k}" for k in range(n)) + " END", n),
    "ts_argmin": _full("CASE " + " ".join(f"WHEN {_lagged(k)} = MIN(x) OVER {f} THEN {k}" for k in range(n)) + " END", n),
    "ts_decay_linear": "(" + " + ".join(f"{n - k} * {_lagged(k)}" for k in range(n)) + f") / {n * (n + 1) / 2}",
}
for _k, _sql in TS.items():
    _put(f"alpha_{_k}", lambda df, k=_k: alpha.OPS[k].build(_context(), X(), n), _sql)
_put("alpha_ts_product", lambda df: alpha.OPS["ts_product"].build(_context(), X() / 35, n), _full(f"PRODUCT(x / 35) OVER {f}", n))
_mom = ", t AS (SELECT entity, time, x, l, c, LIST_AVG(l) AS m FROM (SELECT *, LIST(x) OVER {f} AS l, COUNT(x) OVER {f} AS c FROM sd))".format(f=f)
_central = lambda p: f"LIST_AVG(LIST_TRANSFORM(l, lambda z: POW(z - m, {p})))"
_put("alpha_ts_skew", lambda df: alpha.OPS["ts_skew"].build(_context(), X(), n), f"CASE WHEN c >= {n} THEN {_central(3)} / NULLIF(POW({_central(2)}, 1.5), 0) END", _mom)
_put("alpha_ts_kurt", lambda df: alpha.OPS["ts_kurt"].build(_context(), X(), n), f"CASE WHEN c >= {n} THEN {_central(4)} / NULLIF(POW({_central(2)}, 2), 0) - 3 END", _mom)
_put("alpha_ts_corr", lambda df: alpha.OPS["ts_corr"].build(_context(), X(), Y(), 10), _full(f"COVAR_SAMP(x, y) OVER {_frame(10)} / NULLIF(STDDEV_SAMP(x) OVER {_frame(10)} * STDDEV_SAMP(y) OVER {_frame(10)}, 0)", 10))
_put("alpha_ts_beta", lambda df: alpha.OPS["ts_beta"].build(_context(), X(), Y(), 10), _full(f"COVAR_SAMP(x, y) OVER {_frame(10)} / NULLIF(VAR_SAMP(y) OVER {_frame(10)}, 0)", 10))
_a = 1 - math.exp(-math.log(2) / 5)
_put("alpha_ts_ewm_mean", lambda df: alpha.apply(df, "ts_ewm_mean", "v", "x", 5, context=_context()), f"LIST_REDUCE(LIST(x) OVER ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda m, z: {_a!r} * z + (1 - {_a!r}) * m)")


@query(
    "flagship_zscore_rank",
    f"""WITH {SQL_SUPPLIER}, z AS (SELECT entity, time, {_full(f"(x - AVG(x) OVER {f}) / NULLIF(STDDEV_SAMP(x) OVER {f}, 0)", n)} AS z FROM sd)
    SELECT entity, time, round(z, 6) AS z, round(CASE WHEN z IS NOT NULL THEN (RANK() OVER (PARTITION BY time ORDER BY z NULLS LAST) + (COUNT(*) OVER (PARTITION BY time, z) - 1) / 2.0) END / COUNT(z) OVER {D}, 6) AS r FROM z""",
)
def flagship(spark, sf_dir):
    """Rolling z-score of each supplier's daily revenue, then its rank among the suppliers of the day."""
    df = supplier_day(spark, sf_dir).withColumn("z", rolling.zscore("x", W(), n))
    return df.select(*KEYS, r6(F.col("z")).alias("z"), r6(xs.rank("z", "time", normalize=True)).alias("r"))


@query("alpha_population", f"""WITH {SQL_SUPPLIER}, z AS (SELECT entity, time, {TS['ts_zscore']} AS z FROM sd)
    SELECT entity, time, round(z - AVG(z) OVER {D}, 6) AS a, round((z - AVG(z) OVER {D}) / NULLIF(STDDEV_SAMP(z) OVER {D}, 0), 6) AS b FROM z""")
def population(spark, sf_dir):
    """Two programs that share a sub-program, compiled together."""
    z = alpha.Node("ts_zscore", ("x",), n)
    df = alpha.compile_population(supplier_day(spark, sf_dir), {"a": alpha.Node("cs_demean", (z,)), "b": alpha.Node("cs_zscore", (z,))}, W(), (F.col("time"),))
    return df.select(*KEYS, r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))
