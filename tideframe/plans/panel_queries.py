"""Queries of panel preparation, joins, labels, factors, bars, market features, cleaning and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.core import dealt, shares
from tideframe.operators import asof, bars, clean, econ, evaluation, labels, preprocess, quality, transform, xs
from tideframe.panel import PanelFrame
from tideframe.plans.catalog import query
from tideframe.plans.panels import SQL_EVENTS, SQL_PRICES, SQL_SUPPLIER, SQL_W, SQL_WE, W, day, prices, r6, read, supplier_day, user_events

KEYS = ["entity", "time"]


def _panel(spark, sf_dir, deal: bool | int = False) -> PanelFrame:
    return PanelFrame(supplier_day(spark, sf_dir, deal), "entity", "time")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*KEYS, *[r6(F.col(c)).alias(c) for c in cols])


def _sd(body: str, ctes: str = "") -> str:
    return f"WITH {SQL_SUPPLIER}{ctes} {body}"


def _one(sql: str) -> str:
    return _sd(f"SELECT entity, time, round(CAST({sql} AS DOUBLE), 6) AS x FROM sd")


def _prep(name: str, sql: str):
    """A query of one preparation step over column x of the supplier panel."""

    def put(f):
        query(name, sql)(lambda spark, sf_dir: _rounded(f(_panel(spark, sf_dir, name.startswith("impute_"))).df, "x"))
        return f

    return put


_L = lambda k: f"LAG(x, {k}) OVER ({SQL_W})"
_prep("pre_diff", _one(f"x - {_L(1)}"))(lambda p: preprocess.diff(p, 1, 1, ["x"]))
_prep("pre_diff_seasonal", _one(f"x - {_L(7)}"))(lambda p: preprocess.diff(p, 1, 7, ["x"]))
_prep("pre_diff_second", _one(f"x - 2 * {_L(1)} + {_L(2)}"))(lambda p: preprocess.diff(p, 2, 1, ["x"]))
_prep("pre_detrend", _sd("SELECT entity, time, round(x - (REGR_INTERCEPT(x, i) OVER (PARTITION BY entity) + REGR_SLOPE(x, i) OVER (PARTITION BY entity) * i), 6) AS x FROM t", f", t AS (SELECT *, CAST(ROW_NUMBER() OVER ({SQL_W}) - 1 AS DOUBLE) AS i FROM sd)"))(lambda p: preprocess.detrend(p, "linear", ["x"]))
_prep("pre_detrend_mean", _one("x - AVG(x) OVER (PARTITION BY entity)"))(lambda p: preprocess.detrend(p, "mean", ["x"]))
_prep("pre_scale", _one("(x - AVG(x) OVER (PARTITION BY entity)) / NULLIF(STDDEV_SAMP(x) OVER (PARTITION BY entity), 0)"))(lambda p: preprocess.scale(p, columns=["x"])[0])
_prep("pre_time_to_arange", _sd(f"SELECT entity, ROW_NUMBER() OVER ({SQL_W}) - 1 AS time, round(x, 6) AS x FROM sd"))(preprocess.time_to_arange)
_prep("pre_reindex", _sd("SELECT e.entity, t.time, round(sd.x, 6) AS x FROM (SELECT DISTINCT entity FROM sd) e CROSS JOIN (SELECT DISTINCT time FROM sd) t LEFT JOIN sd ON sd.entity = e.entity AND sd.time = t.time"))(preprocess.reindex)
_prep("pre_trim", _sd("SELECT sd.entity, sd.time, round(x, 6) AS x FROM sd, (SELECT MAX(a) AS a, MIN(b) AS b FROM (SELECT MIN(time) AS a, MAX(time) AS b FROM sd GROUP BY entity)) e WHERE time BETWEEN e.a AND e.b"))(preprocess.trim)

_HOLES = ", h AS (SELECT entity, time, CASE WHEN n % 2 = 0 THEN x END AS x FROM sd)"


def _holed(p: PanelFrame) -> PanelFrame:
    return p._with(p.df.select(*KEYS, F.when(F.col("n") % 2 == 0, F.col("x")).alias("x")))


def _filled(sql: str) -> str:
    return _sd(f"SELECT entity, time, round(COALESCE(x, {sql}), 6) AS x FROM h", _HOLES)


_prep("impute_ffill", _filled(f"LAST_VALUE(x IGNORE NULLS) OVER ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))(lambda p: preprocess.impute(_holed(p), "ffill"))
_prep("impute_bfill", _filled(f"FIRST_VALUE(x IGNORE NULLS) OVER ({SQL_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))(lambda p: preprocess.impute(_holed(p), "bfill", allow_leaky=True))
_prep("impute_mean", _filled("AVG(x) OVER (PARTITION BY entity)"))(lambda p: preprocess.impute(_holed(p), "mean"))
_prep("impute_median", _filled("QUANTILE_CONT(x, 0.5) OVER (PARTITION BY entity)"))(lambda p: preprocess.impute(_holed(p), "median"))
_prep("impute_constant", _filled("0.0"))(lambda p: preprocess.impute(_holed(p), 0.0))
_BACK, _AHEAD = f"({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"({SQL_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_prep(
    "impute_interpolate",
    _sd(
        "SELECT entity, time, round(COALESCE(x, a + (b - a) * COALESCE((i - ia) / NULLIF(CAST(ib - ia AS DOUBLE), 0), 0)), 6) AS x FROM k",
        _HOLES + f""", j AS (SELECT *, ROW_NUMBER() OVER ({SQL_W}) AS i FROM h), k AS (SELECT *, LAST_VALUE(x IGNORE NULLS) OVER {_BACK} AS a, FIRST_VALUE(x IGNORE NULLS) OVER {_AHEAD} AS b,
        MAX(CASE WHEN x IS NOT NULL THEN i END) OVER {_BACK} AS ia, MIN(CASE WHEN x IS NOT NULL THEN i END) OVER {_AHEAD} AS ib FROM j)""",
    ),
)(lambda p: preprocess.impute(_holed(p), "interpolate", allow_leaky=True))


@query("pre_lag", _sd("SELECT entity, time, round(a, 6) AS x__lag_1, round(b, 6) AS x__lag_3 FROM t WHERE i > 3", f", t AS (SELECT *, {_L(1)} AS a, {_L(3)} AS b, ROW_NUMBER() OVER ({SQL_W}) AS i FROM sd)"))
def lag(spark, sf_dir):
    return _rounded(preprocess.lag(_panel(spark, sf_dir), [1, 3], ["x"]).df, "x__lag_1", "x__lag_3")


_F = f"({SQL_W} ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING)"
_STATS = {"mean": f"AVG(x) OVER {_F}", "min": f"MIN(x) OVER {_F}", "max": f"MAX(x) OVER {_F}", "mlm": f"MAX(x) OVER {_F} - MIN(x) OVER {_F}", "sum": f"SUM(x) OVER {_F}", "std": f"STDDEV_SAMP(x) OVER {_F}", "cv": f"STDDEV_SAMP(x) OVER {_F} / NULLIF(AVG(x) OVER {_F}, 0)"}


@query("pre_roll", _sd(f"SELECT entity, time, {', '.join(f'round(CASE WHEN COUNT(x) OVER {_F} >= 5 THEN {v} END, 6) AS x__rolling_{k}_5' for k, v in _STATS.items())} FROM sd"))
def roll(spark, sf_dir):
    df = preprocess.roll(_panel(spark, sf_dir), [5], list(_STATS), ["x"]).df
    return _rounded(df, *[f"x__rolling_{k}_5" for k in _STATS])


def _resampled(how: str, sql: str) -> None:
    @query(f"pre_resample_{how}", f"SELECT event_type AS entity, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS d, round({sql}, 7) AS v FROM events GROUP BY 1, 2")
    def run(spark, sf_dir):
        df = read(spark, sf_dir, "events").select(F.col("event_type").alias("entity"), F.to_date("ts").cast("timestamp").alias("time"), "value")
        out = preprocess.resample(PanelFrame(df, "entity", "time"), "1 day", how, "left", ["value"]).df
        return out.select("entity", day("time").alias("d"), F.round("value", 7).alias("v"))


for _how, _s in (("sum", "SUM(value)"), ("mean", "AVG(value)"), ("median", "MEDIAN(value)")):
    _resampled(_how, _s)


@query("pre_one_hot", "SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS event_type__click, CAST(event_type = 'view' AS INTEGER) AS event_type__view FROM events")
def one_hot(spark, sf_dir):
    return preprocess.one_hot(read(spark, sf_dir, "events"), "event_type", ["click", "view"]).select("event_id", "event_type__click", "event_type__view")


@query("pre_calendar", "SELECT event_id, CAST(hour(ts) AS VARCHAR) AS hour, CAST(day(ts) AS VARCHAR) AS day, CAST(isodow(ts) AS VARCHAR) AS weekday, CAST(weekofyear(ts) AS VARCHAR) AS week, CAST(month(ts) AS VARCHAR) AS month, CAST(quarter(ts) AS VARCHAR) AS quarter, CAST(year(ts) AS VARCHAR) AS year FROM events")
def calendar(spark, sf_dir):
    attrs = ["hour", "day", "weekday", "week", "month", "quarter", "year"]
    return preprocess.add_calendar_effects(read(spark, sf_dir, "events"), "ts", attrs).select("event_id", *attrs)


@query("pre_fourier", _sd(f"SELECT entity, time, {', '.join(f'round(sin({2 * math.pi * i!r} * i / 7), 6) AS sin_7_{i}, round(cos({2 * math.pi * i!r} * i / 7), 6) AS cos_7_{i}' for i in (1, 2))} FROM t", f", t AS (SELECT *, ROW_NUMBER() OVER ({SQL_W}) AS i FROM sd)"))
def fourier(spark, sf_dir):
    return _rounded(preprocess.add_fourier_terms(_panel(spark, sf_dir), 7, 2).df, "sin_7_1", "cos_7_1", "sin_7_2", "cos_7_2")


@query("pre_boxcox", _sd("SELECT entity, time, round((SQRT(x + 1) - 1) / 0.5, 6) AS a, round(LN(x + 1), 6) AS b FROM sd"))
def boxcox(spark, sf_dir):
    df = supplier_day(spark, sf_dir)
    return _rounded(df.withColumns({"a": preprocess.boxcox(F.col("x") + 1, 0.5), "b": preprocess.boxcox(F.col("x") + 1, 0.0)}), "a", "b")


@query("pre_yeojohnson", _sd("SELECT entity, time, round(CASE WHEN x - 35 >= 0 THEN (POW(ABS(x - 35) + 1, 0.5) - 1) / 0.5 ELSE -(POW(ABS(x - 35) + 1, 1.5) - 1) / 1.5 END, 6) AS a FROM sd"))
def yeojohnson(spark, sf_dir):
    return _rounded(supplier_day(spark, sf_dir).withColumn("a", preprocess.yeojohnson(F.col("x") - 35, 0.5)), "a")


# --- transforms ----------------------------------------------------------------------------------------------------------
_TRAIN = "time < 9500"


@query("transform_time_series_scaler", _sd("SELECT entity, time, round((x - m) / (CASE WHEN s < 1e-12 THEN 1 ELSE s END), 6) AS x_scaled FROM sd JOIN st USING (entity)", f", st AS (SELECT entity, AVG(x) AS m, STDDEV_POP(x) AS s FROM sd WHERE {_TRAIN} GROUP BY 1)"))
def ts_scaler(spark, sf_dir):
    p = _panel(spark, sf_dir)
    fitted = transform.TimeSeriesScaler(["x"], suffix="_scaled").fit(p.filter(_TRAIN))
    return _rounded(fitted.transform(p).df.where("x_scaled is not null"), "x_scaled")


@query("transform_cross_sectional_scaler", _sd("SELECT entity, time, round((x - AVG(x) OVER (PARTITION BY time)) / NULLIF(STDDEV_POP(x) OVER (PARTITION BY time), 0), 6) AS x_scaled FROM sd"))
def xs_scaler(spark, sf_dir):
    return _rounded(transform.CrossSectionalScaler(["x"], suffix="_scaled").transform(_panel(spark, sf_dir)).df, "x_scaled")


@query("transform_pipeline", _sd("SELECT entity, time, round(CASE WHEN d IS NOT NULL THEN (RANK() OVER (PARTITION BY time ORDER BY d NULLS LAST) + (COUNT(*) OVER (PARTITION BY time, d) - 1) / 2.0) / COUNT(d) OVER (PARTITION BY time) END, 6) AS x_diff_rank FROM t", f", t AS (SELECT entity, time, x - {_L(1)} AS d FROM sd)"))
def pipeline(spark, sf_dir):
    p = _panel(spark, sf_dir)
    steps = transform.Pipeline([transform.Apply(lambda q: q.with_columns(x_diff=F.col("x") - F.lag("x").over(q.window))), transform.CrossSectionalRank(["x_diff"])])
    return _rounded(steps.fit(p).transform(p).df, "x_diff_rank")


# --- as-of ----------------------------------------------------------------------------------------------------------------
_VINT = ", v AS (SELECT l_suppkey AS entity, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS ev, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS kn, MAX(l_extendedprice) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"


def _vintages(spark, sf_dir, parts: int) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    lines = dealt(lines.select("l_orderkey", F.col("l_suppkey").alias("entity"), day("l_shipdate").alias("kn"), F.col("l_extendedprice").alias("val")), "l_orderkey", parts=parts)
    orders = dealt(orders.select("o_orderkey", day("o_orderdate").alias("ev")), "o_orderkey", parts=parts)
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("entity", "ev", "kn", "val")
    return dealt(rows, "entity", parts=parts).groupBy("entity", "ev", "kn").agg(F.max("val").alias("val"))


def _asof_sql(lag: int) -> str:
    best = "MAX(CASE WHEN r IS NOT NULL THEN {'r': r, 'val': val, 'ev': ev, 'kn': kn} END) OVER (PARTITION BY entity ORDER BY t, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return _sd(
        "SELECT entity, t AS time, g.val AS val, g.ev AS ev, g.kn AS kn FROM b WHERE k = 1",
        f"""{_VINT}, v0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY ev, kn) AS r, GREATEST(kn + {lag}, ev) AS t FROM v),
        u AS (SELECT entity, t, 0 AS k, r, val, ev, kn FROM v0 UNION ALL SELECT entity, time, 1, NULL, NULL, NULL, NULL FROM sd),
        b AS (SELECT entity, t, k, {best} AS g FROM u)""",
    )


def _asof(name: str, lag: int) -> None:
    @query(name, _asof_sql(lag))
    def run(spark, sf_dir):
        parts = shares(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"))
        p = _panel(spark, sf_dir, parts).select()
        return p.asof_join(_vintages(spark, sf_dir, parts), event_time="ev", knowledge_time="kn", lag=lag, provenance=True).df.select(*KEYS, "val", "ev", "kn")


_asof("asof_join", 0)
_asof("asof_join_lagged", 3)

# --- labels and factors ---------------------------------------------------------------------------------------------------
_FWD = f"LEAD(x, 5) OVER ({SQL_W}) / NULLIF(x, 0) - 1"
_CTE_FWD = f", t AS (SELECT *, {_FWD} AS f FROM sd)"


@query("label_forward_return", _sd(f"SELECT entity, time, round({_FWD}, 6) AS fwd_ret, LEAD(time, 5) OVER ({SQL_W}) AS t_end FROM sd"))
def forward(spark, sf_dir):
    df = labels.forward_return(supplier_day(spark, sf_dir), "entity", "time", "x", horizon=5, end_time="t_end")
    return df.select(*KEYS, r6(F.col("fwd_ret")).alias("fwd_ret"), "t_end")


@query("label_fixed_horizon", _sd("SELECT entity, time, CAST(CASE WHEN f > 0.1 THEN 1 WHEN f < -0.1 THEN -1 WHEN f IS NOT NULL THEN 0 END AS INTEGER) AS label FROM t", _CTE_FWD))
def fixed(spark, sf_dir):
    return labels.fixed_horizon(supplier_day(spark, sf_dir), "entity", "time", "x", 5, 0.1).select(*KEYS, F.col("label").cast("int").alias("label"))


@query("label_excess_over_median", _sd("SELECT entity, time, round(CASE WHEN COUNT(f) OVER (PARTITION BY time) >= 5 THEN f - QUANTILE_CONT(f, 0.5) OVER (PARTITION BY time) END, 6) AS excess FROM t", _CTE_FWD))
def excess(spark, sf_dir):
    return _rounded(labels.excess_over_median(supplier_day(spark, sf_dir), "entity", "time", "x", 5, 5), "excess")


_FR = "(RANK() OVER (PARTITION BY time ORDER BY f NULLS LAST) + (COUNT(*) OVER (PARTITION BY time, f) - 1) / 2.0)"


@query("label_quantile", _sd(f"SELECT entity, time, CAST(CASE WHEN f IS NOT NULL THEN LEAST(FLOOR(({_FR} - 1) * 3 / COUNT(f) OVER (PARTITION BY time)), 2) - 1 END AS INTEGER) AS label FROM t", _CTE_FWD))
def quantile_label(spark, sf_dir):
    return labels.quantile_label(supplier_day(spark, sf_dir), "entity", "time", "x", 5, 3).select(*KEYS, "label")


_TB = f""", a AS (SELECT *, x / NULLIF({_L(1)}, 0) - 1 AS r, LIST({{'p': x, 't': time}}) OVER ({SQL_W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM sd),
  b AS (SELECT *, STDDEV_SAMP(r) OVER ({SQL_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM a),
  c AS (SELECT *, LIST_FILTER(ahead, lambda z: z.p >= x * (1 + 2 * s) OR z.p <= x * (1 - s))[1] AS hit, COALESCE(LEN(ahead), 0) AS m FROM b),
  t AS (SELECT *, CASE WHEN s IS NOT NULL THEN COALESCE(hit, ahead[-1]) END AS e, CASE WHEN s IS NULL THEN NULL WHEN hit.p >= x * (1 + 2 * s) THEN 1 WHEN hit.p <= x * (1 - s) THEN -1 ELSE 0 END AS label FROM c)"""


@query("label_triple_barrier", _sd("SELECT entity, time, CAST(label AS INTEGER) AS label, e.t AS t1, round(e.p / NULLIF(x, 0) - 1, 6) AS ret, (label = 0 AND m < 5) AS censored FROM t", _TB))
def triple(spark, sf_dir):
    df = labels.triple_barrier(supplier_day(spark, sf_dir), "entity", "time", "x", 5)
    return df.select(*KEYS, "label", "t1", r6(F.col("ret")).alias("ret"), "censored")


@query("label_meta", _sd("SELECT entity, time, CAST(CASE WHEN SIGN(y - 30) * f > 0 THEN 1 WHEN f IS NOT NULL THEN 0 END AS INTEGER) AS meta FROM t", _CTE_FWD))
def meta(spark, sf_dir):
    df = labels.forward_return(supplier_day(spark, sf_dir), "entity", "time", "x", horizon=5, out="f")
    return df.select(*KEYS, labels.meta_label(F.signum(F.col("y") - 30), F.col("f")).cast("int").alias("meta"))


def _trend(n: int) -> str:
    f = f"({SQL_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    sse = f"(REGR_SYY(x, i) OVER {f} - REGR_SLOPE(x, i) OVER {f} * REGR_SXY(x, i) OVER {f})"
    return f"CASE WHEN COUNT(x) OVER {f} = {n} AND {sse} > 1e-12 THEN REGR_SLOPE(x, i) OVER {f} * SQRT(REGR_SXX(x, i) OVER {f} * {n - 2} / {sse}) END AS t{n}"


@query(
    "label_trend_scan",
    _sd(
        "SELECT entity, time, round(CASE WHEN COALESCE(ABS(t5), -1) >= COALESCE(ABS(t8), -1) AND COALESCE(ABS(t5), -1) >= COALESCE(ABS(t11), -1) THEN t5 WHEN COALESCE(ABS(t8), -1) >= COALESCE(ABS(t11), -1) THEN t8 ELSE t11 END, 4) AS trend_t FROM t",
        f", i AS (SELECT *, CAST(ROW_NUMBER() OVER ({SQL_W}) AS DOUBLE) AS i FROM sd), t AS (SELECT *, {_trend(5)}, {_trend(8)}, {_trend(11)} FROM i)",
    ),
)
def trend_scan(spark, sf_dir):
    df = labels.trend_scan(supplier_day(spark, sf_dir), "entity", "time", "x", 5, 11, 3)
    return df.select(*KEYS, F.round("trend_t", 4).alias("trend_t"))


_SPANS = f", s AS (SELECT *, LEAD(time, 3) OVER ({SQL_W}) AS t1, ROW_NUMBER() OVER ({SQL_W}) AS i FROM sd), p AS (SELECT *, CASE WHEN t1 IS NOT NULL THEN i + 3 END AS e FROM s), c AS (SELECT a.entity, a.time, a.i, a.e, (SELECT COUNT(*) FROM p b WHERE b.entity = a.entity AND b.e IS NOT NULL AND b.i <= a.i AND a.i <= b.e) AS concurrency FROM p a)"


def _spanned(spark, sf_dir) -> DataFrame:
    return supplier_day(spark, sf_dir).select(*KEYS, "x", F.lead("time", 3).over(W()).alias("t1"))


@query("weights_concurrency", _sd("SELECT entity, time, concurrency FROM c", _SPANS))
def concurrency(spark, sf_dir):
    return labels.concurrency(_spanned(spark, sf_dir), "entity", "time").select(*KEYS, F.col("concurrency").cast("long").alias("concurrency"))


_UNIQ = _SPANS + ", u AS (SELECT a.entity, a.time, (SELECT AVG(1.0 / b.concurrency) FROM c b WHERE b.entity = a.entity AND b.i BETWEEN a.i AND a.e) AS uniqueness FROM c a)"


@query("weights_uniqueness", _sd("SELECT entity, time, round(uniqueness, 6) AS uniqueness FROM u", _UNIQ))
def uniqueness(spark, sf_dir):
    return _rounded(labels.average_uniqueness(_spanned(spark, sf_dir), "entity", "time"), "uniqueness")


@query("weights_effective_n", _sd("SELECT round(SUM(uniqueness), 3) AS effective_n FROM u", _UNIQ))
def effective_n(spark, sf_dir):
    return labels.effective_n(_spanned(spark, sf_dir), "entity", "time").select(F.round("effective_n", 3).alias("effective_n"))


@query("weights_return_attribution", _sd("SELECT a.entity, a.time, round(ABS((SELECT SUM(COALESCE(b.r / NULLIF(b.concurrency, 0), 0)) FROM q b WHERE b.entity = a.entity AND b.i > a.i AND b.i <= a.e)), 6) AS w_return FROM q a", _SPANS + f", q AS (SELECT c.*, LN(s.x) - LAG(LN(s.x)) OVER (PARTITION BY c.entity ORDER BY c.time) AS r FROM c JOIN s USING (entity, time))"))
def return_weights(spark, sf_dir):
    return _rounded(labels.return_attribution(_spanned(spark, sf_dir), "entity", "time", "x"), "w_return")


@query("weights_class", "WITH k AS (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1) SELECT event_type, round(SUM(n) OVER () / (COUNT(*) OVER () * n), 6) AS w_class FROM k")
def class_weights(spark, sf_dir):
    return labels.class_weights(read(spark, sf_dir, "events"), "event_type").select("event_type", F.round("w_class", 6).alias("w_class"))


@query(
    "weights_time_decay",
    _sd("SELECT sd.entity, sd.time, round(GREATEST(0, 1 - (0.5 / tot) * tot + (0.5 / tot) * run), 6) AS w_decay FROM sd JOIN (SELECT time, SUM(u) OVER (ORDER BY time) AS run, SUM(u) OVER () AS tot FROM (SELECT time, SUM(y) AS u FROM sd GROUP BY 1)) USING (time)"),
)
def decay(spark, sf_dir):
    return _rounded(labels.time_decay(supplier_day(spark, sf_dir), "time", "y", 0.5), "w_decay")


@query("sizing_sigmoid", _sd("SELECT entity, time, round((x - 35) / SQRT(10 + (x - 35) * (x - 35)), 6) AS size, CAST(TRUNC((x - 35) / SQRT(10 + (x - 35) * (x - 35)) * 100) AS BIGINT) AS pos, round(x - 0.5 * SQRT(10 / 0.75), 6) AS inv FROM sd"))
def sizing(spark, sf_dir):
    df = supplier_day(spark, sf_dir)
    return df.select(*KEYS, r6(labels.sigmoid_size(10.0, F.col("x") - 35)).alias("size"), labels.target_position(10.0, F.col("x"), F.lit(35.0), 100).alias("pos"), r6(labels.inverse_price(F.col("x"), 10.0, F.lit(0.5))).alias("inv"))


@query("sizing_discretize", _sd("SELECT entity, time, LEAST(GREATEST(round(FLOOR((x - 35) / 50 / 0.1 + 0.5) * 0.1, 6), -1.0), 1.0) AS v FROM sd"))
def discretize(spark, sf_dir):
    v = F.floor((F.col("x") - 35) / 50 / 0.1 + 0.5) * 0.1
    return supplier_day(spark, sf_dir).select(*KEYS, r6(labels.discretize(v, 0.1)).alias("v"))


@query("sizing_average_active", _sd("SELECT a.entity, a.time, round(COALESCE((SELECT AVG(b.y) FROM s b WHERE b.entity = a.entity AND b.time <= a.time AND (b.t1 IS NULL OR a.time < b.t1)), 0), 6) AS avg_size FROM s a", f", s AS (SELECT *, LEAD(time, 3) OVER ({SQL_W}) AS t1 FROM sd)"))
def average_active(spark, sf_dir):
    df = supplier_day(spark, sf_dir, True).withColumn("exit", F.lead("time", 3).over(W()))
    return _rounded(labels.average_active(df, "entity", "time", "y"), "avg_size")


_IC = _CTE_FWD + ", g AS (SELECT time, x AS a, f AS b FROM t WHERE f IS NOT NULL), rk AS (SELECT time, RANK() OVER (PARTITION BY time ORDER BY a) + (COUNT(*) OVER (PARTITION BY time, a) - 1) / 2.0 AS a, RANK() OVER (PARTITION BY time ORDER BY b) + (COUNT(*) OVER (PARTITION BY time, b) - 1) / 2.0 AS b FROM g), ic AS (SELECT time, round(COVAR_SAMP(a, b) / NULLIF(STDDEV_SAMP(a) * STDDEV_SAMP(b), 0), 6) AS ic, COUNT(*) AS n FROM rk GROUP BY 1)"


def _signals(spark, sf_dir) -> DataFrame:
    return labels.forward_return(supplier_day(spark, sf_dir), "entity", "time", "x", horizon=5, out="f")


@query("factor_ic", _sd("SELECT time, round(ic, 6) AS ic, n FROM ic", _IC))
def ic(spark, sf_dir):
    return labels.ic(_signals(spark, sf_dir), "x", "f", "time").select("time", F.round("ic", 6).alias("ic"), "n")


@query("factor_ic_pearson", _sd("SELECT time, round(COVAR_SAMP(x, f) / NULLIF(STDDEV_SAMP(x) * STDDEV_SAMP(f), 0), 6) AS ic, COUNT(*) AS n FROM t WHERE f IS NOT NULL GROUP BY 1", _CTE_FWD))
def ic_pearson(spark, sf_dir):
    return labels.ic(_signals(spark, sf_dir), "x", "f", "time", "pearson").select("time", F.round("ic", 6).alias("ic"), "n")


@query("factor_ic_summary", _sd("SELECT round(AVG(ic), 6) AS mean, round(STDDEV_SAMP(ic), 6) AS std, round(AVG(CASE WHEN ic IS NOT NULL THEN CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END END), 6) AS hit_rate, COUNT(ic) AS n_periods, round(AVG(ic) / STDDEV_SAMP(ic), 6) AS icir, round(AVG(ic) / STDDEV_SAMP(ic) * SQRT(COUNT(ic)), 4) AS t_stat FROM ic", _IC))
def ic_summary(spark, sf_dir):
    s = labels.ic_summary(labels.ic(_signals(spark, sf_dir), "x", "f", "time").withColumn("ic", F.round("ic", 6)))
    return s.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "hit_rate", "icir")], "n_periods", F.round("t_stat", 4).alias("t_stat"))


_SORT = _CTE_FWD + ", g AS (SELECT * FROM t WHERE f IS NOT NULL), b AS (SELECT time, f, CAST(LEAST(FLOOR((RANK() OVER (PARTITION BY time ORDER BY x) + (COUNT(*) OVER (PARTITION BY time, x) - 1) / 2.0 - 1) * 5 / COUNT(*) OVER (PARTITION BY time)), 4) AS INTEGER) AS bucket FROM g), m AS (SELECT time, bucket, AVG(f) AS mean_ret, COUNT(*) AS n FROM b GROUP BY 1, 2)"


@query("factor_portfolio_sort", _sd("SELECT time, bucket, round(mean_ret, 6) AS mean_ret, n FROM m", _SORT))
def portfolio(spark, sf_dir):
    means, _ = labels.portfolio_sort(_signals(spark, sf_dir), "x", "f", "time")
    return means.select("time", "bucket", F.round("mean_ret", 6).alias("mean_ret"), "n")


@query("factor_portfolio_spread", _sd("SELECT round(AVG(s), 6) AS mean_spread, round(AVG(s) * SQRT(COUNT(*)) / STDDEV_SAMP(s), 4) AS t_stat, COUNT(*) AS n_periods FROM (SELECT time, MAX(CASE WHEN bucket = 4 THEN mean_ret END) - MAX(CASE WHEN bucket = 0 THEN mean_ret END) AS s FROM m GROUP BY 1) WHERE s IS NOT NULL", _SORT))
def spread(spark, sf_dir):
    _, s = labels.portfolio_sort(_signals(spark, sf_dir), "x", "f", "time")
    return s.select(F.round("mean_spread", 6).alias("mean_spread"), F.round("t_stat", 4).alias("t_stat"), "n_periods")


@query("factor_orthogonalize", _sd("SELECT entity, time, round(xc, 6) AS x_orth, round(yc - xc * COALESCE(SUM(yc * xc) OVER (PARTITION BY time) / NULLIF(SUM(xc * xc) OVER (PARTITION BY time), 0), 0), 4) AS y_orth FROM t", ", t AS (SELECT entity, time, x - AVG(x) OVER (PARTITION BY time) AS xc, y - AVG(y) OVER (PARTITION BY time) AS yc FROM sd)"))
def orthogonalize(spark, sf_dir):
    df = labels.orthogonalize(supplier_day(spark, sf_dir), ["x", "y"], "time")
    return df.select(*KEYS, r6(F.col("x_orth")).alias("x_orth"), F.round("y_orth", 4).alias("y_orth"))


# --- bars and monitors -----------------------------------------------------------------------------------------------------
_AMOUNT = {"tick": ("1.0", 10.0), "volume": ("y", 300.0), "dollar": ("x * y", 9000.0)}


def _bars(kind: str) -> None:
    amount, theta = _AMOUNT[kind]
    sql = _sd(
        "SELECT entity, bar_index, MIN(time) AS t_open, MAX(time) AS time, round(ARG_MIN(x, time), 6) AS open, round(MAX(x), 6) AS high, round(MIN(x), 6) AS low, round(ARG_MAX(x, time), 6) AS close, SUM(y) AS volume, COUNT(*) AS n_ticks FROM e GROUP BY 1, 2 HAVING BOOL_OR(closes)",
        f""", a AS (SELECT *, SUM({amount}) OVER ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM sd), b AS (SELECT *, COALESCE(LAG(c) OVER ({SQL_W}), 0) AS p FROM a),
        d AS (SELECT *, FLOOR(c / {theta}) > FLOOR(p / {theta}) AS closes FROM b), e AS (SELECT *, CAST(COALESCE(SUM(CASE WHEN closes THEN 1 ELSE 0 END) OVER ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bar_index FROM d)""",
    )

    @query(f"bars_{kind}", sql)
    def run(spark, sf_dir):
        df = bars.bars(supplier_day(spark, sf_dir), "entity", "time", "x", "y", kind, theta)
        return df.select("entity", "bar_index", "t_open", "time", *[r6(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume", "n_ticks")


for _kind in _AMOUNT:
    _bars(_kind)


@query("bars_tick_rule", f"WITH {SQL_EVENTS}, s AS (SELECT *, NULLIF(SIGN(x - LAG(x) OVER ({SQL_WE})), 0) AS s FROM ev) SELECT event_id, CAST(LAST_VALUE(s IGNORE NULLS) OVER ({SQL_WE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS side FROM s")
def tick_rule(spark, sf_dir):
    return bars.tick_rule(user_events(spark, sf_dir), "entity", ["ts", "event_id"], "x").select("event_id", "side")


@query("monitor_page_cusum", _sd(f"SELECT entity, time, round(s - LEAST(MIN(s) OVER ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 4) AS page_cusum FROM t", f", t AS (SELECT *, SUM(x - 35 - 1) OVER ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM sd)"))
def page(spark, sf_dir):
    df = supplier_day(spark, sf_dir).withColumn("z", F.col("x") - 35)
    return bars.page_cusum_frame(df, "entity", "time", "z", 1.0).select(*KEYS, F.round("page_cusum", 4).alias("page_cusum"))


@query("monitor_cusum_filter")
def cusum(spark, sf_dir):
    """Events of the symmetric CUSUM filter: a recursion with resets."""
    return bars.cusum_filter(supplier_day(spark, sf_dir), "entity", "time", "x", 60.0).select(*KEYS, "event")


@query("monitor_shiryaev_roberts")
def shiryaev(spark, sf_dir):
    df = supplier_day(spark, sf_dir).withColumn("z", (F.col("x") - 35) / 25)
    return bars.shiryaev_roberts(df, "entity", "time", "z", 0.5).select(*KEYS, F.round("log_sr", 6).alias("log_sr"))


@query("bars_imbalance")
def imbalance(spark, sf_dir):
    return bars.imbalance_bars(user_events(spark, sf_dir).drop("event_type"), "entity", ["ts", "event_id"], "x", kind="tick", expected_ticks=5.0).select("event_id", "bar_index", "closes")


@query(
    "monitor_homm_breitung",
    _sd(
        f"SELECT entity, time, round(CASE WHEN r > 10 THEN s / NULLIF(sd, 0) END, 6) AS hb_stat, round(CASE WHEN r > 10 THEN SQRT(4.6 + LN(r / 10)) * SQRT(r) END, 6) AS hb_bound FROM t",
        f", d AS (SELECT *, x - {_L(1)} AS d, CAST(ROW_NUMBER() OVER ({SQL_W}) - 1 AS DOUBLE) AS r FROM sd), t AS (SELECT *, SUM(CASE WHEN r > 10 THEN d END) OVER ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, STDDEV_SAMP(d) OVER ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sd FROM d)",
    ),
)
def homm(spark, sf_dir):
    return _rounded(bars.homm_breitung_cusum(supplier_day(spark, sf_dir), "entity", "time", "x", 10), "hb_stat", "hb_bound")
