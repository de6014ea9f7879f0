"""Queries of market features, regressions, cleaning, quality checks and forecast evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.operators import clean, econ, evaluation, quality
from tideframe.panel import PanelFrame
from tideframe.plans.catalog import query
from tideframe.plans.panels import SQL_PRICES, SQL_SUPPLIER, SQL_W, W, prices, r6, read, supplier_day

KEYS = ["entity", "time"]


def _frame(n: int) -> str:
    return f"({SQL_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(f: str, x: str, n: int) -> str:
    return f"CASE WHEN COUNT({x}) OVER {_frame(n)} >= {n} THEN {f}({x}) OVER {_frame(n)} END"


_OK = "low > 0 AND high >= GREATEST(open, close) AND low <= LEAST(open, close)"
_LOGS = f"{SQL_PRICES}, lg AS (SELECT entity, time, CASE WHEN {_OK} THEN LN(open) END AS o, CASE WHEN {_OK} THEN LN(high) END AS h, CASE WHEN {_OK} THEN LN(low) END AS l, CASE WHEN {_OK} THEN LN(close) END AS c FROM pr), lp AS (SELECT *, LAG(c) OVER ({SQL_W}) AS c1 FROM lg)"
_GK = f"(0.5 * (h - l) * (h - l) - {econ.GK_CLOSE!r} * (c - o) * (c - o))"
_RS = "((h - o) * (h - c) + (l - o) * (l - c))"
_N = 10
_RANGE = {
    "parkinson": ("AVG", f"((h - l) * (h - l) * {econ.PARKINSON!r})"),
    "garman_klass": ("AVG", _GK),
    "gk_overnight": ("AVG", f"({_GK} + (o - c1) * (o - c1))"),
    "rogers_satchell": ("AVG", _RS),
    "close_to_close": ("VAR_SAMP", "(c - c1)"),
}


def _range(kind: str) -> None:
    if kind == "yang_zhang":
        j = f"CASE WHEN c1 IS NOT NULL AND {_RS} IS NOT NULL THEN"
        k = f"({econ.YZ_ALPHA - 1!r} / ({econ.YZ_ALPHA} + (m + 1.0) / (m - 1)))"
        f = _frame(_N)
        sql = f"WITH {_LOGS}, y AS (SELECT *, COUNT({j} 1 END) OVER {f} AS m, VAR_SAMP({j} o - c1 END) OVER {f} AS a, VAR_SAMP({j} c - o END) OVER {f} AS b, AVG({j} {_RS} END) OVER {f} AS r FROM lp) SELECT entity, time, round(SQRT(GREATEST(CASE WHEN m >= {_N} THEN a + {k} * b + (1 - {k}) * r END, CASE WHEN m >= {_N} THEN 0 END) * 252), 6) AS vol FROM y"
    else:
        f, x = _RANGE[kind]
        v = _full(f, x, _N)
        sql = f"WITH {_LOGS}, y AS (SELECT entity, time, {v} AS v FROM lp) SELECT entity, time, round(CASE WHEN v IS NOT NULL THEN SQRT(GREATEST(v, 0) * 252) END, 6) AS vol FROM y"

    @query(f"econ_range_{kind}", sql)
    def run(spark, sf_dir):
        return econ.range_volatility(prices(spark, sf_dir), "entity", "time", _N, kind).select(*KEYS, r6(F.col("vol")).alias("vol"))


for _kind in (*_RANGE, "yang_zhang"):
    _range(_kind)

_K = 3 - 2 * math.sqrt(2)


@query(
    "econ_corwin_schultz",
    f"""WITH {SQL_PRICES}, a AS (SELECT entity, time, high, low, LAG(high) OVER ({SQL_W}) AS h1, LAG(low) OVER ({SQL_W}) AS l1 FROM pr),
    b AS (SELECT entity, time, POW(LN(high / low), 2) + POW(LN(h1 / l1), 2) AS b, POW(LN(GREATEST(high, h1) / LEAST(low, l1)), 2) AS g, h1 FROM a),
    c AS (SELECT entity, time, CASE WHEN h1 IS NOT NULL THEN {math.sqrt(2) - 1!r} * SQRT(b) / {_K!r} - SQRT(g / {_K!r}) END AS a FROM b),
    s AS (SELECT entity, time, CASE WHEN a IS NOT NULL THEN GREATEST(2 * (EXP(a) - 1) / (1 + EXP(a)), 0) END AS s FROM c) SELECT entity, time, round({_full('AVG', 's', _N)}, 6) AS spread FROM s""",
)
def corwin(spark, sf_dir):
    return econ.corwin_schultz(prices(spark, sf_dir), "entity", "time", _N).select(*KEYS, r6(F.col("spread")).alias("spread"))


@query(
    "econ_abdi_ranaldo",
    f"""WITH {SQL_PRICES}, a AS (SELECT entity, time, (LN(high) + LN(low)) / 2 AS m, LN(close) AS c FROM pr),
    b AS (SELECT entity, time, 4 * (LAG(c) OVER ({SQL_W}) - LAG(m) OVER ({SQL_W})) * (LAG(c) OVER ({SQL_W}) - m) AS x FROM a),
    s AS (SELECT entity, time, {_full('AVG', 'x', _N)} AS v FROM b) SELECT entity, time, round(CASE WHEN v IS NOT NULL THEN SQRT(GREATEST(v, 0)) END, 6) AS spread FROM s""",
)
def abdi(spark, sf_dir):
    return econ.abdi_ranaldo(prices(spark, sf_dir), "entity", "time", _N).select(*KEYS, r6(F.col("spread")).alias("spread"))


_RET = f"{SQL_SUPPLIER}, rt AS (SELECT *, LN(x) - LAG(LN(x)) OVER ({SQL_W}) AS r FROM sd)"


def _returns(spark, sf_dir) -> DataFrame:
    return supplier_day(spark, sf_dir).withColumn("r", F.ln("x") - F.lag(F.ln("x")).over(W()))


def _liquidity(name: str, x: str, f) -> None:
    @query(name, f"WITH {_RET}, q AS (SELECT *, {x} AS q FROM rt) SELECT entity, time, round({_full('AVG', 'q', _N)}, 6) AS v FROM q")
    def run(spark, sf_dir):
        return f(_returns(spark, sf_dir)).select(*KEYS, r6(F.col("v")).alias("v"))


_liquidity("econ_amihud", "CASE WHEN y > 0 THEN 1e3 * ABS(r) / y END", lambda df: econ.amihud(df.withColumn("d", F.col("y") * 1e3), "entity", "time", "r", "d", _N, "v"))
_liquidity("econ_amivest", "CASE WHEN ABS(r) > 0 THEN y / ABS(r) END", lambda df: econ.amivest(df, "entity", "time", "r", "y", _N, "v"))
_liquidity("econ_zero_return_share", "CASE WHEN r IS NOT NULL THEN CASE WHEN ABS(r) <= 0.5 THEN 1.0 ELSE 0.0 END END", lambda df: econ.zero_return_share(df, "entity", "time", "r", _N, 0.5, "v"))


@query(
    "econ_roll_spread",
    f"""WITH {SQL_SUPPLIER}, a AS (SELECT *, x - LAG(x) OVER ({SQL_W}) AS d FROM sd), b AS (SELECT *, LAG(d) OVER ({SQL_W}) AS e FROM a), k AS (SELECT entity, time, CASE WHEN e IS NOT NULL THEN d END AS d, CASE WHEN d IS NOT NULL THEN e END AS e FROM b),
    c AS (SELECT entity, time, CASE WHEN COUNT(d) OVER {_frame(_N)} >= {_N} THEN AVG(d * e) OVER {_frame(_N)} - AVG(d) OVER {_frame(_N)} * AVG(e) OVER {_frame(_N)} END AS cov FROM k) SELECT entity, time, round(CASE WHEN cov < 0 THEN 2 * SQRT(-cov) WHEN cov IS NOT NULL THEN 0 END, 5) AS v FROM c""",
)
def roll_spread(spark, sf_dir):
    return econ.roll_spread(supplier_day(spark, sf_dir), "entity", "time", "x", _N, out="v").select(*KEYS, F.round("v", 5).alias("v"))


@query(
    "econ_price_impact",
    f"""WITH {_RET}, q AS (SELECT *, SIGN(r) * SQRT(y) AS s FROM rt), v AS (SELECT entity, time, COUNT(s) OVER {_frame(_N)} AS n, AVG(s * s) OVER {_frame(_N)} AS ss, AVG(s) OVER {_frame(_N)} AS s, AVG(r * s) OVER {_frame(_N)} AS rs, AVG(r) OVER {_frame(_N)} AS r FROM q)
    SELECT entity, time, round(CASE WHEN n >= {_N} AND ss - s * s > 1e-12 * ss THEN (rs - r * s) / (ss - s * s) END, 6) AS v FROM v""",
)
def impact(spark, sf_dir):
    return econ.price_impact(_returns(spark, sf_dir), "entity", "time", "r", "y", _N, "v").select(*KEYS, r6(F.col("v")).alias("v"))


@query(
    "econ_realized_variance",
    f"""WITH {_RET}, q AS (SELECT *, ABS(r) * ABS(LAG(r) OVER ({SQL_W})) AS z FROM rt), v AS (SELECT entity, time, CASE WHEN COUNT(*) OVER {_frame(_N)} >= {_N} THEN SUM(r * r) OVER {_frame(_N)} END AS rv, CASE WHEN COUNT(*) OVER {_frame(_N)} >= {_N} THEN {math.pi / 2 * _N / (_N - 1)!r} * SUM(z) OVER {_frame(_N)} END AS bv FROM q)
    SELECT entity, time, round(rv, 6) AS rv, round(bv, 6) AS bv, round(CASE WHEN rv IS NOT NULL AND bv IS NOT NULL THEN GREATEST(rv - bv, 0) END, 6) AS jump FROM v""",
)
def realized(spark, sf_dir):
    return econ.realized_variance(_returns(spark, sf_dir), "entity", "time", "r", _N).select(*KEYS, *[r6(F.col(c)).alias(c) for c in ("rv", "bv", "jump")])


@query("econ_har", f"WITH {SQL_SUPPLIER} SELECT entity, time, {', '.join(f'round({_full('AVG', 'x', k)}, 6) AS x_har_{k}' for k in (1, 5, 22))} FROM sd")
def har(spark, sf_dir):
    return econ.har_features(supplier_day(spark, sf_dir), "entity", "time", "x").select(*KEYS, *[r6(F.col(f"x_har_{k}")).alias(f"x_har_{k}") for k in (1, 5, 22)])


_MU = (2 ** (2 / 3) * math.gamma(7 / 6) / math.gamma(1 / 2)) ** -3
_MED = math.pi / (6 - 4 * math.sqrt(3) + math.pi)


@query(
    "econ_intraday_measures",
    f"""WITH e AS (SELECT user_id, event_id, (value - 50) / 1000 AS r FROM events), a AS (SELECT *, ABS(r) AS a0, LAG(ABS(r)) OVER (PARTITION BY user_id ORDER BY event_id) AS a1, LAG(ABS(r), 2) OVER (PARTITION BY user_id ORDER BY event_id) AS a2 FROM e),
    b AS (SELECT *, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN a0 + a1 + a2 - GREATEST(a0, a1, a2) - LEAST(a0, a1, a2) END AS md FROM a)
    SELECT user_id, COUNT(r) AS n_obs, round(SUM(r * r), 8) AS rv, round({math.pi / 2!r} * COUNT(r) / NULLIF(COUNT(r) - 1, 0) * SUM(a0 * a1), 8) AS bv, round({_MED!r} * COUNT(r) / NULLIF(COUNT(r) - 2, 0) * SUM(md * md), 8) AS medrv,
    round({math.pi / (math.pi - 2)!r} * COUNT(r) / NULLIF(COUNT(r) - 1, 0) * SUM(CASE WHEN a1 IS NOT NULL THEN POW(LEAST(a0, a1), 2) END), 8) AS minrv, round(SUM(CASE WHEN r > 0 THEN r * r ELSE 0 END), 8) AS rs_pos, round(SUM(CASE WHEN r < 0 THEN r * r ELSE 0 END), 8) AS rs_neg,
    round(SUM(CASE WHEN r > 0 THEN r * r ELSE 0 END) - SUM(CASE WHEN r < 0 THEN r * r ELSE 0 END), 8) AS sjv, round(COUNT(r) / 3.0 * SUM(r * r * r * r), 8) AS rq, round({_MU!r} * COUNT(r) * COUNT(r) / NULLIF(COUNT(r) - 2, 0) * SUM(CASE WHEN a2 IS NOT NULL AND a1 IS NOT NULL THEN POW(a0 * a1 * a2, {4 / 3!r}) END), 8) AS tpq FROM b GROUP BY 1""",
)
def intraday(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("value") - 50) / 1000).alias("r"))
    out = econ.intraday_measures(df, ["user_id"], ["event_id"], "r")
    return out.select("user_id", "n_obs", *[F.round(c, 8).alias(c) for c in ("rv", "bv", "medrv", "minrv", "rs_pos", "rs_neg", "sjv", "rq", "tpq")])


# --- regressions -----------------------------------------------------------------------------------------------------------
@query("regression_within", f"WITH {SQL_SUPPLIER}, w AS (SELECT x - AVG(x) OVER (PARTITION BY entity) AS x, y - AVG(y) OVER (PARTITION BY entity) AS y FROM sd) SELECT 'y_within' AS term, round(SUM(x * y) / SUM(y * y), 6) AS coef FROM w")
def within(spark, sf_dir):
    df = econ.demean_within(supplier_day(spark, sf_dir), ["x", "y"], ["entity"])
    return econ.ols(df, "x_within", ["y_within"], intercept=False).select("term", F.round("coef", 6).alias("coef"))


@query("regression_ols", f"WITH {SQL_SUPPLIER} SELECT 'const' AS term, round(REGR_INTERCEPT(x, y), 4) AS coef FROM sd UNION ALL SELECT 'y', round(REGR_SLOPE(x, y), 4) FROM sd")
def ols(spark, sf_dir):
    return econ.ols(supplier_day(spark, sf_dir), "x", ["y"]).select("term", F.round("coef", 4).alias("coef"))


_FM = f"{SQL_SUPPLIER}, g AS (SELECT time, REGR_INTERCEPT(x, y) AS const, REGR_SLOPE(x, y) AS y FROM sd GROUP BY 1 HAVING COUNT(*) >= 5 AND REGR_SLOPE(x, y) IS NOT NULL AND NOT ISNAN(REGR_SLOPE(x, y)))"


@query("regression_fama_macbeth", f"WITH {_FM} SELECT 'const' AS term, round(AVG(const), 4) AS coef, round(STDDEV_SAMP(const) / SQRT(COUNT(*)), 4) AS se, COUNT(*) AS n_periods FROM g UNION ALL SELECT 'y', round(AVG(y), 4), round(STDDEV_SAMP(y) / SQRT(COUNT(*)), 4), COUNT(*) FROM g")
def fama_macbeth(spark, sf_dir):
    return econ.fama_macbeth(supplier_day(spark, sf_dir), "time", "x", "y", 5).select("term", F.round("coef", 4).alias("coef"), F.round("se", 4).alias("se"), "n_periods")


@query("regression_mean_group", f"WITH {SQL_SUPPLIER}, g AS (SELECT entity, REGR_SLOPE(x, y) AS s FROM sd GROUP BY 1 HAVING COUNT(*) >= 3) SELECT round(AVG(s), 5) AS coef, round(STDDEV_SAMP(s) / SQRT(COUNT(s)), 5) AS se, COUNT(s) AS n_entities FROM g")
def mean_group(spark, sf_dir):
    return econ.mean_group(supplier_day(spark, sf_dir), "entity", "x", "y").select(F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"), "n_entities")


# --- cleaning -----------------------------------------------------------------------------------------------------------------
@query("clean_exact_unique", "SELECT MIN(doc_id) AS doc_id, lang FROM documents GROUP BY md5(text), lang")
def exact(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), "lang")
    return clean.exact_unique(docs, ["h", "lang"], ["doc_id"]).select("doc_id", "lang")


@query("clean_normalize", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS v FROM part")
def normalize(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", clean.normalize_text(F.col("p_name")).alias("v"))


@query("clean_fingerprint", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '))), ' ') AS v FROM part")
def fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", clean.fingerprint(F.col("p_name")).alias("v"))


@query("clean_levenshtein", "SELECT p_partkey, round(1 - levenshtein(p_name, p_brand) / CAST(GREATEST(length(p_name), length(p_brand)) AS DOUBLE), 6) AS v FROM part")
def levenshtein(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.round(clean.levenshtein_similarity(F.col("p_name"), F.col("p_brand")), 6).alias("v"))


@query("clean_survivors", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, MAX(o_totalprice) AS o_totalprice, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def survivors(spark, sf_dir):
    return clean.survivors(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", {"o_orderstatus": "first", "o_totalprice": "max", "o_orderpriority": "last"})


_BOUNDS = {
    "iqr": (1.5, "QUANTILE_CONT(x, 0.25) - 1.5 * (QUANTILE_CONT(x, 0.75) - QUANTILE_CONT(x, 0.25))", "QUANTILE_CONT(x, 0.75) + 1.5 * (QUANTILE_CONT(x, 0.75) - QUANTILE_CONT(x, 0.25))"),
    "zscore": (2.0, "AVG(x) - 2 * STDDEV_SAMP(x)", "AVG(x) + 2 * STDDEV_SAMP(x)"),
    "quantile": (0.05, "QUANTILE_CONT(x, 0.05)", "QUANTILE_CONT(x, 0.95)"),
}


def _outliers(method: str) -> None:
    k, lo, hi = _BOUNDS[method]

    @query(f"clean_outliers_{method}", f"WITH {SQL_SUPPLIER}, b AS (SELECT entity, {lo} AS lo, {hi} AS hi FROM sd GROUP BY 1) SELECT entity, time, round(LEAST(GREATEST(x, lo), hi), 6) AS x, (x < lo OR x > hi) AS x_outlier FROM sd JOIN b USING (entity)")
    def run(spark, sf_dir):
        df = clean.clean_outliers(supplier_day(spark, sf_dir), "x", method, k, ["entity"], "flag")
        return clean.clean_outliers(df, "x", method, k, ["entity"]).select(*KEYS, r6(F.col("x")).alias("x"), "x_outlier")


for _m in _BOUNDS:
    _outliers(_m)


@query("clean_outliers_mad", f"WITH {SQL_SUPPLIER}, m AS (SELECT *, QUANTILE_CONT(x, 0.5) OVER (PARTITION BY entity) AS m FROM sd), b AS (SELECT entity, ANY_VALUE(m) AS m, QUANTILE_CONT(ABS(x - m), 0.5) AS s, AVG(ABS(x - m)) AS a FROM m GROUP BY 1) SELECT sd.entity, sd.time, round(LEAST(GREATEST(x, b.m - 3 * CASE WHEN s > 0 THEN 1.4826 * s ELSE 1.2533 * a END), b.m + 3 * CASE WHEN s > 0 THEN 1.4826 * s ELSE 1.2533 * a END), 6) AS x FROM sd JOIN b ON sd.entity = b.entity")
def mad(spark, sf_dir):
    return clean.clean_outliers(supplier_day(spark, sf_dir), "x", "mad", 3.0, ["entity"]).select(*KEYS, r6(F.col("x")).alias("x"))


@query("clean_minhash_near_duplicates")
def minhash(spark, sf_dir):
    """Verified near-duplicate pages: candidates come from MinHash bands, so the pairs depend on the hash; tests check precision and recall."""
    return clean.near_duplicates(read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("t")), "page_id", "t").withColumn("jaccard", F.round("jaccard", 6))


@query("clean_resolve_entities")
def resolve(spark, sf_dir):
    return clean.resolve_entities(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "c_name", 0.95).withColumn("score", F.round("score", 6))


# --- quality --------------------------------------------------------------------------------------------------------------------
@query("quality_validate", f"""WITH {SQL_SUPPLIER} SELECT 'null_keys' AS "check", 'entity' AS "column", 'error' AS impact, CAST(COALESCE(SUM(CASE WHEN entity IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_bad, COALESCE(SUM(CASE WHEN entity IS NULL THEN 1 ELSE 0 END), 0) = 0 AS passed FROM sd
 UNION ALL SELECT 'null_keys', 'time', 'error', CAST(COALESCE(SUM(CASE WHEN time IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT), COALESCE(SUM(CASE WHEN time IS NULL THEN 1 ELSE 0 END), 0) = 0 FROM sd
 UNION ALL SELECT 'range', 'x', 'error', CAST(SUM(CASE WHEN x < 5 OR x > 100 THEN 1 ELSE 0 END) AS BIGINT), SUM(CASE WHEN x < 5 OR x > 100 THEN 1 ELSE 0 END) = 0 FROM sd
 UNION ALL SELECT 'rule', 'positive', 'error', CAST(SUM(CASE WHEN NOT (y > 0) THEN 1 ELSE 0 END) AS BIGINT), SUM(CASE WHEN NOT (y > 0) THEN 1 ELSE 0 END) = 0 FROM sd
 UNION ALL SELECT 'unique_keys', 'entity', 'error', 0, TRUE
 UNION ALL SELECT 'min_obs', 'entity', 'warning', COUNT(*), COUNT(*) = 0 FROM (SELECT entity FROM sd GROUP BY 1 HAVING COUNT(*) < 500)""")
def validate(spark, sf_dir):
    p = PanelFrame(supplier_day(spark, sf_dir, True), "entity", "time")
    return quality.validate(p, {"x": quality.ColumnContract(ge=5.0, le=100.0)}, {"positive": F.col("y") > 0}, 500)


@query("quality_coverage", f"WITH {SQL_SUPPLIER} SELECT entity, round(COUNT(DISTINCT time) / CAST((SELECT COUNT(DISTINCT time) FROM sd) AS DOUBLE), 6) AS coverage FROM sd GROUP BY 1")
def coverage(spark, sf_dir):
    return quality.coverage(PanelFrame(supplier_day(spark, sf_dir), "entity", "time")).select("entity", F.round("coverage", 6).alias("coverage"))


@query("quality_report", """SELECT 'c_custkey' AS "column", COUNT(*) AS n_rows, CAST(SUM(CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_nan FROM customer UNION ALL SELECT 'c_acctbal', COUNT(*), CAST(SUM(CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END) AS BIGINT), CAST(SUM(CASE WHEN isnan(c_acctbal) THEN 1 ELSE 0 END) AS BIGINT) FROM customer""")
def report(spark, sf_dir):
    return quality.quality_report(read(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal"]).select("column", "n_rows", "n_null", "n_nan")


# --- evaluation -----------------------------------------------------------------------------------------------------------------
_PRED = f"{SQL_SUPPLIER}, ap AS (SELECT entity, time, x AS a, AVG(x) OVER ({SQL_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p FROM sd), e AS (SELECT * FROM ap WHERE p IS NOT NULL)"
_METRIC = {
    "mae": "AVG(ABS(p - a))",
    "mfe": "AVG(a - p)",
    "mape": "AVG(ABS(p - a) / NULLIF(ABS(a), 0))",
    "mse": "AVG((p - a) * (p - a))",
    "rmse": "SQRT(AVG((p - a) * (p - a)))",
    "smape": "SUM(ABS(p - a)) / NULLIF(SUM(p + a), 0)",
    "smape_original": "100 * AVG(2 * ABS(p - a) / (0.0001 + ABS(a) + ABS(p)))",
    "overforecast": "COALESCE(SUM(CASE WHEN p > a THEN p END), 0)",
    "underforecast": "COALESCE(SUM(CASE WHEN p < a THEN p END), 0)",
}


def _predicted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = supplier_day(spark, sf_dir)
    return df, df.select(*KEYS, F.avg("x").over(W().rowsBetween(-5, -1)).alias("p")).where("p is not null")


def _metric(name: str) -> None:
    @query(f"metric_{name}", f"WITH {_PRED} SELECT entity, round({_METRIC[name]}, 4) AS v FROM e GROUP BY 1")
    def run(spark, sf_dir):
        actual, predicted = _predicted(spark, sf_dir)
        return evaluation.metrics(actual, predicted, "entity", "time", "x", "p", [name]).select("entity", F.round(name, 4).alias("v"))


for _name in _METRIC:
    _metric(_name)


@query("metric_scaled", f"WITH {_PRED}, d AS (SELECT entity, AVG(ABS(x - l)) AS m1, AVG((x - l) * (x - l)) AS m2 FROM (SELECT entity, x, LAG(x) OVER ({SQL_W}) AS l FROM sd) GROUP BY 1) SELECT e.entity, round(AVG(ABS(p - a)) / ANY_VALUE(m1), 6) AS mase, round(SQRT(AVG((p - a) * (p - a)) / ANY_VALUE(m2)), 6) AS rmsse FROM e JOIN d ON e.entity = d.entity GROUP BY 1")
def scaled(spark, sf_dir):
    actual, predicted = _predicted(spark, sf_dir)
    return evaluation.scaled_metrics(actual, predicted, actual, "entity", "time", "x", "p").select("entity", F.round("mase", 6).alias("mase"), F.round("rmsse", 6).alias("rmsse"))


@query("forecast_naive", f"WITH {SQL_SUPPLIER} SELECT entity, CAST(s AS INTEGER) AS step, round(v, 6) AS yhat FROM (SELECT entity, ARG_MAX(x, time) AS v FROM sd GROUP BY 1), generate_series(1, 3) g(s)")
def naive(spark, sf_dir):
    return evaluation.naive(supplier_day(spark, sf_dir), "entity", "time", "x", 3).select("entity", "step", F.round("yhat", 6).alias("yhat"))


_ACF = f"{SQL_SUPPLIER}, l AS (SELECT entity, x, {', '.join(f'LAG(x, {k}) OVER ({SQL_W}) AS l{k}' for k in (1, 2, 3))} FROM sd), ac AS (SELECT entity, COUNT(x) AS n, {', '.join(f'CORR(x, l{k}) AS c{k}' for k in (1, 2, 3))} FROM l GROUP BY 1)"


@query("evaluation_acf", f"WITH {_ACF} " + " UNION ALL ".join(f"SELECT entity, {k} AS lag, round({f'c{k}' if k else '1.0'}, 6) AS acf FROM ac" for k in range(4)))
def acf(spark, sf_dir):
    return evaluation.acf(supplier_day(spark, sf_dir), "entity", "time", "x", 3).select("entity", "lag", F.round("acf", 6).alias("acf"))


@query("evaluation_ljung_box", f"WITH {_ACF} " + " UNION ALL ".join(f"SELECT entity, {k} AS lag, round(n * (n + 2) * ({' + '.join(f'c{j} * c{j} / (n - {j})' for j in range(1, k + 1))}), 5) AS ljung_box FROM ac" for k in (1, 2, 3)))
def ljung(spark, sf_dir):
    a = evaluation.acf(supplier_day(spark, sf_dir), "entity", "time", "x", 3)
    return evaluation.ljung_box(a, "entity").select("entity", "lag", F.round("ljung_box", 5).alias("ljung_box"))


@query("conformal_radius", f"WITH {_PRED}, r AS (SELECT entity, ABS(p - a) AS s, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY ABS(p - a)) AS k, COUNT(*) OVER (PARTITION BY entity) AS n FROM e) SELECT entity, round(MAX(CASE WHEN k = CEIL((n + 1) * 0.9::DOUBLE) THEN s END), 6) AS radius FROM r GROUP BY 1")
def conformal(spark, sf_dir):
    actual, predicted = _predicted(spark, sf_dir)
    s = evaluation.joined(actual, predicted, "entity", "time", "x", "p").select("entity", F.abs(F.col("__p") - F.col("__a")).alias("s"))
    return evaluation.conformal_radius(s, "entity", "s", 0.1).select("entity", F.round("radius", 6).alias("radius"))


_PV = f"{SQL_SUPPLIER}, g AS (SELECT entity, AVG(x) AS m FROM sd GROUP BY 1), pv AS (SELECT entity, (m - (SELECT MIN(m) FROM g)) / ((SELECT MAX(m) FROM g) - (SELECT MIN(m) FROM g)) / 20 AS p FROM g), o AS (SELECT *, COUNT(*) OVER () AS n, ROW_NUMBER() OVER (ORDER BY p) AS i FROM pv)"
_ADJ = {
    "bonferroni": "LEAST(p * n, 1)",
    "holm": "LEAST(MAX((n - i + 1) * p) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)",
    "bh": "LEAST(MIN(n * p / i) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)",
    "by": "LEAST(MIN((SELECT SUM(1.0 / k) FROM generate_series(1, (SELECT COUNT(*) FROM pv)) t(k)) * n * p / i) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)",
}


def _adjust(method: str) -> None:
    @query(f"validation_{method}", f"WITH {_PV} SELECT entity, round({_ADJ[method]}, 6) AS p_adjusted FROM o")
    def run(spark, sf_dir):
        g = supplier_day(spark, sf_dir).groupBy("entity").agg(F.avg("x").alias("m"))
        ends = g.agg(F.min("m").alias("a"), F.max("m").alias("b"))
        pv = g.join(F.broadcast(ends)).select("entity", ((F.col("m") - F.col("a")) / (F.col("b") - F.col("a")) / 20).alias("p"))
        return evaluation.adjust_p_values(pv, "p", method).select("entity", F.round("p_adjusted", 6).alias("p_adjusted"))


for _method in _ADJ:
    _adjust(_method)


@query("validation_sharpe", f"WITH {SQL_SUPPLIER} SELECT entity, COUNT(x) AS n, round(AVG(x - 35) / STDDEV_SAMP(x - 35), 6) AS sharpe FROM sd GROUP BY 1")
def sharpe(spark, sf_dir):
    df = supplier_day(spark, sf_dir).withColumn("r", F.col("x") - 35)
    return evaluation.sharpe_statistics(df, "entity", "r").select("entity", "n", F.round("sharpe", 6).alias("sharpe"))


@query("forecast_elite", f"WITH {_PRED}, s AS (SELECT entity, 'mean' AS model, AVG(ABS(p - a)) AS score FROM e GROUP BY 1 UNION ALL SELECT entity, 'zero', AVG(ABS(a)) FROM e GROUP BY 1), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY score, model) AS k FROM s) SELECT entity, model FROM r WHERE k <= 1")
def elite(spark, sf_dir):
    actual, predicted = _predicted(spark, sf_dir)
    j = evaluation.joined(actual, predicted, "entity", "time", "x", "p").groupBy("entity").agg(F.avg(F.abs(F.col("__p") - F.col("__a"))).alias("mean"), F.avg(F.abs("__a")).alias("zero"))
    scores = j.select("entity", F.explode(F.create_map(F.lit("mean"), "mean", F.lit("zero"), "zero")).alias("model", "score"))
    return evaluation.elite(scores, "entity", "model", "score", 1).select("entity", "model")


# --- clusters of spellings, and checks one by one ---------------------------------------------------------------------------------
_KEY = r"array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '))), ' ')"


@query(
    "clean_fingerprint_clusters",
    f"""WITH r AS (SELECT {_KEY} AS key, p_name AS name, p_partkey AS id FROM part WHERE p_name IS NOT NULL), s AS (SELECT key, name, COUNT(*) AS n FROM r GROUP BY 1, 2),
    b AS (SELECT key, first(name ORDER BY n DESC, name) AS canonical, CAST(SUM(n) AS BIGINT) AS n_rows FROM s GROUP BY 1)
    SELECT b.key, canonical, n_ids, n_rows FROM b JOIN (SELECT key, COUNT(DISTINCT id) AS n_ids FROM r GROUP BY 1) i ON i.key = b.key""",
)
def spellings(spark, sf_dir):
    return clean.fingerprint_clusters(read(spark, sf_dir, "part"), "p_partkey", "p_name")


@query(
    "quality_check_gaps",
    f"""WITH {SQL_SUPPLIER}, g AS (SELECT entity, LAG(time) OVER ({SQL_W}) AS after, time AS before FROM sd)
    SELECT entity, after, before, CAST(before - after - 1 AS BIGINT) AS missing FROM g WHERE before - after > 1""",
)
def missing_steps(spark, sf_dir):
    return quality.check_gaps(supplier_day(spark, sf_dir), "entity", "time", 1).offending


@query("quality_check_min_obs", f"WITH {SQL_SUPPLIER} SELECT entity, COUNT(DISTINCT time) AS n_obs FROM sd GROUP BY 1 HAVING COUNT(DISTINCT time) < 500")
def few_times(spark, sf_dir):
    return quality.check_min_obs(supplier_day(spark, sf_dir), "entity", "time", 500).offending
