"""Queries of the bulk features: one for each feature, over the users' event series, and one of many features at once."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tideframe.operators import features
from tideframe.plans.catalog import query
from tideframe.plans.panels import SQL_EVENTS, SQL_WE, user_events

ORDER = ["ts", "event_id"]
EVERY = "(PARTITION BY entity)"
SQL_PASS = f"""{SQL_EVENTS}, f AS (SELECT entity, x, ROW_NUMBER() OVER ({SQL_WE}) AS rn, COUNT(*) OVER {EVERY} AS n, AVG(x) OVER {EVERY} AS m, MIN(x) OVER {EVERY} AS lo, MAX(x) OVER {EVERY} AS hi,
  STDDEV_SAMP(x) OVER {EVERY} AS sd, MAX(x) OVER ({SQL_WE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top,
  {", ".join(f"LAG(x, {k}) OVER ({SQL_WE}) AS g{k}, LEAD(x, {k}) OVER ({SQL_WE}) AS d{k}" for k in range(1, 5))} FROM ev)"""


def _count(c: str) -> str:
    return f"SUM(CASE WHEN {c} THEN 1 ELSE 0 END)"


def _first(c: str) -> str:
    return f"MAX(CASE WHEN rn = {c} THEN x END)"


def _peaks(s: int) -> str:
    return _count(" AND ".join(f"x > g{i} AND x > d{i}" for i in range(1, s + 1)))


def _moments(v: str, p: float, power: float, less: float) -> str:
    """Standardised population moment of an expression, from the list of its values."""
    lst = f"LIST({v}) FILTER ({v} IS NOT NULL)"
    centred = lambda k: f"LIST_AVG(LIST_TRANSFORM({lst}, lambda z: POW(z - LIST_AVG({lst}), {k})))"
    return f"{centred(int(p))} / NULLIF(POW({centred(2)}, {power}), 0) - {less}"


def _benford() -> str:
    digit = "FLOOR(ABS(x) / POW(10.0, FLOOR(LOG10(CASE WHEN x <> 0 THEN ABS(x) END))))"
    law = [math.log10(1 + 1 / k) for k in range(1, 10)]
    share = [f"({_count(f'{digit} = {k}')} / CAST(COUNT(CASE WHEN x <> 0 THEN x END) AS DOUBLE))" for k in range(1, 10)]
    mean, centre = "((" + " + ".join(share) + ") / 9)", sum(law) / 9
    cov = " + ".join(f"({s} - {mean}) * ({v - centre!r})" for s, v in zip(share, law, strict=True))
    var = " + ".join(f"({s} - {mean}) * ({s} - {mean})" for s in share)
    return f"({cov}) / NULLIF(SQRT({var}) * {math.sqrt(sum((v - centre) ** 2 for v in law))!r}, 0)"


RET = "(x / NULLIF(g1, 0) - 1)"
TREND = {k: f"REGR_{k.upper()}(x, CAST(rn - 1 AS DOUBLE))" for k in ("slope", "intercept", "syy", "sxy")}
SQL: dict[str, str] = {
    "absolute_energy": "SUM(x * x)",
    "absolute_maximum": "MAX(ABS(x))",
    "absolute_sum_of_changes": "SUM(ABS(x - g1))",
    "autocorrelation_1": "SUM((x - m) * (g1 - m)) / NULLIF(MAX(n - 1) * VAR_POP(x), 0)",
    "autocorrelation_2": "SUM((x - m) * (g2 - m)) / NULLIF(MAX(n - 2) * VAR_POP(x), 0)",
    "root_mean_square": "SQRT(AVG(x * x))",
    "benford_correlation": _benford(),
    "c3_1": "SUM(x * g1 * g2) / NULLIF(MAX(n - 2), 0)",
    "c3_2": "SUM(x * g2 * g4) / NULLIF(MAX(n - 4), 0)",
    "cid_ce": "SQRT(SUM((x - d1) * (x - d1)))",
    "cid_ce_normalized": "SQRT(SUM((x - d1) * (x - d1))) / NULLIF(STDDEV_POP(x), 0)",
    "count_above_0": f"100.0 * {_count('x >= 0')} / COUNT(*)",
    "count_below_0": f"100.0 * {_count('x <= 0')} / COUNT(*)",
    "count_above_mean": _count("x > m"),
    "count_below_mean": _count("x < m"),
    "first_location_of_maximum": "(MIN(CASE WHEN x = hi THEN rn END) - 1) / CAST(MAX(n) AS DOUBLE)",
    "first_location_of_minimum": "(MIN(CASE WHEN x = lo THEN rn END) - 1) / CAST(MAX(n) AS DOUBLE)",
    "last_location_of_maximum": "MAX(CASE WHEN x = hi THEN rn END) / CAST(MAX(n) AS DOUBLE)",
    "last_location_of_minimum": "MAX(CASE WHEN x = lo THEN rn END) / CAST(MAX(n) AS DOUBLE)",
    "has_duplicate": "COUNT(x) <> COUNT(DISTINCT x)",
    "has_duplicate_max": f"{_count('x = hi')} > 1",
    "has_duplicate_min": f"{_count('x = lo')} > 1",
    "large_standard_deviation": "STDDEV_SAMP(x) > 0.25 * (MAX(x) - MIN(x))",
    "linear_trend_slope": TREND["slope"],
    "linear_trend_intercept": TREND["intercept"],
    "linear_trend_rss": f"{TREND['syy']} - {TREND['slope']} * {TREND['sxy']}",
    "mean_abs_change": "AVG(ABS(x - g1))",
    "max_abs_change": "MAX(ABS(x - g1))",
    "mean_change": f"({_first('n')} - {_first('1')}) / MAX(CASE WHEN n > 1 THEN n - 1 END)",
    "mean_second_derivative_central": f"({_first('n')} - {_first('n - 1')} - {_first('2')} + {_first('1')}) / NULLIF(2 * MAX(n - 2), 0)",
    "number_crossings_0": _count("(x > 0) <> (g1 > 0)"),
    "number_peaks_1": _peaks(1),
    "number_peaks_3": _peaks(3),
    "range_count_0_1": _count("x >= 0 AND x < 1"),
    "ratio_beyond_1_sigma": f"{_count('ABS(x - m) > sd')} / CAST(COUNT(*) AS DOUBLE)",
    "ratio_n_unique_to_length": "COUNT(DISTINCT x) / CAST(COUNT(*) AS DOUBLE)",
    "symmetry_looking": "ABS(AVG(x) - MEDIAN(x)) < 0.25 * (MAX(x) - MIN(x))",
    "time_reversal_asymmetry_1": "AVG(d2 * d2 * d1 - d1 * x * x)",
    "variation_coefficient": "STDDEV_SAMP(x) / NULLIF(AVG(x), 0)",
    "var_gt_std": "VAR_SAMP(x) > STDDEV_SAMP(x)",
    "harmonic_mean": "COUNT(x) / NULLIF(SUM(1 / NULLIF(x, 0)), 0)",
    "range_over_mean": "(MAX(x) - MIN(x)) / NULLIF(AVG(x), 0)",
    "range_change": "MAX(x) / NULLIF(MIN(x), 0) - 1",
    "realized_volatility": "SQRT(SUM(POW(CASE WHEN x > 0 AND g1 > 0 THEN LN(x) - LN(g1) END, 2)))",
    "return_skew": _moments(RET, 3, 1.5, 0),
    "return_kurtosis": _moments(RET, 4, 2, 3),
    "num_direction_changes": _count("SIGN(x - g1) <> SIGN(g1 - g2)"),
    "max_drawdown": "MIN(x / NULLIF(top, 0) - 1)",
}
FLAGS = {"has_duplicate", "has_duplicate_max", "has_duplicate_min", "large_standard_deviation", "symmetry_looking", "var_gt_std"}
COUNTS = {"count_above_mean", "count_below_mean", "number_crossings_0", "number_peaks_1", "number_peaks_3", "range_count_0_1", "num_direction_changes"}


def _out(name: str, c):
    return c if name in FLAGS else c.cast("long") if name in COUNTS else F.round(c.cast("double"), 6)


def _sql_out(name: str) -> str:
    return SQL[name] if name in FLAGS else f"CAST({SQL[name]} AS BIGINT)" if name in COUNTS else f"round(CAST({SQL[name]} AS DOUBLE), 6)"


def _register(name: str) -> None:
    def run(spark, sf_dir):
        df = features.extract_features(user_events(spark, sf_dir), "entity", ORDER, "x", [name])
        return df.select("entity", _out(name, F.col(name)).alias("v"))

    query(f"feature_{name}", f"WITH {SQL_PASS} SELECT entity, {_sql_out(name)} AS v FROM f GROUP BY entity")(run)


for _name in features.FEATURES:
    _register(_name)

BULK = ("absolute_energy", "mean_abs_change", "autocorrelation_1", "cid_ce", "count_above_mean", "linear_trend_slope", "number_peaks_1", "variation_coefficient", "max_drawdown", "root_mean_square")


@query("features_bulk", f"WITH {SQL_PASS} SELECT entity, {', '.join(f'{_sql_out(k)} AS {k}' for k in BULK)} FROM f GROUP BY entity")
def bulk(spark, sf_dir):
    """Ten features in one window pass and one aggregation."""
    df = features.extract_features(user_events(spark, sf_dir), "entity", ORDER, "x", BULK)
    return df.select("entity", *[_out(k, F.col(k)).alias(k) for k in BULK])


_COUNTED = f"{SQL_EVENTS}, c AS (SELECT entity, ROUND(x) AS x, COUNT(*) AS c FROM ev GROUP BY 1, 2)"


@query(
    "feature_value_counts",
    f"""WITH {_COUNTED} SELECT entity, round(1 - {_count('c = 1')} / CAST(SUM(c) AS DOUBLE), 6) AS percent_reoccurring_points, round({_count('c > 1')} / CAST(COUNT(*) AS DOUBLE), 6) AS percent_reoccurring_values,
    COALESCE(SUM(CASE WHEN c > 1 THEN x * c END), 0.0) AS sum_reoccurring_points, COALESCE(SUM(CASE WHEN c > 1 THEN x END), 0.0) AS sum_reoccurring_values FROM c GROUP BY entity""",
)
def value_counts(spark, sf_dir):
    df = user_events(spark, sf_dir).withColumn("x", F.floor(F.col("x") + 0.5).cast("double"))
    out = features.value_count_features(df, "entity", "x")
    return out.select("entity", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    "feature_binned_entropy",
    f"""WITH {SQL_EVENTS}, b AS (SELECT entity, LEAST(FLOOR(COALESCE((x - MIN(x) OVER {EVERY}) * 10 / NULLIF(MAX(x) OVER {EVERY} - MIN(x) OVER {EVERY}, 0), 0)), 9) AS bin FROM ev),
    c AS (SELECT entity, bin, COUNT(*) AS c FROM b GROUP BY 1, 2), p AS (SELECT entity, c / CAST(SUM(c) OVER {EVERY} AS DOUBLE) AS p FROM c)
    SELECT entity, round(-SUM(p * LN(p)), 6) AS v FROM p GROUP BY entity""",
)
def binned(spark, sf_dir):
    return features.binned_entropy(user_events(spark, sf_dir), "entity", "x").select("entity", F.round("binned_entropy", 6).alias("v"))


@query("feature_energy_ratios", f"WITH {SQL_PASS} SELECT entity, {', '.join(f'round(COALESCE(SUM(CASE WHEN FLOOR((rn - 1) / CEIL(n / 10.0)) = {k} THEN x * x END) / NULLIF(SUM(x * x), 0), 0), 6) AS e{k}' for k in range(10))} FROM f GROUP BY entity")
def energy(spark, sf_dir):
    df = features.energy_ratios(user_events(spark, sf_dir), "entity", ORDER, "x")
    return df.select("entity", *[F.round(F.col("energy_ratios")[k], 6).alias(f"e{k}") for k in range(10)])


@query(
    "feature_index_mass_quantile",
    f"""WITH {SQL_EVENTS}, s AS (SELECT entity, ROW_NUMBER() OVER ({SQL_WE}) AS rn, SUM(ABS(x)) OVER ({SQL_WE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, SUM(ABS(x)) OVER {EVERY} AS t, COUNT(*) OVER {EVERY} AS n FROM ev)
    SELECT entity, round(MIN(CASE WHEN t > 0 AND s >= 0.5 * t THEN rn END) / CAST(MAX(n) AS DOUBLE), 6) AS v FROM s GROUP BY entity""",
)
def mass(spark, sf_dir):
    return features.index_mass_quantile(user_events(spark, sf_dir), "entity", ORDER, "x", 0.5).select("entity", F.round("index_mass_quantile", 6).alias("v"))


@query("feature_mean_n_absolute_max", f"WITH {SQL_EVENTS}, r AS (SELECT entity, ABS(x) AS a, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY ABS(x) DESC NULLS LAST) AS k FROM ev) SELECT entity, round(AVG(a), 6) AS v FROM r WHERE k <= 7 GROUP BY entity")
def top_mean(spark, sf_dir):
    return features.mean_n_absolute_max(user_events(spark, sf_dir), "entity", "x", 7).select("entity", F.round("mean_n_absolute_max", 6).alias("v"))


@query(
    "feature_permutation_entropy",
    f"""WITH {SQL_EVENTS}, q AS (SELECT entity, x AS a, LEAD(x, 1) OVER ({SQL_WE}) AS b, LEAD(x, 2) OVER ({SQL_WE}) AS c FROM ev),
    k AS (SELECT entity, (CASE WHEN b < a THEN 1 ELSE 0 END) + (CASE WHEN c < a THEN 1 ELSE 0 END) AS i, (CASE WHEN a <= b THEN 1 ELSE 0 END) + (CASE WHEN c < b THEN 1 ELSE 0 END) AS j FROM q WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
    n AS (SELECT entity, i, j, COUNT(*) AS n FROM k GROUP BY 1, 2, 3), p AS (SELECT entity, n / CAST(SUM(n) OVER {EVERY} AS DOUBLE) AS p FROM n)
    SELECT entity, round(-SUM(p * LN(p)), 6) AS v FROM p GROUP BY entity""",
)
def permutation(spark, sf_dir):
    return features.permutation_entropy(user_events(spark, sf_dir), "entity", ORDER, "x").select("entity", F.round("permutation_entropy", 6).alias("v"))


def _longest(name: str, on: str) -> str:
    return f"""{name} AS (SELECT entity, MAX(c) AS v FROM (SELECT entity, rn - k AS i, COUNT(*) AS c FROM (SELECT entity, rn, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY rn) AS k FROM f WHERE {on}) GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "feature_streaks",
    f"""WITH {SQL_PASS}, {_longest('a', 'x > m')}, {_longest('b', 'x < m')}, {_longest('w', 'x - g1 >= 0')}, {_longest('l', 'x - g1 <= 0')}, e AS (SELECT DISTINCT entity FROM f)
    SELECT e.entity, COALESCE(a.v, 0) AS longest_streak_above_mean, COALESCE(b.v, 0) AS longest_streak_below_mean, COALESCE(w.v, 0) AS longest_winning_streak, COALESCE(l.v, 0) AS longest_losing_streak
    FROM e LEFT JOIN a USING (entity) LEFT JOIN b USING (entity) LEFT JOIN w USING (entity) LEFT JOIN l USING (entity)""",
)
def streaks(spark, sf_dir):
    return features.streak_features(user_events(spark, sf_dir), "entity", ORDER, "x")


@query(
    "feature_change_quantiles",
    f"""WITH {SQL_EVENTS}, h AS (SELECT entity, x, LAG(x) OVER ({SQL_WE}) AS b, QUANTILE_CONT(x, 0.2) OVER {EVERY} AS lo, QUANTILE_CONT(x, 0.8) OVER {EVERY} AS hi FROM ev)
    SELECT entity, round(AVG(CASE WHEN x BETWEEN lo AND hi AND b BETWEEN lo AND hi THEN ABS(x - b) END), 6) AS v FROM h GROUP BY entity""",
)
def corridor(spark, sf_dir):
    return features.change_quantiles(user_events(spark, sf_dir), "entity", ORDER, "x", 0.2, 0.8).select("entity", F.round("change_quantiles", 6).alias("v"))




_RUNS = f"""{SQL_PASS}, rr AS (SELECT entity, COUNT(*) AS n FROM (SELECT entity, rn - ROW_NUMBER() OVER (PARTITION BY entity ORDER BY rn) AS i FROM f WHERE x - g1 >= 5) GROUP BY entity, i)"""


@query(
    "feature_streak_length_stats",
    f"""WITH {_RUNS} SELECT entity, MIN(n) AS "min", MAX(n) AS "max", round(AVG(n), 6) AS "mean", round(STDDEV_SAMP(n), 6) AS "std", round(QUANTILE_CONT(n, 0.1), 6) AS p10, round(QUANTILE_CONT(n, 0.5), 6) AS "median", round(QUANTILE_CONT(n, 0.9), 6) AS p90 FROM rr GROUP BY entity""",
)
def streak_stats(spark, sf_dir):
    df = features.streak_length_stats(user_events(spark, sf_dir), "entity", ORDER, "x", 5.0)
    return df.select("entity", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p10", "median", "p90")])


@query("feature_longest_streak_above", f"WITH {_RUNS}, e AS (SELECT DISTINCT entity FROM f) SELECT e.entity, COALESCE(MAX(n), 0) AS longest_streak FROM e LEFT JOIN rr ON e.entity = rr.entity GROUP BY 1")
def longest_above(spark, sf_dir):
    return features.longest_streak(user_events(spark, sf_dir), "entity", ORDER, "x", 5.0)


@query("feature_count_above", f"WITH {SQL_EVENTS} SELECT entity, round(100.0 * SUM(CASE WHEN x >= 50 THEN 1 ELSE 0 END) / COUNT(*), 6) AS percent FROM ev GROUP BY entity")
def count_above(spark, sf_dir):
    return features.count_threshold(user_events(spark, sf_dir), "entity", "x", 50.0).select("entity", F.round("percent", 6).alias("percent"))


@query("feature_mci", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount / 2, 6) AS mci, round((CASE WHEN l_tax > 0.04 THEN 1.0 ELSE -1.0 END) * (l_extendedprice - (l_extendedprice * (1 - l_discount) + l_extendedprice) / 2), 6) AS signed FROM lineitem")
def mci(spark, sf_dir):
    from tideframe.plans.panels import read

    df = read(spark, sf_dir, "lineitem")
    bid, ask = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice")
    side = F.when(F.col("l_tax") > 0.04, 1.0).otherwise(-1.0)
    return df.select("l_orderkey", "l_linenumber", F.round(features.marginal_cost_of_immediacy(bid, ask), 6).alias("mci"), F.round(features.signed_mci(ask, bid, ask, side), 6).alias("signed"))
