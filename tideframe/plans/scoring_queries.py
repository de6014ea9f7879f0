"""Queries of forecast scores, panel regressions and spillovers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import panelreg, scoring
from tideframe.plans.catalog import query
from tideframe.plans.market_queries import _PRED, _predicted
from tideframe.plans.panels import SQL_SUPPLIER, SQL_W, W, day, r6, read, supplier_day

KEYS = ["entity", "time"]
_E = _PRED


def _joined(spark, sf_dir):
    actual, predicted = _predicted(spark, sf_dir)
    return actual.join(predicted, KEYS).select(*KEYS, F.col("x").alias("a"), "p")


def _score(name: str, sql: str, make) -> None:
    @query(name, f"WITH {_E} SELECT entity, time, round(CAST({sql} AS DOUBLE), 6) AS v FROM e")
    def run(spark, sf_dir):
        return _joined(spark, sf_dir).select(*KEYS, r6(make()).alias("v"))


A, P = (lambda: F.col("a")), (lambda: F.col("p"))
_score("score_pinball", "CASE WHEN a - p >= 0 THEN 0.9 * (a - p) ELSE (0.9 - 1) * (a - p) END", lambda: scoring.pinball(A(), P(), 0.9))
_score("score_interval", "20 + 20 * CASE WHEN a < p - 10 THEN p - 10 - a ELSE 0 END + 20 * CASE WHEN a > p + 10 THEN a - p - 10 ELSE 0 END", lambda: scoring.interval_score(A(), P() - 10, P() + 10, 0.1))
_score("score_crps_quantiles", " + ".join(f"CASE WHEN a - (p + {s}) >= 0 THEN {q} * (a - (p + {s})) ELSE ({q} - 1) * (a - (p + {s})) END" for q, s in ((0.25, -5), (0.5, 0), (0.75, 5))).join(("2 * (", ") / 3")), lambda: scoring.crps_from_quantiles(A(), [P() - 5, P(), P() + 5], [0.25, 0.5, 0.75]))
_score("score_exceedance", "CASE WHEN a < p - 20 OR a > p + 20 THEN 1 ELSE 0 END", lambda: scoring.exceedance(A(), P() - 20, P() + 20))


@query("score_loss_panel", f"WITH {_E}, j AS (SELECT e.*, 35.0 AS c FROM e) SELECT time, round(AVG((a - p) * (a - p)), 5) AS p, round(AVG((a - c) * (a - c)), 5) AS c FROM j GROUP BY 1")
def loss_panel(spark, sf_dir):
    df = _joined(spark, sf_dir).withColumn("c", F.lit(35.0))
    return scoring.loss_panel(df, "time", "a", ["p", "c"]).select("time", F.round("p", 5).alias("p"), F.round("c", 5).alias("c"))


@query("score_murphy", f"WITH {_E} " + " UNION ALL ".join(f"SELECT {t}.0 AS theta, round(AVG(CASE WHEN LEAST(a, p) <= {t} AND {t} < GREATEST(a, p) THEN ABS(a - {t}) ELSE 0 END), 6) AS score FROM e" for t in (20, 35, 50)))
def murphy(spark, sf_dir):
    return scoring.murphy(_joined(spark, sf_dir), "a", "p", [20, 35, 50]).select("theta", F.round("score", 6).alias("score"))


@query("score_pit_histogram", f"WITH {SQL_SUPPLIER}, r AS (SELECT (RANK() OVER (PARTITION BY time ORDER BY x) - 0.5) / COUNT(*) OVER (PARTITION BY time) AS u FROM sd) SELECT CAST(LEAST(FLOOR(u * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n FROM r GROUP BY 1")
def pit(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("time")
    df = supplier_day(spark, sf_dir).withColumn("u", (F.rank().over(w.orderBy("x")) - 0.5) / F.count(F.lit(1)).over(w))
    return scoring.pit_histogram(df, "u")


@query("forecast_baselines", f"WITH {SQL_SUPPLIER} SELECT entity, time, round(LAG(x) OVER ({SQL_W}), 6) AS naive_last, round(AVG(x) OVER ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS naive_mean, round(LAG(x, 7) OVER ({SQL_W}), 6) AS naive_season FROM sd")
def baselines(spark, sf_dir):
    df = scoring.baselines(supplier_day(spark, sf_dir), "entity", "time", "x", 7)
    return df.select(*KEYS, *[r6(F.col(c)).alias(c) for c in ("naive_last", "naive_mean", "naive_season")])


_XY = ["y"]
FLAGS = ["A", "N", "R"]


@query("regression_hdfe")
def hdfe(spark, sf_dir):
    return panelreg.hdfe(supplier_day(spark, sf_dir), "x", _XY, ["entity", "time"], "entity").select("term", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"))


@query("regression_cce_mg")
def cce_mg(spark, sf_dir):
    out = panelreg.cce_mg(supplier_day(spark, sf_dir), "entity", "time", "x", _XY)
    return out.select("term", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"), "n_entities")


@query("regression_cce_pooled")
def cce_pooled(spark, sf_dir):
    return panelreg.cce_pooled(supplier_day(spark, sf_dir), "entity", "time", "x", _XY).select("term", F.round("coef", 5).alias("coef"))


def _controls(spark, sf_dir):
    df = supplier_day(spark, sf_dir)
    return df.withColumns({"l1": F.lag("x").over(W()), "l2": F.lag("x", 2).over(W()), "m": F.lag("y").over(W())})


@query("causal_dml")
def dml(spark, sf_dir):
    out = panelreg.double_ml(_controls(spark, sf_dir), "time", "x", "y", ["l1", "l2", "m"])
    return out.select("treatment", F.round("theta", 5).alias("theta"), F.round("se", 5).alias("se"), "n")


@query("causal_pds")
def pds(spark, sf_dir):
    out = panelreg.post_double_selection(_controls(spark, sf_dir), "x", "y", ["l1", "l2", "m"])
    return out.select("treatment", F.round("theta", 5).alias("theta"), F.round("se", 5).alias("se"), "selected")


@query("econ_unit_root_panel")
def unit_root(spark, sf_dir):
    out = panelreg.unit_root_panel(supplier_day(spark, sf_dir), "entity", "time", "x")
    return out.select(F.round("t_bar", 5).alias("t_bar"), F.round("sd", 5).alias("sd"), "n_entities")


@query("econ_decompose")
def decompose(spark, sf_dir):
    df = panelreg.decompose(supplier_day(spark, sf_dir).select(*KEYS, "x"), "entity", "time", "x", 7)
    return df.select(*KEYS, *[F.round(f"x_{p}", 6).alias(f"x_{p}") for p in ("trend", "seasonal", "remainder")])


@query("econ_connectedness")
def connectedness(spark, sf_dir):
    # a fixed system that every line of every supplier is part of: revenue by return flag
    lines = read(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("time"), "l_returnflag", F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).alias("c"))
    df = lines.groupBy("time").agg(*[F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("c"))) / 97331.0, F.lit(0.0)).alias(f) for f in FLAGS])
    return panelreg.connectedness(df, "time", FLAGS).select("name", *[F.round(c, 4).alias(c) for c in ("to", "from", "net")])


@query("econ_ivx_screen")
def ivx(spark, sf_dir):
    out = panelreg.ivx_screen(_controls(spark, sf_dir), "entity", "time", "x", ["l1", "m"])
    return out.select("entity", "candidate", F.round("wald", 5).alias("wald"), F.round("pvalue", 6).alias("pvalue"))


@query("forecast_recursive")
def recursive(spark, sf_dir):
    from tideframe.operators import forecast

    f = forecast.LagForecaster("entity", "time", "x", 5).fit(supplier_day(spark, sf_dir))
    return f.predict(7).withColumn("yhat", F.round("yhat", 5))


@query("forecast_direct")
def direct(spark, sf_dir):
    from tideframe.operators import forecast

    f = forecast.LagForecaster("entity", "time", "x", 5, "direct", 3, by_entity=True).fit(supplier_day(spark, sf_dir))
    return f.predict().withColumn("yhat", F.round("yhat", 5))


@query("forecast_snaive", f"WITH {SQL_SUPPLIER}, r AS (SELECT entity, x, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY time DESC) AS k FROM sd) SELECT entity, CAST(s AS INTEGER) AS step, round(x, 6) AS yhat FROM r JOIN generate_series(1, 4) g(s) ON (s - 1) % 2 = 2 - k WHERE k <= 2")
def seasonal_naive(spark, sf_dir):
    from tideframe.operators import forecast

    return forecast.snaive(supplier_day(spark, sf_dir), "entity", "time", "x", 4, 2).withColumn("yhat", F.round("yhat", 6))


@query("embed_delay", f"WITH {SQL_SUPPLIER} SELECT entity, time, round(x, 6) AS a, round(LAG(x, 2) OVER ({SQL_W}), 6) AS b FROM sd QUALIFY LAG(x, 2) OVER ({SQL_W}) IS NOT NULL")
def delay(spark, sf_dir):
    from tideframe.operators import embed

    df = embed.delay(supplier_day(spark, sf_dir), "entity", "time", "x", 2, 2, "d").where("d is not null")
    return df.select(*KEYS, r6(F.col("d")[0]).alias("a"), r6(F.col("d")[1]).alias("b"))


@query("embed_paa", f"WITH {SQL_SUPPLIER} SELECT entity, time, round(CASE WHEN COUNT(x) OVER ({SQL_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 THEN AVG(x) OVER ({SQL_W} ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) END, 6) AS a, round(CASE WHEN COUNT(x) OVER ({SQL_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 THEN AVG(x) OVER ({SQL_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6) AS b FROM sd")
def paa(spark, sf_dir):
    from tideframe.operators import embed

    df = embed.paa(supplier_day(spark, sf_dir), "entity", "time", "x", 6, 2, "d")
    return df.select(*KEYS, r6(F.get("d", F.lit(0))).alias("a"), r6(F.get("d", F.lit(1))).alias("b"))


@query("embed_spectral")
def spectral(spark, sf_dir):
    from tideframe.operators import embed

    return embed.spectral(supplier_day(spark, sf_dir), "entity", "time", "x", 16, 4, "d").select(*KEYS, F.transform("d", lambda v: F.round(v, 6)).alias("d"))


@query("embed_compress")
def compress(spark, sf_dir):
    from tideframe.operators import embed
    from tideframe.plans.panels import read

    df = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embed.compress(df, "embedding", 16, "srp").select("vec_id", F.transform("embedding", lambda v: F.round(v, 4)).alias("embedding"))


@query("sample_sequential_bootstrap")
def bootstrap(spark, sf_dir):
    from tideframe.operators import sampling

    df = supplier_day(spark, sf_dir, True).withColumn("t1", F.lead("time", 3).over(W()))
    return sampling.sequential_bootstrap(df.select(*KEYS, "t1"), "entity", "time").select(*KEYS, "n_drawn")
