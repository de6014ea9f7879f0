"""Rows are dealt out once, by entity, into partitions whose number grows with the input, so that a task's share does not."""

import re
import time

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from tideframe.functions import core
from tideframe.operators import labels, preprocess, sampling
from tideframe.panel import PanelFrame


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sample_sequential_bootstrap", "sizing_average_active", "impute_interpolate", "impute_bfill", "asof_join", "asof_join_lagged", "quality_validate"])
def test_partitions_grow_with_the_input(spark, sf, name, monkeypatch):
    monkeypatch.setattr(core, "SHARE", 1000)
    plan = _plan(entry.queries()[name](spark, sf))
    by_key = re.findall(r"hashpartitioning\(.*, (\d+)\), (\w+)", plan)
    assert by_key and all(int(n) > 10 and kind == "REPARTITION_BY_NUM" for n, kind in by_key)  # others may be merged up to any size in memory


def test_shares_of_what_has_no_files(spark):
    df = spark.createDataFrame([(1,)], "k long")
    assert core.shares(df) == spark.sparkContext.defaultParallelism
    assert core.dealt(df, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_bootstrap_has_one_shuffle_and_no_join(spark):
    rows = [("a", 1, 2), ("a", 2, 2), ("a", 3, None), ("a", 4, 1), ("a", None, 3), (None, 1, 2), ("b", 5, 9)]
    out = sampling.sequential_bootstrap(spark.createDataFrame(rows, "k string, t long, t1 long"), "k", "t")
    plan = _plan(out)
    assert "Join" not in plan and plan.count("Exchange") == 1
    got = {(r.k, r.t): r.n_drawn for r in out.collect()}
    assert len(got) == len(rows)
    assert got["a", 3] == got["a", 4] == got[None, 1] == 0  # no end, an end before its start, no entity
    assert got["a", 1] + got["a", 2] + got["a", None] == 3 and got["b", 5] == 1


def test_average_active_has_one_shuffle_and_no_join(spark):
    rows = [("a", 1, 2.0, 3), ("a", 1, 4.0, None), ("a", 2, 1.0, 2), ("a", 3, 5.0, 4), ("a", 5, 3.0, 5), ("b", 1, 7.0, 2), ("b", 9, 1.0, 9), ("b", None, 1.0, None), (None, 3, 2.0, None)]
    out = labels.average_active(spark.createDataFrame(rows, "k string, t long, size double, exit long"), "k", "t")
    plan = _plan(out)
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert out.columns == ["k", "t", "size", "exit", "avg_size"]

    def want(k, t):
        # a bet without a time counts from the start
        held = [s for e, u, s, x in rows if k is not None and t is not None and e == k and (u is None or u <= t) and (x is None or t < x)]
        return sum(held) / len(held) if held else 0.0

    assert sorted(map(tuple, out.collect()), key=str) == sorted(((*r, want(r[0], r[1])) for r in rows), key=str)


def test_filling_from_ahead_is_not_quadratic_in_a_series(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.when((F.col("id") == 0) | (F.col("id") == n - 1), F.col("id").cast("double")).alias("x"))
    p = PanelFrame(df, "k", "t")
    began = time.monotonic()
    a = preprocess.impute(p, "interpolate", ["x"], allow_leaky=True).df.agg(F.max(F.abs(F.col("x") - F.col("t"))), F.count("x")).first()
    b = preprocess.impute(p, "bfill", ["x"], allow_leaky=True).df.where(F.col("t") > 0).agg(F.min("x"), F.max("x"), F.count("x")).first()
    assert time.monotonic() - began < 20  # a frame gone through anew at each row takes minutes
    assert a[0] < 1e-6 and a[1] == n and tuple(b) == (n - 1, n - 1, n - 1)
