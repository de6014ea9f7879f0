"""Registered queries over panels read every row of their table."""

import __spark_entry__ as entry
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.functions import kernels, regress
from tideframe.operators import sampling
from tideframe.plans.panels import read, supplier_day

PANEL = ("monitor_bsadf", "ts_rolling_xi", "ts_rolling_dcor", "ts_rolling_tail_dep", "ts_rolling_gcmi", "sample_sequential_bootstrap")


@pytest.fixture(scope="module")
def panel(spark, sf):
    rows = supplier_day(spark, sf).orderBy("entity", "time").collect()
    out = {}
    for r in rows:
        out.setdefault(r.entity, []).append((r.time, r.x, float(r.y)))
    return out


@pytest.mark.parametrize("name", PANEL)
def test_every_date_is_there(spark, sf, panel, name):
    got = {(r.entity, r.time) for r in entry.queries()[name](spark, sf).select("entity", "time").collect()}
    assert got == {(e, t) for e, rows in panel.items() for t, *_ in rows}


def test_bubbles_and_dependence_at_the_last_date(spark, sf, panel):
    e, rows = min(panel.items())
    t, x, y = (np.array(v) for v in zip(*rows, strict=True))
    q = entry.queries()
    for name, f in (("xi", "xi"), ("dcor", "dcor"), ("tail_dep", "tail_dep"), ("gcmi", "gcmi")):
        got = q[f"ts_rolling_{name}"](spark, sf).where((F.col("entity") == e) & (F.col("time") == int(t[-1]))).first().v
        assert got == pytest.approx(kernels.DEPENDENCE[f](x[-20:], y[-20:]), abs=1e-6)
    got = q["monitor_bsadf"](spark, sf).where((F.col("entity") == e) & (F.col("time") == int(t[-1]))).first().bsadf
    assert got == pytest.approx(max(kernels.augmented_dickey_fuller(x[s:], 0) for s in range(len(x) - 29)), abs=1e-5)
    got = q["depend_measures"](spark, sf).where(F.col("entity") == e).first()
    for n in ("pearson", "kendall", "xi", "dcor"):
        assert got[n] == pytest.approx(kernels.DEPENDENCE[n](x, y), abs=1e-6)


def test_bootstrap_draws_as_many_as_labels(spark, sf, panel):
    got = {r.entity: r.n for r in entry.queries()["sample_sequential_bootstrap"](spark, sf).groupBy("entity").agg(F.sum("n_drawn").alias("n")).collect()}
    assert got == {e: len(rows) - 3 for e, rows in panel.items()}  # the last three have no end
    assert len(sampling.sequential_draws(np.array([0, 1, 2]), np.array([1, 2, 3]), 3)) == 3


def test_connectedness_is_of_all_lines(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_returnflag", "l_extendedprice", "l_discount").collect()
    names = sorted({r.l_returnflag for r in rows})
    days = {d: i for i, d in enumerate(sorted({r.d for r in rows}))}
    y = np.zeros((len(days), len(names)))
    for r in rows:
        y[days[r.d], names.index(r.l_returnflag)] += np.floor(r.l_extendedprice * (1 - r.l_discount) * 100 + 0.5) / 97331.0
    want = regress.connectedness(y)
    got = {r.name: r for r in entry.queries()["econ_connectedness"](spark, sf).collect()}
    assert sorted(got) == names
    for i, n in enumerate(names):
        assert [got[n].to, got[n]["from"], got[n].net] == pytest.approx([want[k][i] for k in ("to", "from", "net")], abs=1e-3)
