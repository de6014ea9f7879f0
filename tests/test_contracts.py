"""Every registered operator is held to what it promises; audits and streams."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideframe import registry, testing
from tideframe.operators import audit, bars
from tideframe.panel import PanelFrame
from tideframe.sources.tables import generate_panel
from tideframe.streaming import stateful


@pytest.fixture(scope="module")
def panel(spark):
    df = generate_panel(spark, 4, 30, seed=1, signal=True).withColumn("time", F.col("time").cast("long"))
    return PanelFrame(df.cache(), "entity", "time")


def test_registered_operators_keep_their_promises(panel):
    specs = [registry.get(n) for n in registry.names() if registry.get(n).params.get("arity", 1) == 1]

    def make(p, kind):
        return p.with_columns(**{s.name.replace(".", "__"): s.build(F.col("value"), p) for s in specs if s.input_shape in kind})

    series = [s.name.replace(".", "__") for s in specs if s.input_shape in ("elem", "ts")]
    dates = [s.name.replace(".", "__") for s in specs if s.input_shape == "xs"]
    assert len(series) > 25 and len(dates) > 8
    testing.assert_prefix_invariant(lambda p: make(p, ("elem", "ts")), panel, series, [9, 21])
    testing.assert_no_lookahead(lambda p: make(p, ("elem", "ts")), panel, series, 17)
    testing.assert_panel_safe(lambda p: make(p, ("elem", "ts")), panel, series, "e000002")
    testing.assert_no_lookahead(lambda p: make(p, ("xs",)), panel, dates, 17)


def test_verifiers_catch_leaks(panel):
    ahead = lambda p: p.with_columns(v=F.lead("value").over(p.window))
    mixed = lambda p: p.with_columns(v=F.avg("value").over(Window.orderBy("time").rowsBetween(-3, 0)))
    for check, f, args in ((testing.assert_no_lookahead, ahead, (10,)), (testing.assert_prefix_invariant, ahead, ([10],)), (testing.assert_panel_safe, mixed, ("e000001",))):
        with pytest.raises(AssertionError):
            check(f, panel, ["v"], *args)


def test_audit(panel):
    w = panel.window
    assert not audit.audit(panel.df, F.lag("value", 2).over(w))
    assert not audit.audit(panel.df, F.avg("value").over(w.rowsBetween(-4, 0)))
    assert "lead" in [f.rule for f in audit.audit(panel.df, F.lead("value").over(w))]
    assert audit.audit(panel.df, F.avg("value").over(w.rowsBetween(-4, 1)))
    assert audit.audit(panel.df, F.avg("value").over(Window.partitionBy("entity")), "time")
    assert not audit.audit(panel.df, F.avg("value").over(Window.partitionBy("time")), "time")
    with pytest.raises(ValueError):
        audit.assert_causal(panel.df, F.first("value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def test_register_feature():
    @registry.register_feature("mine", panel_safe=True, leakage_safe=True)
    def mine(c, p):
        return c

    assert registry.get("mine").safe_scope == "window"
    with pytest.raises(ValueError):
        registry.register_feature("mine", panel_safe=True, leakage_safe=True)(mine)
    registry.unregister("mine")


def test_stream_equals_batch(spark, panel, tmp_path):
    rows = panel.df.select("entity", "time", "value", F.lit(1.0).alias("size"))
    rows.where("time < 15").coalesce(1).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "a"))
    q = stateful.cusum_events(stream, "entity", "time", "value", 1.5).writeStream.format("memory").queryName("cusum_test").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        rows.where("time >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        q.processAllAvailable()
        got = {(r.entity, r.time, r.event) for r in spark.table("cusum_test").collect()}
    finally:
        q.stop()
    want = {(r.entity, r.time, r.event) for r in bars.cusum_filter(rows.drop("size"), "entity", "time", "value", 1.5).where("event <> 0").collect()}
    assert got == want and want
