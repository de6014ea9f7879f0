"""Checks of panels one by one, the validator, and the registry as a whole."""

import pytest
from pyspark.sql import functions as F

from tideframe import registry
from tideframe.operators import quality


@pytest.fixture(scope="module")
def frame(spark):
    rows = [("a", 1, 1.0, 0), ("a", 2, 2.0, 1), ("a", 4, -3.0, 2), ("b", 2, 1.0, 4), ("b", 1, 1.0, 5), ("b", 1, 9.0, 6), (None, 3, 1.0, 7), ("c", 3, None, 8)]
    return spark.createDataFrame(rows, "e string, t long, x double, seq long")


def test_checks(frame):
    keys = (frame, "e", "t")
    assert quality.check_key_columns(*keys).passed and not quality.check_key_columns(frame, "e", "x").passed and not quality.check_key_columns(frame, "zz", "t").passed
    assert quality.check_null_keys(*keys).n_failing == 1
    assert [tuple(r) for r in quality.check_unique_keys(*keys).offending.collect()] == [("b", 1, 2)]
    assert [r.seq for r in quality.check_monotone_time(*keys, ["seq"]).offending.where("e = 'b'").collect()] == [5]
    assert sorted(r.e for r in quality.check_min_obs(*keys, 2).offending.where("e is not null").collect()) == ["c"]
    assert [tuple(r) for r in quality.check_gaps(*keys, 1).offending.collect()] == [("a", 2, 4, 1)]
    assert [tuple(r) for r in quality.check_gaps(*keys).offending.collect()] == [("a", 2, 4, 1)]
    assert quality.check_coverage(*keys, 0.6).n_failing >= 2
    assert quality.check_fitted_state(2, frame, "t").n_failing == 5


def test_validator(frame):
    v = quality.PanelValidator("e", "t", rules={"positive": F.col("x") > 0}, min_obs=2, gaps=True, order=["seq"])
    report = v.filter(frame)
    assert not report.passed and {c.name for c in report.failed("error")} == {"null_keys", "unique_keys", "monotone_time", "rule positive"}
    assert report.valid.count() == 4 and report.invalid.count() == 4 and report.to_frame().count() == len(report.checks)
    with pytest.raises(quality.PanelValidationError), pytest.warns(quality.QualityWarning):
        v.validate(frame)
    clean = report.valid.where("e <> 'c'")
    assert quality.validate_panel(clean, "e", "t").passed


def test_registry():
    R = registry.FeatureRegistry
    n = len(R.all())
    assert {"alpha", "panel", "xs"} <= set(R.namespaces()) and sum(len(R.by_namespace(s)) for s in R.namespaces()) == n == len(R.to_records())
    registry.register_feature("mine.twice", panel_safe=True, leakage_safe=True)(lambda c, p: c * 2)
    assert "`mine.twice`" in R.to_llms_txt() and len(R.by_namespace("mine")) == 1
    R.clear()
    assert len(R.all()) == n
