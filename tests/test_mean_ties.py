"""Values that equal their mean are neither above nor below it, whatever the order of a floating-point sum."""

import pytest

from tideframe.operators import features


@pytest.mark.parametrize(
    ("values", "above", "below"),
    [
        ([0.1, 0.1, 0.1], 0, 0),  # 0.1 + 0.1 + 0.1 is more than 0.3
        ([0.3, 0.2, 0.1], 1, 1),
        ([0.1, None, 0.3, 0.2, float("nan")], 1, 1),
        ([1e300, 1e300, -1e300], 2, 1),  # no decimals: compared as doubles
        ([1e-12, 2e-12, 6e-12], 1, 2),
        ([None, None], 0, 0),
    ],
)
def test_values_at_the_mean(spark, values, above, below):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t long, x double")
    for order in ("t", "u"):
        held = df.withColumn("u", -df.t)
        got = features.extract_features(held, "k", order, "x", ["count_above_mean", "count_below_mean"]).first()
        assert (got.count_above_mean, got.count_below_mean) == (above, below)


def test_streaks_stop_at_the_mean(spark):
    df = spark.createDataFrame([("a", i, 0.1) for i in range(3)], "k string, t long, x double")
    got = features.streak_features(df, "k", ["t"], "x").first()
    assert (got.longest_streak_above_mean, got.longest_streak_below_mean) == (0, 0)
