"""Causal operators of one entity: all look back only. ``w`` is the entity's ordered window."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tideframe.functions.core import clean, col, corr, div, ffd_weights, full, trailing


def frac_diff(x: Column | str, w: WindowSpec, d: float, threshold: float = 5e-4) -> Column:
    """Fixed-width fractional differencing; null until the width is full, and where any lag is null."""
    x = clean(col(x))
    out = None
    for k, weight in enumerate(ffd_weights(d, threshold)):
        term = (F.lag(x, k).over(w) if k else x) * weight
        out = term if out is None else out + term
    return out


def zscore(x: Column | str, w: WindowSpec, window: int) -> Column:
    """(x - mean) / sample deviation over the last ``window`` rows, which must all have a value."""
    x = clean(col(x))
    f = trailing(w, window)
    return full(div(x - F.avg(x).over(f), F.stddev_samp(x).over(f)), x, w, window)


def rolling_vol(x: Column | str, w: WindowSpec, window: int) -> Column:
    x = clean(col(x))
    return full(F.stddev_samp(x).over(trailing(w, window)), x, w, window)


rs_vol = rolling_vol


def rolling_corr(x: Column | str, y: Column | str, w: WindowSpec, window: int) -> Column:
    x, y = clean(col(x)), clean(col(y))
    return full(corr(x, y, trailing(w, window)), x + y, w, window)


def tick_rule(x: Column | str, w: WindowSpec) -> Column:
    """+1 after a rise, -1 after a fall, the last sign where nothing changed; null before the first change."""
    s = F.signum(col(x) - F.lag(col(x)).over(w))
    # the sign is windowed once more by callers that hold it in a column
    return F.nullif(s, F.lit(0.0)).cast("int")


def ewm_mean(values: Column, alpha: float) -> Column:
    """Recursive mean over an array in time order; a null keeps the last mean."""
    first = F.lit(None).cast("double")
    return F.aggregate(values, first, lambda m, x: F.when(x.isNull(), m).when(m.isNull(), x).otherwise(alpha * x + (1 - alpha) * m))
