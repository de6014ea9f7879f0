"""Splits of each entity's own rows into training and test rows, as columns: one pass by entity, however many splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _from_end(entity: str, time: str) -> tuple[Column, Column]:
    w = Window.partitionBy(entity)
    return F.row_number().over(w.orderBy(time)) - 1, F.count(F.lit(1)).over(w)


def train_test_split(df: DataFrame, entity: str, time: str, test_size: int | float = 0.25, out: str = "is_test") -> DataFrame:
    """``out`` is true for the last rows of each entity: a number of rows, or a share (the training rows are rounded down)."""
    if test_size < 0 or (isinstance(test_size, float) and test_size > 1):
        raise ValueError("test_size is a number of rows or a share from 0 to 1")
    at, n = _from_end(entity, time)
    train = n - test_size if isinstance(test_size, int) else F.floor(n * F.lit(1 - test_size))
    return df.withColumn(out, at >= train)


def _window_split(df: DataFrame, entity: str, time: str, test_size: int, n_splits: int, step_size: int, window: int | None) -> DataFrame:
    if min(test_size, n_splits, step_size) < 1:
        raise ValueError("test_size, n_splits and step_size are at least 1")
    at, n = _from_end(entity, time)
    rows = df.withColumns({"__at": at, "__n": n})
    begin = F.col("__n") - test_size - (n_splits - F.col("split")) * step_size
    rows = rows.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    kept = (F.col("__at") < begin + test_size) & (begin >= 0)
    if window:
        kept &= F.col("__at") >= begin - window
    return rows.where(kept).withColumn("is_test", F.col("__at") >= begin).drop("__at", "__n")


def expanding_window_split(df: DataFrame, entity: str, time: str, test_size: int, n_splits: int = 5, step_size: int = 1) -> DataFrame:
    """The rows of each split (1 is the oldest, the last one ends with the entity) with ``split`` and ``is_test``.

    A split whose test rows would begin before the entity does is left out for that entity.
    """
    return _window_split(df, entity, time, test_size, n_splits, step_size, None)


def sliding_window_split(df: DataFrame, entity: str, time: str, test_size: int, n_splits: int = 5, step_size: int = 1, window_size: int = 10) -> DataFrame:
    """As the expanding one, with at most ``window_size`` training rows before the test rows."""
    return _window_split(df, entity, time, test_size, n_splits, step_size, window_size)
