"""Panels: a DataFrame with the names of its entity and time columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.core import entity_window

TIMES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


class PanelFrame:
    """Rows keyed by (entity, time). Only the schema is looked at; nothing runs until an action does.

    Row order carries no meaning: every time-ordered operator orders by ``time`` and then by ``tiebreak``.
    """

    def __init__(self, df: DataFrame, entity: str, time: str, tiebreak: Sequence[str] = ()) -> None:
        for c in (entity, time, *tiebreak):
            if c not in df.columns:
                raise ValueError(f"no column {c!r}")
        if entity == time:
            raise ValueError("entity and time are the same column")
        if not isinstance(df.schema[time].dataType, TIMES):
            raise ValueError(f"time column {time!r} has type {df.schema[time].dataType.simpleString()}")
        self.df, self.entity, self.time, self.tiebreak = df, entity, time, tuple(tiebreak)

    def _with(self, df: DataFrame) -> PanelFrame:
        return PanelFrame(df, self.entity, self.time, self.tiebreak)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def value_columns(self) -> list[str]:
        return [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (self.entity, self.time, *self.tiebreak)]

    @property
    def entity_col(self) -> str:
        return self.entity

    @property
    def time_col(self) -> str:
        return self.time

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def feature_cols(self) -> list[str]:
        return [c for c in self.df.columns if c not in (self.entity, self.time, *self.tiebreak)]

    def to_native(self) -> DataFrame:
        return self.df

    to_frame = to_native

    def over_entity(self) -> WindowSpec:
        return self.window

    @property
    def window(self) -> WindowSpec:
        return entity_window(self.entity, [self.time, *self.tiebreak])

    @property
    def dates(self) -> WindowSpec:
        return Window.partitionBy(self.time)

    def with_columns(self, **exprs: Column) -> PanelFrame:
        if {self.entity, self.time} & set(exprs):
            raise ValueError("the key columns cannot be replaced")
        return self._with(self.df.withColumns(exprs))

    def select(self, *cols: str | Column) -> PanelFrame:
        named = [c for c in (self.entity, self.time, *self.tiebreak) if c not in cols]
        return self._with(self.df.select(*named, *cols))

    def filter(self, condition: Column | str) -> PanelFrame:
        return self._with(self.df.where(condition))

    def sort_panel(self, descending: bool = False) -> DataFrame:
        keys = [F.col(c) for c in (self.entity, self.time, *self.tiebreak)]
        return self.df.orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys])

    def within_entity(self, expr: Column, frame: tuple[int, int] | None = None) -> Column:
        return expr.over(self.window.rowsBetween(*frame) if frame else self.window)

    def group_by_entity(self):
        return self.df.groupBy(self.entity)

    def entities(self) -> DataFrame:
        return self.df.select(self.entity).distinct().orderBy(self.entity)

    def n_entities(self) -> int:
        return self.df.select(self.entity).distinct().count()

    def time_index(self) -> DataFrame:
        return self.df.select(self.time).distinct().orderBy(self.time)

    def pipe(self, f: Callable, *args, **kwargs):
        return f(self, *args, **kwargs)

    def duplicate_keys(self) -> DataFrame:
        return self.df.groupBy(self.entity, self.time).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def assert_unique_keys(self) -> PanelFrame:
        bad = self.duplicate_keys().limit(5).collect()
        if bad:
            raise ValueError(f"(entity, time) is not unique, for example {[tuple(r)[:2] for r in bad]}")
        return self

    def assert_sorted(self, seq: str) -> PanelFrame:
        """Checks that ``seq``, a column of the input order, ascends with time inside each entity."""
        w = Window.partitionBy(self.entity).orderBy(seq)
        late = self.df.select(self.time, F.lag(self.time).over(w).alias("__before")).where(F.col(self.time) < F.col("__before"))
        if not late.isEmpty():
            raise ValueError(f"{seq!r} does not follow time")
        return self

    def asof_join(self, vintages: DataFrame, **options) -> PanelFrame:
        from tideframe.operators.asof import asof_join

        return self._with(asof_join(self.df, vintages, entity=self.entity, time=self.time, **options))

    def collect(self):
        return self.df.toPandas()


def as_panel(data, entity: str | None = None, time: str | None = None, tiebreak: Sequence[str] = (), spark: SparkSession | None = None) -> PanelFrame:
    """A panel from a PanelFrame, DataFrame, Parquet path, pandas frame or mapping; keys default to the first two columns."""
    if isinstance(data, PanelFrame):
        return data
    if isinstance(data, str):
        data = (spark or SparkSession.getActiveSession()).read.parquet(data)
    elif not isinstance(data, DataFrame):
        import pandas as pd

        data = (spark or SparkSession.getActiveSession()).createDataFrame(pd.DataFrame(data) if isinstance(data, Mapping) else data)
    return PanelFrame(data, entity or data.columns[0], time or data.columns[1], tiebreak)
