"""Bitemporal as-of join: each row gets the latest event that was known by its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {T.IntegerType: "integer", T.LongType: "integer", T.ShortType: "integer", T.ByteType: "integer", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp"}


def asof_join(
    panel: DataFrame,
    vintages: DataFrame,
    *,
    entity: str,
    time: str,
    event_time: str,
    knowledge_time: str,
    vintage_entity: str | None = None,
    values: Sequence[str] | None = None,
    lag: int = 0,
    suffix: str = "",
    provenance: bool = False,
    check: bool = True,
) -> DataFrame:
    """Left join: for a row at t the vintage with knowledge_time + lag <= t and event_time <= t of the greatest
    (event_time, knowledge_time). ``lag`` counts days for dates and timestamps, units for integers.

    A null t, entity or clock matches nothing; exact duplicates collapse; equal keys with other values are an error. It is one
    sort-merge by entity: rows and vintages are ordered together by the time at which they count, the best vintage so far is
    carried by a running maximum of its rank, and the values come with it. No range join is made.
    """
    v_entity = vintage_entity or entity
    values = list(values or [c for c in vintages.columns if c not in (v_entity, event_time, knowledge_time)])
    kinds = {c: _KINDS.get(type(f.schema[c].dataType)) for f, c in ((panel, time), (vintages, event_time), (vintages, knowledge_time))}
    if None in kinds.values() or len(set(kinds.values())) > 1:
        raise ValueError(f"the clocks must be of one family (integer, date or timestamp): {kinds}")
    names = {v_entity: "__e", event_time: "__ev", knowledge_time: "__kn"}
    v = vintages.select(*[F.col(c).alias(n) for c, n in names.items()], F.struct(*[F.col(c) for c in values]).alias("__v")).dropna(subset=list(names.values())).distinct()
    if check and not v.groupBy("__e", "__ev", "__kn").count().where("count > 1").isEmpty():
        raise ValueError("vintages hold different values under one (entity, event_time, knowledge_time)")
    kind = kinds[time]
    known = F.col("__kn") if not lag else F.col("__kn") + lag if kind == "integer" else F.date_add("__kn", lag) if kind == "date" else F.col("__kn") + F.expr(f"INTERVAL {int(lag)} DAYS")
    order = F.row_number().over(Window.partitionBy("__e").orderBy("__ev", "__kn"))
    v = v.select("__e", F.greatest(known, F.col("__ev")).alias("__t"), F.lit(0).alias("__kind"), F.struct(order.alias("r"), F.col("__ev").alias("ev"), F.col("__kn").alias("kn"), F.col("__v").alias("v")).alias("__best"))
    row = F.struct(*[F.col(c) for c in panel.columns]).alias("__row")
    p = panel.select(F.col(entity).alias("__e"), F.col(time).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(v.schema["__best"].dataType).alias("__best"), row)
    both = v.withColumn("__row", F.lit(None).cast(p.schema["__row"].dataType)).unionByName(p)
    # the struct's first field is the rank, so the greatest struct is the best vintage
    so_far = Window.partitionBy("__e").orderBy(F.col("__t").asc_nulls_first(), "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.when(F.col("__t").isNotNull() & F.col("__e").isNotNull(), F.max("__best").over(so_far))
    joined = both.withColumn("__got", best).where("__kind = 1")
    out = [F.col(f"__row.{c}").alias(c) for c in panel.columns] + [F.col(f"__got.v.{c}").alias(f"{c}{suffix}") for c in values]
    if provenance:
        out += [F.col("__got.ev").alias(f"{event_time}{suffix}"), F.col("__got.kn").alias(f"{knowledge_time}{suffix}")]
    return joined.select(*out)
