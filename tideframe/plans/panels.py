"""Panels derived from the driver's tables, in Spark and in SQL. Times are day numbers or (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions.core import dealt, entity_window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str):
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")


def supplier_day(spark: SparkSession, sf_dir: str, deal: bool | int = False) -> DataFrame:
    """entity = supplier, time = day; x = revenue in thousands, y = quantity, n = lines. ``deal``: one shuffle, by entity (of that many parts)."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), day("l_shipdate").alias("time"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).alias("c"), F.col("l_quantity").alias("q"))
    if deal:
        rows = dealt(rows, "entity", parts=None if deal is True else deal)
    return rows.groupBy("entity", "time").agg((F.sum("c") / 97331.0).alias("x"), F.sum("q").alias("y"), F.count(F.lit(1)).alias("n"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity = user; ordered by (ts, event_id); x = value."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), "ts", "event_id", F.col("value").alias("x"), "event_type")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, high, low, close and volume of each supplier and day, from the unit prices of its lines."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), day("l_shipdate").alias("time"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_quantity").alias("q"), F.struct("l_orderkey", "l_linenumber").alias("k"))
    return rows.groupBy("entity", "time").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("q").alias("volume"))


SQL_SUPPLIER = """sd AS (SELECT l_suppkey AS entity, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS time,
  SUM(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5)) / 97331.0 AS x, SUM(l_quantity) AS y, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)"""
SQL_EVENTS = "ev AS (SELECT user_id AS entity, ts, event_id, value AS x, event_type FROM events)"
SQL_PRICES = """pr AS (SELECT l_suppkey AS entity, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS time,
  arg_min(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open, MAX(l_extendedprice / l_quantity) AS high, MIN(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS close, SUM(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""

def W():  # noqa: N802
    return entity_window("entity", "time")


SQL_W = "PARTITION BY entity ORDER BY time"
SQL_WE = "PARTITION BY entity ORDER BY ts, event_id"


def r6(c):
    return F.round(c.cast("double"), 6)
