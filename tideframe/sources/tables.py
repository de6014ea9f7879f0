"""Reading and writing of tables, shared intermediate storage, and a seeded panel generator."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, format: str = "parquet", columns: Sequence[str] | None = None, schema=None, **options) -> DataFrame:
    """Parquet, ORC, JSON, CSV or any format that Spark knows; only the named columns are read."""
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options) -> None:
    df.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def write_bucketed(df: DataFrame, name: str, entity: str, time: str, buckets: int) -> DataFrame:
    """A table bucketed by entity and sorted by time: entity windows and joins on it need no shuffle."""
    df.write.bucketBy(buckets, entity).sortBy(entity, time).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; in one of our own only where that is unset and one process does all."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="tideframe-"))
    return df.checkpoint()


def generate_panel(spark: SparkSession, entities: int, periods: int, seed: int = 0, signal: bool = False) -> DataFrame:
    """A seeded random-walk panel ``entity, time, value[, signal]``, made row by row from hashes: the same at any parallelism."""
    rows = spark.range(entities * periods).select(F.concat(F.lit("e"), F.lpad((F.col("id") / periods).cast("long").cast("string"), 6, "0")).alias("entity"), (F.col("id") % periods).alias("time"))
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "entity", "time"), F.lit(1 << 30)) + 1) / F.lit((1 << 30) + 1)
    noise = F.sqrt(-2 * F.ln(u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
    rows = rows.withColumn("value", noise)
    return rows.withColumn("signal", F.sqrt(-2 * F.ln(u("c"))) * F.cos(2 * 3.141592653589793 * u("d"))) if signal else rows
