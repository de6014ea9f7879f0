"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (an offset and a step derived from
its name); shards take turns claiming their next free slot until the table is full. A key is hashed to a slot and
the table, a few thousand rows however large the data are, is broadcast: placement is one hash and one lookup, without
a shuffle. Removing a shard moves almost only that shard's slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime over 100 times the number of shards keeps every shard's share within about 1 % of the others'.
TABLE_SIZE = 4099
SHARDS = 32


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Shard index of each slot. ``size`` must be a prime not below the number of shards; names must be distinct."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime, and at least the number of shards")

    def number(text: str) -> int:
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)

    offset = [number(f"offset:{s}") % size for s in shards]
    step = [number(f"step:{s}") % (size - 1) + 1 for s in shards] if size > 2 else [1] * len(shards)
    turn, table, left = [0] * len(shards), [-1] * size, size
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while True:
                slot = (offset[i] + turn[i] * step[i]) % size
                turn[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            left -= 1
    return table


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """(slot, shard) rows, made by SQL functions from one literal."""
    text = ",".join(map(str, table))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of the md5 of its text, modulo the table size. A null key hashes as the word ``null``."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(size)


def assign_shards(df: DataFrame, key: str = "doc_id", shards: Sequence[str] | int = SHARDS, size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Adds the slot and the shard of every row; all rows and all other columns stay.

    Columns named like the two new ones are replaced. Rows with equal keys (repeated rows, ties) share a shard; a null
    key has a fixed shard; an empty table gives an empty table. Nothing is shuffled: the only other input is
    the table of ``size`` rows, broadcast with that proven bound.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    table = table_frame(df.sparkSession, lookup_table(names, size)).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    kept = [c for c in df.columns if c not in {slot_col, shard_col} or c == key]
    placed = df.select(*[F.col(f"`{c}`") for c in kept], slot_of(F.col(f"`{key}`"), size).alias("__slot"))
    placed = placed.join(F.broadcast(table), "__slot")
    return placed.select(*[F.col(f"`{c}`") for c in kept], F.col("__slot").alias(slot_col), F.col("__shard").alias(shard_col))


def shard_counts(placed: DataFrame, shard_col: str = "shard") -> DataFrame:
    """Rows per shard, pre-aggregated before the shuffle."""
    return placed.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n_rows"))
