"""Sampling of overlapping labels, weights inside folds, and panels under a null."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.operators import labels


def sequential_draws(start: np.ndarray, end: np.ndarray, draws: int, seed: int = 0) -> np.ndarray:
    """Indices drawn one after another, each with a chance in proportion to its mean uniqueness among those drawn already."""
    rng, n = np.random.default_rng(seed), len(start)
    count = np.zeros(int(end.max()) + 2 if n else 1)
    out = np.empty(draws, int)
    for k in range(draws):
        total = np.concatenate(([0.0], np.cumsum(1 / (count + 1))))
        u = (total[end + 1] - total[start]) / (end - start + 1)
        out[k] = rng.choice(n, p=u / u.sum())
        count[start[out[k]] : end[out[k]] + 1] += 1
    return out


def sequential_bootstrap(df: DataFrame, entity: str, time: str, t1: str = "t1", seed: int = 0) -> DataFrame:
    """Adds ``n_drawn``: how often each label is drawn, by a sequential bootstrap inside its entity of as many draws as labels."""

    def f(has, e):
        s = np.arange(1, len(e) + 1)
        n = np.zeros(len(e), np.int64)
        order = np.flatnonzero(has & (e >= s))
        if len(order):
            first = s[order[0]]
            np.add.at(n, order[sequential_draws(s[order] - first, e[order] - first, len(order), seed + len(order))], 1)
        return {"n_drawn": n}

    # rows without an entity have no label that could be drawn
    drawn = F.when(F.col(entity).isNotNull(), F.col("n_drawn")).otherwise(0).alias("n_drawn")
    return labels._along(df, entity, time, t1, [], "n_drawn long", f).select(*df.columns, drawn)


def fold_weights(df: DataFrame, entity: str, time: str, train: Sequence, t1: str = "t1", price: str | None = None, decay: float | None = None) -> DataFrame:
    """Weights of a fold's training rows from those rows alone: uniqueness or return attribution, times a decay, scaled to mean 1."""
    from tideframe.operators.evaluation import take_times

    rows = take_times(df, time, train)
    held = labels.average_uniqueness(rows, entity, time, t1)
    w = F.col("uniqueness")
    if price:
        held = held.join(labels.return_attribution(rows, entity, time, price, t1).select(entity, time, "w_return"), [entity, time], "left")
        w = F.col("w_return")
    if decay is not None:
        held = labels.time_decay(held, time, "uniqueness", decay)
        w = w * F.col("w_decay")
    held = held.withColumn("__w", F.coalesce(w, F.lit(0.0)))
    mean = held.agg(F.avg("__w").alias("__m"))
    return held.join(F.broadcast(mean)).select(*df.columns, F.coalesce(F.try_divide("__w", "__m"), F.lit(0.0)).alias("weight"))


def null_panel(df: DataFrame, columns: Sequence[str], entity: str, time: str, method: str = "sign", joint: bool = True, seed: int = 0) -> DataFrame:
    """The columns under a null: random signs, per date (``joint``) or per row, or values shifted along the entity."""
    if method == "sign":
        key = [F.lit(seed), F.col(time)] if joint else [F.lit(seed), F.col(entity), F.col(time)]
        s = F.when(F.xxhash64(*key) % 2 == 0, 1.0).otherwise(-1.0)
        return df.withColumns({c: F.col(c) * s for c in columns})
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(time)
    n = F.count(F.lit(1)).over(Window.partitionBy(entity))
    held = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": n})
    by = F.pmod(F.xxhash64(F.lit(seed), *([] if joint else [F.col(entity)])), F.col("__n"))
    moved = held.select(F.col(entity), F.pmod(F.col("__i") + by, F.col("__n")).alias("__i"), *columns)
    return held.drop(*columns).join(moved, [entity, "__i"]).select(*df.columns)
