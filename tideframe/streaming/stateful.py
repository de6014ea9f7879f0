"""Streams: event-time aggregates, and sequential operators whose state is all they keep of an entity."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, time: str, entity: str, value: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Count, sum, least and largest value of each entity and event-time window; rows later than ``late`` are dropped."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), entity).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), entity, "n", "sum", "min", "max")


def sessions(stream: DataFrame, time: str, entity: str, gap: str, late: str) -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), entity).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), entity, "n")


def asof_static(stream: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Joins a stream with a table that is read anew for each batch."""
    return stream.join(table, on, "left")


def _stream(rows: DataFrame, entity: str, columns: list[str], out: str, state: str, f) -> DataFrame:
    return rows.select(entity, *columns).groupBy(entity).applyInPandasWithState(f, out, state, "append", GroupStateTimeout.NoTimeout)


def cusum_events(stream: DataFrame, entity: str, time: str, value: str, threshold: float) -> DataFrame:
    """Events (entity, time, event) of the symmetric CUSUM filter. A batch's rows of an entity are taken in time order."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        up, down, last = state.get if state.exists else (0.0, 0.0, None)
        pdf = pd.concat(list(batches)).sort_values(time)
        found = []
        for t, x in zip(pdf[time], pdf[value], strict=True):
            if x is None or x != x:
                continue
            d = 0.0 if last is None else x - last
            last = float(x)
            up, down = max(0.0, up + d), min(0.0, down + d)
            if up > threshold or down < -threshold:
                found.append((key[0], t, 1 if up > threshold else -1))
                up = down = 0.0
        state.update((up, down, last))
        yield pd.DataFrame(found, columns=[entity, time, "event"])

    kinds = dict(stream.dtypes)
    return _stream(stream, entity, [time, value], f"{entity} {kinds[entity]}, {time} {kinds[time]}, event int", "up double, down double, last double", step)


def bars_stream(stream: DataFrame, entity: str, time: str, price: str, size: str, threshold: float) -> DataFrame:
    """Dollar bars as they close: the state of an entity is its running amount and its open bar."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import math

        import pandas as pd

        total, bar, t_open, o, h, low, volume, n = state.get if state.exists else (0.0, 0, None, 0.0, 0.0, 0.0, 0.0, 0)
        pdf = pd.concat(list(batches)).sort_values(time)
        done = []
        for t, p, v in zip(pdf[time], pdf[price], pdf[size], strict=True):
            if n == 0:
                t_open, o, h, low, volume = t, p, p, p, 0.0
            h, low, volume, n = max(h, p), min(low, p), volume + v, n + 1
            before, total = total, total + p * v
            if math.floor(total / threshold) > math.floor(before / threshold):
                done.append((key[0], bar, t_open, t, o, h, low, p, volume, n))
                bar, n = bar + 1, 0
        state.update((float(total), int(bar), t_open, float(o), float(h), float(low), float(volume), int(n)))
        yield pd.DataFrame(done, columns=[entity, "bar_index", "t_open", time, "open", "high", "low", "close", "volume", "n_ticks"])

    kinds = dict(stream.dtypes)
    k, t = kinds[entity], kinds[time]
    out = f"{entity} {k}, bar_index long, t_open {t}, {time} {t}, open double, high double, low double, close double, volume double, n_ticks long"
    return _stream(stream, entity, [time, price, size], out, f"total double, bar long, t_open {t}, o double, h double, low double, volume double, n long", step)


def page_cusum_stream(stream: DataFrame, entity: str, time: str, value: str, drift: float, alarm: float) -> DataFrame:
    """Alarms (entity, time, level) of a one-sided CUSUM; the sum goes on after an alarm."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        (s,) = state.get if state.exists else (0.0,)
        pdf = pd.concat(list(batches)).sort_values(time)
        found = []
        for t, x in zip(pdf[time], pdf[value], strict=True):
            s = max(0.0, s + float(x) - drift)
            if s > alarm:
                found.append((key[0], t, s))
        state.update((s,))
        yield pd.DataFrame(found, columns=[entity, time, "level"])

    kinds = dict(stream.dtypes)
    return _stream(stream, entity, [time, value], f"{entity} {kinds[entity]}, {time} {kinds[time]}, level double", "s double", step)
