"""Bars from ticks, event filters, and monitors that scan a series in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.core import clean, div


def bars(ticks: DataFrame, entity: str, time: str | Sequence[str], price: str, size: str | None = None, kind: str = "dollar", threshold: float = 1.0) -> DataFrame:
    """Tick, volume or dollar bars: bar k closes at the tick where the running amount passes k times the threshold.

    A tick belongs to the bar that was open before it; only closed bars are returned, stamped by their last tick. Two running
    sums over the entity's order and one aggregation.
    """
    order = [time] if isinstance(time, str) else list(time)
    w = Window.partitionBy(entity).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    p, v = clean(F.col(price)), clean(F.col(size)) if size else F.lit(1.0)
    amount = {"tick": F.lit(1.0), "volume": v, "dollar": p * v}[kind]
    sign = F.signum(p - F.lag(p).over(w))
    held = ticks.select(entity, *order, p.alias("__p"), v.alias("__v"), F.sum(amount).over(run).alias("__c"), F.row_number().over(w).alias("__rn"), F.when(sign != 0, sign).alias("__s"))
    held = held.withColumns({"__before": F.coalesce(F.lag("__c").over(w), F.lit(0.0)), "__side": F.last("__s", ignorenulls=True).over(run)})
    closes = F.floor(F.col("__c") / threshold) > F.floor(F.col("__before") / threshold)
    held = held.withColumn("__closes", closes)
    bar = F.coalesce(F.sum(F.col("__closes").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("bar_index", bar)
    t = order[0]
    first, last = (lambda c: F.min_by(c, "__rn")), (lambda c: F.max_by(c, "__rn"))
    out = held.groupBy(entity, "bar_index").agg(
        first(t).alias("t_open"),
        last(t).alias(t),
        first("__p").alias("open"),
        F.max("__p").alias("high"),
        F.min("__p").alias("low"),
        last("__p").alias("close"),
        F.sum("__v").alias("volume"),
        F.sum(F.col("__p") * F.col("__v")).alias("dollar_volume"),
        F.count(F.lit(1)).alias("n_ticks"),
        F.coalesce(F.sum(F.when(F.col("__side") > 0, F.col("__v"))), F.lit(0.0)).alias("buy_volume"),
        F.max("__closes").alias("__closed"),
    )
    return out.where("__closed").drop("__closed").withColumn("vwap", div(F.col("dollar_volume"), F.col("volume")))


def tick_rule(df: DataFrame, entity: str, time: str | Sequence[str], price: str, out: str = "side") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(*([time] if isinstance(time, str) else time))
    s = F.signum(clean(F.col(price)) - F.lag(clean(F.col(price))).over(w))
    df = df.withColumn("__s", F.when(s != 0, s.cast("int")))
    return df.withColumn(out, F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def page_cusum(z: Column, w, drift: float = 0.0, side: str = "upper") -> Column:
    """Reset-at-zero cumulative sum without a recursion: the running sum less its running minimum (at most 0)."""
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.sum((z if side == "upper" else -z) - drift).over(run)


def page_cusum_frame(df: DataFrame, entity: str, time: str, column: str, drift: float = 0.0, side: str = "upper", out: str = "page_cusum") -> DataFrame:
    w = Window.partitionBy(entity).orderBy(time)
    df = df.withColumn("__s", page_cusum(F.coalesce(clean(F.col(column)), F.lit(0.0)), w, drift, side))
    low = F.min("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.col("__s") - F.least(low, F.lit(0.0))).drop("__s")


def _scan(df: DataFrame, entity: str, order: Sequence[str], make, fields: str) -> DataFrame:
    """Runs a sequential kernel over each entity's rows in order, streaming: its state is all that is held.

    Rows are dealt out by entity and sorted; a partition's entities pass one after another, batch by batch.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(fields)
    schema = StructType([*df.schema.fields, *new.fields])
    rows = df.repartition(entity).sortWithinPartitions(entity, *order)

    def run(batches):
        import pandas as pd

        now, state = object(), None
        for pdf in batches:
            out = []
            keys = pdf[entity].tolist()
            for i, row in enumerate(pdf.itertuples(index=False)):
                if keys[i] != now:
                    now, state = keys[i], make()
                out.append(state(row))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=[f.name for f in new.fields])], axis=1)

    return rows.mapInPandas(run, schema)


def cusum_filter(df: DataFrame, entity: str, time: str | Sequence[str], column: str, threshold: float, out: str = "event") -> DataFrame:
    """Symmetric CUSUM filter: +1 or -1 where the sum of changes since the last event passes the threshold, else 0. Nulls are skipped."""
    order = [time] if isinstance(time, str) else list(time)
    place = df.columns.index(column)

    def make():
        s = {"up": 0.0, "down": 0.0, "last": None}

        def step(row):
            x = row[place]
            if x is None or x != x:
                return (0,)
            d = 0.0 if s["last"] is None else x - s["last"]
            s["last"] = x
            s["up"], s["down"] = max(0.0, s["up"] + d), min(0.0, s["down"] + d)
            if s["up"] > threshold:
                s["up"] = s["down"] = 0.0
                return (1,)
            if s["down"] < -threshold:
                s["up"] = s["down"] = 0.0
                return (-1,)
            return (0,)

        return step

    return _scan(df, entity, order, make, f"{out} int")


def shiryaev_roberts(df: DataFrame, entity: str, time: str, column: str, delta: float, out: str = "log_sr") -> DataFrame:
    """log R = softplus(log R before) + delta z - delta^2 / 2."""
    import math

    place = df.columns.index(column)

    def make():
        s = {"r": None}

        def step(row):
            z = row[place]
            if z is None or z != z:
                return (s["r"],)
            llr = delta * z - delta * delta / 2
            r = s["r"]
            s["r"] = llr + (0.0 if r is None else max(r, 0.0) + math.log1p(math.exp(-abs(r))))
            return (s["r"],)

        return step

    return _scan(df, entity, [time], make, f"{out} double")


def imbalance_bars(ticks: DataFrame, entity: str, time: str | Sequence[str], price: str, size: str | None = None, kind: str = "tick", run: bool = False, expected_ticks: float = 20.0, span: int = 10, bounds: tuple[float, float] = (0.2, 5.0)) -> DataFrame:
    """Imbalance (or run) bars: ``bar_index`` of each tick and whether it closes its bar.

    A bar closes when its signed flow passes the expected length times the expected flow per tick, both exponential
    means over closed bars; the expected length stays within ``bounds`` of its start.
    """
    order = [time] if isinstance(time, str) else list(time)
    at_p, at_v = ticks.columns.index(price), ticks.columns.index(size) if size else None
    alpha = 2 / (span + 1)

    def make():
        s = {"last": None, "side": 0, "bar": 0, "flow": 0.0, "up": 0.0, "down": 0.0, "n": 0, "ups": 0, "length": expected_ticks, "mean": None, "vu": None, "vd": None, "pu": 0.5}

        def step(row):
            p = row[at_p]
            v = row[at_v] if at_v is not None else 1.0
            if p is None or p != p:
                return s["bar"], False
            if s["last"] is not None and p != s["last"]:
                s["side"] = 1 if p > s["last"] else -1
            s["last"] = p
            amount = {"tick": 1.0, "volume": v, "dollar": p * v}[kind]
            s["n"] += 1
            s["flow"] += s["side"] * amount
            s["up"] += amount if s["side"] > 0 else 0.0
            s["down"] += amount if s["side"] < 0 else 0.0
            s["ups"] += s["side"] > 0
            if s["mean"] is None:
                closes = s["n"] >= expected_ticks
            elif run:
                closes = max(s["up"], s["down"]) >= s["length"] * max(s["pu"] * s["vu"], (1 - s["pu"]) * s["vd"])
            else:
                closes = abs(s["flow"]) >= s["length"] * abs(s["mean"])
            bar = s["bar"]
            if closes:
                n, ups = s["n"], s["ups"]
                got = {"mean": s["flow"] / n, "pu": ups / n, "vu": s["up"] / max(1, ups), "vd": s["down"] / max(1, n - ups)}
                for k, x in got.items():
                    s[k] = x if s["mean"] is None and k != "pu" or s[k] is None else alpha * x + (1 - alpha) * s[k]
                s["length"] = min(max(alpha * n + (1 - alpha) * s["length"], bounds[0] * expected_ticks), bounds[1] * expected_ticks)
                s.update(bar=bar + 1, flow=0.0, up=0.0, down=0.0, n=0, ups=0)
            return bar, closes

        return step

    return _scan(ticks, entity, order, make, "bar_index long, closes boolean")


def homm_breitung_cusum(df: DataFrame, entity: str, time: str, column: str, start: int, kappa: float = 4.6) -> DataFrame:
    """(sum of changes since row ``start``) / their running deviation, against sqrt(kappa + ln(r / r0)) sqrt(r): all running sums."""
    w = Window.partitionBy(entity).orderBy(time)
    x = clean(F.col(column))
    df = df.withColumns({"__d": x - F.lag(x).over(w), "__r": (F.row_number().over(w) - 1).cast("double")})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    late = F.when(F.col("__r") > start, F.col("__d"))
    df = df.withColumns({"__s": F.sum(late).over(run), "__sd": F.stddev_samp("__d").over(run)})
    ok = F.col("__r") > start
    return df.withColumns({"hb_stat": F.when(ok, div(F.col("__s"), F.col("__sd"))), "hb_bound": F.when(ok, F.sqrt(kappa + F.ln(F.col("__r") / start)) * F.sqrt("__r"))}).drop("__d", "__r", "__s", "__sd")
