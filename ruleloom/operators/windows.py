"""Time windows over events, and analytics over series of windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def tumbling(df: DataFrame, time: str, ms: int) -> DataFrame:
    """window_start, window_end in ms, aligned to the epoch."""
    t = millis(df[time])
    start = t - F.pmod(t, F.lit(ms))
    return df.withColumns({"window_start": start, "window_end": start + ms})


def sliding_anchored(df: DataFrame, time: str, ms: int, keys: Sequence[str] = ()) -> DataFrame:
    """Windows of ms every ms // 2, the first at the earliest event (of each key); an event is in up to two or three."""
    slide = max(ms // 2, 1)
    t = millis(F.col(time))
    if keys:
        first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(t).alias("_anchor"))
        df = df.join(first, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        df = df.crossJoin(F.broadcast(df.agg(F.min(t).alias("_anchor"))))  # a single row
    k = F.floor((t - F.col("_anchor")) / slide)
    reach = -(-ms // slide) - 1
    df = df.withColumn("_k", F.explode(F.sequence(k - reach, k))).filter("_k >= 0")
    start = F.col("_anchor") + F.col("_k") * slide
    return df.withColumns({"window_start": start, "window_end": start + ms}).filter(t < F.col("window_end")).drop("_anchor", "_k")


def sliding(df: DataFrame, time: str, ms: int, slide_ms: int) -> DataFrame:
    """Windows aligned to the epoch."""
    w = df.withColumn("_w", F.window(F.col(time).cast("timestamp"), f"{ms} milliseconds", f"{slide_ms} milliseconds"))
    return w.withColumns({"window_start": F.unix_millis("_w.start"), "window_end": F.unix_millis("_w.end")}).drop("_w")


def sessions(df: DataFrame, time: str, gap_ms: int, keys: Sequence[str] = (), **aggs: Column) -> DataFrame:
    """Sessions of each key: a gap over gap_ms starts a new one, one of just gap_ms does not."""
    out = df.groupBy(*keys, F.session_window(F.col(time).cast("timestamp"), f"{gap_ms} milliseconds").alias("_s")).agg(F.count(F.lit(1)).alias("count"), *[c.alias(n) for n, c in aggs.items()])
    return out.select(*keys, F.unix_millis("_s.start").alias("session_start"), F.unix_millis("_s.end").alias("session_end"), "count", *aggs)


def newest(df: DataFrame, by: Sequence[str], n: int, order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def trailing_count(df: DataFrame, time: str, ms: int, keys: Sequence[str]) -> DataFrame:
    """Adds trailing: the key's events in [t - ms, t].

    A key's time is cut into stretches as long as ms, each a partition of its own that also sees the times of the stretch
    before it, so a hot key is counted by many tasks. Events without time are counted among themselves.
    """
    t = millis(F.col(time))
    stretch = F.floor(t / max(ms, 1))
    real = df.withColumns({"_t": t, "_stretch": stretch, "_real": F.lit(True)})
    before = df.filter(t.isNotNull()).select(*keys, t.alias("_t"), (stretch + 1).alias("_stretch"), F.lit(False).alias("_real"))
    w = Window.partitionBy(*keys, "_stretch").orderBy("_t").rangeBetween(-ms, 0)
    both = real.unionByName(before, allowMissingColumns=True).withColumn("trailing", F.count(F.lit(1)).over(w))
    return both.filter("_real").drop("_t", "_stretch", "_real")


def recent(df: DataFrame, time: str, ms: int, as_of: Column) -> DataFrame:
    """Events of the last ms up to a given time."""
    t = millis(F.col(time))
    return df.filter((t >= millis(as_of) - ms) & (t <= millis(as_of)))


def in_turn(t: np.ndarray, ms: int) -> list:
    """First-fit windows of events in order of time: each opens where the last one no longer reaches."""
    rows, at = [], 0
    while at < len(t):
        end = int(np.searchsorted(t, t[at] + ms))
        rows.append([int(t[at]), int(t[at]) + ms, end - at])
        at = end
    return rows


def as_they_come(times: list[int], ms: int) -> list:
    """First-fit windows of events in any order of time."""
    done, live = [], []
    for t in times:
        done += [w for w in live if w[1] <= t]
        live = [w for w in live if w[1] > t]
        for w in live:
            if w[0] <= t < w[1]:
                w[2] += 1
                break
        else:
            live.append([t, t + ms, 1])
    return done + live


def active(opened: DataFrame, now: int) -> DataFrame:
    """Of the windows that first_fit opened, those that have not ended at a time."""
    return opened.filter(F.col("window_end") > now)


def latest(opened: DataFrame, key: str) -> DataFrame:
    """Each key's window that starts last."""
    columns = [c for c in opened.columns if c != key]
    return opened.groupBy(key).agg(F.max(F.struct("window_start", *[c for c in columns if c != "window_start"])).alias("_w")).select(key, *[F.col(f"_w.{c}") for c in columns])


def total_events(opened: DataFrame) -> DataFrame:
    return opened.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("events"))


def in_range(df: DataFrame, time: str, start_ms: int, end_ms: int) -> DataFrame:
    """Events in [start, end)."""
    t = millis(F.col(time))
    return df.filter((t >= start_ms) & (t < end_ms))


def described(df: DataFrame, time: str, now: int) -> DataFrame:
    """window_start, window_end, count, latest (time of the last event), is_expired (the window has ended by now) of a table
    of events with their windows."""
    out = df.groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("count"), F.max(millis(F.col(time))).alias("latest"))
    return out.withColumn("is_expired", F.col("window_end") <= now)


def first_fit(df: DataFrame, time: str, ms: int, key: str, id: str) -> DataFrame:
    """key, window_start, window_end, count of windows opened by an event that no open window of its key takes, in order
    of arrival; windows that end at or before the event's time are closed. Arrival order makes this a scan per key."""
    src = df.select(F.col(key).alias("key"), millis(F.col(time)).alias("t"), F.col(id).alias("id"))

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        t = part.sort_values("id", kind="stable")["t"].to_numpy()
        rows = in_turn(t, ms) if (t[1:] >= t[:-1]).all() else as_they_come(t.tolist(), ms)
        return pd.DataFrame({"key": [part["key"].iloc[0]] * len(rows), "window_start": [w[0] for w in rows], "window_end": [w[1] for w in rows], "count": [w[2] for w in rows]})

    kind = src.schema["key"].dataType.simpleString()
    return src.groupBy("key").applyInPandas(scan, f"key {kind}, window_start long, window_end long, count long").withColumnRenamed("key", key)


def window_facts(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per window with the facts that rules over windows read."""
    aggs = [F.count(F.lit(1)).alias("WindowEventCount")]
    for f in fields:
        x = F.col(f).cast("double")
        aggs += [F.sum(x).alias(f"{f}Sum"), F.avg(x).alias(f"{f}Average"), F.min(x).alias(f"{f}Min"), F.max(x).alias(f"{f}Max")]
    out = df.groupBy(*keys, F.col("window_start").alias("WindowStartTime"), F.col("window_end").alias("WindowEndTime")).agg(*aggs)
    return out.withColumn("WindowDurationMs", F.col("WindowEndTime") - F.col("WindowStartTime"))


# -- analytics over a table of windows (one row each) or of events with their window. Windows are few against events.


def across(df: DataFrame, field: str) -> DataFrame:
    """windows, events, and total, least and largest of the windows' sums: one row over all windows."""
    per = df.groupBy("window_start").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(field).cast("double")).alias("_s"))
    return per.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("events"), F.sum("_s").alias("total"), F.min("_s").alias("least"), F.max("_s").alias("largest"))


def with_event_type(df: DataFrame, event_type: str) -> DataFrame:
    """window_start of the windows that hold an event of a type."""
    return df.filter(F.col("event_type") == event_type).select("window_start").distinct()


def moving_average(df: DataFrame, field: str, n: int) -> DataFrame:
    """window_start, moving_average over the newest n windows: sum of values over number of events."""
    per = df.groupBy("window_start").agg(F.sum(F.col(field).cast("double")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("window_start").rowsBetween(-(n - 1), 0)
    return per.select("window_start", (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("moving_average"))


def anomalies(df: DataFrame, field: str, threshold: float) -> DataFrame:
    """Events of the last window whose value is more than threshold deviations off those of all earlier windows; none if
    there are fewer than 3 windows or 10 earlier values. With no deviation any other value is one."""
    last = df.agg(F.max("window_start").alias("_last"), F.count_distinct("window_start").alias("_w"))
    df = df.crossJoin(F.broadcast(last))  # a single row
    base = df.filter("window_start < _last").agg(F.avg(field).alias("_m"), F.stddev_pop(field).alias("_d"), F.count(field).alias("_n"))
    now = df.filter("window_start = _last and _w >= 3").crossJoin(F.broadcast(base)).filter("_n >= 10")  # a single row
    off = F.abs(F.col(field) - F.col("_m"))
    now = now.filter(F.when(F.col("_d") == 0, off > 0).otherwise(off / F.col("_d") > threshold))
    return now.withColumn("z", F.try_divide(F.col(field) - F.col("_m"), F.col("_d"))).drop("_last", "_w", "_m", "_d", "_n")


def trend(df: DataFrame, field: str) -> DataFrame:
    """trend: Increasing, Decreasing or Stable, of the windows' averages in the second half against the first (5 %)."""
    per = df.groupBy("window_start").agg(F.avg(F.col(field).cast("double")).alias("_a"))
    w = Window.orderBy("window_start")
    per = per.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    half = F.floor(F.col("_n") / 2)
    two = per.agg(F.avg(F.when(F.col("_i") <= half, F.col("_a"))).alias("a"), F.avg(F.when(F.col("_i") > half, F.col("_a"))).alias("b"), F.count(F.lit(1)).alias("n"))
    change = (F.col("b") - F.col("a")) / F.when(F.col("a") != 0, F.col("a"))
    sign = F.when(F.col("a") == 0, F.signum("b") * 1e9).otherwise(change)
    return two.select(F.when(F.col("n") < 2, "Stable").when(sign > 0.05, "Increasing").when(sign < -0.05, "Decreasing").otherwise("Stable").alias("trend"))
