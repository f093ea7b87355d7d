"""Watermarks and late data: exact, event by event, over tables; and the settings of a running stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import millis

#: Events of consecutive arrival numbers that a task scans together.
BUCKET = 100_000


def flagged(df: DataFrame, time: str, delay_ms: int, arrival: str, bucket: int = BUCKET) -> DataFrame:
    """Adds watermark_ms (before the event; null for the first) and is_late: time below the watermark.

    The watermark is the largest time so far less the delay, in order of arrival. Late events never raise it, so it
    is a running maximum: within buckets of arrival numbers, after the maxima of the buckets before. Only those, one
    row per bucket, pass through a single task.
    """
    t = millis(F.col(time))
    df = df.withColumns({"_t": t, "_b": F.floor(F.col(arrival) / bucket)})
    per = df.groupBy("_b").agg(F.max("_t").alias("_m"))
    carry = per.select(F.col("_b").alias("_cb"), F.max("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = F.max("_t").over(Window.partitionBy("_b").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_inside", inside).join(carry, F.col("_b") == F.col("_cb"))
    out = out.withColumn("watermark_ms", F.greatest("_inside", "_carry") - delay_ms)
    return out.withColumn("is_late", F.coalesce(F.col("_t") < F.col("watermark_ms"), F.lit(False))).drop("_t", "_b", "_cb", "_m", "_carry", "_inside")


def flagged_by(df: DataFrame, time: str, kind: str, arrival: str, delay_ms: int = 0, interval: int = 1, bucket: int = BUCKET) -> DataFrame:
    """flagged() by kind: "bounded" (largest time less the delay), "ascending" (largest time), "custom" (never advances), or
    "periodic": the largest time, looked at each `interval` arrivals only."""
    if kind == "bounded":
        return flagged(df, time, delay_ms, arrival, bucket)
    if kind == "ascending":
        return flagged(df, time, 0, arrival, bucket)
    if kind == "custom":
        return df.withColumns({"watermark_ms": F.lit(None).cast("long"), "is_late": F.lit(False)})
    if kind != "periodic":
        raise ValueError(f"no watermark {kind!r}")
    t = millis(F.col(time))
    turn = F.floor(F.col(arrival) / interval)
    per = df.groupBy(turn.alias("_turn")).agg(F.max(t).alias("_m"))
    # Turns are one row for each interval of arrivals; they are chained in buckets as events are in flagged().
    per = per.withColumn("_b", F.floor(F.col("_turn") / bucket))
    carry = per.groupBy(F.col("_b").alias("_cb")).agg(F.max("_m").alias("_cm"))
    carry = carry.select("_cb", F.max("_cm").over(Window.orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    before = F.max("_m").over(Window.partitionBy("_b").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_before", before).join(carry, F.col("_b") == F.col("_cb")).select("_turn", F.greatest("_before", "_carry").alias("watermark_ms"))
    out = df.withColumn("_t", t).join(per, turn == F.col("_turn")).drop("_turn")
    return out.withColumn("is_late", F.coalesce(F.col("_t") < F.col("watermark_ms"), F.lit(False))).drop("_t")


def recomputed(df: DataFrame, time: str, window_ms: int, **aggs: Column) -> DataFrame:
    """Tumbling windows with late events taken in: window_start, first (events on time), revisions (late ones, each of which
    made its window be computed again) and the aggregates over all."""
    start = millis(F.col(time)) - F.pmod(millis(F.col(time)), F.lit(window_ms))
    late = F.col("is_late")
    return df.groupBy(start.alias("window_start")).agg(F.count_if(~late).alias("first"), F.count_if(late).alias("revisions"), *[c.alias(n) for n, c in aggs.items()])


def lateness(time: str) -> Column:
    return F.col("watermark_ms") - millis(F.col(time))


def on_time(df: DataFrame) -> DataFrame:
    """Late events dropped."""
    return df.filter("not is_late")


def allowed(df: DataFrame, time: str, max_lateness_ms: int) -> DataFrame:
    """Late events up to a bound are kept."""
    return df.filter(~F.col("is_late") | (lateness(time) <= max_lateness_ms))


def side_output(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events on time, and late ones."""
    return df.filter("not is_late"), df.filter("is_late")


def late_stats(df: DataFrame, time: str, max_lateness_ms: int | None = None) -> DataFrame:
    """total_late, dropped, allowed."""
    late = F.col("is_late")
    ok = late & (lateness(time) <= max_lateness_ms) if max_lateness_ms is not None else F.lit(False)
    return df.agg(F.count_if(late).alias("total_late"), F.count_if(late & ~ok).alias("dropped"), F.count_if(ok).alias("allowed"))


def strategy(df: DataFrame, time: str, kind: str = "bounded", delay_ms: int = 0, max_lateness_ms: int = 0) -> DataFrame:
    """A running stream's watermark: "bounded" by a delay (widened by allowed lateness), "periodic" or "ascending"
    (none), or "custom" (no watermark)."""
    if kind == "custom":
        return df
    return df.withWatermark(time, f"{(delay_ms if kind == 'bounded' else 0) + max_lateness_ms} milliseconds")
