"""Event-time analysis in batch."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _interval(span: timedelta) -> str:
    return f"{int(span.total_seconds() * 1_000_000)} microseconds"


def _windowed(df: DataFrame, window: Column, by: Sequence[str]) -> DataFrame:
    counted = df.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        *by,
        "n",
    )


def tumbling(df: DataFrame, ts: str, width: timedelta, by: Sequence[str] = ()) -> DataFrame:
    """Rows per window of fixed width."""
    return _windowed(df, F.window(ts, _interval(width)), by)


def sliding(
    df: DataFrame, ts: str, width: timedelta, step: timedelta, by: Sequence[str] = ()
) -> DataFrame:
    """Rows per overlapping window.

    Rows are counted per step first, so a row is not copied once per window it is in.
    """
    if width % step:
        return _windowed(df, F.window(ts, _interval(width), _interval(step)), by)
    per_step = tumbling(df, ts, step, by)
    spread = per_step.select(
        F.explode(F.array(*[F.col("window_start") - F.lit(i * step) for i in range(width // step)])).alias(
            "window_start"
        ),
        *by,
        "n",
    )
    totals = spread.groupBy("window_start", *by).agg(F.sum("n").alias("n"))
    end = (F.col("window_start") + F.lit(width)).alias("window_end")
    return totals.select("window_start", end, *by, "n")


def sessionize(df: DataFrame, by: Sequence[str], ts: str, gap: timedelta) -> DataFrame:
    """Sessions per key: first and last event and number of events.

    A session ends where the next event is more than ``gap`` later.  Two events in
    one time cell as wide as the gap are always in one session, so rows are first
    reduced to one per key and cell; the window then sees as many rows as the gap
    fits into the data's time range, however many events a key has.
    """
    micros = int(gap.total_seconds() * 1_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cells = df.groupBy(*by, F.floor(at / F.lit(micros)).alias("cell")).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")
    )
    in_order = Window.partitionBy(*by).orderBy("cell")
    starts = F.coalesce(F.col("first") - F.lag("last").over(in_order) > F.lit(gap), F.lit(True))
    numbered = cells.withColumn("starts", starts.cast("int")).withColumn(
        "session", F.sum("starts").over(in_order)
    )
    return numbered.groupBy(*by, "session").agg(
        F.min("first").alias("session_start"),
        F.max("last").alias("session_end"),
        F.sum("n").alias("n_events"),
    ).drop("session")


def funnel(
    df: DataFrame, by: str, ts: str, col: str, steps: Sequence[str], within: timedelta
) -> DataFrame:
    """Keys that reach each step in turn, within a time of their first first step.

    Per step the earliest time after the step before is kept: an aggregate combined
    before the shuffle.  Each step reads the events once, and all steps are counted at
    the end.
    """
    reached = df.filter(F.col(col) == steps[0]).groupBy(by).agg(F.min(ts).alias("t0"))
    for i, step in enumerate(steps[1:], 1):
        later = df.filter(F.col(col) == step).select(by, F.col(ts).alias("ts_"))
        before = F.col(f"t{i - 1}")
        in_time = (F.col("ts_") > before) & (F.col("ts_") <= F.col("t0") + F.lit(within))
        kept = [F.min(f"t{k}").alias(f"t{k}") for k in range(i)]
        reached = (
            reached.join(later, by, "left")
            .groupBy(by)
            .agg(*kept, F.min(F.when(in_time, F.col("ts_"))).alias(f"t{i}"))
        )
    counts = [F.struct(F.lit(i).alias("step"), F.count(f"t{i}").alias("n")) for i in range(len(steps))]
    out = reached.agg(F.array(*counts).alias("c")).select(F.inline("c"))
    names = F.element_at(F.array(*[F.lit(s) for s in steps]), F.col("step") + 1)
    return out.select(F.col("step").cast("int").alias("step"), names.alias("event"), "n")


def retention(df: DataFrame, by: str, ts: str, unit: str = "week") -> DataFrame:
    """Active keys per first period (cohort) and period.

    Rows are reduced to one per key and period before the cohort is found.
    """
    period = F.date_trunc(unit, ts).cast("timestamp_ntz")
    active = df.select(F.col(by).alias("k"), period.alias("period")).distinct()
    cohort = F.min("period").over(Window.partitionBy("k"))
    return (
        active.withColumn("cohort", cohort)
        .groupBy("cohort", "period")
        .agg(F.count(F.lit(1)).alias("n_active"))
    )
