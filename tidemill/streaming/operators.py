"""Streaming operators: functions from a streaming DataFrame to another."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemill.operators import joins
from tidemill.sources.commits import CommitLog
from tidemill.streaming.queries import read_stream


def _text(span: timedelta) -> str:
    return f"{int(span.total_seconds() * 1_000_000)} microseconds"


def stream_counts(
    sdf: DataFrame, ts: str, width: timedelta, delay: timedelta, by: Sequence[str] = ()
) -> DataFrame:
    """Rows per window, emitted once the watermark has passed its end."""
    counted = (
        sdf.withWatermark(ts, _text(delay))
        .groupBy(F.window(ts, _text(width)).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n"
    )


def stream_sessions(
    sdf: DataFrame, by: Sequence[str], ts: str, gap: timedelta, delay: timedelta
) -> DataFrame:
    """Sessions per key, emitted once the watermark has closed them.

    The session settings make tasks merge sessions before the shuffle, so a busy key
    sends sessions rather than rows.
    """
    merged = (
        sdf.withWatermark(ts, _text(delay))
        .groupBy(*by, F.session_window(ts, _text(gap)).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
    end = F.col("w.end") - F.lit(gap)
    return merged.select(
        *by, F.col("w.start").alias("session_start"), end.alias("session_end"), "n_events"
    )


def stream_totals(sdf: DataFrame, by: str, ts: str, id_col: str, event: str) -> DataFrame:
    """Events so far and the last event of each key, for update mode into the keyed sink.

    A built-in aggregate: combined before the shuffle, so a busy key is a row per task.
    Runs of a key that inactivity has closed are ``stream_sessions``.
    """
    last = F.max(F.struct(ts, id_col, F.col(event).alias("last_event")))
    totals = sdf.groupBy(by).agg(F.count(F.lit(1)).alias("n_events"), last.alias("last"))
    return totals.select(by, "n_events", "last.last_event")


def stream_dedup(
    sdf: DataFrame, keys: Sequence[str], ts: str, delay: timedelta, salts: int = 8
) -> DataFrame:
    """Rows with a key seen before, inside the watermark, dropped.

    Copies of one key meet in one task.  With ``salts`` a first pass drops copies per
    key and slice of the input tasks, so the second sees at most ``salts`` per batch.
    """
    marked = sdf.withWatermark(ts, _text(delay))
    if salts > 1:
        salted = marked.withColumn("__salt", F.spark_partition_id() % salts)
        marked = salted.dropDuplicatesWithinWatermark([*keys, "__salt"]).drop("__salt")
    return marked.dropDuplicatesWithinWatermark(list(keys))


def stream_enrich(
    sdf: DataFrame,
    dim: DataFrame,
    on: dict[str, str],
    broadcast_bytes: int = 32 << 20,
    salts: int = 16,
) -> DataFrame:
    """Each row with its dimension row, if there is one.

    The dimension is measured, as text, when the stream is built, and should not grow
    much while it runs.  Up to ``broadcast_bytes`` it is broadcast and the stream is not
    shuffled.  A larger one is listed once per salt and the stream's rows draw one of the salts, so a busy key is spread over
    tasks - streams have no adaptive split of skewed partitions.
    """
    match = F.lit(True)
    for x, y in on.items():
        match = match & (F.col(x) == F.col(y))
    size = dim.agg(F.sum(F.octet_length(F.to_json(F.struct(*dim.columns))))).first()[0] or 0
    if size <= broadcast_bytes:
        return sdf.join(F.broadcast(dim), match, "left")
    listed = dim.withColumn("__dim_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*sdf.columns), F.lit(salts)).cast("int")
    salted = sdf.withColumn("__salt", salt)
    match = match & (F.col("__salt") == F.col("__dim_salt"))
    return salted.join(listed, match, "left").drop("__salt", "__dim_salt")


def stream_interval_join(
    left: DataFrame,
    right: DataFrame,
    by: dict[str, str],
    left_ts: str,
    right_ts: str,
    within: timedelta,
    delay: timedelta,
    salts: int = 4,
) -> DataFrame:
    """The batch interval join with both sides streams and state dropped by watermark."""
    return joins.interval_join(
        left.withWatermark(left_ts, _text(delay)),
        right.withWatermark(right_ts, _text(delay)),
        by,
        left_ts,
        right_ts,
        within,
        salts,
    )


def late_report(
    spark,
    landing: str,
    schema,
    keys: Sequence[str],
    ts: str,
    delay: timedelta,
    out: str,
    checkpoint: str,
) -> int:
    """Append the on-time rows of ``landing`` to ``out``; return how many rows came too late.

    Every micro-batch writes its rows to a folder of its own and then one entry in a
    ledger (``late_ledger``): rows landed, kept and late, and totals so far.  The number
    returned is the last total, so a run costs as much as its new files.  A batch that is
    repeated after a crash overwrites its folder, and one that is in the ledger does nothing.

    A row is judged by the watermark of the batch before its own: ``delay`` behind the
    latest time of the batches before that one, and 1970 before there is any.  Late copies
    of a row that was kept are late rows too; rows neither kept nor late are copies.
    """
    sdf = read_stream(spark, landing, schema)
    columns = sdf.columns
    kept = stream_dedup(sdf, keys, ts, delay, salts=1).select(
        *columns, F.lit(None).cast("timestamp").alias("__landed"), F.lit(True).alias("__kept")
    )
    # The same rows as they landed, of which only the time is read.
    landed = sdf.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in sdf.schema],
        F.col(ts).alias("__landed"),
        F.lit(False).alias("__kept"),
    )
    ledger = CommitLog(spark, f"{out}/_ledger")
    delay_ms = int(delay.total_seconds() * 1000)

    def write(batch: DataFrame, batch_id: int) -> None:
        number, totals = ledger.last()
        if number >= batch_id:
            return
        before = ledger.read(batch_id - 2)["latest_ms"] if 2 <= batch_id <= number + 2 else None
        watermark = 0 if before is None else max(0, before - delay_ms)
        late = ~F.col("__kept") & (F.col("__landed") <= F.timestamp_millis(F.lit(watermark)))
        seen = Observation()
        counted = batch.observe(
            seen,
            F.count_if(~F.col("__kept")).alias("landed"),
            F.count_if("__kept").alias("kept"),
            F.count_if(late).alias("late"),
            F.max(F.unix_millis("__landed")).alias("latest_ms"),
        )
        counted.filter("__kept").select(*columns).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        entry = dict(seen.get)
        totals = totals or {}
        for name in ("landed", "kept", "late"):
            entry[f"{name}_total"] = totals.get(f"{name}_total", 0) + entry[name]
        times = [t for t in (totals.get("latest_ms"), entry["latest_ms"]) if t is not None]
        ledger.add(batch_id, entry | {"latest_ms": max(times, default=None)})

    query = (
        kept.unionByName(landed)
        .writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return (ledger.last()[1] or {"late_total": 0})["late_total"]


def late_ledger(spark, out: str) -> DataFrame:
    """batch, landed, kept, late and their totals so far, of every micro-batch."""
    ledger = CommitLog(spark, f"{out}/_ledger")
    names = ["landed", "kept", "late", "landed_total", "kept_total", "late_total"]
    rows = [(n, *[e[c] for c in names]) for n in ledger.numbers() for e in [ledger.read(n)]]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["batch", *names]))
