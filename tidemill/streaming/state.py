"""Custom state per key: runs of activity with timers that expire them."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Times are microseconds here: Python workers then convert no time zones.
_RUN = "started bigint, ended bigint, n bigint, last_id bigint, last_event string"
_COLUMNS = ["started", "ended", "n", "last_id", "last_event"]
_OUT = ["key", *_COLUMNS, "seq", "expired"]
_HELD = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in _COLUMNS[:-1]], ("last_event", pa.string())])

# Keys share state by a hash: what a call costs is then paid per bucket, not per key.
BUCKETS = 1024


def _joined(parts: pd.DataFrame, idle: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Runs of many keys from parts of runs (``key`` and ``_COLUMNS``), and each part's run."""
    code = pd.factorize(parts["key"], use_na_sentinel=False)[0]
    started, ended = parts["started"].to_numpy(np.int64), parts["ended"].to_numpy(np.int64)
    order = np.lexsort((ended, started, code))
    sorted_code = code[order]
    # The latest end of the key so far is that of the open run: later runs end later.
    upto = pd.Series(ended[order]).groupby(sorted_code).cummax().to_numpy()
    new = np.ones(len(order), bool)
    new[1:] = (sorted_code[1:] != sorted_code[:-1]) | (started[order][1:] - upto[:-1] > idle)
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(new) - 1
    first = order[new]
    # The last event by time and id is last within its run.
    by_end = np.lexsort((parts["last_id"].to_numpy(), ended, run))
    last = by_end[np.append(np.flatnonzero(np.diff(run[by_end])), len(by_end) - 1)] if len(by_end) else by_end
    runs = parts.iloc[last].reset_index(drop=True)
    runs["started"] = started[first]
    counts = np.zeros(len(first), np.int64)
    np.add.at(counts, run, parts["n"].to_numpy(np.int64))
    runs["n"] = counts
    return runs, run


def joined_runs(parts: list[tuple], idle: int) -> list[tuple]:
    """One key's runs from parts of runs (``_COLUMNS``): parts no more than ``idle`` apart are one.

    Whatever way a run's events were cut into parts, the result is the same.
    """
    runs, _ = _joined(pd.DataFrame(parts, columns=_COLUMNS).assign(key=""), idle)
    return list(runs[_COLUMNS].itertuples(index=False, name=None))


def _parts(batches: Iterator[pd.DataFrame], idle: int) -> Iterator[pd.DataFrame]:
    """Per task and key the runs of its events, so that a busy key sends few rows."""
    for batch in batches:
        if batch.empty:
            continue
        code, keys = pd.factorize(batch["key"], use_na_sentinel=False)
        order = np.lexsort((batch["id"], batch["ts"], code))
        code, ts, ids = code[order], batch["ts"].to_numpy()[order], batch["id"].to_numpy()[order]
        event = batch["event"].to_numpy(object)[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(ts) > idle)]))
        last = np.concatenate([first[1:], [len(ts)]]) - 1
        yield pd.DataFrame({
            "key": pd.Series(keys, dtype=object).where(pd.notna(keys), None).to_numpy()[code[first]],
            "event_time": pd.to_datetime(ts[last], unit="us"), "started": ts[first], "ended": ts[last],
            "n": last - first + 1, "last_id": ids[last], "last_event": event[last],
        })


def _dump(runs: pd.DataFrame) -> bytes:
    """Runs as an Arrow stream, the form they are kept in."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as writer:
        writer.write_table(pa.Table.from_pandas(runs, _HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _load(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


class _Runs(StatefulProcessor):
    """Open runs of a bucket of keys, and one timer at the time the first of them is over."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", "held binary, seq bigint, timer bigint")

    def _due(self, ended: np.ndarray) -> np.ndarray:
        """Milliseconds, rounded up, at which runs that ended then are over."""
        return -(-(ended + self.idle) // 1000)

    def _keep(self, runs: pd.DataFrame, seq: int, timer: int | None) -> None:
        """Put the open runs down and move the timer, which was at ``timer``.

        A bucket without any keeps only its number.
        """
        first = int(self._due(runs["ended"].to_numpy()).min()) if len(runs) else None
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.state.update((_dump(runs), seq, first))

    def _tell(self, rows: pd.DataFrame, seq: int, expired: bool) -> pd.DataFrame:
        return rows.assign(seq=seq, expired=expired)[_OUT]

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([batch[_HELD.names] for batch in rows], ignore_index=True)
        held, seq, timer = self.state.get() if self.state.exists() else (None, -1, None)
        before = _load(bytes(held)) if held is not None else new[:0]
        parts = pd.concat([before, new], ignore_index=True) if len(before) else new
        after, run = _joined(parts, self.idle)
        # As the timer would: other keys of the bucket must not wait for the next watermark.
        over = self._due(after["ended"].to_numpy()) <= timerValues.getCurrentWatermarkInMs()
        self._keep(after[~over], seq + 1, timer)
        changed = np.zeros(len(after), bool)
        changed[run[len(before) :]] = True
        # A run that another has taken in is told with no events.
        started = after["started"].to_numpy()[run[: len(before)]]
        gone = before[before["started"].to_numpy() != started].assign(n=0)
        yield self._tell(pd.concat([after[changed & ~over], gone], ignore_index=True), seq + 1, False)
        yield self._tell(after[over], seq + 1, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, seq, _ = self.state.get()
        runs, now = _load(bytes(held)), timerValues.getCurrentWatermarkInMs()
        over = self._due(runs["ended"].to_numpy()) <= now
        self._keep(runs[~over], seq + 1, None)
        yield self._tell(runs[over], seq + 1, True)

    def close(self) -> None:
        pass


def activity_runs(
    sdf: DataFrame,
    by: str,
    ts: str,
    id_col: str,
    event: str,
    delay: timedelta,
    idle: timedelta,
    buckets: int = BUCKETS,
) -> DataFrame:
    """What changes about each key's runs of activity, for update mode into a keyed sink.

    A run is a key's events with no gap above ``idle``.  Every batch tells the runs it
    changed: start, end, events so far, last event.  When the watermark, ``delay`` behind
    the latest event, passes a run's end by ``idle``, a timer tells it once more as expired
    and its state is dropped.  ``n`` is 0 for a run that an event between has joined to an
    earlier one.  Of the rows for a key and start the last by ``seq`` counts.

    Events are made into parts of runs before the shuffle, so a busy key sends a row per
    task and gap.  A part is late as a whole, by its last event.  Rows without a time are
    left out.  State is kept per bucket of keys, and a bucket that gets rows is rewritten
    with the open runs of all its keys: for very many keys raise ``buckets``, which a
    checkpoint then holds to.  Keys are kept as strings, so their type has to be one that a
    cast to string and back leaves as it is.
    """
    micros = int(idle.total_seconds() * 1_000_000)
    kind = sdf.schema[by].dataType.simpleString()
    rows = sdf.where(F.col(ts).isNotNull()).select(
        F.col(by).cast("string").alias("key"), F.unix_micros(ts).alias("ts"), F.col(id_col).alias("id"), F.col(event).alias("event")
    )
    parts = rows.mapInPandas(lambda batches: _parts(batches, micros), f"key string, event_time timestamp, {_RUN}")
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    changed = (
        parts.withWatermark("event_time", f"{int(delay.total_seconds() * 1_000_000)} microseconds")
        .groupBy("bucket")
        .transformWithStateInPandas(
            _Runs(micros), f"key string, {_RUN}, seq bigint, expired boolean", "Update", "EventTime"
        )
    )
    return changed.select(
        F.col("key").cast(kind).alias(by), F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"),
        F.col("n").alias("n_events"), "last_event", "seq", "expired",
    )
