"""Streams: what batches give once windows are closed, late rows, restarts, replays."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidemill.operators import events
from tidemill.streaming import operators as ops
from tidemill.streaming import queries as run
from tidemill.streaming.state import activity_runs, joined_runs

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("kind", T.StringType()),
])
T0 = datetime(2024, 3, 1)
HOUR = timedelta(hours=1)


class Feed:
    """A landing folder that rows are delivered to."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path = spark, str(tmp_path / "landing")
        self.out, self.checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def deliver(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(self.path)

    def stream(self):
        return run.read_stream(self.spark, self.path, SCHEMA)

    def read(self, sdf):
        return run.naive_times(self.spark.read.schema(sdf.schema).parquet(self.out))


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def row(i, user, hours, kind="a"):
    return (i, user, T0 + hours * HOUR, kind)


def test_sessions_and_counts_equal_batch_once_closed(feed, as_rows):
    # Includes events exactly one gap apart.
    rows = [row(i, u, h) for i, (u, h) in enumerate(
        [(1, 0), (1, 1), (1, 3), (1, 6), (2, 0), (2, 2), (2, 5), (9, 200)])]
    feed.deliver(rows)
    gap = 2 * HOUR
    got = run.result_of(ops.stream_sessions(feed.stream(), ["user"], "ts", gap, HOUR), "s")
    batch = events.sessionize(feed.spark.read.parquet(feed.path), ["user"], "ts", gap)
    assert as_rows(got) == as_rows(batch.filter("user <> 9"))
    counts = run.result_of(ops.stream_counts(feed.stream(), "ts", timedelta(days=1), HOUR), "c")
    assert as_rows(counts, "n") == [(7,)]


def test_dedup_drops_copies_in_and_across_batches(feed):
    feed.deliver([row(i % 3, 1, i % 3) for i in range(60)])
    sdf = ops.stream_dedup(feed.stream(), ["id"], "ts", timedelta(days=2), salts=4)
    run.run_once(sdf, feed.out, feed.checkpoint)
    feed.deliver([row(2, 1, 2), row(3, 1, 3), row(3, 1, 3)])
    run.run_once(ops.stream_dedup(feed.stream(), ["id"], "ts", timedelta(days=2), salts=4), feed.out, feed.checkpoint)
    assert sorted(r.id for r in feed.read(sdf).collect()) == [0, 1, 2, 3]


def test_late_rows_are_dropped_and_counted(feed):
    deliveries = [
        [row(i, 1, i) for i in range(5)],
        [row(10 + i, 1, 300 + i) for i in range(5)],  # the watermark jumps after this
        [row(20, 1, 305)],  # the batch between
        [row(30 + i, 1, i) for i in range(7)] + [row(40, 1, 306)],
    ]
    dropped = []
    for rows in deliveries:
        feed.deliver(rows)
        dropped.append(
            ops.late_report(
                feed.spark, feed.path, SCHEMA, ["id"], "ts", timedelta(days=1), feed.out, feed.checkpoint
            )
        )
    assert dropped == [0, 0, 0, 7]
    kept = feed.spark.read.schema("id bigint").parquet(feed.out)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 20, 40]


def test_stream_joins(feed, as_rows):
    feed.deliver([row(1, 1, 0, "click"), row(2, 1, 3, "buy"), row(3, 1, 30, "buy"), row(4, 2, 1, "buy"),
                  row(5, 1, 0, "buy"), row(6, None, 0, "click"), row(7, None, 0, "buy")])
    clicks = feed.stream().filter("kind = 'click'").select("id", "user", "ts")
    bought = feed.stream().filter("kind = 'buy'").select(
        F.col("id").alias("b"), F.col("user").alias("buyer"), F.col("ts").alias("bought_at")
    )
    joined = ops.stream_interval_join(
        clicks, bought, {"user": "buyer"}, "ts", "bought_at", timedelta(days=1), HOUR
    )
    assert as_rows(run.result_of(joined, "j"), "id", "b") == [(1, 2), (1, 5)]
    dim = feed.spark.createDataFrame([(1, "one")], "k bigint, name string")
    for broadcast_bytes in (1000, 0):
        enriched = ops.stream_enrich(feed.stream(), dim, {"user": "k"}, broadcast_bytes, salts=3)
        wide = run.result_of(enriched, "e")
        assert wide.columns == ["id", "user", "ts", "kind", "k", "name"]
        assert sorted((r.id, r.name or "") for r in wide.collect()) == [
            (1, "one"), (2, "one"), (3, "one"), (4, ""), (5, "one"), (6, ""), (7, "")
        ]


def test_the_ledger_survives_a_crash_and_a_replay(feed, monkeypatch):
    def report():
        return ops.late_report(
            feed.spark, feed.path, SCHEMA, ["id"], "ts", timedelta(days=1), feed.out, feed.checkpoint
        )

    def ledger():
        return {r.batch: (r.landed, r.kept, r.late) for r in ops.late_ledger(feed.spark, feed.out).collect()}

    feed.deliver([row(i % 4, 1, i % 4) for i in range(6)] + [row(9, 1, 400)])  # two copies; the watermark jumps
    assert report() == 0
    feed.deliver([row(20, 1, 401)])
    with monkeypatch.context() as m:
        m.setattr(ops.CommitLog, "add", lambda *_: 1 / 0)
        with pytest.raises(Exception):
            report()
    before = ledger()
    assert sum(v[0] for v in before.values()) == 7 and sum(v[1] for v in before.values()) == 5
    assert report() == 0
    # Late: a new id, and a copy of a kept one; on time: a copy, and a row without a time.
    feed.deliver([row(50, 1, 2), row(1, 1, 1), row(20, 1, 401), (60, 1, None, "a")])
    assert report() == 2 and report() == 2
    last = ledger()
    assert set(before.items()) <= set(last.items())
    assert [sum(v[i] for v in last.values()) for i in range(3)] == [12, 7, 2]
    kept = feed.spark.read.schema("id bigint").parquet(feed.out)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 9, 20, 60]


def test_runs_are_the_same_however_events_are_cut():
    rng = random.Random(4)
    for _ in range(200):
        events_ = [(t, t, 1, i, f"e{i}") for i, t in enumerate(rng.choices(range(60), k=rng.randint(1, 25)))]
        whole = joined_runs(events_, 3)
        rng.shuffle(events_)
        cut = rng.randint(0, len(events_))
        assert joined_runs(joined_runs(events_[:cut], 3) + joined_runs(events_[cut:], 3), 3) == whole
        assert sum(r[2] for r in whole) == len(events_)
        assert all(b[0] - a[1] > 3 for a, b in zip(whole, whole[1:]))


def test_runs_expire_and_keys_return(feed):
    path, keys = feed.out, ["user", "started"]

    def deliver(*rows):
        feed.deliver(list(rows))
        runs = activity_runs(feed.stream(), "user", "ts", "id", "kind", HOUR, 10 * HOUR)
        run.run_upserts(runs, path, feed.checkpoint, keys, ["seq"], mode="update")
        got = run.read_upserted(feed.spark, path, runs.schema, keys, ["seq"]).filter("n_events > 0").collect()
        at = lambda t: (t - T0) / HOUR
        return sorted(((r.user, at(r.started), at(r.ended), r.n_events, r.last_event, r.expired) for r in got), key=repr)

    # Two runs of user 1 with a gap above ten hours between; a key that is null; equal times.
    assert deliver(*[row(i, 1, 2 + i % 4, f"k{i}") for i in range(20)], row(50, 1, 15.5, "x"), row(51, 2, 1, "two"),
                   row(52, None, 2, "null"), row(53, 2, 1, "tie")) == [
        (1, 15.5, 15.5, 1, "x", False), (1, 2, 5, 20, "k19", False),
        (2, 1, 1, 2, "tie", True), (None, 2, 2, 1, "null", True)]
    # After a restart an event between joins the two runs of user 1.
    assert deliver(row(60, 1, 14.8, "between"), row(61, 1, 15, "between")) == [
        (1, 2, 15.5, 23, "x", False), (2, 1, 1, 2, "tie", True), (None, 2, 2, 1, "null", True)]
    # Much later user 1 returns: the old runs expire, a new one starts.
    got = deliver(row(70, 1, 100, "back"))
    assert got == [(1, 100, 100, 1, "back", False), (1, 2, 15.5, 23, "x", True),
                   (2, 1, 1, 2, "tie", True), (None, 2, 2, 1, "null", True)]
    # So does user 2, twice in one delivery; a row from before the watermark is late.
    got = deliver(row(80, 2, 101, "a"), row(81, 2, 130, "b"), row(82, 3, 5, "late"))
    assert [r for r in got if r[0] in (2, 3)] == [
        (2, 1, 1, 2, "tie", True), (2, 101, 101, 1, "a", True), (2, 130, 130, 1, "b", False)]
    assert (1, 100, 100, 1, "back", True) in got


def test_state_is_kept_per_bucket_of_keys(feed):
    """Many keys, few buckets: as many states, and the runs of a plain loop over each key."""
    rng, idle, seen = random.Random(6), 10, {}
    keys = [None, 2**53, 2**53 + 1, *range(200)]
    for first in (0, 100):
        rows = [row(i, rng.choice(keys), first + rng.randrange(90), f"k{i}") for i in range(first * 10, first * 10 + 700)]
        feed.deliver(rows)
        for i, user, ts, kind in rows:
            seen.setdefault(user, []).append(((ts - T0) // HOUR, i, kind))
        runs = activity_runs(feed.stream(), "user", "ts", "id", "kind", HOUR, idle * HOUR, buckets=4)
        query = run.run_upserts(runs, feed.out, feed.checkpoint, ["user", "started"], ["seq"], mode="update")
    # The states, and no more timers than that; timers may be counted twice.
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 12
    end = max(e[0] for events_ in seen.values() for e in events_) - 1
    want = []
    for user, events_ in seen.items():
        for t, i, kind in sorted(events_):
            if want and want[-1][0] == user and t - want[-1][2] <= idle:
                want[-1] = (user, want[-1][1], t, want[-1][3] + 1, kind, True)
            else:
                want.append((user, t, t, 1, kind, True))
    want = [(*r[:5], r[2] + idle <= end) for r in want]
    got = run.read_upserted(feed.spark, feed.out, runs.schema, ["user", "started"], ["seq"]).filter("n_events > 0").collect()
    at = lambda t: (t - T0) // HOUR
    assert sorted(((r.user, at(r.started), at(r.ended), r.n_events, r.last_event, r.expired) for r in got), key=repr) == sorted(want, key=repr)


def test_upsert_sink_replays_without_effect(feed, as_rows, tmp_path):
    path, order = str(tmp_path / "table"), ["ts", "id"]
    feed.deliver([row(1, 1, 0, "x"), row(2, 1, 5, "y"), row(3, 2, 1, "z")])
    run.run_upserts(feed.stream(), path, feed.checkpoint, ["user"], order)
    feed.deliver([row(4, 2, 9, "new"), row(5, 1, 2, "stale")])
    run.run_upserts(feed.stream(), path, feed.checkpoint, ["user"], order)

    def table():
        return as_rows(run.read_upserted(feed.spark, path, feed.stream().schema, ["user"], order), "user", "kind")

    assert table() == [(1, "y"), (2, "new")]
    # The second batch again, as after a crash between writing and committing.
    batch = run._retyped(
        feed.spark.createDataFrame([row(4, 2, 9, "new"), row(5, 1, 2, "stale")], SCHEMA),
        T.TimestampNTZType,
        "timestamp",
    )
    run.upsert_sink(feed.spark, path, feed.stream().schema, ["user"], order)(batch, 1)
    assert table() == [(1, "y"), (2, "new")]


def test_state_is_kept_on_disk_and_batches_are_bounded(spark, sf_dir):
    from tidemill.session import SQL_SETTINGS

    provider = "spark.sql.streaming.stateStore.providerClass"
    assert spark.conf.get(provider) == SQL_SETTINGS[provider] and "RocksDB" in SQL_SETTINGS[provider]
    assert run.MAX_FILES >= 1


def test_totals_go_on_after_a_restart(feed, tmp_path):
    path = str(tmp_path / "totals")

    def totals():
        return ops.stream_totals(feed.stream(), "user", "ts", "id", "kind")

    for rows in ([row(1, 1, 5, "x"), row(2, 1, 3, "y"), row(3, None, 1, "n")], [row(4, 1, 5, "z"), row(5, 2, 0, "q")]):
        feed.deliver(rows)
        run.run_upserts(totals(), path, feed.checkpoint, ["user"], ["n_events"], mode="update")
    got = run.read_upserted(feed.spark, path, totals().schema, ["user"], ["n_events"]).collect()
    assert {(r.user, r.n_events, r.last_event) for r in got} == {(1, 3, "z"), (2, 1, "q"), (None, 1, "n")}
