"""Operators over keys forced through the hot path, against the plain path or Python."""

import itertools
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F
from tidemill.operators import aggregate, clean, events, joins, nested, windows

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def feed(spark):
    """Events of which one user has half, some at equal times, one user null."""
    rng = random.Random(3)
    rows = []
    for i in range(500):
        user = rng.choice([1, 1, 1, 2, None, 3, 4, 5])
        at = T0 + timedelta(hours=rng.randint(0, 400), minutes=rng.choice([0, 30]))
        rows.append((i, user, at, rng.choice("abc"), rng.choice([None, 0.25, 1.5, 2.0])))
    schema = "id bigint, user bigint, ts timestamp_ntz, kind string, value double"
    df = spark.createDataFrame(rows, schema).repartition(3)
    df.rows = rows
    return df


@pytest.mark.parametrize("max_rows", [30, 3])
def test_moving_sum(feed, as_rows, max_rows):
    span = timedelta(days=2)
    args = (feed, ["user"], "ts", "value", span)
    got = as_rows(windows.moving_sum(*args, cells=8, frame_rows=20, max_rows=max_rows))
    assert got == as_rows(windows.moving_sum(*args, frame_rows=None))
    by_id = {r[0]: r[-1] for r in got}
    for i, user, at, _, _ in feed.rows:
        inside = [
            v for _, u, t, _, v in feed.rows
            if u == user and at - span <= t <= at and v is not None
        ]
        assert by_id[i] == (sum(inside) if inside else None)


def test_running_total_and_scd2(feed, as_rows):
    args = (feed, ["user"], ["ts", "id"], "value")
    got = as_rows(windows.running_total(*args, max_rows=20))
    assert got == as_rows(windows.running_total(*args, max_rows=None))

    history = as_rows(windows.scd2(feed, ["user"], "ts", ["kind"], tie=["id"], max_rows=20))
    assert history == as_rows(
        windows.scd2(feed, ["user"], "ts", ["kind"], tie=["id"], max_rows=None)
    )
    want = []
    ordered = sorted(feed.rows, key=lambda r: (r[1] is None, r[1] or 0, r[2], r[0]))
    for user, rows in itertools.groupby(ordered, key=lambda r: r[1]):
        runs = [(kind, next(g)[2]) for kind, g in itertools.groupby(rows, key=lambda r: r[3])]
        for (kind, start), (_, end) in zip(runs, [*runs[1:], (None, None)]):
            want.append((user, kind, start, end, end is None))
    assert history == sorted(want, key=repr)


def test_ranks_with_ties(spark, as_rows):
    rng = random.Random(5)
    rows = [(i, rng.choice("xxxy"), rng.choice([1, 1, 1, 2, 3, 4, None])) for i in range(203)]
    rows += [(1000, "single", 7)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    for tiles in (4, 250):
        got = as_rows(windows.ranks(df, ["g"], "v", "id", tiles, max_rows=0))
        assert got == as_rows(windows.ranks(df, ["g"], "v", "id", tiles, max_rows=None))


def test_percentiles(spark, as_rows):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([1.0, 1.0, 2.5, 9.0, None, rng.random()]))
            for _ in range(400)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p90": 0.9, "hi": 1.0}
    plain = as_rows(aggregate.percentiles(df, ["g"], "v", ps, max_rows=None))
    hot = as_rows(aggregate.percentiles(df, ["g"], "v", ps, max_rows=10))
    assert len(plain) == len(hot) == 4
    for a, b in zip(plain, hot):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])
    approx = {r[0]: r for r in as_rows(aggregate.percentiles(df, ["g"], "v", ps, exact=False))}
    assert approx["one"][1:] == (4.0,) * 5


def test_outliers(spark):
    df = spark.createDataFrame(
        [("a", float(v)) for v in [10, 11, 12, 13, 100]] + [(None, 1.0), (None, 1.0), (None, 50.0)],
        "g string, v double",
    )
    for limit in (2_000_000, 2):
        flagged = clean.flag_outliers(df, "v", ["g"], max_rows=limit)
        assert {(r.g, r.v) for r in flagged.filter("is_outlier").collect()} == {("a", 100.0)}
        assert flagged.count() == 8


@pytest.mark.parametrize("tolerance", [None, timedelta(hours=10)])
@pytest.mark.parametrize("max_rows", [None, 20])
def test_asof(feed, tolerance, max_rows):
    left = feed.filter("kind = 'a'").select("id", "user", "ts")
    right = feed.filter("kind = 'b'").select("user", "ts", F.col("id").alias("rid"), "value")
    cols = {"rid": "right_id", "value": "right_value"}
    got = joins.asof_join(left, right, "ts", ["user"], cols, tolerance, max_rows).collect()
    rights = [r for r in feed.rows if r[3] == "b"]
    lefts = [r for r in feed.rows if r[3] == "a"]
    assert len(got) == len(lefts)
    by_id = {r.id: (r.right_id, r.right_value) for r in got}
    for i, user, at, _, _ in lefts:
        seen = [r for r in rights if user is not None and r[1] == user and r[2] <= at]
        if not seen:
            assert by_id[i] == (None, None)
            continue
        best = max(seen, key=lambda r: (r[2], r[0]))
        near = tolerance is None or best[2] >= at - tolerance
        assert by_id[i] == ((best[0], best[4]) if near else (None, None))


@pytest.mark.parametrize("salts", [1, 3])
def test_interval_join_counts_each_pair_once(feed, salts):
    within = timedelta(hours=7)
    left = feed.filter("kind = 'a'").select("id", "user", "ts")
    right = feed.filter("kind = 'b'").select(
        F.col("id").alias("rid"), F.col("user").alias("ruser"), F.col("ts").alias("rts")
    )
    got = joins.interval_join(left, right, {"user": "ruser"}, "ts", "rts", within, salts)
    pairs = Counter((r.id, r.rid) for r in got.collect())
    want = {
        (a[0], b[0])
        for a in feed.rows for b in feed.rows
        if a[3] == "a" and b[3] == "b" and a[1] is not None and a[1] == b[1]
        and a[2] <= b[2] <= a[2] + within
    }
    assert set(pairs) == want and set(pairs.values()) == {1}


@pytest.mark.parametrize("direct_items", [100, 6, 2])
@pytest.mark.parametrize("min_n", [1, 2, 3])
def test_pairs_with_a_group_that_has_a_third_of_all_rows(spark, direct_items, min_n):
    rng = random.Random(11)
    rows = [("hot", i) for i in range(40)] + [("hot2", i) for i in range(20, 45)]
    rows += [(f"g{rng.randint(1, 15)}", rng.randint(0, 50)) for _ in range(70)]
    rows += [("dup", 1)] * 30 + [("dup", 2), (None, 3), ("g1", None)]
    df = spark.createDataFrame(rows, "g string, i int")
    groups = defaultdict(set)
    for g, i in rows:
        if g is not None and i is not None:
            groups[g].add(i)
    want = Counter(p for items in groups.values() for p in itertools.combinations(sorted(items), 2))
    got = joins.pairs(df, "g", "i", min_n, direct_items).collect()
    assert {(r.a, r.b): r.n for r in got} == {p: n for p, n in want.items() if n >= min_n}
    assert len(got) == len({(r.a, r.b) for r in got})


@pytest.mark.parametrize("direct_items", [100, 6])
def test_pairs_are_counted_in_more_tasks_where_there_are_more(spark, monkeypatch, direct_items):
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    rows = [(g, (g * 7 + i) % 90) for g in range(400) for i in range(5)] + [(g, i) for g in range(400) for i in (90, 91)]
    df = spark.createDataFrame(rows + [(1, i) for i in range(30)], "g int, i int").repartition(2)
    groups = defaultdict(set)
    for g, i in rows + [(1, i) for i in range(30)]:
        groups[g].add(i)
    want = Counter(p for items in groups.values() for p in itertools.combinations(sorted(items), 2))
    got = joins.pairs(df, "g", "i", 3, direct_items)
    assert {(r.a, r.b): r.n for r in got.collect()} == {p: n for p, n in want.items() if n >= 3}
    if direct_items == 100:
        n_pairs = sum(len(x) * (len(x) - 1) // 2 for x in groups.values())
        assert got.rdd.getNumPartitions() >= n_pairs // 100


def test_paths_and_nests_come_in_bounded_parts(feed, as_rows):
    for max_rows in (None, 25):
        parts = aggregate.paths(feed, ["user"], ["ts", "id"], "kind", "", steps=7, max_rows=max_rows).collect()
        assert max(p.n_steps for p in parts) == 7
        joined = defaultdict(str)
        for p in sorted(parts, key=lambda p: p.part):
            joined[p.user] += p.path
        for user, path in joined.items():
            mine = sorted((r[2], r[0], r[3]) for r in feed.rows if r[1] == user)
            assert path == "".join(k for _, _, k in mine)

        cols = ["id", "ts", "kind", "value"]
        boxed = nested.nest(feed, ["user"], cols, ["ts", "id"], size=7, max_rows=max_rows)
        assert boxed.agg(F.max(F.size("items"))).first()[0] == 7
        assert as_rows(nested.unnest(boxed, "items").select(*feed.columns)) == as_rows(feed)


def test_sessions_equal_sessions_by_hand(feed):
    gap = timedelta(hours=6)
    got = events.sessionize(feed.filter("user IS NOT NULL"), ["user"], "ts", gap).collect()
    want = []
    for user in {r[1] for r in feed.rows if r[1] is not None}:
        times = sorted(r[2] for r in feed.rows if r[1] == user)
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > gap:
                want.append((user, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        want.append((user, start, last, n))
    assert sorted(tuple(r) for r in got) == sorted(want)
