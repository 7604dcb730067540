"""Versions and their commit files: crashes, replays, conflicts, bounded reads."""

import os
from datetime import datetime, timedelta

import pytest

from pyspark.sql import types as T
from tidemill.sources import files
from tidemill.sources.commits import CommitConflict, CommitLog
from tidemill.sources.keyed import KeyedTable

SCHEMA = T.StructType([
    T.StructField("k", T.LongType()), T.StructField("t", T.LongType()), T.StructField("v", T.StringType())
])
CHANGES = "k long, t long, v string, gone boolean"
T0 = datetime(2024, 1, 1)


class Crash(RuntimeError):
    pass


def die(*_):
    raise Crash


def keyed(spark, path, **options):
    return KeyedTable(spark, str(path), SCHEMA, ["k"], ["t"], delete_flag="gone", buckets=4, **options)


def changes(spark, *rows):
    return spark.createDataFrame([(*r, False)[:4] for r in rows], CHANGES)


def test_log_commits_a_number_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.last() == (-1, None) and log.numbers() == []
    log.add(0, {"a": "ä"})
    with pytest.raises(CommitConflict):
        log.add(0, {"a": 2})
    log.add(1, {"b": [1, 2]})
    assert log.last() == (1, {"b": [1, 2]}) and log.read(0) == {"a": "ä"}
    # Nothing else stays, and drafts of dead writers are no commits.
    (tmp_path / "log" / "_draft").write_text("{")
    assert log.numbers() == [0, 1]
    assert not [f for f in os.listdir(tmp_path / "log") if f.startswith("_") and f != "_draft"]


def test_a_dead_writer_leaves_the_old_version(spark, tmp_path, as_rows, monkeypatch):
    table = keyed(spark, tmp_path)
    assert table.version == -1 and table.read().count() == 0
    table.replace(spark.createDataFrame([(k, 1, "old") for k in range(20)], SCHEMA))
    before = as_rows(table.read())
    batch = changes(spark, (1, 2, "new"), (2, 2, None, True), (3, 0, "stale"), (50, 1, "added"))
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "add", die)
        for write in (table.upsert, lambda b: table.add(b, 7), table.replace):
            with pytest.raises(Crash):
                write(batch)
    assert table.version == 0 and as_rows(table.read()) == before
    table.upsert(batch)
    want = sorted([(k, 1, "old") for k in range(20) if k not in (1, 2)] + [(1, 2, "new"), (50, 1, "added")], key=repr)
    assert as_rows(table.read()) == want and as_rows(table.read(0)) == before
    # What the dead writers left goes, and what only the first version used.
    assert table.vacuum(keep=2) == 3 and as_rows(table.read(0)) == before
    assert table.vacuum() > 0 and as_rows(table.read()) == want and table.vacuum() == 0


def test_a_batch_twice_is_a_batch_once(spark, tmp_path, as_rows):
    rows = spark.createDataFrame([(k, 1, "old") for k in range(9)], SCHEMA)
    batch = changes(spark, (1, 1, "same time"), (2, 5, None, True), (3, 4, "x"), (3, 6, "y"), (None, 1, "null key"))
    states = []
    for i, batches in enumerate(([1], [1, 1], [None, None])):
        table = keyed(spark, tmp_path / str(i))
        table.replace(rows)
        for n in batches:
            table.upsert(batch, n)
        states.append((as_rows(table.read()), table.version))
    assert states[0] == states[1] and states[0][0] == states[2][0]
    assert (None, 1, "null key") in states[0][0]


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    table = keyed(spark, tmp_path)
    table.replace(spark.createDataFrame([(k, 1, "old") for k in range(100)], SCHEMA))
    first = table.log.last()[1]["buckets"]
    table.upsert(changes(spark, (5, 2, "new")))
    second = table.log.last()[1]["buckets"]
    assert len(first) == 4 and sum(first[b] != second[b] for b in first) == 1
    # A bucket that loses its last row has no folder any more.
    table.upsert(changes(spark, *[(k, 3, None, True) for k in range(100)]))
    assert table.read().count() == 0 and table.log.last()[1]["buckets"] == {}


def test_two_writers_do_not_mix(spark, tmp_path, as_rows):
    one, two = keyed(spark, tmp_path), keyed(spark, tmp_path)
    one.replace(spark.createDataFrame([(1, 1, "a")], SCHEMA))
    commit = two.log.add
    two.log.add = lambda number, entry: (one.upsert(changes(spark, (2, 1, "b"))), commit(number, entry))
    with pytest.raises(CommitConflict):
        two.upsert(changes(spark, (3, 1, "c")))
    assert as_rows(one.read()) == [(1, 1, "a"), (2, 1, "b")]


def test_a_read_touches_a_bounded_number_of_folders(spark, tmp_path, as_rows):
    table, want = keyed(spark, tmp_path, max_changes=3), {}
    for n in range(11):
        batch = [(k, n, f"{n}") for k in (n, n + 1, 0)]
        table.add(changes(spark, *batch), n)
        table.add(changes(spark, (0, 99, "replayed")), n)
        want |= {k: (k, t, v) for k, t, v in batch}
        state = table.log.last()[1]
        assert len(state["changes"]) < 3 and len(state["buckets"]) <= 4
        assert len({os.path.dirname(f) for f in table.read().inputFiles()}) <= 4 + 2
        assert as_rows(table.read()) == sorted(want.values(), key=repr)
    table.upsert(changes(spark, (0, 100, None, True)), 11)
    assert table.log.last()[1]["changes"] == [] and as_rows(table.read().filter("k = 0")) == []


def test_a_crash_while_folding_changes_nothing(spark, tmp_path, as_rows, monkeypatch):
    table = keyed(spark, tmp_path, max_changes=2)
    table.add(changes(spark, (1, 1, "a")), 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "merge", die)
        with pytest.raises(Crash):
            table.add(changes(spark, (2, 1, "b")), 1)
    # The batch was committed; its replay does nothing, the next one folds all.
    assert table.add(changes(spark, (2, 9, "again")), 1) == 1
    table.add(changes(spark, (1, 2, "c")), 2)
    assert table.log.last()[1]["changes"] == [] and as_rows(table.read()) == [(1, 2, "c"), (2, 1, "b")]


def source(spark, hours):
    return spark.createDataFrame([(i, T0 + timedelta(hours=i)) for i in hours], "id int, ts timestamp_ntz")


def test_a_dead_load_is_recognised(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    files.load_incremental(source(spark, range(4)), path, "ts")
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "add", die)
        with pytest.raises(Crash):
            files.load_incremental(source(spark, range(8)), path, "ts")
    loads = files.Loads(spark, path)
    assert len(loads.abandoned()) == 1 and loads.read(source(spark, [0]).schema).count() == 4
    again = files.load_incremental(source(spark, range(8)), path, "ts")
    assert sorted(r.id for r in again.collect()) == list(range(8))
    assert len(loads.all()) == 2 and len(loads.abandoned()) == 1


def test_a_load_does_not_read_the_target(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    files.load_incremental(source(spark, range(4)), path, "ts")
    read = []
    monkeypatch.setattr(files.Loads, "read", lambda self, schema, loads=None: read.append(loads) or source(spark, []))
    before = set(spark.read.parquet(path + "/load-*").inputFiles())
    files.load_incremental(source(spark, range(6)), path, "ts")
    assert read == [None]  # only the result
    fresh = set(spark.read.parquet(path + "/load-*").inputFiles()) - before
    assert sorted(r.id for r in spark.read.parquet(*fresh).collect()) == [4, 5]


def test_an_overlap_reads_near_loads_only(spark, tmp_path, monkeypatch):
    path, read = str(tmp_path / "t"), []
    for hours in ([0, 1], [10, 12], [20, 21]):
        files.load_incremental(source(spark, hours), path, "ts")
    plain = files.Loads.read
    monkeypatch.setattr(files.Loads, "read", lambda self, schema, loads=None: read.append(loads) or plain(self, schema, loads))
    got = files.load_incremental(source(spark, [0, 5, 11, 12, 21]), path, "ts", keys=["id"], overlap=timedelta(hours=10.5))
    assert [len(x) for x in read if x is not None] == [2]
    assert sorted(r.id for r in got.collect()) == [0, 1, 10, 11, 12, 20, 21]


def test_many_loads_are_listed_from_two_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FULL_LIST", 3)
    loads = files.Loads(spark, str(tmp_path))
    for n in range(11):
        loads.add(n - 1, {"folder": f"load-{n}"}, str(n))
        assert [x["folder"] for x in loads.all()] == [f"load-{i}" for i in range(n + 1)]
        assert len(loads.last()[1]["loads"]) <= (n + 1 if n % 3 == 0 else 2)
