"""Laws that hold for any input, tried on generated ones."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import clean, events, joins, nested, quality, windows

T0 = datetime(2024, 1, 1)
LAW = settings(
    max_examples=6,
    deadline=None,
    derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
KEYS = st.one_of(st.none(), st.integers(0, 3))
EVENTS = st.lists(st.tuples(KEYS, st.integers(0, 60), st.sampled_from("ab")), min_size=1, max_size=40)


def frame(spark, drawn):
    rows = [(i, k, T0 + timedelta(hours=h), v) for i, (k, h, v) in enumerate(drawn)]
    return spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz, v string")


@LAW
@given(EVENTS)
def test_history_intervals_follow_each_other(spark, drawn):
    df = frame(spark, drawn)
    runs = windows.scd2(df, ["k"], "ts", ["v"], tie=["id"], max_rows=5)
    w = Window.partitionBy("k").orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    after = runs.withColumn("next", F.lead("valid_from").over(w))
    assert after.filter("NOT valid_to <=> next").count() == 0
    assert runs.filter("is_current").count() == df.select("k").distinct().count()


@LAW
@given(EVENTS, EVENTS)
def test_applying_changes_twice_is_applying_them_once(spark, before, changes):
    target = clean.dedup_latest(frame(spark, before), ["k"], [F.col("ts").desc(), F.col("id").desc()])
    order = ["ts", "id"]
    once = quality.upsert(target, frame(spark, changes), ["k"], order)
    twice = quality.upsert(once, frame(spark, changes), ["k"], order)
    assert quality.reconcile(once, twice, ["k"]).count() == 0


@LAW
@given(EVENTS)
def test_sessions_hold_every_event_once(spark, drawn):
    df, gap = frame(spark, drawn), timedelta(hours=5)
    found = events.sessionize(df, ["k"], "ts", gap)
    assert found.agg(F.sum("n_events")).first()[0] == df.count()
    w = Window.partitionBy("k").orderBy("session_start")
    apart = found.withColumn("quiet", F.col("session_start") - F.lag("session_end").over(w))
    assert apart.filter(F.col("quiet") <= F.lit(gap)).count() == 0


@LAW
@given(EVENTS)
def test_unnesting_restores_rows(spark, drawn):
    df = frame(spark, drawn)
    boxed = nested.nest(df, ["k"], ["id", "ts", "v"], ["ts", "id"], size=3, max_rows=6)
    back = nested.unnest(boxed, "items").select(*df.columns)
    assert quality.reconcile(df, back, ["id"]).count() == 0


@LAW
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=40), st.integers(1, 3))
def test_pairs_do_not_depend_on_the_way(spark, drawn, min_n):
    df = spark.createDataFrame(drawn, "g int, i int")
    direct = joins.pairs(df, "g", "i", min_n)
    other = joins.pairs(df, "g", "i", min_n, direct_items=2)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, other.collect()))
