"""Joins, aggregates, sets, event time and nested values on small frames."""

import math
import random
from datetime import date, datetime, timedelta

import pytest

from pyspark.sql import functions as F
from tidemill.operators import aggregate, events, joins, nested, sets, windows

N = 1


def test_semi_and_anti_with_nulls_and_repeats(spark, as_rows):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (1,), (1,), (None,), (7,)], "y int")
    assert as_rows(joins.having_match(a, b, {"x": "y"})) == [(1,), (1,)]
    assert as_rows(joins.without_match(a, b, {"x": "y"})) == [(2,), (None,)]


def test_band_join_overlap_edges_and_gaps(spark, as_rows):
    bands = spark.createDataFrame(
        [("low", -1.0, 10.0), ("mid", 5.0, 20.0), ("empty", 30.0, 30.0), ("back", 9.0, 1.0)], "band string, lo double, hi double"
    )
    df = spark.createDataFrame([(-1.0,), (5.0,), (10.0,), (20.0,), (30.0,), (None,)], "v double")
    got = as_rows(joins.band_join(df, bands, "v"), "v", "band")
    assert got == sorted([(-1.0, "low"), (5.0, "low"), (5.0, "mid"), (10.0, "mid")], key=repr)
    assert joins.band_join(df, bands.limit(0), "v").count() == 0 == joins.band_join(df.limit(0), bands, "v").count()


def test_band_join_of_all_widths_equals_a_nested_loop(spark):
    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    number = lambda: rng.choice([0.0, rng.uniform(-1, 1), rng.uniform(-1, 1) * 10 ** rng.uniform(-12, 12)])
    values = [number() for _ in range(300)] + [inf, -inf, nan, 1.7e308, -1.7e308, 5e-324, -0.0]
    bands = [(i, *sorted((number(), number()))) for i in range(150)]
    bands += [(200 + i, v, v + abs(v) * 1e-15) for i, v in enumerate(values[:20])]
    edges = [None, inf, -inf, -1.7e308, 1.7e308, 0.0, nan]
    bands += [(300 + i, a, b) for i, (a, b) in enumerate((a, b) for a in edges for b in edges)]
    # Spark and SQL alike: NaN is above all other numbers.
    less = lambda a, b: (not math.isnan(a)) and (math.isnan(b) or a < b)
    want = sorted((i, n) for n, lo, hi in bands for i, v in enumerate(values)
                  if (lo is None or not less(v, lo)) and (hi is None or less(v, hi)))
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    joined = joins.band_join(df, spark.createDataFrame(bands, "band int, lo double, hi double"), "v")
    assert sorted((r.i, r.band) for r in joined.collect()) == want
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_a_wide_band_is_listed_a_few_times(spark):
    bands = spark.createDataFrame([(1, 0, 10**9), (2, 5, 6), (3, None, None)], "band int, lo long, hi long")
    df = spark.range(10).selectExpr("id * 100000000 as v")
    joined = joins.band_join(df, bands, "v")
    assert sorted((r.v, r.band) for r in joined.collect()) == sorted((i * 10**8, b) for i in range(10) for b in (1, 3))


def test_densify_fills_every_day(spark, as_rows):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 5)), (1, datetime(2024, 1, 3))], "k int, at timestamp_ntz")
    dims = spark.createDataFrame([(1,), (2,)], "id int")
    got = joins.densify(df, dims, {"id": "k"}, "at", {"n": F.count(F.lit(N))})
    days = [date(2024, 1, d) for d in (1, 2, 3)]
    assert sorted(as_rows(got)) == [(1, d, int(d.day != 2)) for d in days] + [(2, d, 0) for d in days]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_subtotals_tell_null_values_from_totals(spark, as_rows):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x")], "g string, h string")
    m = {"n": F.count(F.lit(N))}
    rolled = aggregate.rollup_totals(df, ["g", "h"], m)
    assert rolled.filter("level_id = 3").first().n == 3
    assert {(r.g, r.n) for r in rolled.filter("level_id = 1").collect()} == {("a", 2), ("b", 1)}
    assert rolled.filter("level_id = 0 AND h IS NULL").first().n == 1
    assert aggregate.cube_totals(df, ["g", "h"], m).count() == 3 + 2 + 2 + 1
    chosen = aggregate.grouping_set_totals(df, [["h"], []], m)
    assert as_rows(chosen, "h", "level_id", "n") == sorted([("x", 0, 2), (None, 0, 1), (None, 1, 3)], key=repr)


def test_histogram_edges(spark, as_rows):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.4,), (2.5,), (9.99,), (10.0,), (None,)], "v double")
    assert as_rows(aggregate.histogram(df, "v", 0.0, 10.0, 4)) == sorted(
        [(0, 1), (1, 2), (2, 1), (4, 1), (5, 1), (None, 1)], key=repr
    )


def test_approx_distinct_within_bound(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("v"), F.lit("g").alias("g"))
    got = aggregate.approx_distinct(df, ["g"], ["v"], rsd=0.02).first().n_v
    assert abs(got - 5000) < 5000 * 0.06
    assert aggregate.distinct_counts(df, ["g"], ["v"]).first().n_v == 5000


def test_pivot_and_unpivot(spark, as_rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "k int, s string")
    assert as_rows(aggregate.pivot_counts(df, ["k"], "s", ["a", "b"])) == [(1, 1, 2), (2, 0, 0)]
    wide = spark.createDataFrame([(1, 10, None)], "k int, p int, q int")
    assert as_rows(aggregate.to_long(wide, ["k"], ["p", "q"])) == [(1, "p", 10), (1, "q", None)]


def test_top_k_and_samples(spark, as_rows):
    df = spark.createDataFrame([(1, v) for v in (5, 9, 9, 1)] + [(None, 3)], "k int, v int")
    top = windows.top_k(df, ["k"], [F.col("v").desc()], 2)
    assert as_rows(top) == sorted([(1, 9, 1), (1, 9, 2), (None, 3, 1)], key=repr)
    many = spark.range(4000).withColumnRenamed("id", "k")
    once = as_rows(windows.hash_sample(many, "k"))
    assert once == as_rows(windows.hash_sample(many.repartition(7), "k")) and 180 < len(once) < 320


def test_first_last_with_null_key(spark, as_rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c")], "k int, t int, v string")
    got = as_rows(windows.first_last(df, ["k"], ["t"], "v"), "t", "first_v", "last_v")
    assert got == [(1, "a", "b"), (1, "c", "c"), (2, "a", "b")]


def test_set_forms(spark, as_rows):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")
    assert as_rows(sets.common(a, b)) == [(1,), (None,)]
    assert as_rows(sets.common(a, b, all=True)) == [(1,), (1,), (None,)]
    assert as_rows(sets.minus(a, b)) == [(2,)]
    assert as_rows(sets.minus(a, b, all=True)) == [(1,), (2,)]
    many = spark.createDataFrame([(1,)] * 25 + [(2,)] * 3, "k int")
    few = spark.createDataFrame([(1,)] * 4 + [(2,)] * 9, "k int")
    for copies in (1, 4, 7, 100):
        got = sets.minus(many, few, all=True, copies=copies)
        assert as_rows(got) == as_rows(many.exceptAll(few)) == [(1,)] * 21
        got = sets.common(many, few, all=True, copies=copies)
        assert as_rows(got) == as_rows(many.intersectAll(few)) == [(1,)] * 4 + [(2,)] * 3
    c = spark.createDataFrame([(5, "x")], "k int, extra string")
    stacked = sets.union_evolved(b, c)
    assert stacked.columns == ["k", "extra"] and stacked.count() == 5


def test_sliding_equals_sparks_own_windows(spark, as_rows):
    rows = [(datetime(2024, 1, d, h),) for d, h in [(1, 0), (1, 23), (2, 5), (4, 12)]]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    two, one = timedelta(days=2), timedelta(days=1)
    own = events._windowed(df, F.window("ts", "2 days", "1 day"), ())
    assert as_rows(events.sliding(df, "ts", two, one)) == as_rows(own)
    odd = events.sliding(df, "ts", timedelta(hours=36), one)
    assert odd.agg(F.sum("n")).first()[0] > 4


def test_funnel_uses_first_step_only(spark, as_rows):
    t = datetime(2024, 1, 1)
    h = timedelta(hours=1)
    rows = [
        (1, t, "view"), (1, t + h, "click"), (1, t + 2 * h, "buy"),
        (2, t, "view"), (2, t + 30 * h, "click"), (2, t + 31 * h, "buy"),  # too late
        (3, t, "click"), (3, t + h, "view"), (3, t + 2 * h, "buy"),  # no click after
        (4, t, "view"), (4, t + h, "buy"), (4, t + 2 * h, "click"),  # wrong order
        (5, t, "view"), (5, t, "click"),  # not after
    ]
    df = spark.createDataFrame(rows, "u int, ts timestamp_ntz, e string")
    got = events.funnel(df, "u", "ts", "e", ["view", "click", "buy"], timedelta(days=1))
    assert as_rows(got) == [(0, "view", 5), (1, "click", 2), (2, "buy", 1)]


def test_retention_cohorts(spark, as_rows):
    week = [datetime(2024, 1, d) for d in (1, 8, 15)]
    rows = [(1, week[0]), (1, week[0]), (1, week[2]), (2, week[1]), (2, week[2]), (3, week[1])]
    df = spark.createDataFrame(rows, "u int, ts timestamp_ntz")
    assert sorted(as_rows(events.retention(df, "u", "ts"))) == [
        (week[0], week[0], 1),
        (week[0], week[2], 1),
        (week[1], week[1], 2),
        (week[1], week[2], 1),
    ]


def test_nested_values(spark, as_rows):
    df = spark.createDataFrame([("A b  a\n", "en"), ("", "en"), (None, "de")], "t string, lang string")
    assert as_rows(nested.word_counts(df, "t", ["lang"])) == [("en", "a", 2), ("en", "b", 1)]
    kinds = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (1, None)], "k int, e string")
    assert nested.count_map(kinds, ["k"], "e").first().counts == {"x": 2, "y": 1}


def test_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = nested.cosine_top_k(df, [2.0, 0.0], 3, "id", "v").collect()
    assert [r.id for r in got] == [1, 3, 2]
    assert [r.cosine for r in got] == pytest.approx([1.0, 0.5**0.5, 0.0])
