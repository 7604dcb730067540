"""Cleaning, quality, change batches: hand-made frames with exact results."""

from datetime import datetime

import pytest

from pyspark.sql import functions as F
from tidemill.functions import text
from tidemill.operators import clean, quality


def test_quarantine_splits_and_names_reasons(spark, as_rows):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None), (-4, -1)], "a int, b int")
    good, bad = clean.quarantine(df, {"a_positive": F.col("a") > 0, "b_positive": F.col("b") > 0})
    assert as_rows(good) == [(1, 5)]
    assert as_rows(bad) == sorted(
        [(2, -1, ["b_positive"]), (3, None, ["b_positive"]), (-4, -1, ["a_positive", "b_positive"])],
        key=repr,
    )
    assert good.count() + bad.count() == df.count()


def test_dedup_exact_keeps_lowest_and_counts(spark, as_rows):
    df = spark.createDataFrame(
        [(3, "x", None), (1, "x", None), (2, "y", "z"), (5, None, "q"), (4, None, "q")],
        "id int, t string, u string",
    )
    assert as_rows(clean.dedup_exact(df, ["t"], "id"), "id", "copies") == [(1, 2), (2, 1), (4, 2)]
    # ("a", null) and (null, "a") are different values.
    pair = spark.createDataFrame([(1, "a", None), (2, None, "a")], "id int, t string, u string")
    assert clean.dedup_exact(pair, ["t", "u"], "id").count() == 2


def test_dedup_latest_with_null_key(spark, as_rows):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (None, 1, "c"), (None, 2, "d")], "k int, t int, v string")
    assert as_rows(clean.dedup_latest(df, ["k"], [F.col("t").desc()])) == [(1, 7, "b"), (None, 2, "d")]


def test_standardize_and_safe_cast(spark, as_rows):
    df = spark.createDataFrame([("  Big \t RED ", "12"), ("blue", "x1"), (None, None)], "c string, n string")
    coded = clean.standardize(df, {"c": {"big red": "BR"}})
    assert as_rows(coded, "c", "c_known") == sorted(
        [("BR", True), ("blue", False), (None, False)], key=repr
    )
    cast = clean.safe_cast(df, "n", "int")
    assert as_rows(cast, "n", "n_failed") == sorted(
        [(12, False), (None, True), (None, False)], key=repr
    )


def test_fill_missing_keeps_types(spark):
    df = spark.createDataFrame([(None, None), (1, 2.5)], "a bigint, b double")
    filled = clean.fill_missing(df, {"a": 0, "b": 0})
    assert filled.dtypes == df.dtypes
    assert {tuple(r) for r in filled.collect()} == {(0, 0.0), (1, 2.5)}


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("Mail a.b@x.example.com or c@d.org, call (555) 123-4567 or 555.123.4567!",), ("none @ all",), (None,)],
        "t string",
    )
    got = [r.t for r in text.redact(df, "t").collect()]
    assert got == ["Mail [EMAIL] or [EMAIL], call [PHONE] or [PHONE]!", "none @ all", None]
    urls = spark.createDataFrame(
        [("HTTPS://WWW.Example.COM/A/b?x=1#top",), ("http://h.org",), ("no scheme/Path?q",)], "u string"
    )
    assert [r.url_norm for r in text.normalize_urls(urls, "u").collect()] == [
        "https://www.example.com/A/b",
        "http://h.org",
        "no scheme/Path",
    ]


def test_profile_counts_nulls_and_empty(spark, as_rows):
    df = spark.createDataFrame([(1, "b"), (1, None), (None, "a")], "n int, s string")
    want = [("n", 3, 1, 1, "1", "1"), ("s", 3, 1, 2, "a", "b")]
    assert as_rows(quality.profile(df)) == want
    assert as_rows(quality.profile(df.limit(0)))[0] == ("n", 0, 0, 0, None, None)


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "z", 50), (2, None, None), (9, "a", 1)], "k int, s string, n int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    checks = [
        quality.NotNull("s"),
        quality.InSet("s", ("a", "b")),
        quality.InRange("n", 0, 10),
        quality.Unique(("k",)),
        quality.ForeignKey("k", parent, "id"),
    ]
    got = {r.check_name: (r.n_failed, r.passed) for r in quality.expect(df, checks).collect()}
    assert got == {
        "not_null(s)": (1, False),
        "in_set(s)": (1, False),
        "in_range(n)": (1, False),
        "unique(k)": (1, False),
        "foreign_key(k)": (1, False),
    }
    empty = quality.expect(df.limit(0), checks)
    assert all(r.passed for r in empty.collect())


def test_reconcile_handles_nulls_and_repeats(spark, as_rows):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "c"), (4, "d"), (4, "d"), (5, "e")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "now"), (4, "d"), (5, "e"), (6, "f")], "k int, v string")
    assert as_rows(quality.reconcile(a, b, ["k"])) == [
        (2, "changed"),
        (3, "missing"),
        (4, "changed"),
        (6, "extra"),
    ]
    assert quality.reconcile(a, a, ["k"]).count() == 0


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 10, "c"), (None, 10, "n")], "k int, t int, v string")


def test_upsert(spark, target, as_rows):
    changes = spark.createDataFrame(
        [
            (1, 11, "a2", False),
            (1, 12, "a3", False),  # newest of two
            (2, 9, "stale", True),  # older than the target: no effect
            (3, 11, "gone", True),
            (4, 1, "new", None),
            (5, 1, "born", False),
            (5, 2, "dead", True),
            (None, 10, "n2", False),  # null key, equal time: the change wins
        ],
        "k int, t int, v string, deleted boolean",
    )
    once = quality.upsert(target, changes, ["k"], ["t"], "deleted")
    assert as_rows(once) == sorted(
        [(1, 12, "a3"), (2, 10, "b"), (4, 1, "new"), (None, 10, "n2")], key=repr
    )
    plain = changes.filter("not coalesce(deleted, false)")
    once = quality.upsert(target, plain, ["k"], ["t"], "deleted")
    assert as_rows(quality.upsert(once, plain, ["k"], ["t"], "deleted")) == as_rows(once)
    assert as_rows(quality.upsert(target, changes.limit(0), ["k"], ["t"])) == as_rows(target)


def test_growth_gap_is_null(spark, as_rows):
    from tidemill.operators.windows import growth

    df = spark.createDataFrame([(datetime(y, 1, 1),) for y in (2000, 2000, 2001, 2003)], "d timestamp_ntz")
    got = as_rows(growth(df, F.year("d"), F.count(F.lit(1))))
    assert got == [(2000, 2, None, None), (2001, 1, 2, -1), (2003, 1, None, None)]
