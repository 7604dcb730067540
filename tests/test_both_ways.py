"""Operators with a limit on key size: rows and schema are the same on either side of it."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from pyspark.sql import functions as F
from tidemill.functions import text
from tidemill.operators import aggregate, clean, joins, windows
from tidemill.schemas import TABLES
from tidemill.sources.ingest import ingest, parse_lines

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in key, time and value, decimals, ties, one key with most rows."""
    rows = []
    for i in range(240):
        key = None if i % 11 == 0 else 1 if i % 3 else i % 5
        ts = None if i % 13 == 0 else T0 + timedelta(seconds=(i * 37) % 90_000 // 2)
        value = None if i % 7 == 0 else Decimal(i % 40) / 4
        rows.append((i, key, ts, value, float(value) if value is not None else None))
    return spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz, d decimal(10,2), v double").repartition(3)


def same(as_rows, a, b):
    assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
    assert as_rows(a) == as_rows(b)


@pytest.mark.parametrize("col", ["d", "v"])
@pytest.mark.parametrize("span", [timedelta(seconds=1), timedelta(hours=1), timedelta(days=1)])
def test_moving_sum(odd, as_rows, span, col):
    args = (odd, ["k"], "ts", col, span)
    same(as_rows, windows.moving_sum(*args, frame_rows=20, max_rows=15), windows.moving_sum(*args, frame_rows=None))


def test_moving_sum_refuses_bad_spans_before_it_looks(odd):
    for limit in (None, 20):
        with pytest.raises(ValueError):
            windows.moving_sum(odd, ["k"], "ts", "v", timedelta(0), frame_rows=limit)


@pytest.mark.parametrize("col", ["d", "v"])
def test_running_total_and_ranks(odd, as_rows, col):
    for limit in (10, 60):
        same(
            as_rows,
            windows.running_total(odd, ["k"], ["ts", "id"], col, max_rows=limit),
            windows.running_total(odd, ["k"], ["ts", "id"], col, max_rows=None),
        )
        same(as_rows, windows.ranks(odd, ["k"], col, "id", 4, limit), windows.ranks(odd, ["k"], col, "id", 4, None))


def test_other_limits(odd, as_rows):
    for limit in (10, None):
        parts = aggregate.paths(odd, ["k"], ["ts", "id"], "d", max_rows=limit).collect()
        assert all(p.path.count(">") == p.n_steps - 1 for p in parts) and any("?" in p.path for p in parts)
    same(
        as_rows,
        windows.scd2(odd, ["k"], "ts", ["d"], tie=["id"], max_rows=10),
        windows.scd2(odd, ["k"], "ts", ["d"], tie=["id"], max_rows=None),
    )


def test_top_k_beyond_the_group_limit(odd, as_rows, spark):
    order = [F.col("id").desc()]
    want = as_rows(windows.top_k(odd, ["k"], order, 5))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "4")
    try:
        got = windows.top_k(odd, ["k"], order, 5, max_rows=20)
        assert got.schema["rn"].dataType.simpleString() == "int"
        assert as_rows(got) == want
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_asof_ignores_null_keys_and_times(spark):
    left = spark.createDataFrame([(1, None, T0), (2, 7, T0), (3, 7, None)], "id int, k int, ts timestamp_ntz")
    right = spark.createDataFrame([(9, None, T0), (8, 7, None)], "rid int, k int, ts timestamp_ntz")
    for limit in (None, 0):
        got = joins.asof_join(left, right, "ts", ["k"], {"rid": "rid"}, max_rows=limit).collect()
        assert sorted((r.id, r.rid) for r in got) == [(1, None), (2, None), (3, None)]


def test_interval_of_no_length(spark):
    left = spark.createDataFrame([(1, T0)], "k int, a timestamp_ntz")
    right = spark.createDataFrame([(1, T0), (1, T0 + timedelta(microseconds=1))], "q int, b timestamp_ntz")
    assert joins.interval_join(left, right, {"k": "q"}, "a", "b", timedelta(0)).count() == 1


def test_csv_columns_are_found_by_name(spark, tmp_path, as_rows):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("a int, b string, c double")
    path = tmp_path / "in"
    path.mkdir()
    (path / "x.csv").write_text('"b",a\nhello,1\n"a, b",2\nbad,x\n\n')
    good, rejects = ingest(spark, str(path), "csv", schema)
    assert as_rows(good) == [(1, "hello", None), (2, "a, b", None)]
    assert [r.raw for r in rejects.collect()] == ["bad,x"]
    (path / "x.csv").write_text("b,a,zzz\n")
    with pytest.raises(ValueError, match="zzz"):
        ingest(spark, str(path), "csv", schema)
    one = tmp_path / "one"
    one.mkdir()
    (one / "x.csv").write_text("v\nq\n\nr\n")
    kept = parse_lines(spark, str(one), "csv", T.StructType.fromDDL("v string"))
    assert sorted(map(str, (r.v for r in kept.collect()))) == ["None", "q", "r"]
    assert TABLES["orders"].names[0] == "o_orderkey"


def test_addresses_keep_user_and_password(spark):
    urls = spark.createDataFrame([("HTTP://Me:Pw@Host.COM/Path?x#y",), ("https://A.b",), (None,)], "u string")
    got = [r.url_norm for r in text.normalize_urls(urls, "u").collect()]
    assert got == ["http://Me:Pw@host.com/Path", "https://a.b", None]


def test_codes_from_a_table(spark, as_rows):
    df = spark.createDataFrame([(1, " Red "), (2, "blue"), (3, None)], "id int, c string")
    codes = spark.createDataFrame([("red", "R"), ("red", "R"), ("green", "G")], "v string, code string")
    by_table = clean.standardize(df, {"c": codes})
    assert as_rows(by_table) == [(1, "R", True), (2, "blue", False), (3, None, False)]
    assert as_rows(by_table) == as_rows(clean.standardize(df, {"c": {"red": "R", "green": "G"}}))


def test_hot_plans_read_the_source_at_most_twice(spark, odd, tmp_path):
    """Once for ordinary keys; hot rows were read before, when they were written out."""
    odd.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plans = [
        windows.ranks(df, ["k"], "v", "id", 4, 20),
        aggregate.percentiles(df, ["k"], "v", {"p": 0.5}, max_rows=20),
        windows.moving_sum(df, ["k"], "ts", "v", timedelta(hours=1), frame_rows=20, max_rows=15),
    ]
    for plan in plans:
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("id#") and plan.inputFiles()
        scans = plan._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/t")
        assert scans <= 2, scans
