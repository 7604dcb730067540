"""User-defined functions and the shape of plans."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from tidemill import session
from tidemill.functions import udf
from tidemill.operators import windows
from tidemill.plans import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_weighted_median():
    def median(values, counts):
        return udf.weighted_median(pd.Series(values, dtype=float), pd.Series(counts))

    assert median([3, 1], [1, 1]) == 2
    assert median([1, 9], [3, 1]) == 1
    assert median([1, 9, 4], [2, 2, 1]) == 4
    assert median([None, 5], [10, 1]) == 5
    assert pd.isna(median([None], [3]))


def test_registered_functions_work_in_sql(spark, as_rows):
    udf.register_scalar(spark, "twice", lambda s: s * 2, "double")
    assert spark.sql("SELECT twice(1.5D) AS v").first().v == 3.0
    udf.register_table_fn(spark, "words_of", udf.Tokens, "pos int, token string")
    got = spark.sql("SELECT id, pos, token FROM VALUES (1, 'a  b'), (2, ''), (3, NULL) AS t(id, s), LATERAL words_of(s)")
    assert as_rows(got) == [(1, 0, "a"), (1, 1, "b")]


def test_token_batches_equal_rows(spark, as_rows):
    udf.register_table_fn(spark, "batches_of", udf.TokenBatches, "doc_id bigint, pos int, token string", True)
    rows = [(1, " x y\n z"), (2, ""), (3, None), (4, "   "), (5, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = as_rows(spark.sql("SELECT * FROM batches_of(TABLE({df}))", df=df))
    assert got == [(1, 0, "x"), (1, 1, "y"), (1, 2, "z"), (5, 0, "one")]


def test_map_groups_cuts_large_groups(spark, as_rows):
    df = spark.range(1000).select("id", F.when(F.col("id") < 950, 1).otherwise(F.col("id")).alias("k"))

    def count(key, rows):
        return pd.DataFrame({"k": [key[0]], "n": [len(rows)], "calls": [1]})

    def counted(max_rows):
        merge = {"n": F.sum, "calls": F.sum}
        got = udf.map_groups(df, ["k"], count, "k bigint, n bigint, calls bigint", "id", merge, max_rows)
        rows = got.collect()
        assert len(rows) == 51
        return {r.k: (r.n, r.calls) for r in rows}

    whole, cut = counted(1000), counted(100)
    assert whole[1] == (950, 1) and cut[1][0] == 950 and cut[1][1] > 5
    assert {k: n for k, (n, _) in whole.items()} == {k: n for k, (n, _) in cut.items()}


def test_quantiles_stay_within_their_bound():
    rng = np.random.default_rng(1)
    for n, size in [(0, 8), (1, 8), (15, 8), (5000, 64), (200_000, 256)]:
        values = rng.permutation(n).astype(float)
        whole, parts = udf.Quantiles(size), [udf.Quantiles(size) for _ in range(7)]
        for chunk in np.array_split(values, 40):
            whole.add(np.append(chunk, np.nan))
            parts[int(rng.integers(7))].add(chunk)
        merged = udf.Quantiles(size)
        for p in parts:
            merged.merge(udf.Quantiles.load(p.dump()))
        for state in (whole, merged):
            assert sum(len(v) << i for i, v in enumerate(state.levels)) == n
            assert len(state.dump()) < 16 * size * 24
            bound = n * max(0, np.log2(max(n, 1) / size)) / (2 * size) + 1
            for q in (0, 0.1, 0.5, 0.99, 1):
                got = state.quantile(q)
                assert np.isnan(got) if n == 0 else abs(got - q * (n - 1)) <= bound
    assert udf.Quantiles().quantile(0.5) != udf.Quantiles().quantile(0.5)


def test_partial_aggregate_of_a_large_domain(spark, as_rows):
    df = spark.range(0, 300_000, 1, 6).selectExpr("id % 3 = 0 as g", "cast(id as double) as v")
    odd = spark.createDataFrame([(None, 4.0), (None, 5.0), (False, None), (False, float("nan"))], "g boolean, v double")
    few = spark.createDataFrame([(None, None)], "g boolean, v double")
    got = udf.aggregate_partial(
        df.unionByName(odd).unionByName(few), ["g"], "v", lambda: udf.Quantiles(512), lambda s: s.quantile(0.5), "m"
    )
    got = {r.g: r.m for r in got.collect()}
    assert got.pop(None) == 4.5 and set(got) == {True, False}
    assert all(abs(m - 150_000) < 300_000 * 10 / 1024 + 3 for m in got.values())


PYTHON = {"udf_scalar", "udaf_median", "udaf_median_partial", "udtf_tokens", "grouped_map"}
# These write files or run streams while they are built; their plans are read-backs.
EAGER = {"ingest_typed", "ingest_quoted", "write_partitioned", "load_incremental", "upsert", "compact_files", "elt_daily"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in EAGER and not n.startswith("stream_")))
def test_plans_have_no_cross_join_and_python_only_where_meant(spark, sf_dir, name):
    plan = plan_of(QUERIES[name].run(spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    python = any(w in plan for w in ("Python", "Arrow", "InPandas"))
    assert python == (name in PYTHON)


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = plan_of(QUERIES["pivot_status"].run(spark, sf_dir))
    assert "ReadSchema: struct<o_orderstatus:string,o_orderdate:timestamp_ntz>" in plan
    plan = plan_of(QUERIES["orders_without_lines"].run(spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["customers_with_returns"].run(spark, sf_dir))
    assert "EqualTo(l_returnflag,R)" in plan


def test_top_rows_are_cut_before_the_shuffle(spark, sf_dir):
    for name in ("top_k_per_group", "dedup_latest"):
        plan = plan_of(QUERIES[name].run(spark, sf_dir))
        lines = plan.splitlines()
        partial = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line)
        shuffle = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
        assert shuffle < partial  # printed top down
    df = spark.range(10).withColumn("k", F.lit(1))
    assert "TakeOrderedAndProject" in plan_of(windows.top_n(df, [F.col("id").desc()], 3))


def test_revenue_sums_orders_in_the_join_partitioning(spark, sf_dir):
    plan = plan_of(QUERIES["monthly_revenue"].run(spark, sf_dir))
    assert plan.count("hashpartitioning(l_orderkey") == 1


class FakeSession:
    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = SimpleNamespace(master=master, applicationId="app")


def test_shared_folder(spark):
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")
    on_cluster = FakeSession("yarn", "hdfs://name/place/")
    assert session.fresh_path(on_cluster, "x").startswith("hdfs://name/place/x-")
    with pytest.raises(ValueError):
        session.shared_dir(FakeSession("spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(FakeSession("local-cluster[2,1,1024]"))


def test_every_query_has_sql_or_a_reason():
    assert not [n for n, q in QUERIES.items() if not q.sql]


def test_words_of_a_batch_come_in_bounded_tables():
    import pyarrow as pa

    texts = [" a  b\n" * 5, None, "", "  ", "w" * 3_000_000, "x y " * 700_000 + "ü  z", *["short text é "] * 300_000]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    tables = list(udf.TokenBatches().eval(batch))
    assert max(t.num_rows for t in tables) <= udf.SLICE_BYTES
    got = pa.concat_tables(tables).to_pydict()
    want = [(i, p, w) for i, t in enumerate(texts) for p, w in enumerate((t or "").split())]
    assert list(zip(got["doc_id"], got["pos"], got["token"])) == want
