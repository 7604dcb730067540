"""Registered queries on windows, top rows, samples and set operations."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import sets, windows
from tidemill.plans.registry import query
from tidemill.sources.tables import read_table


@query(
    "top_k_per_group",
    """
    SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS INTEGER) AS rn FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
      FROM orders) WHERE rn <= 3
    """,
)
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of each customer."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return windows.top_k(orders, ["o_custkey"], order, 3)


@query(
    "rank_suite",
    """
    SELECT o_orderkey, o_orderpriority, o_totalprice,
           rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
           round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist,
           ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS ntile
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)
    """,
)
def rank_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of orders by total within their priority."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    ranked = windows.ranks(orders, ["o_orderpriority"], "o_totalprice", "o_orderkey", tiles=4)
    return ranked.withColumns(
        {"percent_rank": F.round("percent_rank", 9), "cume_dist": F.round("cume_dist", 9)}
    )


@query(
    "running_total",
    """
    SELECT event_id, user_id, ts, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS UNBOUNDED PRECEDING), 2) AS running_total
    FROM events
    """,
)
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative value per user."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    totals = windows.running_total(events, ["user_id"], ["ts", "event_id"], "value")
    return totals.select("event_id", "user_id", "ts", F.round("running_total", 2).alias("running_total"))


@query(
    "moving_sum_7d",
    """
    SELECT event_id, user_id, ts, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts
           RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW), 2) AS moving_sum
    FROM events
    """,
)
def moving_sum_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's value over the seven days up to each event."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    sums = windows.moving_sum(events, ["user_id"], "ts", "value", timedelta(days=7))
    return sums.select("event_id", "user_id", "ts", F.round("moving_sum", 2).alias("moving_sum"))


@query(
    "period_growth",
    """
    WITH p AS (SELECT year(o_orderdate) AS period, count(*) AS value FROM orders GROUP BY 1)
    SELECT c.period AS period, c.value AS value, CAST(b.value AS DOUBLE) AS prior_value,
           CAST(c.value - b.value AS DOUBLE) AS change
    FROM p c LEFT JOIN p b ON c.period = b.period + 1
    """,
)
def period_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per year and the change on the year before."""
    orders = read_table(spark, sf_dir, "orders")
    changes = windows.growth(orders, F.year("o_orderdate"), F.count(F.lit(1)))
    doubles = {c: F.col(c).cast("double") for c in ("prior_value", "change")}
    return changes.withColumns(doubles)


@query(
    "first_last",
    """
    SELECT event_id, user_id, first_value(event_type) OVER w AS first_event_type,
           last_value(event_type) OVER w AS last_event_type
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's first and last event type."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return windows.first_last(events, ["user_id"], ["ts", "event_id"], "event_type").drop(
        "ts", "event_type"
    )


@query(
    "scd2_history",
    """
    WITH c AS (SELECT user_id, event_type, ts FROM (
        SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
        FROM events) WHERE prev IS DISTINCT FROM event_type)
    SELECT user_id, event_type, ts AS valid_from,
           lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to,
           lead(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS is_current
    FROM c
    """,
)
def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals of each user's latest event type."""
    events = read_table(spark, sf_dir, "events")
    return windows.scd2(events, ["user_id"], "ts", ["event_type"], tie=["event_id"])


_LARGEST = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query(
    "top_k_global",
    f"SELECT {', '.join(_LARGEST)} FROM lineitem"
    f" ORDER BY {', '.join(c + ' DESC' for c in _LARGEST)} LIMIT 100",
)
def top_k_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest line items."""
    lines = read_table(spark, sf_dir, "lineitem").select(*_LARGEST)
    return windows.top_n(lines, [F.col(c).desc() for c in _LARGEST], 100)


@query(
    "hash_sample",
    "SELECT * FROM orders WHERE md5(CAST(o_orderkey AS VARCHAR))[1] = '0'",
)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sixteenth of the orders."""
    return windows.hash_sample(read_table(spark, sf_dir, "orders"), "o_orderkey")


@query(
    "union_evolved",
    """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
           NULL::VARCHAR AS nation FROM customer
    UNION ALL
    SELECT s_suppkey, s_name, s_acctbal, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier
    """,
)
def union_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers stacked, each lacking a column of the other."""
    customers = read_table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    suppliers = read_table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "s_name AS name", "s_acctbal AS balance", "CAST(s_nationkey AS STRING) AS nation"
    )
    return sets.union_evolved(customers, suppliers)


def _part_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = read_table(spark, sf_dir, "lineitem")
    kept = lines.filter("l_returnflag <> 'R'").select(F.col("l_partkey").alias("k"))
    returned = lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    return kept, returned


def _both_forms_sql(op: str) -> str:
    kept = "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag <> 'R'"
    returned = "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'"
    return (
        f"SELECT 'distinct' AS form, k FROM ({kept} {op} {returned})"
        f" UNION ALL SELECT 'bag' AS form, k FROM ({kept} {op} ALL {returned})"
    )


def _both_forms(distinct: DataFrame, bag: DataFrame) -> DataFrame:
    return distinct.select(F.lit("distinct").alias("form"), "k").unionByName(
        bag.select(F.lit("bag").alias("form"), "k")
    )


@query("intersect_keys", _both_forms_sql("INTERSECT"))
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts both kept and returned: once each, and as often as both occur."""
    kept, returned = _part_keys(spark, sf_dir)
    return _both_forms(sets.common(kept, returned), sets.common(kept, returned, all=True))


@query("except_keys", _both_forms_sql("EXCEPT"))
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts kept and not returned, in both forms."""
    kept, returned = _part_keys(spark, sf_dir)
    return _both_forms(sets.minus(kept, returned), sets.minus(kept, returned, all=True))
