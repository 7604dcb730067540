"""Registered aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import aggregate, joins
from tidemill.plans.registry import query
from tidemill.plans.revenue import NET
from tidemill.session import stage
from tidemill.sources.tables import read_table


def _count():
    return F.count(F.lit(1))


@query(
    "pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_price,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_discount
    FROM lineitem GROUP BY 1, 2
    """,
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, revenue and averages by return flag and line status."""
    measures = {
        "n": _count(),
        "sum_qty": F.round(F.sum("l_quantity"), 2),
        "sum_price": F.round(F.sum("l_extendedprice"), 2),
        "revenue": F.round(F.sum(F.expr(NET)), 4),
        "charge": F.round(F.sum(F.expr(f"{NET} * (1 + l_tax)")), 2),
        "avg_qty": F.round(F.avg("l_quantity"), 4),
        "avg_discount": F.round(F.avg("l_discount"), 4),
    }
    lines = read_table(spark, sf_dir, "lineitem")
    return aggregate.summarize(lines, ["l_returnflag", "l_linestatus"], measures)


@query(
    "totals_rollup",
    """
    SELECT r_name, n_name, c_mktsegment,
           CAST(grouping_id(r_name, n_name, c_mktsegment) AS BIGINT) AS level_id,
           count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name, c_mktsegment)
    """,
)
def totals_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and balance by region, nation and segment, with subtotals."""
    placed = joins.enrich(
        read_table(spark, sf_dir, "customer"),
        [
            (read_table(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"}),
            (read_table(spark, sf_dir, "region"), {"n_regionkey": "r_regionkey"}),
        ],
    )
    measures = {"n_customers": _count(), "balance": F.round(F.sum("c_acctbal"), 2)}
    return aggregate.rollup_totals(placed, ["r_name", "n_name", "c_mktsegment"], measures)


@query(
    "totals_cube",
    """
    SELECT o_orderstatus, o_orderpriority,
           CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level_id,
           count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
    """,
)
def totals_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority with all subtotals."""
    measures = {"n": _count(), "total": F.round(F.sum("o_totalprice"), 2)}
    orders = read_table(spark, sf_dir, "orders")
    return aggregate.cube_totals(orders, ["o_orderstatus", "o_orderpriority"], measures)


@query(
    "totals_grouping_sets",
    """
    SELECT o_orderstatus, o_orderpriority,
           CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level_id, count(*) AS n
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
    """,
)
def totals_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, by priority and in total."""
    orders = read_table(spark, sf_dir, "orders")
    sets = [["o_orderstatus"], ["o_orderpriority"], []]
    return aggregate.grouping_set_totals(orders, sets, {"n": _count()})


def _lines_with_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and supplier of each order's lines, with the order's priority."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return joins.enrich(lines, [(orders, {"l_orderkey": "o_orderkey"})])


@query(
    "distinct_counts",
    """
    SELECT o_orderpriority, count(DISTINCT l_partkey) AS n_l_partkey,
           count(DISTINCT l_suppkey) AS n_l_suppkey
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts and suppliers per order priority."""
    lines = _lines_with_priority(spark, sf_dir)
    return aggregate.distinct_counts(lines, ["o_orderpriority"], ["l_partkey", "l_suppkey"])


@query(
    "distinct_approx",
    """
    SELECT DISTINCT o_orderpriority, TRUE AS n_l_partkey_close, TRUE AS n_l_suppkey_close
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def distinct_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the same, estimated, is within four standard errors of the exact counts.

    Sketches have no equal in the other engine, so the bound is what is compared.
    """
    lines = _lines_with_priority(spark, sf_dir)
    by, cols, rsd = ["o_orderpriority"], ["l_partkey", "l_suppkey"], 0.02
    exact = aggregate.distinct_counts(lines, by, cols)
    guess = aggregate.approx_distinct(lines, by, cols, rsd)
    guess = guess.select(*by, *[F.col(f"n_{c}").alias(f"guess_{c}") for c in cols])
    close = [
        (F.abs(F.col(f"guess_{c}") - F.col(f"n_{c}")) <= 4 * rsd * F.col(f"n_{c}")).alias(f"n_{c}_close")
        for c in cols
    ]
    return exact.join(guess, by).select(*by, *close)


@query(
    "distinct_rollup",
    """
    SELECT year(l_shipdate)::INTEGER AS y, month(l_shipdate)::INTEGER AS m, TRUE AS close_to_raw, TRUE AS close
    FROM lineitem GROUP BY 1, 2
    """,
)
def distinct_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts per month from stored sketches of days, which are merged without the rows.

    Whether the estimate is within four standard errors of that from the month's rows, and
    of the exact count.
    """
    lg_k, month = 12, ["y", "m"]
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.dayofmonth("l_shipdate").alias("day"), "l_partkey"
    )
    daily = stage(aggregate.distinct_sketches(lines, [*month, "day"], ["l_partkey"], lg_k), "sketches-of-days")
    rolled = aggregate.sketched_counts(aggregate.merge_sketches(daily, month))
    raw = aggregate.sketched_counts(aggregate.distinct_sketches(lines, month, ["l_partkey"], lg_k))
    raw = raw.withColumnRenamed("n_l_partkey", "raw")
    exact = aggregate.distinct_counts(lines, month, ["l_partkey"]).withColumnRenamed("n_l_partkey", "exact")
    error = 4 * 1.04 / 2 ** (lg_k / 2)
    return rolled.join(raw, month).join(exact, month).select(
        *month,
        (F.abs(F.col("n_l_partkey") - F.col("raw")) <= error * F.col("raw")).alias("close_to_raw"),
        (F.abs(F.col("n_l_partkey") - F.col("exact")) <= error * F.col("exact")).alias("close"),
    )


@query(
    "percentiles",
    """
    SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS p50,
           round(quantile_cont(o_totalprice, 0.95), 4) AS p95
    FROM orders GROUP BY 1
    """,
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median and 95th percentile of order totals per priority."""
    orders = read_table(spark, sf_dir, "orders")
    found = aggregate.percentiles(
        orders, ["o_orderpriority"], "o_totalprice", {"p50": 0.5, "p95": 0.95}
    )
    return found.select(
        "o_orderpriority", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95")
    )


@query(
    "pivot_status",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS y,
           count(*) FILTER (o_orderstatus = 'F') AS "F",
           count(*) FILTER (o_orderstatus = 'O') AS "O",
           count(*) FILTER (o_orderstatus = 'P') AS "P"
    FROM orders GROUP BY 1
    """,
)
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per year, one column per status."""
    orders = read_table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return aggregate.pivot_counts(orders, ["y"], "o_orderstatus", ["F", "O", "P"])


@query(
    "unpivot_columns",
    """
    SELECT o_orderkey, 'o_orderstatus' AS name, o_orderstatus AS value FROM orders
    UNION ALL
    SELECT o_orderkey, 'o_orderpriority' AS name, o_orderpriority AS value FROM orders
    """,
)
def unpivot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two order columns as name and value."""
    orders = read_table(spark, sf_dir, "orders")
    return aggregate.to_long(orders, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(
    "histogram",
    """
    SELECT CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 11
                ELSE CAST(floor(o_totalprice * 10 / 500000) AS BIGINT) + 1 END AS bucket,
           count(*) AS n
    FROM orders GROUP BY 1
    """,
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per bucket of total price."""
    return aggregate.histogram(
        read_table(spark, sf_dir, "orders"), "o_totalprice", 0.0, 500_000.0, 10
    )


@query(
    "event_paths",
    """
    SELECT user_id, part, count(*) AS n_steps, string_agg(event_type, '>' ORDER BY rn) AS path
    FROM (SELECT *, CAST((rn - 1) // 1000 AS BIGINT) AS part
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
                FROM events))
    GROUP BY 1, 2
    """,
)
def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types in order, in parts of a thousand."""
    events = read_table(spark, sf_dir, "events")
    return aggregate.paths(events, ["user_id"], ["ts", "event_id"], "event_type")
