"""The flagship: monthly revenue by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.joins import enrich
from tidemill.plans.registry import query
from tidemill.sources.tables import read_table

NET = "l_extendedprice * (1 - l_discount)"


@query(
    "monthly_revenue",
    """
    SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
           count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS rev
    FROM lineitem
    JOIN orders   ON l_orderkey  = o_orderkey
    JOIN customer ON o_custkey   = c_custkey
    JOIN nation   ON c_nationkey = n_nationkey
    JOIN region   ON n_regionkey = r_regionkey
    GROUP BY 1, 2, 3
    """,
)
def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items and revenue by region, year and month.

    Lines are summed per order first.  The join uses the same partitioning, so this
    adds no shuffle, and an order with very many lines sends one row per task.
    """
    lines = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(NET)).alias("rev"))
    )
    where = enrich(
        read_table(spark, sf_dir, "customer"),
        [
            (read_table(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"}),
            (read_table(spark, sf_dir, "region"), {"n_regionkey": "r_regionkey"}),
        ],
    )
    orders = read_table(spark, sf_dir, "orders")
    wide = enrich(lines, [(orders, {"l_orderkey": "o_orderkey"}), (where, {"o_custkey": "c_custkey"})])
    return wide.groupBy(
        "r_name", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")
    ).agg(F.sum("n").alias("n"), F.round(F.sum("rev"), 4).alias("rev"))
