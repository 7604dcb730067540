"""Registered join queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import joins
from tidemill.plans.registry import query
from tidemill.sources.tables import read_table

DAY = timedelta(days=1)
# Half-open price bands.
PRICE_BANDS = [
    ("budget", None, 930.0), ("middle", 930.0, 960.0), ("premium", 960.0, None),
    ("exactly", 950.0, 950.01), ("all", None, None), ("wide", 900.0, 1e9),
]


@query(
    "enrich_star",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate,
           o_orderdate, o_orderpriority, c_name, c_mktsegment, n_name, r_name
    FROM lineitem
    JOIN orders   ON l_orderkey  = o_orderkey
    JOIN customer ON o_custkey   = c_custkey
    JOIN nation   ON c_nationkey = n_nationkey
    JOIN region   ON n_regionkey = r_regionkey
    """,
)
def enrich_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order, customer, nation and region."""
    where = joins.enrich(
        read_table(spark, sf_dir, "customer"),
        [
            (read_table(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"}),
            (read_table(spark, sf_dir, "region"), {"n_regionkey": "r_regionkey"}),
        ],
    )
    # Orders are widened before they meet the lines, so lines shuffle once.
    placed = joins.enrich(read_table(spark, sf_dir, "orders"), [(where, {"o_custkey": "c_custkey"})])
    wide = joins.enrich(
        read_table(spark, sf_dir, "lineitem"), [(placed, {"l_orderkey": "o_orderkey"})]
    )
    return wide.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        "l_shipdate",
        "o_orderdate",
        "o_orderpriority",
        "c_name",
        "c_mktsegment",
        "n_name",
        "r_name",
    )


@query(
    "customers_with_returns",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey
                  WHERE o_custkey = c_custkey AND l_returnflag = 'R')
    """,
)
def customers_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with at least one returned line."""
    returned = read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    orders = joins.having_match(
        read_table(spark, sf_dir, "orders"), returned, {"o_orderkey": "l_orderkey"}
    )
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.having_match(customers, orders, {"c_custkey": "o_custkey"})


@query(
    "orders_without_lines",
    """
    SELECT * FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders no line refers to."""
    lines = read_table(spark, sf_dir, "lineitem")
    return joins.without_match(
        read_table(spark, sf_dir, "orders"), lines, {"o_orderkey": "l_orderkey"}
    )


@query(
    "asof_join",
    """
    SELECT p.event_id, p.user_id, p.ts, p.value, coalesce(v.event_id, -1) AS view_id, v.ts AS view_ts
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
      ON p.user_id = v.user_id AND p.ts >= v.ts
    """,
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view before it; -1 where there is none."""
    events = read_table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    views = events.filter("event_type = 'view'").select(
        "user_id", "ts", "event_id", F.col("ts").alias("at")
    )
    joined = joins.asof_join(
        bought, views, "ts", ["user_id"], {"event_id": "view_id", "at": "view_ts"}
    )
    return joined.withColumn("view_id", F.coalesce("view_id", F.lit(-1)))


@query(
    "interval_join",
    """
    SELECT c.event_id AS click_id, p.event_id AS purchase_id, c.user_id AS user_id,
           c.ts AS click_ts, p.ts AS purchase_ts
    FROM events c JOIN events p ON c.user_id = p.user_id
     AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 24 HOUR
    WHERE c.event_type = 'click' AND p.event_type = 'purchase'
    """,
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the same user's purchases within a day."""
    events = read_table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select(
        F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts")
    )
    bought = events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"),
        F.col("user_id").alias("buyer_id"),
        F.col("ts").alias("purchase_ts"),
    )
    found = joins.interval_join(
        clicks, bought, {"user_id": "buyer_id"}, "click_ts", "purchase_ts", DAY
    )
    return found.drop("buyer_id")


@query(
    "band_join",
    """
    SELECT p_partkey, p_retailprice, band
    FROM part JOIN (VALUES ('budget', NULL, 930.0), ('middle', 930.0, 960.0), ('premium', 960.0, NULL),
                           ('exactly', 950.0, 950.01), ('all', NULL, NULL), ('wide', 900.0, 1e9)) AS b(band, lo, hi)
      ON (lo IS NULL OR p_retailprice >= lo) AND (hi IS NULL OR p_retailprice < hi)
    """,
)
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their price bands, some of them open, narrow, wide or within others."""
    bands = spark.createDataFrame(PRICE_BANDS, "band string, lo double, hi double")
    parts = read_table(spark, sf_dir, "part")
    return joins.band_join(parts, bands, "p_retailprice").select("p_partkey", "p_retailprice", "band")


@query(
    "basket_pairs",
    """
    WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem)
    SELECT x.i AS a, y.i AS b, count(*) AS n
    FROM m x JOIN m y ON x.g = y.g AND x.i < y.i
    GROUP BY 1, 2 HAVING count(*) >= 3
    """,
)
def basket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together at least three times."""
    return joins.pairs(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 3)


@query(
    "dense_calendar",
    """
    WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id FROM events),
    days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
             FROM d)
    SELECT n_nationkey, n_name, CAST(days.day AS TIMESTAMP) AS day, count(d.day) AS n_events
    FROM nation CROSS JOIN days
    LEFT JOIN (SELECT c_nationkey, d.day FROM d JOIN customer ON user_id = c_custkey) d
      ON d.c_nationkey = n_nationkey AND d.day = days.day
    GROUP BY 1, 2, 3
    """,
)
def dense_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per nation and day, days without any included."""
    # Per user and day first, so that a busy user is one row per day in the join.
    per_user = (
        read_table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").alias("on"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = joins.enrich(per_user, [(customers, {"user_id": "c_custkey"})])
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    dense = joins.densify(
        placed, nations, {"n_nationkey": "c_nationkey"}, "on", {"n_events": F.sum("n")}
    )
    return dense.withColumn("day", F.col("day").cast("timestamp_ntz"))
