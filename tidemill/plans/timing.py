"""Registered queries on event time, nested values and text."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import events as ev
from tidemill.operators import nested
from tidemill.plans.registry import query
from tidemill.sources.tables import read_table, spread

DAY = timedelta(days=1)


@query(
    "tumbling_counts",
    """
    SELECT date_trunc('day', ts)::TIMESTAMP AS window_start,
           date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end,
           event_type, count(*) AS n
    FROM events GROUP BY 1, 2, 3
    """,
)
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type."""
    return ev.tumbling(read_table(spark, sf_dir, "events"), "ts", DAY, ["event_type"])


@query(
    "sliding_counts",
    """
    SELECT window_start, window_start + INTERVAL 2 DAY AS window_end, count(*) AS n
    FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP,
                         date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS window_start
          FROM events) GROUP BY 1
    """,
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per two days, every day."""
    return ev.sliding(read_table(spark, sf_dir, "events"), "ts", 2 * DAY, DAY)


SESSIONS_SQL = """
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events
    FROM (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS s
          FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                             > INTERVAL 6 HOUR, true) AS starts FROM events))
    GROUP BY user_id, s
"""


@query("sessions", SESSIONS_SQL)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User sessions that end after six quiet hours."""
    events = read_table(spark, sf_dir, "events")
    return ev.sessionize(events, ["user_id"], "ts", timedelta(hours=6))


@query(
    "funnel",
    """
    WITH v AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'view' GROUP BY 1),
    c AS (SELECT e.user_id, min(t0) AS t0, min(ts) AS t1 FROM events e JOIN v ON e.user_id = v.user_id
          WHERE event_type = 'click' AND ts > t0 AND ts <= t0 + INTERVAL 24 HOUR GROUP BY 1),
    p AS (SELECT e.user_id FROM events e JOIN c ON e.user_id = c.user_id
          WHERE event_type = 'purchase' AND ts > t1 AND ts <= t0 + INTERVAL 24 HOUR GROUP BY 1)
    SELECT 0 AS step, 'view' AS event, count(*) AS n FROM v
    UNION ALL SELECT 1, 'click', count(*) FROM c
    UNION ALL SELECT 2, 'purchase', count(*) FROM p
    """,
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who view, then click, then buy within a day of their first view."""
    events = read_table(spark, sf_dir, "events")
    steps = ["view", "click", "purchase"]
    return ev.funnel(events, "user_id", "ts", "event_type", steps, DAY)


@query(
    "retention",
    """
    WITH a AS (SELECT DISTINCT user_id, date_trunc('week', ts)::TIMESTAMP AS period FROM events),
    c AS (SELECT *, min(period) OVER (PARTITION BY user_id) AS cohort FROM a)
    SELECT cohort, period, count(*) AS n_active FROM c GROUP BY 1, 2
    """,
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active users per first week and week."""
    return ev.retention(read_table(spark, sf_dir, "events"), "user_id", "ts")


@query(
    "word_counts",
    r"""
    SELECT lang, word, count(*) AS n
    FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents)
    WHERE word <> '' GROUP BY 1, 2
    """,
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word frequencies per language."""
    documents = read_table(spark, sf_dir, "documents").select("lang", "text")
    return nested.word_counts(spread(documents), "text", ["lang"])


@query(
    "nest_orders",
    """
    SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY 1
    """,
)
def nest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an array per customer, and totals read from the arrays."""
    orders = read_table(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_orderdate", "o_totalprice"]
    per_customer = nested.nest(
        orders.select("o_custkey", *cols), ["o_custkey"], cols, ["o_orderdate", "o_orderkey"]
    )
    # A customer of many orders comes in parts; the totals are per customer.
    return per_customer.groupBy("o_custkey").agg(
        F.sum(F.size("items")).alias("n_orders"),
        F.round(F.sum(nested.nested_total("items", "o_totalprice")), 2).alias("total"),
    )


@query(
    "event_type_map",
    """
    SELECT user_id, count(*) FILTER (event_type = 'view') AS views,
           count(*) FILTER (event_type = 'purchase') AS purchases,
           CAST(count(DISTINCT event_type) AS INTEGER) AS n_types
    FROM events GROUP BY 1
    """,
)
def event_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of event types per user, and three facts read from it."""
    counts = nested.count_map(read_table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return counts.select(
        "user_id",
        F.coalesce(F.try_element_at("counts", F.lit("view")), F.lit(0)).alias("views"),
        F.coalesce(F.try_element_at("counts", F.lit("purchase")), F.lit(0)).alias("purchases"),
        F.size("counts").alias("n_types"),
    )


@query(
    "cosine_top_k",
    """
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((
             SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6) AS cosine
    FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 10
    """,
)
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to the first one."""
    vectors = read_table(spark, sf_dir, "embeddings")
    first = vectors.filter("vec_id = 0").select("embedding").first()[0]
    near = nested.cosine_top_k(spread(vectors), first, 10, "vec_id", "embedding")
    return near.withColumn("cosine", F.round("cosine", 6))
