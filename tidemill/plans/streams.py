"""Registered streaming queries, each run to completion over the event files."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans import joining  # noqa: F401  (its SQL is reused)
from tidemill.plans.registry import QUERIES, query
from tidemill.plans.timing import SESSIONS_SQL
from tidemill.schemas import TABLES
from tidemill.session import fresh_path
from tidemill.sources.tables import read_table
from tidemill.streaming import operators as ops
from tidemill.streaming import queries as run
from tidemill.streaming.state import activity_runs

HOUR, DAY = timedelta(hours=1), timedelta(days=1)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In braces the name is a pattern, which may stand for one file or a folder of them.
    return run.read_stream(spark, f"{sf_dir}/{{events.parquet}}", TABLES["events"])


@query(
    "stream_tumbling",
    """
    SELECT * FROM (
      SELECT date_trunc('day', ts)::TIMESTAMP AS window_start,
             date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, count(*) AS n
      FROM events GROUP BY 1, 2)
    WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    """,
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts; the day the watermark is in stays open."""
    return run.result_of(ops.stream_counts(_events(spark, sf_dir), "ts", DAY, HOUR), "stream-counts")


@query(
    "stream_sessions",
    f"""
    SELECT * FROM ({SESSIONS_SQL})
    WHERE session_end + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    """,
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions the watermark has closed."""
    sessions = ops.stream_sessions(
        _events(spark, sf_dir), ["user_id"], "ts", timedelta(hours=6), HOUR
    )
    return run.result_of(sessions, "stream-sessions")


@query("stream_dedup", "SELECT * FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed that delivers purchases and errors twice, without the second copies."""
    landing = fresh_path(spark, "landing-twice")
    events = read_table(spark, sf_dir, "events")
    again = events.filter("event_type IN ('purchase', 'error')")
    events.unionByName(again).write.parquet(landing)
    feed = run.read_stream(spark, landing, TABLES["events"])
    return run.result_of(ops.stream_dedup(feed, ["event_id"], "ts", HOUR), "stream-dedup")


@query(
    "stream_enrich",
    """
    SELECT event_id, user_id, ts, event_type, c_name, c_mktsegment
    FROM events LEFT JOIN customer ON user_id = c_custkey
    """,
)
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their customer, a static table."""
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    wide = ops.stream_enrich(_events(spark, sf_dir), customers, {"user_id": "c_custkey"})
    kept = wide.select("event_id", "user_id", "ts", "event_type", "c_name", "c_mktsegment")
    return run.result_of(kept, "stream-enrich")


@query("stream_interval_join", QUERIES["interval_join"].sql)
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with purchases within a day, both sides streams."""
    clicks = _events(spark, sf_dir).filter("event_type = 'click'")
    bought = _events(spark, sf_dir).filter("event_type = 'purchase'")
    joined = ops.stream_interval_join(
        clicks.select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts")),
        bought.select(
            F.col("event_id").alias("purchase_id"),
            F.col("user_id").alias("buyer_id"),
            F.col("ts").alias("purchase_ts"),
        ),
        {"user_id": "buyer_id"},
        "click_ts",
        "purchase_ts",
        DAY,
        HOUR,
    )
    return run.result_of(joined.drop("buyer_id"), "stream-interval-join")


@query(
    "stream_user_state",
    """
    WITH gaps AS (
      SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (
      SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM gaps)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_events,
           arg_max(event_type, (ts, event_id)) AS last_event,
           max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS expired
    FROM numbered GROUP BY user_id, run
    """,
)
def stream_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of activity per user; a timer expires a run once the user was idle for six hours.

    Users fall idle and return all the time.  The feed comes in three deliveries, each
    taken up by a restarted stream.
    """
    path, checkpoint = fresh_path(spark, "user-runs"), fresh_path(spark, "user-runs-checkpoint")
    landing, events = fresh_path(spark, "landing-users"), read_table(spark, sf_dir, "events")
    edges = ["TIMESTAMP_NTZ '2024-01-11'", "TIMESTAMP_NTZ '2024-01-21'"]
    deliveries = [f"ts < {edges[0]}", f"ts >= {edges[0]} AND ts < {edges[1]}", f"ts >= {edges[1]}"]
    for delivery in deliveries:
        events.filter(delivery).write.mode("append").parquet(landing)
        feed = run.read_stream(spark, landing, TABLES["events"])
        runs = activity_runs(feed, "user_id", "ts", "event_id", "event_type", HOUR, timedelta(hours=6))
        run.run_upserts(runs, path, checkpoint, ["user_id", "started"], ["seq"], mode="update")
    kept = run.read_upserted(spark, path, runs.schema, ["user_id", "started"], ["seq"])
    return kept.filter("n_events > 0").drop("seq")


@query(
    "stream_late_data",
    """
    SELECT count(*) FILTER (NOT late) AS n_kept, count(*) FILTER (late) AS n_late
    FROM (SELECT event_type = 'error' AND ts < TIMESTAMP '2024-01-06' AS late FROM events)
    """,
)
def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept and rows dropped when early errors are delivered last."""
    events = read_table(spark, sf_dir, "events")
    late = (F.col("event_type") == "error") & F.expr("ts < TIMESTAMP_NTZ '2024-01-06'")
    second_half, last_day = "TIMESTAMP_NTZ '2024-01-16'", "TIMESTAMP_NTZ '2024-01-30'"
    on_time = events.filter(~late)
    deliveries = [
        on_time.filter(f"ts < {second_half}"),
        on_time.filter(f"ts >= {second_half} AND ts < {last_day}"),
        on_time.filter(f"ts >= {last_day}"),
        events.filter(late),
    ]
    landing, out = fresh_path(spark, "landing-late"), fresh_path(spark, "on-time")
    checkpoint = fresh_path(spark, "on-time-checkpoint")
    for delivery in deliveries:
        # Appended to what landed before; the stream restarts and reads the new files.
        delivery.write.mode("append").parquet(landing)
        dropped = ops.late_report(
            spark, landing, TABLES["events"], ["event_id"], "ts", DAY, out, checkpoint
        )
    kept = spark.read.schema("event_id bigint").parquet(out)
    return kept.agg(F.count(F.lit(1)).alias("n_kept")).withColumn(
        "n_late", F.lit(dropped).cast("bigint")
    )


@query(
    "stream_upsert",
    """
    SELECT event_id, ts, user_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1
    """,
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, kept by an idempotent keyed sink."""
    path, checkpoint = fresh_path(spark, "latest"), fresh_path(spark, "latest-checkpoint")
    feed = _events(spark, sf_dir).drop("props")
    order = ["ts", "event_id"]
    run.run_upserts(feed, path, checkpoint, ["user_id"], order)
    return run.read_upserted(spark, path, feed.schema, ["user_id"], order)
