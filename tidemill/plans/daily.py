"""The daily job: landing, typed, quarantined, deduplicated, star, mart.

``checked`` holds every landed line by day and outcome - accepted, rejected with
its reasons, or malformed - so the landing files are parsed once; ``events`` holds
the accepted rows without copies; ``mart`` counts them by region.  Every layer is
a Parquet table partitioned by day.  A run replaces the folders of all days it is
given, so running a day again, with corrected input or none that is valid, leaves what
a first run would, and a run that died half-way is simply repeated.  A folder is only
replaced by one with rows, so each day has one more row whose ``present`` is false;
``read_layer`` leaves it out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import clean, joins
from tidemill.plans.registry import query
from tidemill.schemas import TABLES
from tidemill.session import fresh_path
from tidemill.sources.files import write_partitioned
from tidemill.sources.ingest import parse_lines
from tidemill.sources.tables import read_table


def land(events: DataFrame, landing: str, day: str | None = None) -> None:
    """Events as JSON lines, one folder per day; those without a time go to ``day``."""
    days = events.withColumn("day", F.coalesce(F.to_date("ts"), F.lit(day).cast("date")))
    text = days.select("day", F.to_json(F.struct(*events.columns)).alias("value"))
    text.hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").text(landing)


def run_daily(
    spark: SparkSession, landing: str, star: DataFrame, out: str, days: Sequence[str]
) -> None:
    """Bring the given days (``YYYY-MM-DD``) from ``landing`` into the mart under ``out``.

    ``star`` is the customer dimension widened to its region.
    """
    files = f"{landing}/day={{{','.join(days)}}}"
    rules = {"known_user": F.col("user_id") >= 0, "value_over_one": F.col("value") > 1}
    outcome = (
        F.when(F.col("malformed") | F.col("ts").isNull(), "malformed")
        .when(F.size("reasons") > 0, "rejected")
        .otherwise("accepted")
    )
    checked = (
        parse_lines(spark, files, "json", TABLES["events"])
        .withColumn("reasons", F.when(~F.col("malformed"), clean.broken_rules(rules)))
        .withColumn("outcome", outcome)
        # The landing folder is the day, also for lines no time could be read from.
        .withColumn("day", F.regexp_extract("source_file", r"day=(\d{4}-\d{2}-\d{2})", 1).cast("date"))
        .withColumn("raw", F.when(F.col("outcome") != "accepted", F.col("raw")))
        .drop("malformed")
    )
    accepted = _replace(spark, checked, f"{out}/checked", days).filter("outcome = 'accepted'")
    good = accepted.select(*TABLES["events"].names, "day")
    unique = clean.dedup_latest(good, ["day", "event_id"], [F.col("ts").desc()])
    kept = _replace(spark, unique, f"{out}/events", days)
    # Reduced per user first: a busy user is a few rows in the join.
    per_user = kept.groupBy("day", "event_type", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")
    )
    mart = (
        joins.enrich(per_user, [(star, {"user_id": "c_custkey"})])
        .groupBy("day", "r_name", "event_type")
        .agg(F.sum("n").alias("n_events"), F.sum("value").alias("value"))
    )
    _replace(spark, mart, f"{out}/mart", days)


def _replace(spark: SparkSession, rows: DataFrame, path: str, days: Sequence[str]) -> DataFrame:
    """Write the given days of a layer in place of what was there, and read them back."""
    marks = spark.createDataFrame([(d,) for d in days], "day string")
    marks = marks.select(F.col("day").cast("date").alias("day"), F.lit(False).alias("present"))
    whole = rows.withColumn("present", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    write_partitioned(whole, path, ["day"], dynamic=True)
    back = spark.read.schema(whole.schema).parquet(path).filter("present").select(rows.columns)
    return back.filter(F.col("day").isin(*[F.lit(d).cast("date") for d in days]))


def read_layer(spark: SparkSession, out: str, name: str) -> DataFrame:
    """All rows of ``checked``, ``events`` or ``mart``."""
    return spark.read.parquet(f"{out}/{name}").filter("present").drop("present")


def customer_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = joins.enrich(
        read_table(spark, sf_dir, "customer"),
        [
            (read_table(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"}),
            (read_table(spark, sf_dir, "region"), {"n_regionkey": "r_regionkey"}),
        ],
    )
    return placed.select("c_custkey", "r_name")


@query(
    "elt_daily",
    """
    SELECT date_trunc('day', ts)::TIMESTAMP AS day, r_name, event_type, count(*) AS n_events,
           round(sum(value), 2) AS value
    FROM events JOIN customer ON user_id = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE value > 1 GROUP BY 1, 2, 3
    """,
)
def elt_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart over all days: run in two halves that overlap, purchases landed twice."""
    landing, out = fresh_path(spark, "landing"), fresh_path(spark, "daily")
    events = read_table(spark, sf_dir, "events")
    land(events, landing)
    land(events.filter("event_type = 'purchase'"), landing)
    dated = events.filter("ts IS NOT NULL").select(F.to_date("ts").cast("string"))
    days = sorted(r[0] for r in dated.distinct().collect())
    star, half = customer_star(spark, sf_dir), len(days) // 2
    run_daily(spark, landing, star, out, days[: half + 1])
    run_daily(spark, landing, star, out, days[half:])
    mart = read_layer(spark, out, "mart")
    return mart.select(
        F.col("day").cast("timestamp_ntz").alias("day"),
        "r_name",
        "event_type",
        "n_events",
        F.round("value", 2).alias("value"),
    )
