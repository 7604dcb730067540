"""Registered queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.plans.registry import query
from tidemill.schemas import TABLES
from tidemill.session import fresh_path
from tidemill.sources import files
from tidemill.sources.ingest import flatten_json, ingest
from tidemill.sources.keyed import KeyedTable
from tidemill.sources.tables import read_table

# Orders after ``order_changes``: repriced and deleted recent ones, new ones, and
# old ones whose change is older than they are and so has no effect.
CHANGED_ORDERS_SQL = """
    SELECT * FROM orders
    WHERE o_orderdate < TIMESTAMP '2000-01-01'
    UNION ALL
    SELECT o_orderkey, o_custkey, 'F' AS o_orderstatus, o_totalprice,
           o_orderdate + INTERVAL 1 DAY AS o_orderdate, o_orderpriority
    FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderpriority <> '5-LOW'
    UNION ALL
    SELECT -1 - o_orderkey AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
           o_orderpriority
    FROM orders WHERE o_orderpriority = '1-URGENT'
"""


def order_changes(orders: DataFrame) -> DataFrame:
    """A change batch derived from the orders, with a delete flag."""
    day = F.expr("INTERVAL 1 DAY")
    recent = orders.filter("o_orderdate >= TIMESTAMP_NTZ '2000-01-01'").withColumns(
        {
            "o_orderstatus": F.lit("F"),
            "o_orderdate": F.col("o_orderdate") + day,
            "deleted": F.col("o_orderpriority") == "5-LOW",
        }
    )
    stale = orders.filter("o_orderdate < TIMESTAMP_NTZ '1996-01-01'").withColumns(
        {
            "o_orderstatus": F.lit("X"),
            "o_orderdate": F.col("o_orderdate") - day,
            "deleted": F.lit(True),
        }
    )
    new = orders.filter("o_orderpriority = '1-URGENT'").withColumns(
        {"o_orderkey": F.lit(-1) - F.col("o_orderkey"), "deleted": F.lit(False)}
    )
    return recent.unionByName(stale).unionByName(new)


@query("ingest_typed", "SELECT * FROM orders")
def ingest_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV and read back with their declared schema."""
    path = fresh_path(spark, "orders-csv")
    read_table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    good, _ = ingest(spark, path, "csv", TABLES["orders"])
    return good


@query(
    "ingest_quoted",
    """
    SELECT c_custkey, c_name || chr(10) || 'of "' || c_mktsegment || '",' || chr(10) || chr(10) || c_nationkey AS note, c_acctbal
    FROM customer
    """,
)
def ingest_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a note of several lines, written as CSV and read back in splits."""
    path, br = fresh_path(spark, "customers-csv"), F.lit("\n")
    note = F.concat("c_name", br, F.lit('of "'), "c_mktsegment", F.lit('",'), br, br, F.col("c_nationkey").cast("string"))
    noted = read_table(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), "c_acctbal")
    noted.write.option("header", True).option("escape", '"').csv(path)
    good, _ = ingest(spark, path, "csv", noted.schema, quoted_breaks=True)
    return good


@query("flatten_json", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON properties of events as a typed column."""
    events = read_table(spark, sf_dir, "events").select("event_id", "props")
    return flatten_json(events, "props", T.StructType.fromDDL("k int"))


@query(
    "write_partitioned",
    "SELECT *, 1996 AS y FROM orders WHERE year(o_orderdate) = 1996",
)
def write_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by year; one year read back, which opens that folder only."""
    path = fresh_path(spark, "orders-by-year")
    orders = read_table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    files.write_partitioned(orders, path, ["y"])
    return spark.read.schema(orders.schema).parquet(path).filter("y = 1996")


@query("load_incremental", "SELECT * FROM events")
def load_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events loaded up to a day, then the rest, then again, which adds nothing."""
    path = fresh_path(spark, "events-loaded")
    events = read_table(spark, sf_dir, "events")
    files.load_incremental(events.filter("ts < TIMESTAMP_NTZ '2024-01-16'"), path, "ts")
    files.load_incremental(events, path, "ts")
    return files.load_incremental(events, path, "ts")


@query("upsert", CHANGED_ORDERS_SQL)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in versions: a change batch applied, sent again in vain, and read back."""
    orders = read_table(spark, sf_dir, "orders")
    table = KeyedTable(
        spark, fresh_path(spark, "orders-versions"), orders.schema, ["o_orderkey"], ["o_orderdate"],
        delete_flag="deleted", buckets=8,
    )
    table.replace(orders)
    table.upsert(order_changes(orders), batch=1)
    table.upsert(order_changes(orders), batch=1)
    return table.read()


@query("compact_files", "SELECT * FROM lineitem")
def compact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in many files rewritten into as few as their size asks for."""
    small, large = fresh_path(spark, "lines-small-files"), fresh_path(spark, "lines-compacted")
    read_table(spark, sf_dir, "lineitem").repartition(16).write.parquet(small)
    return files.compact(spark, small, large)
