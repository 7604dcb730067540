"""Registered queries over user-defined functions."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import udf
from tidemill.plans.registry import query
from tidemill.sources.tables import read_table, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def price_with_tax(price: pd.Series, tax: pd.Series) -> pd.Series:
    return price * (1 + tax)


@query(
    "udf_scalar",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 + l_tax), 4) AS gross
    FROM lineitem
    """,
)
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised function over two columns of the line items."""
    gross = udf.register_scalar(spark, "price_with_tax", price_with_tax, "double")
    lines = read_table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(gross("l_extendedprice", "l_tax"), 4).alias("gross"),
    )


@query(
    "udaf_median",
    """
    SELECT l_returnflag, l_linestatus, median(l_quantity) AS median_quantity
    FROM lineitem GROUP BY 1, 2
    """,
)
def udaf_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median quantity by a grouped aggregate; quantities have fifty values."""
    median = udf.register_agg(spark, "weighted_median", udf.weighted_median, "double")
    lines = read_table(spark, sf_dir, "lineitem")
    by = ["l_returnflag", "l_linestatus"]
    return udf.aggregate_counts(lines, by, "l_quantity", median, "median_quantity")


@query(
    "udaf_median_partial",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, TRUE AS close
    FROM lineitem GROUP BY 1, 2
    """,
)
def udaf_median_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median price from partial states of bounded size, and whether its rank is within their bound.

    Nearly all prices differ, so no count of values would bound a group.
    """
    by, price, size = ["l_returnflag", "l_linestatus"], "l_extendedprice", 2048
    lines = read_table(spark, sf_dir, "lineitem").select(*by, price)
    guess = udf.aggregate_partial(
        lines, by, price, lambda: udf.Quantiles(size), lambda s: s.quantile(0.5), "guess"
    )
    ranked = lines.join(guess, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(price) < F.col("guess")).alias("below"),
        F.count_if(F.col(price) <= F.col("guess")).alias("upto"),
    )
    error = F.greatest(F.log2(F.col("n") / size), F.lit(0.0)) * F.col("n") / (2 * size) + 1
    close = (F.col("below") <= F.col("n") / 2 + error) & (F.col("upto") >= F.col("n") / 2 - error)
    return ranked.select(*by, "n", close.alias("close"))


@query(
    "udtf_tokens",
    r"""
    SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, token FROM (
      SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
      FROM (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''] AS t
            FROM documents))
    """,
)
def udtf_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to one row per token, in SQL."""
    schema = "doc_id bigint, pos int, token string"
    udf.register_table_fn(spark, "tokens_of", udf.TokenBatches, schema, batches=True)
    documents = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spark.sql("SELECT * FROM tokens_of(TABLE({documents}))", documents=documents)


def spending(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Count, sum and largest value of one user's rows."""
    value = rows["value"].to_numpy()
    return pd.DataFrame(
        {"user_id": key[0], "n": len(value), "total": value.sum(), "largest": value.max()}, index=[0]
    )


@query(
    "grouped_map",
    """
    SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, max(value) AS largest
    FROM events GROUP BY 1
    """,
)
def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events reduced in Python, large users in slices that are then combined."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    per_user = udf.map_groups(
        events,
        ["user_id"],
        spending,
        "user_id bigint, n bigint, total double, largest double",
        spread_by="event_id",
        merge={"n": F.sum, "total": F.sum, "largest": F.max},
    )
    return per_user.withColumn("total", F.round("total", 2))
