"""Reading the declared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.schemas import TABLES


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One declared table: a Parquet file or a folder of them."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly per-row work on an input of few row groups.

    Spark cuts a small file into about one range per core, but a row group is read
    by one task, so the others may have nothing to do.  An input with more splits
    than that is large; it is left as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df
