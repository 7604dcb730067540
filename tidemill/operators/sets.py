"""Set operations over whole rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Copies of one row that one task writes out.
COPIES = 1_000_000


def union_evolved(*dfs: DataFrame) -> DataFrame:
    """Tables stacked by column name; a column a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def common(a: DataFrame, b: DataFrame, all: bool = False, copies: int = COPIES) -> DataFrame:
    """Rows in both: each once, or with ``all`` as often as in the side that has fewer."""
    if all:
        return _repeated(a, b, F.least("__a", "__b"), copies)
    return _counted(a, b).filter("__a > 0 AND __b > 0").select(*a.columns)


def minus(a: DataFrame, b: DataFrame, all: bool = False, copies: int = COPIES) -> DataFrame:
    """Rows only in ``a``: each once, or with ``all`` one removed per row of ``b``."""
    if all:
        return _repeated(a, b, F.col("__a") - F.col("__b"), copies)
    return _counted(a, b).filter("__b = 0").select(*a.columns)


def _counted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each distinct row with its number of copies on both sides.

    One shuffle for both sides together, after copies were combined in each task.
    """
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(2)))
    return both.groupBy(*a.columns).agg(
        F.count_if(F.col("__side") == 1).alias("__a"), F.count_if(F.col("__side") == 2).alias("__b")
    )


def _repeated(a: DataFrame, b: DataFrame, times: Column, copies: int) -> DataFrame:
    """Rows written out as often as ``times`` says.

    A row with very many copies is cut into shares first, and the shares are spread
    over tasks: no task writes out more than a few of them.
    """
    needed = _counted(a, b).withColumn("__n", times).filter("__n > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(copies).cast("bigint"))
    shares = needed.withColumn("__start", F.explode(starts))
    share = F.least(F.lit(copies), F.col("__n") - F.col("__start")).cast("int")
    # A fixed number of partitions: shares are few bytes, whatever they expand to.
    partitions = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = shares.repartition(partitions, *a.columns, "__start")
    return spread.select(*a.columns, F.explode(F.array_repeat(F.lit(1), share)).alias("__x")).drop("__x")
