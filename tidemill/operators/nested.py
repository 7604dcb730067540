"""Arrays, maps and vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import hotkeys
from tidemill.operators.hotkeys import HOT_ROWS


def word_counts(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Occurrences of each word, lower case, split at white space."""
    words = df.select(*by, F.explode(F.split(F.lower(F.col(col)), r"\s+")).alias("word"))
    return words.filter("word != ''").groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def nest(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    order: Sequence[str],
    name: str = "items",
    size: int = 1000,
    max_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Rows of a key as an array of structs, in order, in parts of up to ``size``.

    A key with more rows gets several rows, numbered by ``part``: nothing is dropped
    and no array grows with the data.
    """
    numbered = hotkeys.number_rows(df, by, order, "__rn", max_rows)
    part = F.floor((F.col("__rn") - 1) / F.lit(size)).alias("part")
    items = F.array_sort(F.collect_list(F.struct("__rn", F.struct(*cols).alias("v"))))
    return numbered.groupBy(*by, part).agg(F.transform(items, lambda x: x["v"]).alias(name))


def unnest(df: DataFrame, col: str) -> DataFrame:
    """One row per array element, its fields as columns."""
    kept = [c for c in df.columns if c not in (col, "part")]
    return df.select(*kept, F.inline(col))


def nested_total(col: str, field: str) -> Column:
    """Sum of one field over an array of structs, without unnesting it."""
    zero = F.lit(0.0)
    return F.aggregate(col, zero, lambda acc, x: acc + F.coalesce(x[field], zero))


def count_map(df: DataFrame, by: Sequence[str], col: str, name: str = "counts") -> DataFrame:
    """Per key a map from each value of ``col`` to its number of rows.

    Rows are counted per key and value before a map is built, so a map has one entry
    per distinct value; use it for columns with few of them.
    """
    counted = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(col).alias("key"), F.col("n").alias("value"))))
    return counted.groupBy(*by).agg(F.map_from_entries(entries).alias(name))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_top_k(
    df: DataFrame, query: Sequence[float], k: int, key: str, vector: str
) -> DataFrame:
    """The ``k`` rows nearest to ``query`` by cosine, exact; ties by ``key``.

    Vectors of another length are left out.  Each task keeps ``k`` rows; only those
    meet.
    """
    weights = F.array(*[F.lit(float(x)) for x in query])
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    v = F.col(vector)
    cosine = F.try_divide(_dot(v, weights), F.sqrt(_dot(v, v)) * F.lit(length))
    scored = df.select(key, cosine.alias("cosine")).filter("cosine IS NOT NULL")
    return scored.orderBy(F.col("cosine").desc(), key).limit(k)
