"""What several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, wherever a contract counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space between such words.
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def content_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes of a row's columns, nulls told apart.

    Rows that agree in all of ``cols`` have the same key, so whatever is decided
    from these columns alone can be joined back by it, null ids and repeated rows
    included.
    """
    parts = [c for name in cols for c in (F.col(name).isNull(), F.col(name))]
    return [
        F.xxhash64(*parts).alias("_k1"),
        F.xxhash64(F.lit("second"), *parts).alias("_k2"),
    ]


def bare(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra ones cannot clash with an operator's own."""
    return df.select(*cols)
