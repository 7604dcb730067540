"""Cleaning: quarantine, deduplication, standard values, casts, defaults, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import clean_text
from tidemill.operators.aggregate import percentiles
from tidemill.operators.hotkeys import HOT_ROWS
from tidemill.session import stage


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the names of those they break.

    A rule that evaluates to null counts as broken.
    """
    checked = df.withColumn("reasons", broken_rules(rules))
    clean = F.size("reasons") == 0
    return checked.filter(clean).drop("reasons"), checked.filter(~clean)


def broken_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules a row breaks, as an array."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*broken))


def dedup_exact(df: DataFrame, cols: Sequence[str], keep: str) -> DataFrame:
    """One row per distinct value of ``cols``: the lowest ``keep``, with a copy count.

    ``keep`` identifies rows.  Only digests and ids are shuffled for grouping, and
    copies are combined before the shuffle, so a value with many copies is cheap.
    """
    value = F.col(cols[0]) if len(cols) == 1 else F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    kept = (
        df.groupBy(F.unhex(F.md5(value)).alias("__digest"))
        .agg(F.min(keep).alias(keep), F.count(F.lit(1)).alias("copies"))
        .select(keep, "copies")
    )
    return df.join(kept, keep)


def dedup_latest(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order_by``.

    Spark keeps one row per key and task before the shuffle (window group limit),
    so a key with many versions does not travel.
    """
    first = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")


def standardize(df: DataFrame, rules: dict[str, dict[str, str] | DataFrame | None]) -> DataFrame:
    """Text columns cleaned, then mapped to codes where a code list is given.

    A short list is a dict and becomes part of the plan; a long one is a table of value
    and code (its first two columns, values cleaned and each there once) and is joined,
    the size of which Spark weighs.  A value missing from its list stays as cleaned;
    ``<col>_known`` says which.
    """
    out = df
    for col, codes in rules.items():
        out = out.withColumn(col, clean_text(F.col(col)))
        if isinstance(codes, DataFrame):
            value, code = codes.columns[:2]
            table = codes.groupBy(F.col(value).alias("__value")).agg(F.min(code).alias("__code"))
            out = out.join(table, F.col(col) == F.col("__value"), "left")
            out = out.withColumn(f"{col}_known", F.col("__code").isNotNull())
            out = out.withColumn(col, F.coalesce("__code", col)).drop("__value", "__code")
        elif codes is not None:
            pairs = [F.lit(x) for pair in codes.items() for x in pair]
            code = F.try_element_at(F.create_map(*pairs), F.col(col))
            out = out.withColumn("__code", code)
            out = out.withColumn(f"{col}_known", F.col("__code").isNotNull())
            out = out.withColumn(col, F.coalesce("__code", col)).drop("__code")
    return out


def safe_cast(df: DataFrame, col: str, type_: str, name: str | None = None) -> DataFrame:
    """``col`` cast to ``type_``: null and ``<name>_failed`` where it does not fit."""
    name = name or col
    raw = F.col(col)
    cast = raw.try_cast(type_)
    failed = raw.isNotNull() & cast.isNull()
    return df.withColumns({f"{name}_failed": failed, name: cast})


def fill_missing(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls replaced by a default per column."""
    filled = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items()}
    return df.withColumns(filled)


def flag_outliers(
    df: DataFrame, col: str, by: Sequence[str], k: float = 1.5, max_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows flagged outside ``[q1 - k*iqr, q3 + k*iqr]`` of their group.

    The quartiles are exact.  They are staged, so Spark knows their size when it
    picks the join: few groups are broadcast, many are shuffled.
    """
    quartiles = stage(percentiles(df, by, col, {"q1": 0.25, "q3": 0.75}, max_rows=max_rows), "quartiles")
    renamed = quartiles.select(*[F.col(c).alias(f"__by_{c}") for c in by], "q1", "q3")
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    spread = (F.col("q3") - F.col("q1")) * k
    outside = (F.col(col) < F.col("q1") - spread) | (F.col(col) > F.col("q3") + spread)
    joined = df.join(renamed, match, "left")
    return joined.withColumn("is_outlier", outside).drop(*[f"__by_{c}" for c in by])
