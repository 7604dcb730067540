"""Data quality: profiles, expectations and the comparison of two versions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.clean import dedup_latest


def profile(df: DataFrame, exact: Sequence[str] = (), rsd: float = 0.02) -> DataFrame:
    """One row per column: rows, nulls, distinct values, smallest and largest as text.

    All columns come from one scan and one aggregation, whose sketches of distinct values
    have a fixed size and are merged by column: no value is shuffled.  Sketched counts have
    the relative standard deviation ``rsd``.  Columns in ``exact`` are counted exactly, each
    grouped by its values.
    """
    value = {c: F.col(f"`{c}`") for c in df.columns}
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, (name, col) in enumerate(value.items()):
        measures += [
            F.count(col).alias(f"n{i}"),
            F.min(col).cast("string").alias(f"lo{i}"),
            F.max(col).cast("string").alias(f"hi{i}"),
        ]
        if name not in exact:
            measures.append(F.approx_count_distinct(col, rsd).alias(f"d{i}"))
    one = df.agg(*measures)
    found = []
    for i, name in enumerate(value):
        distinct = F.lit(None).cast("bigint") if name in exact else F.col(f"d{i}")
        row = [F.lit(name).alias("column"), F.col("rows").alias("n_rows"), (F.col("rows") - F.col(f"n{i}")).alias("n_nulls"),
               distinct.alias("n_distinct"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value")]
        found.append(F.struct(*row))
    profiled = one.select(F.inline(F.array(*found)))
    if not exact:
        return profiled
    counted = [
        df.groupBy(value[c].alias("v")).agg(F.lit(1)).agg(F.count("v").alias("__n")).select(F.lit(c).alias("column"), "__n")
        for c in exact
    ]
    both = profiled.join(reduce(DataFrame.unionByName, counted), "column", "left")
    return both.withColumn("n_distinct", F.coalesce("__n", "n_distinct")).drop("__n")


@dataclass(frozen=True)
class NotNull:
    col: str


@dataclass(frozen=True)
class Unique:
    cols: tuple[str, ...]


@dataclass(frozen=True)
class InSet:
    col: str
    values: tuple


@dataclass(frozen=True)
class InRange:
    col: str
    lo: object
    hi: object


@dataclass(frozen=True)
class ForeignKey:
    col: str
    parent: DataFrame
    parent_col: str


Check = NotNull | Unique | InSet | InRange | ForeignKey


def _row_check(check: NotNull | InSet | InRange) -> tuple[str, Column]:
    match check:
        case NotNull(col):
            return f"not_null({col})", F.col(col).isNull()
        case InSet(col, values):
            return f"in_set({col})", ~F.col(col).isin(*values)
        case InRange(col, lo, hi):
            return f"in_range({col})", ~F.col(col).between(F.lit(lo), F.lit(hi))


def expect(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: its name, the rows that fail it and whether it passed.

    Checks that look at one row share a single pass.  ``Unique`` counts the rows
    beyond the first of each key; ``ForeignKey`` counts the child rows, not null,
    without a parent.  Nulls fail only ``NotNull``.
    """
    parts: list[DataFrame] = []
    simple = [_row_check(c) for c in checks if isinstance(c, NotNull | InSet | InRange)]
    if simple:
        counted = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, (_, bad) in enumerate(simple)])
        named = [F.struct(F.lit(n).alias("n"), F.col(f"c{i}").alias("f")) for i, (n, _) in enumerate(simple)]
        parts.append(counted.select(F.inline(F.array(*named))))
    for check in checks:
        if isinstance(check, Unique):
            repeats = df.groupBy(*check.cols).agg(F.count(F.lit(1)).alias("n"))
            failing = repeats.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("f"))
            parts.append(failing.select(F.lit(f"unique({','.join(check.cols)})"), "f"))
        elif isinstance(check, ForeignKey):
            # Children are counted per key first, so a frequent orphan costs one row.
            children = df.filter(F.col(check.col).isNotNull()).groupBy(F.col(check.col).alias("__fk"))
            parents = check.parent.select(F.col(check.parent_col).alias("__fk"))
            orphans = children.agg(F.count(F.lit(1)).alias("n")).join(parents, "__fk", "left_anti")
            failing = orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("f"))
            parts.append(failing.select(F.lit(f"foreign_key({check.col})"), "f"))
    named = [p.toDF("check_name", "n_failed") for p in parts]
    return reduce(DataFrame.unionByName, named).withColumn("passed", F.col("n_failed") == 0)


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ: ``missing`` from ``b``, ``extra`` in it, or ``changed``.

    Both sides are stacked and counted per distinct row, then per key.  Equal rows
    collapse before the shuffle and a key repeated on both sides never multiplies,
    as it would in a full outer join; repeated keys compare as bags of rows.
    """
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(2)))
    per_row = both.groupBy(*a.columns).agg(
        F.count_if(F.col("__side") == 1).alias("__a"), F.count_if(F.col("__side") == 2).alias("__b")
    )
    per_key = per_row.groupBy(*keys).agg(
        F.sum("__a").alias("__a"),
        F.sum("__b").alias("__b"),
        F.max(F.col("__a") != F.col("__b")).alias("__differs"),
    )
    status = (
        F.when(F.col("__b") == 0, "missing").when(F.col("__a") == 0, "extra").otherwise("changed")
    )
    return per_key.filter("__differs").select(*keys, status.alias("status"))


def upsert(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    delete_flag: str | None = None,
) -> DataFrame:
    """``target`` after a batch of changes: per key the newest row wins.

    Target rows no change mentions pass through untouched: with a small batch both
    joins broadcast its keys and the target is not shuffled.  A target row newer
    than a change beats it; at equal ``order_by`` the change wins.  A winning change
    with ``delete_flag`` set removes the key.  The result is a plan: write it to a
    new folder, never over the one it reads.
    """
    flag = F.coalesce(F.col(delete_flag), F.lit(False)) if delete_flag else F.lit(False)
    changed = changes.select(*target.columns, F.lit(1).alias("__rank"), flag.alias("__deleted"))
    touched = changes.select(*[F.col(k).alias(f"__key_{k}") for k in keys]).distinct()
    match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    untouched = target.join(touched, match, "left_anti")
    contested = target.join(touched, match, "left_semi").select(
        "*", F.lit(0).alias("__rank"), F.lit(False).alias("__deleted")
    )
    newest = newest_per_key(contested.unionByName(changed), keys, [*order_by, "__rank"])
    return untouched.unionByName(newest.filter(~F.col("__deleted")).drop("__rank", "__deleted"))


def newest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row per key; one row per key and task is kept before the shuffle."""
    return dedup_latest(df, keys, [F.col(c).desc() for c in order_by])
