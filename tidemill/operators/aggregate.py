"""Aggregations.  All combine before the shuffle; none holds a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import hotkeys
from tidemill.operators.hotkeys import HOT_ROWS
from tidemill.session import stage


def summarize(df: DataFrame, by: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()])


def _levels(cols: Sequence[str]) -> Column:
    return F.grouping_id(*cols).cast("bigint").alias("level_id")


def rollup_totals(df: DataFrame, cols: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Totals at every prefix of ``cols``; ``level_id`` has a bit per column left out."""
    return df.rollup(*cols).agg(_levels(cols), *[m.alias(n) for n, m in measures.items()])


def cube_totals(df: DataFrame, cols: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Totals at every subset of ``cols``."""
    return df.cube(*cols).agg(_levels(cols), *[m.alias(n) for n, m in measures.items()])


def grouping_set_totals(
    df: DataFrame, sets: Sequence[Sequence[str]], measures: dict[str, Column]
) -> DataFrame:
    """Totals at the given subsets only."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    chosen = [[F.col(c) for c in s] for s in sets]
    return df.groupingSets(chosen, *cols).agg(
        _levels(cols), *[m.alias(n) for n, m in measures.items()]
    )


def distinct_counts(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in cols])


def approx_distinct(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], rsd: float = 0.02
) -> DataFrame:
    """Distinct counts within relative standard deviation ``rsd``, from sketches."""
    return df.groupBy(*by).agg(*[F.approx_count_distinct(c, rsd).alias(f"n_{c}") for c in cols])


def distinct_sketches(df: DataFrame, by: Sequence[str], cols: Sequence[str], lg_k: int = 12) -> DataFrame:
    """One sketch column ``s_<column>`` per column and group, to be stored.

    A sketch has at most about ``2 ** lg_k`` bytes whatever it has seen.  The relative
    standard error of its estimate is about ``1.04 / sqrt(2 ** lg_k)``.  Columns are of
    whole numbers, text or bytes; nulls don't count.
    """
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(c, lg_k).alias(f"s_{c}") for c in cols])


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of larger groups from stored ones: no row is read again."""
    names = [c for c in sketches.columns if c.startswith("s_")]
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(c).alias(c) for c in names])


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """Sketch columns ``s_<column>`` as estimates ``n_<column>``."""
    return sketches.select(*[
        F.hll_sketch_estimate(c).alias(f"n_{c[2:]}") if c.startswith("s_") else F.col(c) for c in sketches.columns
    ])


def percentiles(
    df: DataFrame,
    by: Sequence[str],
    col: str,
    ps: dict[str, float],
    exact: bool = True,
    accuracy: int = 10_000,
    max_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One column per entry of ``ps``, interpolated between neighbouring values.

    Exact percentiles of small groups use Spark's own aggregate, which holds the
    group's distinct values in memory.  In groups above ``max_rows`` values are
    counted, numbered by a chunked scan, and only those at the wanted positions
    are kept.  ``exact=False`` uses a sketch of fixed size instead.
    """
    names, at = list(ps), [float(p) for p in ps.values()]
    if not exact:
        return df.groupBy(*by).agg(
            *[F.percentile_approx(col, p, accuracy).alias(n) for n, p in ps.items()]
        )
    values = df.select(*by, F.col(col).cast("double").alias("__v")).filter("__v IS NOT NULL")
    hot = hotkeys.find(values, by, max_rows)
    small = values if hot is None else hot.cold_rows(values)
    out = small.groupBy(*by).agg(F.percentile("__v", F.array(*map(F.lit, at))).alias("__ps"))
    out = out.select(*by, *[F.get("__ps", i).alias(n) for i, n in enumerate(names)])
    if hot is None:
        return out

    # Read from the source once; what follows reads the hot rows only.
    large = stage(hot.hot_rows(values).drop("__key"), "hot-rows")
    counts = large.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    upto = hotkeys.scan(counts, by, ["__v"], {"__upto": hotkeys.running_sum(F.col("__n"))}, hot, all_hot=True)
    totals = large.groupBy(*[F.col(c).alias(f"__t_{c}") for c in by]).agg(
        F.count(F.lit(1)).alias("__total")
    )
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__t_{c}"))
    placed = upto.join(totals, match)
    picks, columns = [], []
    for n, p in zip(names, at):
        position = (F.col("__total") - 1) * F.lit(p)

        def value_at(k: Column) -> Column:
            held = (F.col("__upto") > k) & (F.col("__upto") - F.col("__n") <= k)
            return F.max(F.when(held, F.col("__v")))

        picks += [
            value_at(F.floor(position)).alias(f"__lo_{n}"),
            value_at(F.ceil(position)).alias(f"__hi_{n}"),
            F.max(position - F.floor(position)).alias(f"__f_{n}"),
        ]
        lo, hi = F.col(f"__lo_{n}"), F.col(f"__hi_{n}")
        columns.append((lo + (hi - lo) * F.col(f"__f_{n}")).alias(n))
    return out.unionByName(placed.groupBy(*by).agg(*picks).select(*by, *columns))


def pivot_counts(df: DataFrame, row: Sequence[str], col: str, values: Sequence[str]) -> DataFrame:
    """Row counts with one column per listed value, zero where there is none."""
    return df.groupBy(*row).agg(*[F.count_if(F.col(col) == v).alias(v) for v in values])


def to_long(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def histogram(df: DataFrame, col: str, lo: float, hi: float, n: int) -> DataFrame:
    """Rows per bucket of equal width: 0 is below ``lo``, ``n + 1`` at or above ``hi``."""
    bucket = F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(n).cast("bigint"))
    return df.groupBy(bucket.cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def paths(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    col: str,
    sep: str = ">",
    missing: str = "?",
    steps: int = 1000,
    max_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Values of ``col`` in order as text, one row per key and run of ``steps`` values.

    Parts are numbered from 0; joined in order they are the whole path.  A part is
    what one task and one cell can hold, however long the path.  A null step is written
    as ``missing``.
    """
    numbered = hotkeys.number_rows(df.select(*by, *order, col), by, order, "__rn", max_rows)
    part = F.floor((F.col("__rn") - 1) / F.lit(steps)).alias("part")
    collected = F.array_sort(F.collect_list(F.struct("__rn", F.col(col).alias("v"))))
    path = F.array_join(F.transform(collected, lambda x: x["v"]), sep, missing)
    return numbered.groupBy(*by, part).agg(F.count(F.lit(1)).alias("n_steps"), path.alias("path"))
