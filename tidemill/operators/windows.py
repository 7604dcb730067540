"""Ranking, running and moving values, histories, top rows and samples."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import hotkeys
from tidemill.operators.hotkeys import HOT_ROWS
from tidemill.session import stage


# Rows of one key up to which a sliding frame is added up row by row.
FRAME_ROWS = 10_000


def top_k(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[Column],
    k: int,
    max_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The first ``k`` rows per key, numbered in ``rn``.

    Each task keeps ``k`` rows per key before the shuffle (window group limit).  Spark
    does so up to a limit on ``k``; above it rows are numbered by a chunked scan.
    """
    most = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > most:
        numbered = hotkeys.number_rows(df, by, order_by, "rn", max_rows)
        return numbered.withColumn("rn", F.col("rn").cast("int")).filter(F.col("rn") <= k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))
    return df.withColumn("rn", place).filter(F.col("rn") <= k)


def top_n(df: DataFrame, order_by: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of all: each task keeps ``n`` before they meet."""
    return df.orderBy(*order_by).limit(n)


def hash_sample(df: DataFrame, key: str, digits: str = "0", length: int = 1) -> DataFrame:
    """Rows whose key hashes to the given hexadecimal prefix: repeatable, 1/16 by default."""
    prefix = F.substring(F.md5(F.col(key).cast("string")), 1, length)
    return df.filter(prefix == digits)


def ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tie: str,
    tiles: int,
    max_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """rank, dense_rank, percent_rank, cume_dist by ``value``; ntile by (``value``, ``tie``).

    In keys above ``max_rows`` the rows are numbered by a chunked scan and every
    rank follows from positions: a value's first and last position, its place among
    the distinct values, and the number of rows in the key.
    """
    w = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by).orderBy(value, tie)
    hot = hotkeys.find(df, by, max_rows)
    small = df if hot is None else hot.cold_rows(df)
    out = small.select(
        "*",
        F.rank().over(w).cast("bigint").alias("rank"),
        F.dense_rank().over(w).cast("bigint").alias("dense_rank"),
        F.percent_rank().over(w).alias("percent_rank"),
        F.cume_dist().over(w).alias("cume_dist"),
        F.ntile(tiles).over(whole).cast("bigint").alias("ntile"),
    )
    if hot is None:
        return out

    # Read from the source once; what follows reads the hot rows only.
    large = stage(hot.hot_rows(df).drop("__key"), "hot-rows")
    number = hotkeys.row_number()
    numbered = hotkeys.scan(large, by, [value, tie], {"__rn": number}, hot, all_hot=True)
    distinct = numbered.groupBy(*by, value).agg(
        F.min("__rn").alias("__first"), F.max("__rn").alias("__last")
    )
    distinct = hotkeys.scan(distinct, by, [value], {"__dense": number}, hot, all_hot=True)
    totals = large.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    distinct = _left_null_safe(distinct, totals, by)
    placed = _left_null_safe(numbered, distinct, [*by, value])
    n, rn = F.col("__n"), F.col("__rn")
    small_tile, longer = F.floor(n / tiles), n % tiles
    # The first n % tiles tiles have one row more than the others.
    in_longer = rn <= longer * (small_tile + 1)
    tile = F.when(in_longer, F.ceil(rn / (small_tile + 1))).otherwise(
        longer + F.ceil(F.try_divide(rn - longer * (small_tile + 1), small_tile))
    )
    return out.unionByName(
        placed.select(
            *df.columns,
            F.col("__first").alias("rank"),
            F.col("__dense").alias("dense_rank"),
            F.coalesce(F.try_divide(F.col("__first") - 1, n - 1), F.lit(0.0)).alias("percent_rank"),
            (F.col("__last") / n).alias("cume_dist"),
            tile.cast("bigint").alias("ntile"),
        )
    )


def _left_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right.select(
        *[F.col(c).alias(f"__on_{c}") for c in on], *[c for c in right.columns if c not in on]
    )
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return left.join(renamed, match, "left").drop(*[f"__on_{c}" for c in on])


def running_total(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    col: str,
    name: str = "running_total",
    max_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Cumulative sum per key, row by row."""
    steps = {name: hotkeys.running_sum(F.col(col))}
    return hotkeys.scan(df, by, order, steps, hotkeys.find(df, by, max_rows))


def moving_sum(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    col: str,
    span: timedelta,
    cells: int = 168,
    name: str = "moving_sum",
    frame_rows: int | None = FRAME_ROWS,
    max_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Sum over ``[ts - span, ts]`` of the same key, rows at equal times included.

    Spark adds up a sliding frame anew for every row, which is fine for keys of up to
    ``frame_rows``.  A larger key is cut into time cells, ``cells`` to a span.  Its sum is
    the part of the oldest cell at or after ``ts - span``, the whole cells between,
    and the part of the row's own cell up to ``ts``: sums only, no differences of
    large totals.  The two parts are scans per (key, cell), themselves chunked where
    a cell is above ``max_rows``.  Where the span can't be cut into ``cells`` whole
    microseconds, the next smaller number is taken.  Rows without a time have the sum
    of their key's rows without a time.
    """
    micros = int(span.total_seconds() * 1_000_000)
    if micros < 1 or cells < 1:
        raise ValueError("the span and the number of cells must be positive")
    cells = next(n for n in range(min(cells, micros), 0, -1) if micros % n == 0)
    hot = hotkeys.find(df, by, frame_rows)
    days = span / timedelta(days=1)
    frame = (
        f"sum({col}) OVER (PARTITION BY {', '.join(by)} ORDER BY {ts} RANGE BETWEEN"
        f" INTERVAL '{micros / 1e6:.6f}' SECOND PRECEDING AND CURRENT ROW)"
    )
    if days == int(days):
        frame = frame.replace(f"INTERVAL '{micros / 1e6:.6f}' SECOND", f"INTERVAL {int(days)} DAYS")
    small = df if hot is None else hot.cold_rows(df)
    out = small.select("*", F.expr(frame).alias(name))
    if hot is None:
        return out

    width = micros // cells
    type_ = out.schema[name].dataType
    every = stage(hot.hot_rows(df).drop("__key"), "hot-rows")
    large, undated = every.filter(F.col(ts).isNotNull()), every.filter(F.col(ts).isNull())
    sums = undated.groupBy(*by).agg(F.sum(col).cast(type_).alias(name))
    out = out.unionByName(_left_null_safe(undated, sums, by))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    points = large.groupBy(*by, at.alias("__t")).agg(F.sum(col).alias("__v"))
    points = points.withColumn("__cell", F.floor(F.col("__t") / F.lit(width)))
    in_cell = [*by, "__cell"]
    hot_cells = hotkeys.find(points, in_cell, max_rows)
    head = hotkeys.scan(
        points, in_cell, ["__t"], {"__head": hotkeys.running_sum(F.col("__v"))}, hot_cells
    ).select(*by, "__t", "__cell", "__head")
    # Probes stand at t - span and see the points of that cell from there on.
    probes = points.select(
        *by,
        (F.col("__t") - micros).alias("__t"),
        (F.col("__cell") - cells).alias("__cell"),
        F.lit(1).alias("__probe"),
        F.lit(None).cast(points.schema["__v"].dataType).alias("__v"),
    )
    backwards = points.withColumn("__probe", F.lit(0)).unionByName(probes)
    tail = hotkeys.scan(
        backwards,
        in_cell,
        [F.col("__t").desc(), F.col("__probe")],
        {"__tail": hotkeys.running_sum(F.col("__v"))},
        hotkeys.find(backwards, in_cell, max_rows),
    )
    tail = tail.filter("__probe = 1").select(*by, (F.col("__t") + micros).alias("__t"), "__tail")
    between = Window.partitionBy(*by).orderBy("__cell").rangeBetween(-(cells - 1), -1)
    middle = points.groupBy(*in_cell).agg(F.sum("__v").alias("__v"))
    middle = middle.select(*in_cell, F.sum("__v").over(between).alias("__middle"))
    parts = _left_null_safe(_left_null_safe(head, tail, [*by, "__t"]), middle, in_cell)
    amounts = [F.col(c) for c in ("__tail", "__middle", "__head")]
    known = F.coalesce(*amounts).isNotNull()
    total = sum((F.coalesce(a, F.lit(0)) for a in amounts[1:]), F.coalesce(amounts[0], F.lit(0)))
    parts = parts.select(*by, "__t", F.when(known, total).cast(type_).alias(name))
    placed = _left_null_safe(large.withColumn("__t", at), parts, [*by, "__t"])
    return out.unionByName(placed.drop("__t"))


def growth(df: DataFrame, period: Column, measure: Column) -> DataFrame:
    """A measure per whole-number period, with its change on the period before.

    The period before is looked up by number, so a gap gives null, not the change
    since some older period.
    """
    per = df.groupBy(period.cast("bigint").alias("period")).agg(measure.alias("value"))
    prior = per.select((F.col("period") + 1).alias("period"), F.col("value").alias("prior_value"))
    joined = per.join(prior, "period", "left")
    return joined.withColumn("change", F.col("value") - F.col("prior_value"))


def first_last(df: DataFrame, by: Sequence[str], order: Sequence[str], col: str) -> DataFrame:
    """Every row with its key's first and last value of ``col``.

    Both are aggregates combined before the shuffle, joined back; no window sorts a key.
    """
    at = F.struct(*order)
    ends = df.groupBy(*by).agg(
        F.min_by(col, at).alias(f"first_{col}"), F.max_by(col, at).alias(f"last_{col}")
    )
    return _left_null_safe(df, ends, by)


def scd2(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    cols: Sequence[str],
    tie: Sequence[str] = (),
    max_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """History of ``cols``: one row per run of equal values, valid in ``[from, to)``.

    The last run of a key is open: ``valid_to`` is null and ``is_current`` true.
    """
    hot = hotkeys.find(df, key, max_rows)
    state = F.struct(*cols)
    order = [ts, *tie]
    states = df.select(*key, *order, *[c for c in cols if c not in order])
    seen = hotkeys.scan(states, key, order, {"__prev": hotkeys.previous(state)}, hot)
    starts = F.col("__prev").isNull() | ~F.col("__prev.v").eqNullSafe(state)
    changed = seen.filter(starts).drop("__prev")
    runs = hotkeys.scan(changed, key, order, {"__next": hotkeys.following(F.col(ts))}, hot)
    return runs.select(
        *key,
        *cols,
        F.col(ts).alias("valid_from"),
        F.col("__next.v").alias("valid_to"),
        F.col("__next").isNull().alias("is_current"),
    )
