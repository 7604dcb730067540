"""Joins: star, semi, anti, as-of, interval, band, pairs in a group, dense grids.

No join carries a broadcast hint.  Spark broadcasts a side whose size, from file
or run-time statistics, is below ``spark.sql.autoBroadcastJoinThreshold`` and
shuffles it otherwise; adaptive execution splits skewed partitions.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import hotkeys
from tidemill.operators.hotkeys import HOT_ROWS
from tidemill.operators.windows import top_k
from tidemill.session import stage

# Distinct items up to which a group's pairs are listed directly: at most half as
# many pairs per input row.  Larger groups take the other way in ``pairs``.
DIRECT_ITEMS = 100
# Rows, groups or pairs that one task of ``pairs`` counts: tasks grow in number, not in memory.
TASK_ROWS = 500_000
# Slices per task, so that tasks get about as much as each other.
TASK_SLICES = 8
# Cells of band joins are four times as wide from level to level.
LEVEL_STEP = 2


def enrich(fact: DataFrame, dims: Sequence[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """``fact`` widened by each dimension in turn; ``{left column: dimension key}``."""
    wide = fact
    for dim, keys in dims:
        match = reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in keys.items()])
        wide = wide.join(dim, match)
    return wide


def having_match(a: DataFrame, b: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``a`` with a match in ``b``, each once."""
    return _by_presence(a, b, on, "left_semi")


def without_match(a: DataFrame, b: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``a`` with no match in ``b``; a null key matches nothing."""
    return _by_presence(a, b, on, "left_anti")


def _by_presence(a: DataFrame, b: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    # Distinct keys first: a key repeated in b is combined before the shuffle.
    found = b.select(*[F.col(k).alias(f"__{k}") for k in on.values()]).distinct()
    match = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__{v}") for k, v in on.items()])
    return a.join(found, match, how)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    right_cols: dict[str, str],
    tolerance: timedelta | None = None,
    max_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Each left row with the latest right row at or before it, for the same key.

    ``on`` and ``by`` have the same names on both sides; ``right_cols`` maps right
    columns to their names in the result, null where no row qualifies.  Right rows
    with equal times are ranked by those columns.  Both sides are stacked and the
    last right row seen is carried forward, so nothing is paired up.  A null key or
    time matches nothing, on either side.
    """
    found = F.struct(F.col(on).alias("__on"), *[F.col(c).alias(n) for c, n in right_cols.items()])
    whole = F.struct(*left.columns)
    lefts = left.select(*by, on, F.lit(1).alias("__side"), whole.alias("__row"))
    dated = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, on)])
    rights = right.filter(dated).select(*by, on, F.lit(0).alias("__side"), found.alias("__found"))
    stacked = rights.unionByName(lefts, allowMissingColumns=True)
    seen = hotkeys.scan(
        stacked,
        by,
        [on, "__side", "__found"],
        {"__seen": hotkeys.last_seen(F.col("__found"))},
        hotkeys.find(stacked, by, max_rows),
    )
    near = F.lit(True)
    if tolerance is not None:
        near = F.col("__seen.__on") >= F.col(on) - F.lit(tolerance)
    return seen.filter("__side = 1").select(
        "__row.*", *[F.when(near, F.col(f"__seen.`{n}`")).alias(n) for n in right_cols.values()]
    )


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    by: dict[str, str],
    left_ts: str,
    right_ts: str,
    within: timedelta,
    salts: int = 1,
) -> DataFrame:
    """Pairs of one key with ``left_ts <= right_ts <= left_ts + within``.

    Time is cut into buckets of that width and the bucket joins the equality key,
    so a busy key is spread over time and only neighbours are compared.  A left row
    looks into its own bucket and the next; a right row is in one, hence each pair
    comes out once.  Column names must not overlap.

    Adaptive execution splits a bucket that is still hot.  Streams have none: there
    ``salts`` spreads a bucket's left rows and lists its right rows once per salt.
    """
    width = max(1, int(within.total_seconds() * 1_000_000))
    bucket = F.floor(_micros(F.col(left_ts)) / F.lit(width))
    looking = left.withColumn("__lb", F.explode(F.array(bucket, bucket + 1)))
    held = right.withColumn("__rb", F.floor(_micros(F.col(right_ts)) / F.lit(width)))
    match = F.col("__lb") == F.col("__rb")
    if salts > 1:
        drawn = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
        looking = looking.withColumn("__ls", drawn)
        held = held.withColumn("__rs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        match = match & (F.col("__ls") == F.col("__rs"))
    for x, y in by.items():
        match = match & (F.col(x) == F.col(y))
    later = F.col(right_ts) >= F.col(left_ts)
    close = F.col(right_ts) <= F.col(left_ts) + F.lit(within)
    return looking.join(held, match & later & close).drop("__lb", "__rb", "__ls", "__rs")


def band_join(df: DataFrame, bands: DataFrame, col: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each row with every band whose ``[lo, hi)`` holds ``col``; bands may overlap.

    A null edge leaves a band open on that side.  Cells come in several widths, powers of
    ``2 ** LEVEL_STEP``: a band is listed in the two or three cells it touches of the width
    next above its own, however wide it is, and a value is looked for once per width in
    use, of which there are as many as the bands' widths have orders of magnitude.  So the
    range condition becomes an equality plus a residual test and never a nested loop over
    all bands.  Open bands are as wide as the values reach.  Infinite values and NaN meet
    bands that are open or have such an edge.
    """
    number = F.col(col).cast("double")
    endless = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    seen = df.where(~endless(number)).agg(F.min(number), F.max(number)).first()
    least, most = seen[0] or 0.0, seen[1] or 0.0
    edge = lambda c, open_at: F.when(F.col(c).isNull() | endless(F.col(c).cast("double")), F.lit(open_at)).otherwise(F.col(c).cast("double"))
    sized = bands.withColumns({"__lo": edge(lo, least), "__hi": edge(hi, most)})
    # No cell is so narrow that numbers of this size could not be told apart in it.
    size = F.greatest(F.abs(F.col("__lo")), F.abs(F.col("__hi")))
    span = F.greatest(F.col("__hi") - F.col("__lo"), size * 2.0**-50, F.lit(2.0**-900))
    level = F.ceil(F.log2(F.least(span, F.lit(sys.float_info.max))) / LEVEL_STEP)
    sized = sized.withColumn("__level_b", level.cast("int"))
    cells = F.sequence(_cell(F.col("__lo"), F.col("__level_b")), _cell(F.col("__hi"), F.col("__level_b")))
    special = F.col(lo).isNull() | F.col(hi).isNull() | endless(F.col(lo).cast("double")) | endless(F.col(hi).cast("double"))
    # A band that ends before it starts holds nothing.
    cells = F.when(F.col("__hi") >= F.col("__lo"), cells).otherwise(F.array().cast("array<bigint>"))
    at = lambda level, cell: F.struct(level.alias("level"), cell.alias("cell"))
    listed = F.transform(cells, lambda c: at(F.col("__level_b"), c))
    none = at(F.lit(None).cast("int"), F.lit(0).cast("bigint"))
    listed = F.when(special, F.concat(listed, F.array(none))).otherwise(listed)
    sized = sized.withColumn("__at_b", F.explode(listed)).drop("__lo", "__hi", "__level_b")
    # Not more than there are powers of two in a double.
    levels = [r[0] for r in sized.select("__at_b.level").distinct().collect() if r[0] is not None]
    looked = F.array(*[at(F.lit(n).cast("int"), _cell(number, F.lit(n))) for n in levels]) if levels else F.array().cast("array<struct<level:int,cell:bigint>>")
    placed = df.where(F.col(col).isNotNull()).withColumn("__at", F.explode(F.when(endless(number), F.array(none)).otherwise(looked)))
    inside = (F.col(lo).isNull() | (F.col(col) >= F.col(lo))) & (F.col(hi).isNull() | (F.col(col) < F.col(hi)))
    match = F.col("__at.level").eqNullSafe(F.col("__at_b.level")) & (F.col("__at.cell") == F.col("__at_b.cell")) & inside
    return placed.join(sized, match).drop("__at", "__at_b")


def _cell(x: Column, level: Column) -> Column:
    """The cell a number is in; larger numbers are never in an earlier one."""
    at = x / F.pow(F.lit(2.0**LEVEL_STEP), level)
    return F.floor(F.greatest(F.least(at, F.lit(2.0**62)), F.lit(-(2.0**62))))


def pairs(
    df: DataFrame, group: str, item: str, min_n: int, direct_items: int = DIRECT_ITEMS
) -> DataFrame:
    """Item pairs found together in at least ``min_n`` groups, with that number.

    Groups of up to ``direct_items`` distinct items list their pairs: work linear in
    the rows.  A larger group is never listed whole.  It contributes in two ways:

    * for pairs that small groups produced, by looking up both items in it;
    * for pairs that only large groups hold, by prefix filtering.  Take an item's
      large groups in order of size.  Two items that share ``min_n`` of them share
      one outside the ``min_n - 1`` largest of either, so those are left out when
      candidates are formed - the very largest groups never form any - and the
      surviving candidates are counted exactly afterwards.

    The candidates of large groups number half the sum, over groups, of the squared
    number of items for which the group is not among their ``min_n - 1`` largest.  Ten
    groups of ``n`` items, each item in three and ``min_n`` 3, form about
    ``10 * (n / 3) ** 2 / 2``: the result itself can be of that size.  A pair that can't
    reach ``min_n`` with all the large groups of its rarer item is dropped before it is
    counted.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i")).dropna()
    # A group with few rows has few items; only the others need their items counted.
    sizes = _counted(rows, ["g"], ["g", "i"], _tasks(df, df.count()))
    listed = F.least(F.col("n"), F.lit(direct_items))
    most, n_pairs = sizes.agg(F.max("n"), F.sum(listed * (listed - 1) / 2)).first()
    tasks = _tasks(df, n_pairs or 0)
    if (most or 0) <= direct_items:
        return _listed_counts(rows, tasks).filter(F.col("n") >= min_n)

    members = rows.distinct()
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    large = stage(sizes.filter(F.col("size") > direct_items), "large-groups")
    counted = _listed_counts(members.join(large, "g", "left_anti"), tasks)
    in_large = stage(members.join(large, "g"), "large-group-items")
    largest = _largest_groups(in_large, min_n - 1)
    # An item in too few large groups forms no candidate there.
    enough = in_large.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    prefix = in_large.join(enough.select("i"), "i", "left_semi")
    prefix = prefix.join(largest, ["i", "g"], "left_anti").select("g", "i")
    only_large = _paired(prefix).distinct().withColumn("n", F.lit(0).cast("bigint"))
    # Pairs of small groups and candidates of large ones meet in one row per pair.
    known = counted.unionByName(only_large).groupBy("a", "b").agg(F.sum("n").alias("n"))
    in_groups = in_large.groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    most = F.col("n") + F.least(F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0)))
    known = (
        known.join(in_groups.select(F.col("i").alias("a"), F.col("d").alias("da")), "a", "left")
        .join(in_groups.select(F.col("i").alias("b"), F.col("d").alias("db")), "b", "left")
        .filter(most >= min_n)
        .select("a", "b", "n")
    )
    known = stage(known, "known-pairs")
    return _add_large(known, in_large.select("i", "g")).filter(F.col("n") >= min_n)


def _tasks(df: DataFrame, rows: float) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def _counted(rows: DataFrame, by: Sequence[str], spread_by: Sequence[str], tasks: int) -> DataFrame:
    """Rows per ``by`` in ``tasks`` tasks, counted in slices first, so that a busy value sends
    a row per slice."""
    return _summed(_sliced(rows, spread_by, tasks), by, tasks)


def _sliced(rows: DataFrame, by: Sequence[str], tasks: int) -> DataFrame:
    slice_no = F.pmod(F.xxhash64(*by), F.lit(tasks * TASK_SLICES)).cast("int")
    return rows.withColumn("slice", slice_no).repartition(tasks, "slice")


def _summed(slices: DataFrame, by: Sequence[str], tasks: int) -> DataFrame:
    """Rows per ``by`` of rows that are dealt by ``slice``."""
    parts = slices.groupBy("slice", *by).agg(F.count(F.lit(1)).alias("n"))
    return parts.repartition(tasks, *by).groupBy(*by).agg(F.sum("n").alias("n"))


def _listed_counts(members: DataFrame, tasks: int) -> DataFrame:
    """Pairs ``a < b`` of small groups with the number of groups, each group's items as one
    short array."""
    items = F.array_sort(F.collect_set("i"))
    baskets = _sliced(members, ["g"], tasks).groupBy("slice", "g").agg(items.alias("items"))
    first = baskets.filter(F.size("items") > 1).select("slice", "items", F.posexplode("items").alias("at", "a"))
    rest = F.slice("items", F.col("at") + 2, F.size("items"))
    return _summed(first.select("slice", "a", F.explode(rest).alias("b")), ["a", "b"], tasks)


def _paired(members: DataFrame) -> DataFrame:
    """Pairs ``a < b`` that share a group, by a join that splits over tasks."""
    first = members.select("g", F.col("i").alias("a"))
    second = members.select("g", F.col("i").alias("b"))
    return first.join(second, "g").filter("a < b").select("a", "b")


def _largest_groups(in_large: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest groups of each item."""
    order = [F.col("size").desc(), F.col("g").desc()]
    return top_k(in_large, ["i"], order, k).select("i", "g")


def _add_large(known: DataFrame, in_large: DataFrame) -> DataFrame:
    """Counts of ``known`` plus the large groups that hold both items of the pair."""
    degree = in_large.groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    # Walk the groups of the rarer item and look the other one up.
    sided = (
        known.join(degree.select(F.col("i").alias("a"), F.col("d").alias("da")), "a")
        .join(degree.select(F.col("i").alias("b"), F.col("d").alias("db")), "b")
        .withColumn("rare", F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")))
        .withColumn("other", F.when(F.col("da") <= F.col("db"), F.col("b")).otherwise(F.col("a")))
    )
    walked = sided.join(in_large.withColumnRenamed("i", "rare"), "rare")
    both = walked.join(in_large.withColumnRenamed("i", "other"), ["other", "g"], "left_semi")
    more = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(more).groupBy("a", "b").agg(F.sum("n").alias("n"))


def densify(
    df: DataFrame,
    dims: DataFrame,
    on: dict[str, str],
    date_col: str,
    measures: dict[str, Column],
) -> DataFrame:
    """Every day of ``df``'s range for every row of ``dims``, zero where ``df`` has none.

    Each dimension row generates its own days, between two scalar subqueries, so the
    grid takes no cross join.  ``on`` maps dimension columns to ``df`` columns.
    """
    day = F.to_date(date_col).alias("__day")
    counted = df.groupBy(*[F.col(v).alias(f"__{v}") for v in on.values()], day).agg(
        *[m.alias(n) for n, m in measures.items()]
    )
    bounds = counted.agg(F.min("__day").alias("lo"), F.max("__day").alias("hi"))
    days = F.sequence(bounds.select("lo").scalar(), bounds.select("hi").scalar())
    grid = dims.withColumn("day", F.explode(days))
    match = F.col("day") == F.col("__day")
    for x, y in on.items():
        match = match & (F.col(x) == F.col(f"__{y}"))
    joined = grid.join(counted, match, "left")
    filled = [F.coalesce(n, F.lit(0)).alias(n) for n in measures]
    return joined.select(*dims.columns, "day", *filled)
