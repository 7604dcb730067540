"""Ordered per-key computations that survive a key with a third of all rows.

A Spark window puts every row of a key into one task.  That is the plan to have
while keys are small, and a failure once one of them is not.  ``find`` counts the
rows per key (combined before the shuffle) and names the keys above a limit.
``scan`` then leaves ordinary keys to a plain window and handles the hot ones as
a prefix scan:

1. range-partition the hot rows by (key, order), which cuts a key into chunks of
   about equal size that follow each other in order, and pin them in the shared
   folder;
2. run the window inside each (key, chunk);
3. reduce each chunk to one small state, run a window over those states, and
   combine what came before (or after) a chunk with the chunk's own values.

Step 3 handles one row per (hot key, chunk), a number bounded by the chunk count
plus the hot key count, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.session import stage

# Rows of one key that one task may sort.  Above MAX_CHUNKS / 2 times that many hot
# rows chunks grow instead of their number, and a task's sort spills.
HOT_ROWS = 2_000_000
MAX_CHUNKS = 20_000

_KEY, _CHUNK, _POS, _ROWS = "__key", "__chunk", "__pos", "__rows"

Order = Sequence[str | Column]


@dataclass(frozen=True)
class HotKeys:
    """The keys above the limit, one row each, with a surrogate number."""

    frame: DataFrame
    by: tuple[str, ...]
    chunks: int

    def _match(self) -> Column:
        return reduce(
            lambda a, b: a & b,
            [F.col(c).eqNullSafe(F.col(f"__hot_{c}")) for c in self.by],
        )

    def cold_rows(self, df: DataFrame) -> DataFrame:
        return df.join(self.frame, self._match(), "left_anti")

    def hot_rows(self, df: DataFrame) -> DataFrame:
        """Rows of hot keys, with the surrogate key as one more column."""
        return df.join(self.frame, self._match()).select(*df.columns, _KEY)


def find(df: DataFrame, by: Sequence[str], max_rows: int | None = HOT_ROWS) -> HotKeys | None:
    """Keys with more than ``max_rows`` rows; ``None`` if there are none.

    Runs one aggregation that reads the key columns only.  ``max_rows=None`` skips
    it, for inputs whose keys are known to be small.
    """
    if max_rows is None:
        return None
    big = (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias(_ROWS))
        .filter(F.col(_ROWS) > max_rows)
        .select(*[F.col(c).alias(f"__hot_{c}") for c in by], _ROWS)
    )
    total = big.agg(F.sum(_ROWS)).first()[0]
    if total is None:
        return None
    keys = stage(big.drop(_ROWS).withColumn(_KEY, F.monotonically_increasing_id()), "hot-keys")
    chunks = min(MAX_CHUNKS, max(2, math.ceil(2 * total / max(1, max_rows))))
    return HotKeys(keys, tuple(by), chunks)


@dataclass(frozen=True)
class Step:
    """One computed column, in the form a chunked scan needs.

    ``local``   the column over a window that holds a whole key, or one chunk
    ``state``   the aggregate one chunk passes on, given the position column
    ``carry``   the states of other chunks, over a window of the key's chunks
    ``combine`` the local value and the carried one put together
    """

    local: Callable[[WindowSpec], Column]
    state: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    combine: Callable[[Column, Column], Column]


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _through(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def row_number() -> Step:
    return Step(
        local=lambda w: F.row_number().over(w).cast("bigint"),
        state=lambda pos: F.count(F.lit(1)),
        carry=lambda c, w: F.sum(c).over(_before(w)),
        combine=lambda own, prior: own + F.coalesce(prior, F.lit(0)),
    )


def running_sum(value: Column) -> Step:
    return Step(
        local=lambda w: F.sum(value).over(_through(w)),
        state=lambda pos: F.sum(value),
        carry=lambda c, w: F.sum(c).over(_before(w)),
        combine=lambda own, prior: F.coalesce(own + prior, own, prior),
    )


def previous(value: Column) -> Step:
    """The row before, as a struct; null only where there is none."""
    boxed = F.struct(value.alias("v"))
    return Step(
        local=lambda w: F.lag(boxed).over(w),
        state=lambda pos: F.max_by(boxed, pos),
        carry=lambda c, w: F.lag(c).over(w),
        combine=F.coalesce,
    )


def following(value: Column) -> Step:
    """The row after, as a struct; null only where there is none."""
    boxed = F.struct(value.alias("v"))
    return Step(
        local=lambda w: F.lead(boxed).over(w),
        state=lambda pos: F.min_by(boxed, pos),
        carry=lambda c, w: F.lead(c).over(w),
        combine=F.coalesce,
    )


def last_seen(value: Column) -> Step:
    """The latest non-null value at or before the row."""
    return Step(
        local=lambda w: F.last(value, ignorenulls=True).over(_through(w)),
        state=lambda pos: F.max_by(value, F.when(value.isNotNull(), pos)),
        carry=lambda c, w: F.last(c, ignorenulls=True).over(_before(w)),
        combine=F.coalesce,
    )


def _chunked(df: DataFrame, hot: HotKeys, order_by: Order) -> DataFrame:
    """Hot rows cut into ordered chunks; positions follow the order everywhere."""
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    ranged = (
        hot.hot_rows(df)
        .repartitionByRange(hot.chunks, F.col(_KEY), *order)
        .sortWithinPartitions(F.col(_KEY), *order)
        .withColumn(_CHUNK, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id())
    )
    return stage(ranged, "hot-rows")


def scan(
    df: DataFrame,
    by: Sequence[str],
    order_by: Order,
    steps: dict[str, Step],
    hot: HotKeys | None,
    all_hot: bool = False,
) -> DataFrame:
    """``df`` with one column per step, computed in order within each key.

    ``order_by`` should decide the order fully: rows it leaves tied come in any
    order, as in any window.  With ``all_hot`` every row of ``df`` is of a hot key and
    ordinary keys are not looked for.
    """
    window = Window.partitionBy(*by).orderBy(*order_by)
    plain = df if hot is None else hot.cold_rows(df)
    plain = plain.select("*", *[s.local(window).alias(n) for n, s in steps.items()])
    if hot is None:
        return plain

    rows = _chunked(df, hot, order_by)
    inside = Window.partitionBy(_KEY, _CHUNK).orderBy(_POS)
    local = rows.select("*", *[s.local(inside).alias(n) for n, s in steps.items()])
    states = rows.groupBy(_KEY, _CHUNK).agg(
        *[s.state(F.col(_POS)).alias(f"__state_{n}") for n, s in steps.items()]
    )
    across = Window.partitionBy(_KEY).orderBy(_CHUNK)
    carried = states.select(
        _KEY,
        _CHUNK,
        *[s.carry(F.col(f"__state_{n}"), across).alias(f"__carry_{n}") for n, s in steps.items()],
    )
    # Adding states up widens decimals; the column keeps the type it has in small keys.
    types = {n: plain.schema[n].dataType for n in steps}
    scanned = local.join(carried, [_KEY, _CHUNK], "left").select(
        *df.columns,
        *[
            s.combine(F.col(n), F.col(f"__carry_{n}")).cast(types[n]).alias(n)
            for n, s in steps.items()
        ],
    )
    return scanned if all_hot else plain.unionByName(scanned)


def number_rows(
    df: DataFrame, by: Sequence[str], order_by: Order, name: str, max_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Position of each row within its key, from 1."""
    return scan(df, by, order_by, {name: row_number()}, find(df, by, max_rows))
