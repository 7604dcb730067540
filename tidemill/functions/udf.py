"""User-defined functions: scalar, aggregate, table and grouped map.

These are the extension surface, for what no built-in function expresses.  All
exchange Arrow batches; none receives an unbounded group in one call.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import hotkeys

# Rows of one group that one Python call receives.
GROUP_ROWS = 500_000
# Text that is made into words at a time.
SLICE_BYTES = 1 << 20
_SPACE = re.compile(r"[ \t\r\n]")

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register_scalar(spark: SparkSession, name: str, fn: Callable, type_: str):
    """A function from pandas Series to Series, for Python and SQL."""
    return spark.udf.register(name, F.pandas_udf(fn, type_))


def register_agg(spark: SparkSession, name: str, fn: Callable, type_: str):
    """A grouped aggregate ``fn(values: Series, counts: Series) -> scalar``.

    It receives distinct values with their counts; see ``aggregate_counts``.
    """
    return spark.udf.register(name, F.pandas_udf(fn, type_))


def aggregate_counts(df: DataFrame, by: Sequence[str], col: str, udaf, name: str) -> DataFrame:
    """Apply a registered aggregate to the distinct values of ``col`` and their counts.

    Spark hands an aggregate in Python its whole group.  Counting values first
    bounds that by the column's distinct values - use it for columns with a small
    domain, and ``percentiles`` for others.
    """
    counted = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*by).agg(udaf(F.col(col), F.col("__n")).alias(name))


def weighted_median(values: pd.Series, counts: pd.Series) -> float:
    """Median of values that occur ``counts`` times; the middle two are averaged."""
    known = values.notna()
    ordered = pd.DataFrame({"v": values[known], "n": counts[known]}).sort_values("v")
    if ordered.empty:
        return float("nan")
    upto = ordered["n"].cumsum().to_numpy()
    total = int(upto[-1])
    low, high = upto.searchsorted([(total - 1) // 2, total // 2], side="right")
    v = ordered["v"].to_numpy()
    return float((v[low] + v[high]) / 2)


class Quantiles:
    """A mergeable summary of numbers in bounded memory, for ``aggregate_partial``.

    Buffers of ``size`` numbers stand for ``2 ** level`` times as many.  Two full buffers of
    a level are sorted together and every other number goes to the next level.  One such
    step moves a rank by at most ``2 ** level``, so after ``n`` numbers a rank is off by at
    most ``n * log2(n / size) / (2 * size)``; up to ``size`` numbers nothing is lost.
    """

    def __init__(self, size: int = 2048):
        self.size = size
        self.levels: list[np.ndarray] = []

    def add(self, values: np.ndarray, level: int = 0) -> None:
        """Take in numbers that stand for ``2 ** level`` each; NaN is left out."""
        values = values[~np.isnan(values)]
        while len(self.levels) <= level:
            self.levels.append(np.zeros(0))
        held = np.concatenate([self.levels[level], values])
        full = len(held) // (2 * self.size) * 2 * self.size
        self.levels[level] = held[full:]
        if full:
            pairs = np.sort(held[:full].reshape(-1, 2 * self.size), axis=1)
            # Odd and even places in turn, so that errors do not add up.
            self.add(pairs[:, level % 2 :: 2].ravel(), level + 1)

    def merge(self, other: Quantiles) -> None:
        for level, values in enumerate(other.levels):
            self.add(values, level)

    def dump(self) -> bytes:
        lengths = np.array([self.size, *map(len, self.levels)], np.int64)
        return np.int64(len(lengths)).tobytes() + lengths.tobytes() + b"".join(v.tobytes() for v in self.levels)

    @classmethod
    def load(cls, state: bytes) -> Quantiles:
        n = int(np.frombuffer(state, np.int64, 1)[0])
        size, *lengths = np.frombuffer(state, np.int64, n, 8).tolist()
        out, values = cls(size), np.frombuffer(state, np.float64, offset=8 * (n + 1))
        out.levels = np.split(values, np.cumsum(lengths)[:-1]) if lengths else []
        return out

    def quantile(self, p: float) -> float:
        """The number at rank ``p``, between the middle two where there are two."""
        if not sum(map(len, self.levels)):
            return float("nan")
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 2**i, np.int64) for i, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        at = p * (upto[-1] - 1)
        low, high = upto.searchsorted([np.floor(at), np.ceil(at)], side="right")
        a, b = values[order[low]], values[order[high]]
        return float(a if a == b else a + (b - a) * (at - np.floor(at)))


def aggregate_partial(
    df: DataFrame, by: Sequence[str], col: str, make: Callable[[], Quantiles], finish: Callable, name: str
) -> DataFrame:
    """An aggregate in Python in two phases, for groups and domains of any size.

    ``make()`` gives an empty state of bounded size with ``add(array)``, ``merge(state)``,
    ``dump()`` and ``load(bytes)``; ``finish(state)`` is the group's result.  Every task
    makes a state per group; states of a group meet in as many tasks as the root of the
    input's number of tasks first, and then in one, so no call sees the group's rows.
    """
    salts = math.isqrt(df.rdd.getNumPartitions()) + 1
    key = F.xxhash64(*[F.lit(0)], *by).alias("__key")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Quantiles] = {}
        for batch in batches:
            keys = batch.column("__key").to_numpy()
            values = batch.column("__value").to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            found, first = np.unique(keys[order], return_index=True)
            for k, part in zip(found.tolist(), np.split(values[order], first[1:])):
                states.setdefault(k, make()).add(part)
            if len(states) > 1000:  # many groups: pass them on
                yield dumped(states)
                states = {}
        yield dumped(states)

    def dumped(states: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(states), pa.int64()), pa.array([s.dump() for s in states.values()], pa.binary())],
            names=["__key", "__state"],
        )

    def merged(states: pd.Series) -> Quantiles:
        whole = make()
        for state in states:
            whole.merge(type(whole).load(state))
        return whole

    @F.pandas_udf("binary")
    def merge(states: pd.Series) -> bytes:
        return merged(states).dump()

    @F.pandas_udf("double")
    def last(states: pd.Series) -> float:
        return finish(merged(states))

    rows = df.select(key, F.col(col).cast("double").alias("__value")).where(F.col("__value").isNotNull())
    states = rows.mapInArrow(partial, "__key long, __state binary").withColumn("__salt", F.spark_partition_id() % salts)
    few = states.groupBy("__key", "__salt").agg(merge("__state").alias("__state"))
    result = few.groupBy("__key").agg(last("__state").alias(name))
    groups = df.select(*by).distinct().withColumn("__key", key)
    return groups.join(result, "__key", "left").drop("__key")


def register_table_fn(
    spark: SparkSession, name: str, cls: type, schema: str, batches: bool = False
):
    """A class with ``eval`` as a table function for SQL and Python.

    ``eval(*values)`` yields rows and joins a table by ``LATERAL``.  With ``batches``
    it is ``eval(record_batch)``, yields Arrow tables and takes ``TABLE(...)``: much
    faster, as no Python code runs per row.
    """
    make = F.arrow_udtf if batches else F.udtf
    return spark.udtf.register(name, make(cls, returnType=schema))


class Tokens:
    """Words of one text with their position."""

    def eval(self, text: str):
        for i, token in enumerate((text or "").split()):
            yield i, token


class TokenBatches:
    """Words of a batch of ``(doc_id, text)`` rows with their position.

    Some ``SLICE_BYTES`` of text are taken at a time, also of one long text, so that memory
    follows neither the words of a batch nor those of a text.
    """

    def eval(self, batch: pa.RecordBatch):
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE_BYTES, side="right")) - 1)
            ids, texts = batch.column("doc_id").slice(at, to - at), batch.column("text").slice(at, to - at)
            if sizes[at] > SLICE_BYTES:
                yield from self._long(ids, texts[0].as_py())
            else:
                yield self._words(ids, texts)
            at = to

    def _long(self, ids: pa.Array, text: str) -> Iterator[pa.Table]:
        """Words of one text, cut at white space that any rule for words knows."""
        at = pos = 0
        while at < len(text):
            space = _SPACE.search(text, at + SLICE_BYTES)
            to = space.start() if space else len(text)
            words = self._words(ids, pa.array([text[at:to]]), pos)
            yield words
            at, pos = to, pos + words.num_rows

    def _words(self, ids: pa.Array, texts: pa.Array, start: int = 0) -> pa.Table:
        words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        owner, token = pc.list_parent_indices(words), pc.list_flatten(words)
        # Position within a text: the running index less that of the text's first word.
        rows = np.arange(len(token))
        first = np.searchsorted(owner.to_numpy(), np.arange(len(words)))
        pos = rows - first[owner.to_numpy()] + start
        out = pa.table({"doc_id": ids.take(owner), "pos": pa.array(pos, pa.int32()), "token": token})
        return out.filter(pc.not_equal(token, ""))


def map_groups(
    df: DataFrame,
    by: Sequence[str],
    fn: Callable[[tuple, pd.DataFrame], pd.DataFrame],
    schema: str,
    spread_by: str,
    merge: dict[str, Callable[[str], Column]],
    max_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``fn(key, rows)`` per group or part of one, and the parts put together by ``merge``.

    ``fn`` returns one row of partial results; ``merge`` names the aggregate that
    combines each of its columns (``F.sum``, ``F.max``), so the result has one row per
    group whatever its size.  A group of up to ``max_rows`` is one call.  A larger one is
    cut into slices by a hash of ``spread_by``, and ``fn`` gets each Arrow batch of a
    slice by itself.  What can't be combined from parts, such as a median, is not for
    this function.
    """

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return fn(key, rows)

    # Spark picks the batch form by these annotations.
    def sliced(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield fn(key[:-1], batch)

    hot = hotkeys.find(df, by, max_rows)
    small = df if hot is None else hot.cold_rows(df)
    out = _by_count(small, by).groupBy(*by).applyInPandas(whole, schema)
    merged = [f(c).alias(c) for c, f in merge.items()]
    if hot is None:
        return out.groupBy(*by).agg(*merged)
    slice_no = F.pmod(F.xxhash64(spread_by), F.lit(hot.chunks)).alias("__slice")
    large = hot.hot_rows(df).drop("__key").select("*", slice_no)
    keys = [*by, "__slice"]
    parts = _by_count(large, keys).groupBy(*keys).applyInPandas(sliced, schema)
    return out.unionByName(parts).groupBy(*by).agg(*merged)


def _by_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A fixed number of partitions: sized by bytes, as adaptive execution does, few
    bytes that cost much Python work would end up in one task."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)
