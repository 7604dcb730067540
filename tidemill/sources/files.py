"""Writers: partitioned output, incremental loads and compaction."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.commits import CommitLog, delete_folders, folders_in


def write_partitioned(
    df: DataFrame, path: str, cols: Sequence[str], mode: str = "overwrite", dynamic: bool = False
) -> None:
    """Parquet in one folder per value of ``cols``.

    The rebalance hint lets adaptive execution merge small pieces and split a
    value that holds much of the data, so files are neither tiny nor huge.
    ``dynamic`` replaces only the folders that ``df`` has rows for.
    """
    writer = df.hint("rebalance", *[F.col(c) for c in cols]).write.mode(mode).partitionBy(*cols)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


#: Every so many loads a commit lists all folders; those between list what came since.
FULL_LIST = 100


class Loads:
    """The committed loads of a target: a folder each, its range of times, and the mark.

    A load's rows go to a folder of their own and its commit is written after them.  A
    folder without a commit is what a dead load left: nobody reads it, and the next load
    takes its rows again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/_commits")

    def last(self) -> tuple[int, dict | None]:
        return self.log.last()

    def _listed(self, entry: dict) -> list[dict]:
        """All loads up to an entry, from two commit files at most."""
        before = [] if entry["base"] is None else self.log.read(entry["base"])["loads"]
        return before + entry["loads"]

    def all(self) -> list[dict]:
        _, entry = self.last()
        return self._listed(entry) if entry else []

    def add(self, after: int, load: dict, mark: str) -> None:
        """Commit a load as the one after number ``after``."""
        number, entry = after + 1, self.log.read(after) if after >= 0 else {"base": None, "loads": []}
        if number % FULL_LIST == 0:
            base, loads = None, [*self._listed(entry), load]
        else:
            base = number - number % FULL_LIST
            loads = [load] if after == base else [*entry["loads"], load]
        self.log.add(number, {"base": base, "loads": loads, "mark": mark})

    def read(self, schema: T.StructType, loads: Sequence[dict] | None = None) -> DataFrame:
        """The rows of all or the given committed loads."""
        folders = [f"{self.path}/{x['folder']}" for x in (self.all() if loads is None else loads)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def abandoned(self) -> list[str]:
        """Paths of folders that no commit names.  A load that is running has one too."""
        known = {x["folder"] for x in self.all()}
        found = [f for f in folders_in(self.spark, self.path) if f.startswith("load-")]
        return [f"{self.path}/{f}" for f in found if f not in known]


def load_incremental(
    src: DataFrame,
    target_path: str,
    ts_col: str,
    keys: Sequence[str] = (),
    overlap: timedelta | None = None,
    undated: str = "refuse",
) -> DataFrame:
    """Add the rows of ``src`` newer than any that loads brought to ``target_path``.

    The mark comes from the log of loads (``Loads``); the target is not read for it.  A
    rerun adds nothing, also after a load that died half-way, and of two loads at once one
    fails.  Rows that arrive later with a time at or before the mark are missed, unless
    ``overlap`` says how far back to look and ``keys`` tell which of those rows the target
    already has; then only loads that reach into that span are read.  Rows whose contents
    change need ``upsert`` instead.  Rows without a time fit no mark: the load fails
    before it adds anything, or with ``undated="skip"`` every load leaves them out.
    """
    if undated not in ("refuse", "skip"):
        raise ValueError(f"unknown choice: {undated}")
    spark, schema = src.sparkSession, src.schema
    kind = schema[ts_col].dataType
    if undated == "skip":
        src = src.filter(F.col(ts_col).isNotNull())
    else:
        message = F.raise_error(F.lit(f"a row has no {ts_col}")).cast(kind)
        src = src.withColumn(ts_col, F.when(F.col(ts_col).isNull(), message).otherwise(F.col(ts_col)))
    loads = Loads(spark, target_path)
    number, entry = loads.last()
    if entry is None:
        fresh = src
    elif overlap is None:
        fresh = src.filter(F.col(ts_col) > F.lit(entry["mark"]).cast(kind))
    else:
        if not keys:
            raise ValueError("an overlap needs keys to recognise rows already loaded")
        since = datetime.fromisoformat(entry["mark"]) - overlap
        recent = F.col(ts_col) > F.lit(str(since)).cast(kind)
        near = [x for x in loads.all() if datetime.fromisoformat(x["high"]) >= since]
        known = loads.read(schema, near).filter(recent).select(*keys).distinct()
        fresh = src.filter(recent).join(known, list(keys), "left_anti")
    folder = f"load-{uuid.uuid4().hex}"
    fresh.write.parquet(f"{loads.path}/{folder}")
    written = spark.read.schema(schema).parquet(f"{loads.path}/{folder}")
    mark = F.max(ts_col) if entry is None else F.greatest(F.max(ts_col), F.lit(entry["mark"]).cast(kind))
    low, high, mark, n = written.agg(
        F.min(ts_col).cast("string"), F.max(ts_col).cast("string"), mark.cast("string"), F.count(F.lit(1))
    ).first()
    if n:
        loads.add(number, {"folder": folder, "low": low, "high": high, "rows": n}, mark)
    else:
        delete_folders(spark, [f"{loads.path}/{folder}"])
    return loads.read(schema)


def compact(
    spark: SparkSession, path_in: str, path_out: str, file_bytes: int = 256 << 20
) -> DataFrame:
    """The same rows in files of about ``file_bytes``, as many as the input's size asks for."""
    rows = spark.read.parquet(path_in)
    files = rows.select("_metadata.file_path", "_metadata.file_size").distinct()
    total = files.agg(F.sum("file_size")).first()[0] or 0
    rows.repartition(max(1, math.ceil(total / file_bytes))).write.mode("errorifexists").parquet(path_out)
    return spark.read.schema(rows.schema).parquet(path_out)
