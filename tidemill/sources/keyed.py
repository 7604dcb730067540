"""Keyed tables in versions: folders of key buckets, recent changes, and a commit file.

A version is a list of folders, one per bucket of keys, and the folders of changes that
came since.  A change batch either rewrites the buckets that hold its keys, or is added as
it is and folded into them once a few have gathered; other buckets are not read or
written.  The version's commit file is written last, so a reader sees all of a version or
the one before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.quality import newest_per_key, upsert
from tidemill.sources.commits import CommitLog, delete_folders, folders_in
from tidemill.sources.files import write_partitioned

BUCKETS = 64
#: Change folders that are read besides the buckets, at most.
MAX_CHANGES = 8


class KeyedTable:
    """A table with one row per key at ``path``.

    ``schema`` is that of its rows.  Of several rows for a key the last in ``order_by``
    counts, the later change where that is equal; a change with ``delete_flag`` set
    removes its key.  The number of buckets is kept from the first version on.  There may
    be one writer at a time: a second one fails when it commits.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        order_by: Sequence[str],
        delete_flag: str | None = None,
        buckets: int = BUCKETS,
        max_changes: int = MAX_CHANGES,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order_by, self.delete_flag = list(keys), list(order_by), delete_flag
        self.buckets, self.max_changes = buckets, max_changes
        self.log = CommitLog(spark, f"{self.path}/_commits")

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        number, entry = self.log.last() if version is None else (version, self.log.read(version))
        return number, entry or {"n_buckets": self.buckets, "buckets": {}, "changes": [], "batch": -1}

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(state["n_buckets"])).cast("int")

    def _fresh(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def _commit(self, number: int, state: dict) -> int:
        self.log.add(number + 1, state)
        return number + 1

    @property
    def version(self) -> int:
        """The number of the current version; -1 before the first."""
        return self.log.last()[0]

    def _rows(self, folders: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
        schema = schema or self.schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _changes(self, state: dict) -> DataFrame | None:
        """The newest change of each key that isn't in the buckets yet."""
        if not state["changes"]:
            return None
        schema = self.schema
        if self.delete_flag:
            schema = T.StructType([*schema.fields, T.StructField(self.delete_flag, T.BooleanType())])
        parts = [self._rows([f], schema).withColumn("__nth", F.lit(i)) for i, f in enumerate(state["changes"])]
        return newest_per_key(reduce(DataFrame.unionByName, parts), self.keys, [*self.order_by, "__nth"]).drop("__nth")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the current or a given version."""
        _, state = self._state(version)
        rows, changes = self._rows(sorted(state["buckets"].values())), self._changes(state)
        return rows if changes is None else upsert(rows, changes, self.keys, self.order_by, self.delete_flag)

    def _rewritten(self, state: dict, changes: DataFrame) -> dict:
        """The buckets after ``changes``, those with a changed key in fresh folders."""
        bucket = self._bucket(state)
        # At most one row per bucket.
        touched = {str(r[0]) for r in changes.select(bucket.alias("b")).distinct().collect()}
        before = self._rows(sorted(f for b, f in state["buckets"].items() if b in touched))
        after = upsert(before, changes, self.keys, self.order_by, self.delete_flag)
        return {b: f for b, f in state["buckets"].items() if b not in touched} | self._written(state, after)

    def _written(self, state: dict, rows: DataFrame) -> dict:
        folder = self._fresh()
        write_partitioned(rows.withColumn("__bucket", self._bucket(state)), f"{self.path}/{folder}", ["__bucket"])
        names = folders_in(self.spark, f"{self.path}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("__bucket=")}

    def replace(self, rows: DataFrame) -> int:
        """A version of exactly ``rows``, which have one row per key."""
        number, state = self._state()
        buckets = self._written(state, rows.select(*self.schema.names))
        return self._commit(number, state | {"buckets": buckets, "changes": []})

    def upsert(self, changes: DataFrame, batch: int | None = None) -> int:
        """A version with ``changes`` in it; only buckets that hold their keys are rewritten.

        With ``batch``, a number that grows from batch to batch, a batch that is in the
        table already is recognised and makes no version.
        """
        number, state = self._state()
        if batch is not None and batch <= state["batch"]:
            return number
        if state["changes"]:
            number, state = self.merge(), self._state()[1]
        buckets = self._rewritten(state, changes)
        return self._commit(number, state | {"buckets": buckets, "batch": state["batch"] if batch is None else batch})

    def add(self, changes: DataFrame, batch: int) -> int:
        """A version with the changes of a batch beside the buckets, folded in from time to time.

        The work follows the batch, not the table.  A batch that is there already, as when
        a stream repeats its last one, changes nothing.
        """
        number, state = self._state()
        if batch <= state["batch"]:
            return number
        columns = [*self.schema.names, *([self.delete_flag] if self.delete_flag else [])]
        newest = newest_per_key(changes.select(*columns), self.keys, self.order_by)
        folder = self._fresh()
        newest.write.parquet(f"{self.path}/{folder}")
        number = self._commit(number, state | {"changes": [*state["changes"], folder], "batch": batch})
        return self.merge() if len(state["changes"]) + 1 >= self.max_changes else number

    def merge(self) -> int:
        """A version with the same rows and no folders of changes."""
        number, state = self._state()
        changes = self._changes(state)
        if changes is None:
            return number
        return self._commit(number, state | {"buckets": self._rewritten(state, changes), "changes": []})

    def vacuum(self, keep: int = 1) -> int:
        """Delete data that none of the last ``keep`` versions uses; how many folders went.

        Also what dead writers left.  Not while somebody writes or reads older versions.
        """
        used = set()
        for number in self.log.numbers()[-keep:]:
            state = self.log.read(number)
            used |= {*state["buckets"].values(), *state["changes"]}
        gone = []
        for name in folders_in(self.spark, f"{self.path}/data"):
            inner = [f for f in used if f.startswith(f"data/{name}/")]
            if inner:  # some of its buckets are in use
                found = [f"data/{name}/{b}" for b in folders_in(self.spark, f"{self.path}/data/{name}")]
                gone += [f for f in found if f not in used]
            elif f"data/{name}" not in used:
                gone.append(f"data/{name}")
        delete_folders(self.spark, [f"{self.path}/{f}" for f in gone])
        return len(gone)
