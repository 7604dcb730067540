"""Running streams: sources, sinks and reading results back.

Event times arrive as ``timestamp_ntz``, which watermarks reject; streams use
``timestamp`` in a UTC session and results are cast back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemill.session import fresh_path
from tidemill.sources.keyed import MAX_CHANGES, KeyedTable


# Files of one micro-batch: a backlog is worked off in batches, not in one.
MAX_FILES = 1000


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = MAX_FILES
) -> DataFrame:
    """Parquet files as they arrive; ``timestamp_ntz`` columns become ``timestamp``."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _retyped(reader.parquet(path), T.TimestampNTZType, "timestamp")


def _retyped(df: DataFrame, from_type: type, to: str) -> DataFrame:
    casts = {f.name: F.col(f.name).cast(to) for f in df.schema if isinstance(f.dataType, from_type)}
    # One projection that keeps other columns as they are.
    return df.select(*[casts[c].alias(c) if c in casts else F.col(c) for c in df.columns])


def naive_times(df: DataFrame) -> DataFrame:
    return _retyped(df, T.TimestampType, "timestamp_ntz")


def run_once(sdf: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, in micro-batches, and stop.  Restarts where it stopped."""
    query = (
        sdf.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def result_of(sdf: DataFrame, name: str) -> DataFrame:
    """Run ``sdf`` into fresh folders and return what it wrote, as a batch table."""
    spark = sdf.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    run_once(sdf, out, checkpoint)
    return naive_times(spark.read.schema(sdf.schema).parquet(out))


def upsert_sink(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    order_by: Sequence[str],
    max_changes: int = MAX_CHANGES,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps a keyed table in versions.

    A batch adds its own rows, newest per key, and is committed under its number: one that
    is replayed after a failure changes nothing.  Once ``max_changes`` batches have
    gathered they are folded into the table, of which only the buckets with changed keys
    are rewritten, so a read touches the table and a bounded number of other folders.
    """
    table = KeyedTable(spark, path, schema, keys, order_by, max_changes=max_changes)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.add(batch, batch_id)

    return write


def read_upserted(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """The newest row per key of all batches; a later batch wins a tie."""
    return naive_times(KeyedTable(spark, path, schema, keys, order_by).read())


def run_upserts(
    sdf: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    mode: str = "append",
    max_changes: int = MAX_CHANGES,
) -> StreamingQuery:
    """Run a stream into the keyed sink; ``mode="update"`` for aggregates that go on changing."""
    query = (
        sdf.writeStream.foreachBatch(
            upsert_sink(sdf.sparkSession, path, sdf.schema, keys, order_by, max_changes)
        )
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
