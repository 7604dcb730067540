"""Typed ingestion that keeps what it could not read."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import stage

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BAD = "_corrupt_record"
_PIECES = "f string, b long, raw string, head boolean"
#: Splits that begin inside quotes, up to which every task is told all of them.
TOLD_SPLITS = 100_000


def ingest(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType,
    header: bool = True,
    sep: str = ",",
    quoted_breaks: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rows that fit ``schema``, and the raw text and file of those that do not.

    Parquet is typed already and has no rejects.  With ``quoted_breaks`` a line break
    inside quotes belongs to its CSV record, see ``quoted_records``.
    """
    if fmt == "parquet":
        good = spark.read.schema(schema).parquet(path)
        return good, spark.createDataFrame([], "raw string, source_file string")
    parsed = parse_lines(spark, path, fmt, schema, header, sep, quoted_breaks)
    good = parsed.filter(~F.col("malformed")).select(*schema.fieldNames())
    return good, parsed.filter("malformed").select("raw", "source_file")


def parse_lines(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType,
    header: bool = True,
    sep: str = ",",
    quoted_breaks: bool = False,
) -> DataFrame:
    """Every line typed by ``schema``, with its raw text, its file and ``malformed``.

    CSV and JSON hold one record per line, which is what lets a large file be
    split; with ``quoted_breaks`` a CSV record ends where quotes are closed, and files are
    split all the same.  With ``header`` the first line names the columns: they are found by name, in
    any order and quoted or not, those it lacks are null, and an unknown name is an error.
    All files of one call have the same header.  A blank line is a null record of a
    one-column CSV and no record anywhere else.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    fields = list(schema.fields)
    if quoted_breaks and fmt == "csv":
        lines = quoted_records(spark, path)
    else:
        lines = spark.read.text(path).select(
            F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_file")
        )
    if fmt == "json" or len(fields) > 1:
        lines = lines.filter(F.trim("raw") != "")
    if fmt == "csv":
        style = {"sep": sep} | ({"escape": '"'} if quoted_breaks else {})
        if header:
            names = spark.read.option("header", True).option("sep", sep).csv(path).columns
            unknown = [n for n in names if n not in schema.fieldNames()]
            if unknown:
                raise ValueError(f"columns that the schema lacks: {unknown}")
            fields = [schema[n] for n in names]
            texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
            as_text = F.from_csv("raw", _ddl(texts), style)
            is_header = [F.coalesce(as_text[n] == n, F.lit(False)) for n in names]
            lines = lines.filter(~reduce(lambda a, b: a & b, is_header, F.lit(True)))
        target = T.StructType([*fields, T.StructField(_BAD, T.StringType())])
        parsed = F.from_csv("raw", _ddl(target), options | style)
    elif fmt == "json":
        parsed = F.from_json("raw", T.StructType([*fields, T.StructField(_BAD, T.StringType())]), options)
    else:
        raise ValueError(f"unknown format: {fmt}")
    lines = lines.withColumn("parsed", parsed)
    read = {f.name for f in fields}
    return lines.select(
        *[
            F.col(f"parsed.`{f.name}`") if f.name in read else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        "raw",
        "source_file",
        F.col(f"parsed.{_BAD}").isNotNull().alias("malformed"),
    )


def quoted_records(spark: SparkSession, path: str, told_splits: int = TOLD_SPLITS) -> DataFrame:
    """raw and source_file of every CSV record under ``path``, line breaks in quotes kept.

    Files are read in splits, twice.  The first pass counts each split's quotes: where those
    before it in its file are odd, a split begins inside quotes.  The second pass goes
    through the lines of a split in order, knowing that, and joins those of one record.  Only
    the pieces of records that cross from split to split meet after that, one or two a split.

    A quote inside quotes is doubled; a backslash means nothing.  A break of any kind inside
    quotes becomes a line feed.  A quote that is never closed takes in the rest
    of its file, as it does in any reader of this format.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.col("value").alias("v"),
        F.regexp_count("v", F.lit('"')).alias("q"),
    )
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split.
    counts = lines.groupBy("f", "b").agg(F.sum("q").alias("q"))
    opened = counts.select("f", "b", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1).alias("opened"))
    opened = stage(opened.where("opened"), "splits-in-quotes")
    if opened.count() <= told_splits:
        # A broadcast join leaves the lines where and in the order they are.
        told = lines.join(F.broadcast(opened), ["f", "b"], "left")
    else:
        numbered = lines.withColumn("i", F.monotonically_increasing_id())
        told = numbered.join(opened, ["f", "b"], "left").repartition("f", "b").sortWithinPartitions("f", "b", "i").drop("i")
    pieces = stage(told.select("f", "b", "v", "q", "opened").mapInArrow(_join_lines, _PIECES), "csv-records")
    whole = pieces.where("head IS NULL").select("raw", F.col("f").alias("source_file"))
    # A record that crosses begins with the last piece of one split; what follows are first pieces.
    nth = F.sum((~F.col("head")).cast("int")).over(Window.partitionBy("f").orderBy("b", F.desc("head")))
    crossing = pieces.where("head IS NOT NULL").withColumn("n", nth).groupBy("f", "n").agg(
        F.array_sort(F.collect_list(F.struct("b", "raw"))).alias("p")
    )
    joined = F.array_join(F.transform("p", lambda x: x["raw"]), "\n")
    return whole.unionByName(crossing.select(joined.alias("raw"), F.col("f").alias("source_file")))


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one split after the other; ``head`` is set for what a border cuts."""
    at, held, head, inside = None, [], False, False

    def piece(cut: bool | None) -> tuple:
        return (*at, "\n".join(held), cut)

    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("f", "b", "v", "q", "opened")]
        for f, b, v, q, opened in zip(*columns):
            if (f, b) != at:
                if held:
                    out.append(piece(head))
                at, held = (f, b), []
                head = inside = bool(opened)
            held.append(v)
            inside ^= q % 2 == 1
            if not inside:
                out.append(piece(True if head else None))
                held, head = [], False
        yield _pieces(out)
    if held:
        yield _pieces([piece(head)])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    f, b, raw, head = zip(*rows) if rows else ((), (), (), ())
    arrays = [pa.array(f, pa.string()), pa.array(b, pa.int64()), pa.array(raw, pa.string()), pa.array(head, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["f", "b", "raw", "head"])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def flatten_json(df: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """JSON text column replaced by one typed column per field of ``schema``."""
    kept = [c for c in df.columns if c != col]
    parsed = df.withColumn("__json", F.from_json(col, schema))
    return parsed.select(*kept, *[F.col(f"__json.`{f}`") for f in schema.fieldNames()])
