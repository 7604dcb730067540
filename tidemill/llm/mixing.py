"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash.  A source's budget is met by taking the documents
whose hash lies below a threshold.  The threshold comes from histograms: sizes are
summed by source and hash bucket, the bucket in which the running sum passes the
budget is found, and only the documents of that bucket are looked at again, in finer
buckets and at last by single hash values.  Documents are filtered, never sorted.
Thresholds are nested: a larger budget takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import word_count
from tidemill.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
HASH_BITS = 60
LEVEL_BITS = 10
#: A source's documents meet its row in this many parts, so that a large source is not one task.
PARTS = 32
BROADCAST_SOURCES = 50_000


def hash_of(id_col: str) -> Column:
    """60 bits of the MD5 of an id; the same in any engine and on any run."""
    text = F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source with its size and target.

    Sources in code-point order (null last) weigh ``weights`` in turn and share
    ``share`` of all sizes.  A target stops at ``most`` times its source's size; what
    is over goes to the others by weight until none is above.  Sorted by size per
    weight, the stopped sources come first, so one running sum finds them.

    The windows over all sources see one row per source, not per document.
    """
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]),
        ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"),
    )
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_w", w)
    everything = Window.partitionBy()
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_cap", F.col("source_size") * float(most))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_budget", F.sum("source_size").over(everything) * share)
        .withColumn("_all_w", F.sum("_w").over(everything))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                    / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
        .withColumn("_stopped", F.col("_level") >= F.col("_ratio"))
        .withColumn("_free_level", F.max(F.when(~F.col("_stopped"), F.col("_level"))).over(everything))
    )
    # The first source that is not stopped sets the level of all free ones.  It is the
    # highest: taking the cap of a free source away, more than its share, lowers it.
    target = F.when(F.col("_stopped"), F.col("_cap")).otherwise(F.col("_free_level") * F.col("_w"))
    return rows.select("source", "source_size", target.alias("target"))


def _boundary(docs: DataFrame, bucket: Column, keys: list[str]) -> DataFrame:
    """Of each source, the bucket in which the running size passes ``_left``."""
    running = Window.partitionBy("source").orderBy("_b")
    return (
        docs.groupBy("source", *keys, "_left", bucket.alias("_b"))
        .agg(F.sum("size").alias("_sum"))
        .withColumn("_to", F.sum("_sum").over(running))
        .where((F.col("_to") > F.col("_left")) & (F.col("_to") - F.col("_sum") <= F.col("_left")))
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per source: whole copies of everything and the hash threshold of one more.

    ``sized`` has source, size and _h.  The nearer side of the budget wins at the last
    single hash value.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = goals.withColumn("_whole", whole.cast("long")).withColumn(
        "_left", F.col("target") - F.col("_whole") * F.col("source_size")
    )
    # One row per source, written once: the levels below would each work it out again.
    goals = stage(goals, "mix-goals")
    docs = _with_source(sized, goals.select("source", "_left"))
    shift, prefix = HASH_BITS, F.lit(0).cast("long")
    docs = docs.withColumn("_p", prefix)
    for _ in range(2):
        shift -= LEVEL_BITS
        edge = _boundary(docs, F.shiftright("_h", shift), ["_p"]).select(
            "source", F.col("_b").alias("_p2"), (F.col("_left") - (F.col("_to") - F.col("_sum"))).alias("_left2")
        )
        docs = (
            _with_source(docs, stage(edge, "mix-edge"))
            .where(F.shiftright("_h", shift) == F.col("_p2"))
            .select("source", "size", "_h", F.col("_left2").alias("_left"), F.col("_p2").alias("_p"))
        )
    last = _boundary(docs, F.col("_h"), ["_p"]).select(
        "source",
        (F.col("_b") + F.when(F.col("_to") - F.col("_left") < F.col("_left") - (F.col("_to") - F.col("_sum")), 1).otherwise(0)).alias("_below"),
    )
    return (
        goals.alias("g")
        .join(last.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")), "left")
        .select("g.source", "source_size", "target", "_whole", F.coalesce("_below", F.lit(0)).alias("_below"))
    )


def _with_source(docs: DataFrame, by_source: DataFrame) -> DataFrame:
    """Documents with the columns of their source's row; a null source matches itself."""
    parts = by_source.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return (
        docs.alias("d")
        .join(parts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))
              & (F.col("d._h") % PARTS == F.col("s._part")))
        .select("d.*", *[F.col(f"s.{c}") for c in by_source.columns if c != "source"])
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """How much of every document the mix takes: doc_id, source, size, source_size, target, copies, taken.

    One row per input row.  ``size`` is the number of words (0 for null and empty
    texts, which are taken as often as their source is as a whole).  A null source is a source of
    its own, last in order.  Rows with the same id (repeats, null ids) have the same
    hash, so they are taken together; a source's sum then misses its target by at most
    half of such a group, otherwise by at most half of one document.  An empty table
    gives an empty result; other columns are ignored.
    """
    sized, cut = _decide(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")),
                         weights, share, most)
    return _copies(sized, cut).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("*", word_count("text").alias("size"), hash_of("doc_id").alias("_h"))


def _decide(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Documents without their text but with size and hash, and one row of thresholds per source."""
    sized = stage(_sized(docs).select("doc_id", "source", "size", "_h"), "mix-sizes")
    return sized, stage(thresholds(sized, targets(sized, weights, share, most)), "mix-thresholds")


def _copies(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """``sized`` with source_size, target and copies.

    Up to BROADCAST_SOURCES thresholds (three numbers and a name each) are sent to every
    executor, so that documents needn't move; more are met in parts.
    """
    if cut.count() <= BROADCAST_SOURCES:
        rows = sized.alias("d").join(F.broadcast(cut).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        rows = rows.select("d.*", *[F.col(f"s.{c}") for c in cut.columns if c != "source"])
    else:
        rows = _with_source(sized, cut)
    # Empty texts bring a source no nearer to its target, so the threshold adds none of them.
    more = (F.col("_h") < F.col("_below")) & (F.col("size") > 0)
    return rows.withColumn("copies", F.col("_whole") + more.cast("long"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: each row as many times as the mix takes it.

    Rows keep the columns of documents and get ``copy`` (from 1), ``size``,
    ``source_size`` and ``target``.
    """
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    _, cut = _decide(plain)
    rows = _copies(_sized(plain), cut).where("copies > 0")
    return rows.select(
        *plain.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        "size", "source_size", "target",
    )


def op1(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# The same mix with an exact running sum over hash values in place of histograms.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM per),
ratios AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio,
         1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w FROM weighed),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER o, 0)) / (all_w - coalesce(sum(w) OVER o, 0)) AS level FROM ratios
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         CASE WHEN level >= ratio THEN cap
              ELSE max(CASE WHEN level < ratio THEN level END) OVER () * w END AS target FROM levels),
left_over AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
by_hash AS (
  SELECT source, h, sum(size) AS s FROM sized GROUP BY source, h),
running AS (
  SELECT source, h, s, sum(s) OVER (PARTITION BY source ORDER BY h) AS upto FROM by_hash),
taken_more AS (
  SELECT r.source, r.h FROM running r JOIN left_over g ON r.source IS NOT DISTINCT FROM g.source
  WHERE r.upto <= g.target - g.whole * g.source_size
     OR (r.upto - r.s <= g.target - g.whole * g.source_size
         AND r.upto - (g.target - g.whole * g.source_size) < (g.target - g.whole * g.source_size) - (r.upto - r.s)))
SELECT d.doc_id, d.size, g.source_size, g.target,
       CAST(d.size * (g.whole + CASE WHEN t.h IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM sized d JOIN left_over g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN taken_more t ON d.source IS NOT DISTINCT FROM t.source AND d.h = t.h
"""
