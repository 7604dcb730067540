"""Line dedup: documents probe a sharded minimal perfect hash instead of joining lines.

Lines are hashed.  The distinct hashes are dealt to shards of bounded size, and each shard
numbers its own by a minimal perfect hash: bit arrays level by level, in which a key takes
the place that no other key of its level wants, and its number is the count of bits before
it.  That costs a few bits a key.  By number a shard holds compact arrays: a fingerprint,
the count of documents and the first document.  A shard is one row, written as Parquet.

Lines then go to their shard as short rows and are looked up there in batches, as they
stream by: no line is sorted or matched against another, and a task holds one shard.  The
lines of a shard that many ask for are dealt out, and its row is copied to each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import content_key
from tidemill.session import stage

#: Shorter keys, in code points, are never dropped.
MIN_CHARS = 10
MIN_DOCS = 2
SPACE = " \t\n\x0b\x0c\r"
#: Keys of a shard, on average, and lookups of a part of one.
SHARD_KEYS = 250_000
PART_LOOKUPS = 1_000_000
#: Bits of a level for each key that is left.
GAMMA = 2
#: Keys without a place after this many levels are listed as they are.
LEVELS = 48
#: Sorts behind every id; stands for null.
LAST = 2**63 - 1

_INDEX = "shard long, n long, sizes array<long>, bits binary, rest1 binary, rest2 binary, prints binary, counts binary, firsts binary"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A to Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, upper, lower))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """_k1, _k2 (of the row), _doc, _pos (of the line), h1 and h2 of every line that is long enough."""
    line = F.col("_line")
    rows = docs.select(*content_key("doc_id", "text"), F.coalesce("doc_id", F.lit(LAST)).alias("_doc"),
                       F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"))
    # A line of fewer characters needs no key.
    keys = rows.where(F.length(line) >= min_chars).withColumn("_line", line_key(line))
    return keys.where(F.length(line) >= min_chars).select(
        "_k1", "_k2", "_doc", "_pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")
    )


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """64 evenly spread bits of a key for a level."""
    with np.errstate(over="ignore"):
        x = h1 * np.uint64(2 * level + 0x9E3779B97F4A7C15) + (h2 ^ np.uint64((level * 0xD1B54A32D192ED03) % 2**64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 to n - 1 for ``n`` distinct keys of two 64-bit halves each."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: tuple[np.ndarray, np.ndarray]):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.n = int(self.before[-1]) + len(rest[0])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, levels: int = LEVELS) -> PerfectHash:
        sizes, parts = [], []
        for level in range(levels):
            if not len(h1):
                break
            size = GAMMA * len(h1) + 1
            place = (_mixed(h1, h2, level) % np.uint64(size)).astype(np.int64)
            wanted = np.bincount(place, minlength=size)
            parts.append(wanted == 1)
            sizes.append(size)
            left = wanted[place] > 1
            h1, h2 = h1[left], h2[left]
        return cls(sizes, np.concatenate([np.zeros(0, bool), *parts]), (h1, h2))

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each key; anything, or -1, for keys that weren't built in."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            if not len(left):
                return out
            at = self.starts[level] + (_mixed(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest[0]):
            listed = {k: i for i, k in enumerate(zip(*map(np.ndarray.tolist, self.rest)))}
            base = self.n - len(listed)
            for i in left:
                place = listed.get((int(h1[i]), int(h2[i])))
                out[i] = -1 if place is None else base + place
        return out


def _unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _fingerprint(h2: np.ndarray) -> np.ndarray:
    return (h2 >> np.uint64(32)).astype(np.uint32)


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    h1, h2 = (_unsigned(table.column(c).combine_chunks()) for c in ("h1", "h2"))
    hashed = PerfectHash.build(h1, h2)
    number = hashed.number(h1, h2)
    place = np.empty(len(number), np.int64)
    place[number] = np.arange(len(number))
    # Four bytes a count; larger ones stay at the largest.
    counts = np.minimum(table.column("_docs").to_numpy(), 2**32 - 1).astype(np.uint32)[place]
    firsts = table.column("_first").to_numpy()[place]
    row = {
        "shard": pa.array([key[0].as_py()], pa.int64()),
        "n": pa.array([len(h1)], pa.int64()),
        "sizes": pa.array([hashed.sizes], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(hashed.bits).tobytes()], pa.binary()),
        "rest1": pa.array([hashed.rest[0].tobytes()], pa.binary()),
        "rest2": pa.array([hashed.rest[1].tobytes()], pa.binary()),
        "prints": pa.array([_fingerprint(h2)[place].tobytes()], pa.binary()),
        "counts": pa.array([counts.tobytes()], pa.binary()),
        "firsts": pa.array([firsts.astype(np.int64).tobytes()], pa.binary()),
    }
    return pa.table(row)


class Shard:
    """A row of the index, ready to be asked."""

    def __init__(self, row: dict):
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
        rest = tuple(np.frombuffer(row[c], np.uint64) for c in ("rest1", "rest2"))
        self.hashed = PerfectHash(row["sizes"], bits, rest)
        self.prints = np.frombuffer(row["prints"], np.uint32)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.firsts = np.frombuffer(row["firsts"], np.int64)

    def ask(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and first document of each key; 0 and LAST for a key that isn't there."""
        number = self.hashed.number(h1, h2)
        known = number >= 0
        known[known] = self.prints[number[known]] == _fingerprint(h2[known])
        count, first = np.zeros(len(h1), np.int64), np.full(len(h1), LAST, np.int64)
        count[known], first[known] = self.counts[number[known]], self.firsts[number[known]]
        return count, first


def build_index(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The shards of the distinct keys of ``lines`` (_doc, h1, h2), one row each, and their number.

    A line that occurs often is counted before the shuffle.  Counts are of documents: a
    key counts once for all rows with one id.
    """
    counted = lines.groupBy("h1", "h2", "_doc").agg(F.lit(1).alias("_one"))
    keys = counted.groupBy("h1", "h2").agg(F.count("*").alias("_docs"), F.min("_doc").alias("_first"))
    keys = stage(keys, "line-keys")
    shards = max(1, -(-keys.count() // shard_keys))
    dealt = keys.withColumn("_s", F.pmod("h1", F.lit(shards)))
    return stage(dealt.groupBy("_s").applyInArrow(_build_shard, _INDEX), "line-index"), shards


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to drop; the row of a part's shard comes before the lines that ask it."""
    shard = None
    for batch in batches:
        is_shard = batch.column("_bits_of").is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(is_shard)
        for start, end in zip([0, *edges], [*edges, batch.num_rows]):
            part = batch.slice(start, end - start)
            if not part.num_rows:
                continue
            if is_shard[start]:
                shard = Shard(part.column("_bits_of")[0].as_py())
                part = part.slice(1)
            count, first = shard.ask(_unsigned(part.column("h1")), _unsigned(part.column("h2")))
            own = part.column("_doc").to_numpy()
            gone = (count >= MIN_DOCS) & (own != first)
            yield part.select(["_k1", "_k2", "_pos"]).filter(pa.array(gone))


def repeated_lines(lines: DataFrame, index: DataFrame, shards: int, part_lookups: int = PART_LOOKUPS) -> DataFrame:
    """_k1, _k2 and _pos of the lines that an earlier document holds too."""
    asking = lines.withColumn("_s", F.pmod("h1", F.lit(shards)))
    load = asking.groupBy("_s").agg(F.ceil(F.count("*") / part_lookups).alias("_parts"))
    load = stage(load, "line-parts")
    salt = F.pmod(F.xxhash64("_k1", "_k2", "_pos"), F.col("_parts"))
    asks = asking.join(load, "_s").select("_s", salt.alias("_p"), "_k1", "_k2", "_doc", "_pos", "h1", "h2")
    held = F.struct(*[c for c in index.columns if c != "shard"]).alias("_bits_of")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_p")
    shard = index.withColumnRenamed("shard", "_s").join(load, "_s").select("_s", part, held)
    both = shard.unionByName(asks, allowMissingColumns=True)
    met = both.repartition("_s", "_p").sortWithinPartitions("_s", "_p", F.col("_bits_of").isNull())
    return met.mapInArrow(_probe, "_k1 long, _k2 long, _pos int")


def drop_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, part_lookups: int = PART_LOOKUPS
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and the columns n_lines and n_dropped.

    A line goes where a document with a smaller doc_id holds the same key.  A null or empty
    text is one empty line, stays as it is, and drops nothing.  Rows with one id are one
    document, which keeps all its lines that no smaller one holds, however often; rows
    without an id are one document that comes last.  Repeated rows give the same result
    each.  Empty tables give an empty result.  Other columns stay; the two new ones
    replace columns of their name.
    """
    lines = stage(line_hashes(docs.select("doc_id", "text"), min_chars), "line-hashes")
    index, shards = build_index(lines, shard_keys)
    gone = repeated_lines(lines, index, shards, part_lookups)
    # Repeated rows share a key: each position once.
    gone = gone.groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_gone"))
    rows = docs.select("*", *content_key("doc_id", "text")).join(stage(gone, "line-places"), ["_k1", "_k2"], "left")
    split = F.split("text", "\n", -1)
    stay = F.filter(split, lambda x, i: ~F.array_contains("_gone", i))
    dropped = F.coalesce(F.size("_gone"), F.lit(0))
    return rows.withColumns({
        "n_lines": F.coalesce(F.size(split), F.lit(1)).cast("long"),
        "n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(dropped).cast("long"),
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")),
    }).drop("_k1", "_k2", "_gone")


def op13(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    kept = drop_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS MATERIALIZED (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
keyed AS MATERIALIZED (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, o.first IS NOT NULL AND k.doc_id <> o.first AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
