"""Quality rules: per-document counts, and lines that too many documents of a host share.

Lines are normalised and hashed.  For each host and line the distinct texts holding it
are counted (copies of one text count once).  A line above the limit is removed from
every document of the host but the first by id, and a document that loses too much of
its words is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, content_key
from tidemill.session import stage

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A line of this many words or more is removed where more texts of a host hold it.
LINE_WORDS = 4
LINE_TEXTS = 10
#: A document must keep this share of its words and MIN_WORDS of them.
KEEP_SHARE = 0.5

_SYMBOLS = b"#*$%&|<>"
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = h[:n].copy()
    for k in range(1, window):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key += h[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += twice
    cover[window : window + n] -= twice
    return int((np.cumsum(cover)[:-1] > 0).sum())


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of one whole text; all 0 for null and blank texts."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at the six ASCII white-space characters only
    kept = b"".join(words)
    chars = len(kept.decode("utf-8", "surrogatepass"))
    symbols = len(kept) - len(kept.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _count(texts: pd.Series) -> pd.DataFrame:
    rows = [count_text(t) for t in texts]
    return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def normal_line(line: Column) -> Column:
    """A line in lower case, trimmed, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def _lines(docs: DataFrame) -> DataFrame:
    """A row per document and line of enough words."""
    line = F.col("_line")
    return (
        docs.select("_k1", "_k2", "doc_id", "source", F.xxhash64("text").alias("_text"),
                    F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"))
        .select("_k1", "_k2", "_pos", "doc_id", "source", "_text", F.xxhash64(normal_line(line)).alias("_h"),
                F.regexp_count(line, F.lit(WORD)).alias("_n"))
        .where(F.col("_n") >= LINE_WORDS)
    )


def frequent_lines(lines: DataFrame, line_texts: int = LINE_TEXTS) -> DataFrame:
    """Host and hash of lines above the limit, with the first document, which keeps its own."""
    own = F.coalesce("doc_id", F.lit(2**63 - 1))
    return (
        lines.groupBy("source", "_h", "_text").agg(F.min(own).alias("_d"))
        .groupBy("source", "_h").agg(F.count("*").alias("_texts"), F.min("_d").alias("_first"))
        .where(F.col("_texts") > line_texts)
    )


def judge(docs: DataFrame, line_texts: int = LINE_TEXTS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Every row's counts and verdict: doc_id, the five counts, base_failed, n_removed, kept.

    One row per input row.  Null and blank texts have no words and fail the base rules.
    Hosts are values of ``source``; null is a host of its own.  Rows with a null id come
    last when the first holder of a line is chosen.  Rows alike in id, source and text
    get the same verdict.  An empty table gives an empty result; other columns are
    ignored.
    """
    plain = docs.select("doc_id", "source", "text").select("*", *content_key("doc_id", "source", "text"))
    lines = stage(_lines(plain), "line-hashes")
    often = frequent_lines(lines, line_texts)
    lost = (
        lines.alias("a")
        .join(often.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._h") == F.col("b._h")))
        .where(F.coalesce("a.doc_id", F.lit(2**63 - 1)) != F.col("b._first"))
        .select("_k1", "_k2", "_pos", "_n")
    )
    # Repeated rows share a key; their lines count once, by position.
    lost = lost.distinct().groupBy("_k1", "_k2").agg(F.sum("_n").alias("_lost"))
    counted = plain.select("_k1", "_k2", "doc_id", F.pandas_udf(_count, _COUNTS)("text").alias("_c")).select("_k1", "_k2", "doc_id", "_c.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed")
    return (
        counted.join(lost, ["_k1", "_k2"], "left")
        .withColumn("n_removed", F.coalesce("_lost", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= MIN_WORDS) & (left >= keep_share * F.col("n_words")))
        .drop("_k1", "_k2", "_lost")
    )


def remove_lines(docs: DataFrame, line_texts: int = LINE_TEXTS) -> DataFrame:
    """The documents with their too frequent lines taken out of ``text``."""
    keyed = docs.select("*", *content_key("doc_id", "source", "text"))
    lines = stage(_lines(keyed.select("doc_id", "source", "text", "_k1", "_k2")), "line-hashes")
    often = frequent_lines(lines, line_texts)
    gone = (
        lines.alias("a")
        .join(often.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._h") == F.col("b._h")))
        .where(F.coalesce("a.doc_id", F.lit(2**63 - 1)) != F.col("b._first"))
        .groupBy("_k1", "_k2")
        .agg(F.collect_set("a._h").alias("_gone"))
    )
    stay = F.filter(
        F.split("text", "\n", -1),
        lambda x: ~((F.regexp_count(x, F.lit(WORD)) >= LINE_WORDS) & F.array_contains("_gone", F.xxhash64(normal_line(x)))),
    )
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return keyed.join(gone, ["_k1", "_k2"], "left").withColumn("text", text).select(docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    return judge(read_table(spark, sf_dir, "documents"))


# The same by words, windows and lines as rows; ids are unique in the given tables.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
starts AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM d WHERE len(words) >= 8),
grams AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS g FROM starts),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
again AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, text, line,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE n > 0 GROUP BY doc_id),
long_lines AS (
  SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM lines WHERE n >= 4),
often AS (
  SELECT source, norm, min(doc_id) AS first FROM long_lines GROUP BY source, norm HAVING count(DISTINCT text) > 10),
lost AS (
  SELECT l.doc_id, sum(l.n) AS n_removed FROM long_lines l
  JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm AND l.doc_id <> o.first GROUP BY l.doc_id),
counted AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_words - n_removed >= 20 AND n_words - n_removed >= 0.5 * n_words AS kept FROM judged
"""
