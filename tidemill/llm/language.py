"""Language identification by Bayesian fusion of independent evidence.

The text gives a likelihood under hashed byte-trigram models.  The declared markup
language and the suffix of the address count by how far they agree with the texts over
the whole corpus.  Every host has a prior smoothed towards its parent domain's, and that
towards the corpus's.  All these come from grouped sums of the texts' own posteriors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.html_text import extract
from tidemill.session import stage

#: Documented bounds of the sample that the trigram models are trained on.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_CHARS = 20_000
#: Up to this many languages the sample's ids are sent to every executor.
BROADCAST_LANGUAGES = 64

BUCKETS = 1 << 15
#: Trigrams overlap, so a text counts as at most this many independent ones.
EVIDENCE = 60
#: Rows of prior weight when a host is smoothed, and a declaration's reliability.
HOST_WEIGHT = 5.0
VALUE_WEIGHT = 2.0
PARTS = 32
#: A text's share below which a language has none: far less than sums of doubles tell apart.
LEAST_MASS = 1e-12
#: Rows whose posteriors are worked out together.
SLICE = 512
KEYS = ("declared", "suffix", "domain", "host")


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-case text, white space and digits made one."""
    raw = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not raw:
        return np.zeros(0, np.int64)
    b = np.frombuffer(f" {raw} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return ((b[:-2] * 0x9E3779B1) ^ (b[1:-1] * 0x85EBCA6B) ^ (b[2:] * 0xC2B2AE35)) * 0x27D4EB2F >> 13 & (BUCKETS - 1)


def likelihood(text: str | None, table: np.ndarray) -> np.ndarray:
    """Log likelihood per language, 0 for all without evidence."""
    ids = trigrams(text)
    if not len(ids):
        return np.zeros(table.shape[1])
    counts = np.bincount(ids, minlength=BUCKETS)
    seen = np.flatnonzero(counts)
    total = counts[seen] @ table[seen]
    total = total / len(ids) * min(len(ids), EVIDENCE)
    return total - total.max()


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language) from a bounded sample of declared documents.

    Every declared language with a text is one.  Texts above SAMPLE_CHARS characters are
    trained on, by their beginning, only where a language has no shorter ones.
    """
    short = F.length("text") <= SAMPLE_CHARS
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    has_short = {r[0]: r[1] for r in usable.groupBy("lang").agg(F.max(short)).collect()}
    langs = sorted(has_short) or ["und"]
    long_only = [x for x in langs if has_short.get(x) is False]
    usable = usable.where(short | F.col("lang").isin(long_only)) if long_only else usable.where(short)
    usable = usable.withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("lang", "doc_id", F.row_number().over(first).alias("_rn"))
    picked = ids.where(F.col("_rn") <= per_language).select("lang", "doc_id").distinct()
    # At most per_language ids of each of BROADCAST_LANGUAGES: safe to broadcast.
    if len(langs) <= BROADCAST_LANGUAGES:
        picked = F.broadcast(picked)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                seen = np.bincount(trigrams(text), minlength=BUCKETS)
                sums[lang] = sums[lang] + seen if lang in sums else seen
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    rows = usable.join(picked, ["lang", "doc_id"]).select("lang", "text")
    found = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((BUCKETS, len(langs)), 0.05)
    # At most BUCKETS rows per language.
    for lang, part in found.toPandas().groupby("lang"):
        counts[part["bucket"], langs.index(lang)] += part["n"]
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def _evidence(texts: DataFrame, table: np.ndarray, column: Column, is_html: bool) -> DataFrame:
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([likelihood(extract(t) if is_html else t, table) for t in batch], dtype=object)

    return texts.withColumn("_ll", F.pandas_udf(scored, "array<double>")(column))


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, parent domain (last two labels) and suffix (last label); null without a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(F.length(host) > 0, host)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract(host, r"\.([a-z]{2,63})$", 1)
    return host, F.when(F.length(domain) > 0, domain).otherwise(host), F.when(F.length(suffix) > 0, suffix)


def declared_language(html: Column) -> Column:
    """Primary subtag of the html element's lang attribute, in lower case; null without one."""
    tag = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,8})", 1))
    return F.when(F.length(tag) > 0, tag)


def _spread_join(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Left join by a column, each key met in PARTS parts, so that a hot key is not one task."""
    parts = groups.withColumn("_gp", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    cond = (F.col(f"r.{key}") == F.col(f"g.{key}")) & (F.col("r._part") == F.col("g._gp"))
    return rows.alias("r").join(parts.alias("g"), cond, "left").select(
        "r.*", *[F.col(f"g.{c}") for c in groups.columns if c != key]
    )


def _mass(ll: Column) -> Column:
    """Entries (i, p) of the languages that a text may be in; -1 stands for the row itself."""
    top = F.array_max(ll)
    total = F.aggregate(ll, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    entries = F.transform(ll, lambda x, i: F.struct(i.cast("int").alias("i"), (F.exp(x - top) / total).alias("p")))
    one = F.array(F.struct(F.lit(-1).alias("i"), F.lit(1.0).alias("p")))
    return F.concat(F.filter(entries, lambda e: e["p"] >= LEAST_MASS), one)


def _parallel(entries: Column, prefix: str) -> list[Column]:
    return [F.transform(entries, lambda e: e["i"]).alias(f"{prefix}_i"), F.transform(entries, lambda e: e["p"]).alias(f"{prefix}_p")]


def group_sums(rows: DataFrame) -> DataFrame:
    """kind, value and _sums, the summed entries of ``_mass``, of every value of every key.

    Entries are summed as rows, combined before the shuffle, so the plan is the same for
    any number of languages.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KEYS]))
    named = rows.select(keys.alias("_k"), "_mass").where("_k.value IS NOT NULL")
    entries = named.select("_k.kind", "_k.value", F.explode("_mass").alias("_m"))
    sums = entries.groupBy("kind", "value", F.col("_m.i").alias("i")).agg(F.sum("_m.p").alias("p"))
    # An array of at most one entry per language and one more.
    return sums.groupBy("kind", "value").agg(F.collect_list(F.struct("i", "p")).alias("_sums"))


def posterior(ll: np.ndarray, own: np.ndarray, sums: dict[str, np.ndarray], base: np.ndarray) -> np.ndarray:
    """Log posterior per row and language; the last column of ``own`` and ``sums`` counts rows.

    A group's sums go in without the row itself, so that a text is not evidence twice.
    """
    rest = {k: np.maximum(v - own, 0) for k, v in sums.items()}
    smooth = lambda k, prior, weight: (rest[k][:, :-1] + weight * prior) / (rest[k][:, -1:] + weight)
    log = ll + np.log(smooth("host", smooth("domain", base, HOST_WEIGHT), HOST_WEIGHT))
    for key in ("declared", "suffix"):
        # P(value | language) up to a factor that is the same for every language.
        told = sums[key][:, -1:] > 0
        log = log + np.where(told, np.log(smooth(key, base, VALUE_WEIGHT) / base), 0.0)
    return log


def fuse(rows: DataFrame, langs: list[str]) -> DataFrame:
    """``rows`` (_ll, host, domain, suffix, declared and others) with ``language`` and ``probability``."""
    n = len(langs)
    rows = rows.withColumn("_mass", _mass(F.col("_ll")))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_id", "_ll"), F.lit(PARTS)).cast("int"))
    rows = stage(rows, "language-evidence")
    groups = stage(group_sums(rows), "language-groups")

    # The corpus's own mix of languages: one row for each.
    base = np.ones(n)
    world = rows.select(F.explode("_mass").alias("_m")).groupBy("_m.i").agg(F.sum("_m.p").alias("p")).where("i >= 0")
    for i, p in world.collect():
        base[i] += p
    base /= base.sum()

    for key in KEYS:
        entries = _parallel(F.col("_sums"), f"_{key}")
        rows = _spread_join(rows, groups.where(F.col("kind") == key).select(F.col("value").alias(key), *entries), key)

    def dense(at: pd.Series, values: pd.Series) -> np.ndarray:
        """A matrix of a row for each; entry -1 comes last."""
        out = np.zeros((len(at), n + 1))
        for row, i, p in zip(out, at, values):
            if i is not None:
                row[i] = p
        return out

    def decided(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, chances = [], []
            for k in range(0, len(batch[0]), SLICE):
                ll, *entries = [c.iloc[k : k + SLICE] for c in batch]
                own, *of = [dense(entries[j], entries[j + 1]) for j in range(0, len(entries), 2)]
                log = posterior(np.stack(ll.to_list()), own, dict(zip(KEYS, of)), base)
                best = log.argmax(1)
                names += [langs[i] for i in best]
                chances += list(1 / np.exp(log - log.max(1, keepdims=True)).sum(1))
            yield pd.DataFrame({"language": names, "probability": chances})

    inputs = ["_ll", "_own_i", "_own_p", *[f"_{k}_{x}" for k in KEYS for x in "ip"]]
    rows = rows.select("*", *_parallel(F.col("_mass"), "_own"))
    told = F.pandas_udf(decided, "language string, probability double")(*inputs)
    return rows.withColumn("_told", told).select("*", "_told.language", "_told.probability")


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_id, language, probability for every row of both tables.

    Rows of ``docs`` (doc_id, text, source, and lang to train on) have their source as
    host and no declaration; rows of ``pages`` (page_id, url, html) have all evidence and
    the main text as text.  Null and empty texts count as no evidence, so address,
    declaration and prior decide; a null host, suffix or declaration is left out.
    Repeated rows get the same answer, ties go to the first language in order.  Empty
    tables give empty results; extra columns are ignored.
    """
    langs, table = train(docs)
    a = _evidence(docs.select("doc_id", "text", "source"), table, F.col("text"), False).select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), F.concat(F.lit("source:"), "source").alias("host"),
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"),
        F.lit(None).cast("string").alias("declared"), "_ll", F.col("doc_id").alias("_id"),
    )
    host, domain, suffix = address_parts(F.col("url"))
    b = _evidence(pages.select("page_id", "url", "html"), table, F.col("html"), True).select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", host.alias("host"), domain.alias("domain"),
        suffix.alias("suffix"), declared_language(F.col("html")).alias("declared"), "_ll", F.col("page_id").alias("_id"),
    )
    return fuse(a.unionByName(b), langs).select("doc_id", "page_id", "language", "probability")


def op7(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    return identify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages"))
