"""From raw documents to a training mix: five stages, each written before the next reads it.

    python -c "import corpus_pipeline as p; ..."   # p.run(spark, folder)

Toxic documents go, of near duplicates one stays, documents that hold benchmark items go,
personal data is masked, and sources are mixed to their weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import mixing, near_join, pii, templates, toxicity
from tidemill.session import apply_settings, stage
from tidemill.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    docs = docs.select(*COLUMNS)
    labels = read_table(apply_settings(spark), sf_dir, "labels")
    return toxicity.keep_clean(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near duplicates."""
    apply_settings(spark)
    return near_join.keep_one(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item has leaked."""
    benchmark = read_table(apply_settings(spark), sf_dir, "benchmark")
    return templates.clean(docs.select(*COLUMNS), benchmark)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms masked; n_chars follows the text."""
    apply_settings(spark)
    masked = pii.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks."""
    apply_settings(spark)
    return mixing.apply_mix(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

# A trained classifier has no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table.  Every stage's result is written to the shared folder."""
    docs = read_table(apply_settings(spark), sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
