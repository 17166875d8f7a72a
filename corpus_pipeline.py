"""A training corpus from `documents`: toxicity, quality rules, near-duplicates, secrets, packing.

Each stage works on all that the one before kept; run() writes a stage's rows to
the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgauge.llm import dedup, packing, quality, secrets, toxicity
from skillgauge.llm.common import stored, table
from skillgauge.session import configure

# No stage can be said in SQL as a whole; tests compare them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression distance says toxic go; the labels of all folds may be learned from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules or lie below the target ratio go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the least id stays."""
    return dedup.distinct_documents(docs, width=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def fill_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among sequences of the permitted lengths."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_dedup", one_of_each),
    ("secrets", hide_secrets),
    ("packing", fill_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
