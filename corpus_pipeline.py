"""Cleaning and tokenising a corpus: the stages, in order.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is
written as Parquet in the shared folder and reread as the next stage's
``docs``.  ``run`` applies all of them to the ``documents`` table.  All stages
but the last return the columns they were given; the last one returns
``doc_id``, ``ids`` and ``n_tokens`` of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasift.llm import bpe, decontaminate, exact_dedup, jaccard, toxicity
from parasift.llm.common import materialise
from parasift.llm.q_bpe import default_codec
from parasift.llm.q_toxicity import labelled_rows
from parasift.sources.tables import read_table

NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled
    rows of the training fold among ``docs``."""
    model = toxicity.fit(labelled_rows(spark, docs, sf_dir))
    return toxicity.keep_clean(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest ``doc_id`` stays."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of similarity 0.8 over 5-word shingles join, the
    row with the smallest ``doc_id`` stays."""
    return jaccard.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a (nearly) copied benchmark item go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document."""
    return bpe.encode(docs, default_codec(), keep=["doc_id"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", tokenise),
]

#: The classifier has no SQL form; every stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
