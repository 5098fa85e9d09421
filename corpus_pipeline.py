"""A corpus pipeline: each stage reads what the one before it wrote; of the stages' tables the last one stays until the application ends.

``run`` applies the stages to ``documents`` and returns the token ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import decontaminate, line_dedup, quality_gam, sentencepiece_trie, simhash
from wardline.llm.common import checkpointed, table
from wardline.sources.tables import working_tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_gam.keep(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document holds; n_chars follows."""
    return line_dedup.rewrite(docs, count_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    return sentencepiece_trie.encode(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: SQL can't express the fitted classifier, the fingerprints' hash and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with working_tables(spark, keep=1):
        for _, stage in STAGES[:-1]:
            with working_tables(spark, keep=1):  # what a stage has written for itself goes with it
                docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
