"""A training-data pipeline over ``documents``: five of the llm operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. The last names the documents of the mix with their copies.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import _blocks as B
from gavel.llm import decontaminate as clean
from gavel.llm import mixing, ngram_join, pii, quality_crf
from gavel.llm.queries import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    model = quality_crf.learn(docs, table(spark, sf_dir, "labels"), max_docs=3000, max_lines=200)
    return quality_crf.keep_good(docs, model, min_share=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least doc_id."""
    return ngram_join.keep_one(docs, k=5, threshold=0.8, recall=0.999)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return clean.decontaminate(docs, table(spark, sf_dir, "benchmark"), k=5, threshold=0.8, radius=31)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is taken."""
    return mixing.mix_sources(docs, weights=(5, 2, 1), share=1.5, limit=2.0).where("copies > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("mixing", mix),
]

ORACLE_SQL = None  # line labels and signatures have no SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = B.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
