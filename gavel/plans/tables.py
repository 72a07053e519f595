"""Driver tables and the deterministic derivations every registered query shares.

Human score of a document: ``1 + pmod(doc_id * 7 + n_chars, 5)``; group of a document:
``lang || '/' || source || '/' || doc_id div 200``. Both are plain expressions in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# A group is a shelf of neighbouring documents, as a paragraph's sentences are: groups grow
# in number with the data, not in size.
GROUP_DOCS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def human_score(doc_id="doc_id", n_chars="n_chars") -> Column:
    return (F.lit(1) + F.pmod(F.col(doc_id) * 7 + F.col(n_chars), F.lit(5))).cast("int")


def doc_group(lang="lang", source="source", doc_id="doc_id") -> Column:
    shelf = F.floor(F.col(doc_id) / GROUP_DOCS).cast("string")
    return F.concat(F.col(lang), F.lit("/"), F.col(source), F.lit("/"), shelf)


HUMAN_SCORE_SQL = "CAST(1 + ((doc_id * 7 + n_chars) % 5) AS INTEGER)"
DOC_GROUP_SQL = f"(lang || '/' || source || '/' || CAST(doc_id // {GROUP_DOCS} AS VARCHAR))"
