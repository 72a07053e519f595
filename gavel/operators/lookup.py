"""Attach small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_

def display_names(df: DataFrame, col: str, dim: DataFrame, key: str, display: str, out: str) -> DataFrame:
    """Display-name mapping with identity default."""
    # no hint: Spark broadcasts by the size it has seen, else shuffles
    d = dim.select(F.col(key).alias("_dn_key"), F.col(display).alias("_dn_val"))
    j = df.join(d, df[col] == F.col("_dn_key"), "left")
    return j.withColumn(out, F.coalesce("_dn_val", F.col(col))).drop("_dn_key", "_dn_val")


def attach_answers(df: DataFrame, idx_col: str, answers: DataFrame, answers_idx: str = "idx") -> DataFrame:
    """Attach index -> verdict rows; unmatched rows keep nulls."""
    return df.join(answers.withColumnRenamed(answers_idx, idx_col), idx_col, "left")


def any_column_lookup(values: DataFrame, value_col: str, dim: DataFrame, search_cols: list[str],
                      order_col: str, result_col: str, out: str) -> DataFrame:
    """Match a value against any of ``search_cols``; the first column wins, then the
    first row (by ``order_col``); no match -> empty string.

    The dimension is unpivoted to (value, column position, row order, result) and
    joined on the value, so the lookup is an equi join, not a per-row scan.
    """
    long = None
    for pos, c in enumerate(search_cols):
        part = dim.select(F.col(c).cast("string").alias("_lk_val"), F.lit(pos).alias("_lk_pos"),
                          F.col(order_col).alias("_lk_ord"), F.col(result_col).cast("string").alias("_lk_res"))
        long = part if long is None else long.unionByName(part)
    long = long.filter(F.col("_lk_val").isNotNull())
    best = long.groupBy("_lk_val").agg(F.min_by("_lk_res", F.struct("_lk_pos", "_lk_ord")).alias("_lk_res"))
    j = values.join(best, col_(value_col).cast("string") == F.col("_lk_val"), "left")
    return j.withColumn(out, F.coalesce("_lk_res", F.lit(""))).drop("_lk_val", "_lk_res")

