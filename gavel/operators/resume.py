"""Skip work that is already done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def done_ids(results: DataFrame, id_col: str = "id", output_col: str | None = "output") -> DataFrame:
    """ids with a result; rows whose output is null are not done (they are retried)."""
    r = results
    if output_col is not None:
        r = r.filter(F.col(output_col).isNotNull())
    return r.select(item_key(r.columns, id_col).alias("_done_id")).where("_done_id is not null").distinct()


def item_key(columns: list[str], id_col: str = "id", fallback: str = "sample_idx"):
    """The id of a row, or its ``sample_idx`` where it has none (both as strings)."""
    have = [F.col(c).cast("string") for c in (id_col, fallback) if c in columns]
    return F.coalesce(*have)


def pending_items(items: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Left anti join on the id, or on ``sample_idx`` for rows without one (AQE picks
    broadcast or shuffle from runtime size)."""
    return items.join(done, item_key(items.columns, id_col) == F.col("_done_id"), "left_anti")


def pending_batches(batches: DataFrame, done: DataFrame, ids_col: str = "original_ids") -> DataFrame:
    """A batch is kept when any of its member ids is not done."""
    members = batches.select("batch_id", F.explode(ids_col).alias("_mid"))
    open_members = members.join(done, F.col("_mid") == F.col("_done_id"), "left_anti")
    return batches.join(open_members.select("batch_id").distinct(), "batch_id", "left_semi")


def merge_previous(df: DataFrame, previous: DataFrame, key: str, result_col: str,
                   order_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Fill ``result_col`` from a previous output (the first non-null per key by
    ``order_cols``, else the least value), then split into (done, todo) by whether the
    result is still null."""
    order = F.struct(*(order_cols or []), result_col)
    prev = (previous.filter(F.col(result_col).isNotNull())
                    .groupBy(key).agg(F.min_by(result_col, order).alias("_prev")))
    merged = df.join(prev, key, "left")
    if result_col in df.columns:
        merged = merged.withColumn(result_col, F.coalesce(F.col(result_col), F.col("_prev")))
    else:
        merged = merged.withColumn(result_col, F.col("_prev"))
    merged = merged.drop("_prev")
    return merged.filter(F.col(result_col).isNotNull()), merged.filter(F.col(result_col).isNull())
