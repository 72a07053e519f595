"""Global order without a single-task window (W3, L1, L3, L5-L8 building blocks).

* ``seeded_hash``: deterministic "random" order, ``md5(key | seed)``; stable under
  task retries, repartitioning and across engines (DuckDB's ``md5`` agrees).
* ``rank_by_hash``: exact 1..N rank of rows ordered by such a hash. Rows are
  bucketed by the first hex digits of the hash (a range split, because hex order is
  string order), ranked inside their bucket, and shifted by the row count of all
  earlier buckets. The offsets table has at most 16**digits rows.
* ``global_rank``: exact 1..N rank for any total order. Range-partition + sort, a
  per-partition position, materialised once with ``checkpoint()`` (reliable storage
  in ``spark.checkpoint.dir``) so positions survive recomputation, plus per-partition
  offsets (one row per partition, broadcast).
* ``top_n_per_group``: exact top-n per group that survives one group holding a large
  share of the rows: top-n per (group, salt) first, then top-n of those candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..functions.text import col_

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def seeded_hash(*cols, seed: int | str = 42) -> Column:
    """md5 over ``col1|col2|...|seed`` (all cast to string)."""
    parts = [col_(c).cast("string") for c in cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def _offsets(counts: DataFrame, key: str, n_col: str, off_col: str, total_col: str | None = None) -> DataFrame:
    # ``counts`` has one row per bucket/partition (bounded), so a global window is fine.
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    cols = [key, F.coalesce(F.sum(n_col).over(w), F.lit(0)).alias(off_col)]
    if total_col:
        cols.append(F.sum(n_col).over(Window.partitionBy(F.lit(1))).alias(total_col))
    return counts.select(*cols)


def rank_by_hash(df: DataFrame, hash_col: str, tie_cols: list[str], name: str = "rank",
                 digits: int = 3, total_col: str | None = None) -> DataFrame:
    """Exact row_number() over (order by hash_col, tie_cols) without a one-task window.
    ``total_col`` also attaches the row count (summed from the same bucket counts)."""
    b = "_rbh_bucket"
    with_b = df.withColumn(b, F.substring(F.col(hash_col), 1, digits))
    w = Window.partitionBy(b).orderBy(F.col(hash_col), *[F.col(c) for c in tie_cols])
    local = with_b.withColumn("_rbh_local", F.row_number().over(w))
    counts = with_b.groupBy(b).agg(F.count(F.lit(1)).alias("_rbh_n"))
    offs = _offsets(counts, b, "_rbh_n", "_rbh_off", total_col)
    # at most 16**digits rows: a proven bound, so broadcasting is safe
    out = local.join(F.broadcast(offs), b)
    return out.withColumn(name, (F.col("_rbh_off") + F.col("_rbh_local")).cast("long")).drop(
        b, "_rbh_local", "_rbh_off")


def global_rank(df: DataFrame, order_cols: list, name: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Exact row_number() over (order by order_cols); order_cols must be a total order."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [col_(c) for c in order_cols]
    tagged = (df.repartitionByRange(n, *order)
                .sortWithinPartitions(*order)
                .withColumn("_gr_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    tagged = (tagged.withColumn("_gr_part", F.shiftright(F.col("_gr_mid"), _LOCAL_BITS))
                    .withColumn("_gr_local", F.col("_gr_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    counts = tagged.groupBy("_gr_part").agg(F.count(F.lit(1)).alias("_gr_n"))
    offs = _offsets(counts, "_gr_part", "_gr_n", "_gr_off")
    # one row per partition: bounded by the partition count
    out = tagged.join(F.broadcast(offs), "_gr_part")
    return out.withColumn(name, (F.col("_gr_off") + F.col("_gr_local") + 1).cast("long")).drop(
        "_gr_mid", "_gr_part", "_gr_local", "_gr_off")


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list, n,
                    name: str = "rn", salts: int = 32, salt_cols: list[str] | None = None) -> DataFrame:
    """row_number() over (partition by group order by order_cols) <= n, skew-safe.

    ``n`` is an int or the name of a per-row limit column (constant within a group).
    ``order_cols`` must be a total order inside each group. ``salt_cols`` (default:
    all of ``order_cols`` that are plain names) spread one group over ``salts`` tasks.
    """
    order = [col_(c) for c in order_cols]
    salt_src = [F.col(c) for c in (salt_cols or [c for c in order_cols if isinstance(c, str)])]
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    salted = df.withColumn("_tn_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "_tn_salt").orderBy(*order)
    cand = salted.withColumn("_tn_r", F.row_number().over(w1)).filter(F.col("_tn_r") <= limit)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return (cand.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= limit)
                .drop("_tn_salt", "_tn_r"))


def first_n(df: DataFrame, order_cols: list, n: int) -> DataFrame:
    """L1: first n rows in input order (TakeOrderedAndProject: per-task top-n, then merge)."""
    return df.orderBy(*[col_(c) for c in order_cols]).limit(n)


def seeded_shuffle(df: DataFrame, key_cols: list[str], seed: int = 42) -> DataFrame:
    """L3: deterministic shuffle order (a sort by ``md5(key | seed)``)."""
    return df.withColumn("_shuffle_key", seeded_hash(*key_cols, seed=seed)).orderBy("_shuffle_key", *key_cols)


def positional_split(df: DataFrame, order_cols: list, train_share: float = 0.8,
                     split_col: str = "split") -> DataFrame:
    """The first floor(share * n) rows in input order are 'train', the rest 'test'."""
    ranked = global_rank(df, order_cols, "_ps_rank")
    total = df.agg(F.count(F.lit(1)).alias("_ps_n"))
    out = ranked.crossJoin(F.broadcast(total))  # one row
    cut = F.floor(F.lit(train_share) * F.col("_ps_n"))
    return out.withColumn(split_col, F.when(F.col("_ps_rank") <= cut, "train").otherwise("test")).drop(
        "_ps_rank", "_ps_n")
