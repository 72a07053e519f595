"""Shared plumbing: tables in the shared folder, blocks of documents, connected components."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 8_000_000
MAX_BUCKETS = 300_000
SALT = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); set here only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        from gavel.session import ensure_checkpoint_dir
        path = ensure_checkpoint_dir(spark)
    return path.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, *partition_by: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gavel-llm/{uuid.uuid4().hex}"


class Steps:
    """Tables of a job in rounds: each is written under a name, and the one that it replaces is deleted.

    Shuffle files of a step go as soon as its table is written (Spark's own setting, put back
    after the write), so that the disk holds one round and not all of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        before, path = self.spark.conf.get(CLEANUP, None), new_path(self.spark)
        self.spark.conf.set(CLEANUP, "true")
        try:
            out = stored(df, path=path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, name: str) -> None:
        path = self.paths.pop(name, None)
        if path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def layout(n_bytes: int, tasks: int) -> tuple[int, int]:
    """(bytes of text a block, buckets) for an input of ``n_bytes``.

    A block packs one row a bucket, so packed rows are blocks times buckets. Blocks grow with the
    input from 16 MB to 64 MB, and a bucket takes what 64 MB of text send: at 256 GB that is 4,096 of
    each, at 1 TB 16,000 of each with the packed content of 4 KB of text a row. Neither a block nor a
    bucket outgrows a worker, and up to there what is shuffled is in proportion to the input.
    """
    return min(max(n_bytes // 4096, 16_000_000), 64_000_000), max(tasks, -(-n_bytes // 64_000_000))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def block_count(docs: DataFrame, text: str = "text") -> int:
    """Blocks of about BLOCK_BYTES of text, and one a shuffle partition at least.

    The count follows the input, so a block fits a worker's memory at any size.
    """
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-n // BLOCK_BYTES))


def with_block(docs: DataFrame, n: int, *cols: str) -> DataFrame:
    """Adds ``block``: rows are dealt by their content, the same in every run and retry."""
    return docs.withColumn("block", F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int"))


def attach(rows: DataFrame, facts: DataFrame, key: str, spread: str, how: str, salts: int = 64) -> DataFrame:
    """Joins rows with the facts of their key; a hot key's rows are dealt to ``salts`` join keys by ``spread``."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def column_of(table: pa.Table, name: str):
    return table.column(name).combine_chunks() if table.num_rows else table.column(name)


def to_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def pieces(batches, text: str = "text", most: int = 2_000_000):
    """Slices of Arrow batches with about ``most`` bytes of text (a longer text is a slice of its own)."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        sizes = pa.compute.binary_length(table.column(text)).fill_null(0).to_pylist()
        first = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield table.slice(first, i - first)
                first, size = i, 0
            size += n
        yield table.slice(first)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge (a, b): root is the least node joined to it.

    Alternating large-star and small-star rounds: each is a partial ``min`` per node, a join
    back and a ``distinct``. A hot node's neighbours are salted over SALT join keys, which AQE
    splits further. The rounds end when the edges are stars: every node has one edge, to a node
    that has none of its own. Only two counts reach the driver.
    """
    spread = F.array([F.lit(i) for i in range(SALT)])

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            sides = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
                pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:  # the larger node looks at its smaller neighbours
            sides = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = (sides.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
               .join(least.withColumn("salt", F.explode(spread)), ["u", "salt"]))
        if large:
            new = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            new = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return new.where("a <> b").distinct()

    cur = stored(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(max_rounds):
        cur = stored(star(star(cur, True), False))
        n, nodes = cur.agg(F.count("*"), F.countDistinct("a")).first()
        hubs = cur.select(F.col("b").alias("a")).distinct()
        if n == nodes and cur.join(hubs, "a", "left_semi").isEmpty():
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def grouped(docs: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return docs.groupBy(key).applyInArrow(fn, schema)


def cogrouped(left: DataFrame, right: DataFrame, key: str, fn: Callable[[pa.Table, pa.Table], pa.Table],
              schema: str) -> DataFrame:
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(fn, schema)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
