"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sizes are words. Sources share ``share`` times all words by weight; no target goes beyond
``limit`` times its source's words, and what is over goes to the others by weight (water
filling, in closed form: the level is the largest of the levels at which the sources, taken
by their limit per weight, would stop).

A source's target is ``whole`` certain copies of each of its documents and a rest. For the
rest each document has the inclusion probability ``pi`` (the rest's share of the source) and
is ranked by ``(u / (1 - u)) / (pi / (1 - pi))``, random odds divided by inclusion odds; the
sample takes documents in that order while they fit the rest, and closes with the one
document left whose size is nearest to what is still missing, if that brings it nearer.
``u`` is a hash of the doc_id: reruns agree, whatever the partitioning.

Ranks are cut into BINS equal bins, summed per (source, bin) before the shuffle; a running
sum over the bins finds the bin in which the rest is used up, and only that bin's documents
are ordered one by one. So a source with most of the rows is never sorted in one task;
joins of rows with their source's figures are salted.

Defined results: a null text has size 0; a null source is a source of its own, the last;
equal ranks (repeated doc_ids) go by size; documents of size 0 take 0; an empty table gives
no rows; a long text only has a large size. Extra columns, whatever their names, are ignored.
One row a source goes through one task (the level of the water filling): sources are names of
corpora, thousands at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm import _blocks as B

BINS = 1024
WEIGHTS = (5, 2, 1)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row a source: key, source_size, target. One row a source meets in a task, no more."""
    by_source = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    before = Window.orderBy("cap_per_weight", "key").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("cap_per_weight", "key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    return (by_source.withColumn("weight", weight).withColumn("cap", limit * F.col("source_size"))
            .withColumn("cap_per_weight", F.col("cap") / F.col("weight")).withColumn("level", level)
            .withColumn("target", F.least("cap", F.max("level").over(every) * F.col("weight")))
            .select("key", "source_size", "target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    sized = B.stored(docs.select(
        "doc_id", "source", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("key"),
        B.word_count(F.col("text")).alias("size"), ((digits.cast("double") + 0.5) / float(2**52)).alias("u"),
        F.monotonically_increasing_id().alias("row")))

    plan = (targets(sized, weights, share, limit)
            .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
            .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
            .withColumn("pi", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0))))
    plan = B.stored(plan)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("pi") / (1 - F.col("pi")))
    ranked = (B.attach(sized, plan, "key", "row", "inner").withColumn("odds", F.when(F.col("pi") > 0, odds))
              .withColumn("rank", F.col("odds") / (1 + F.col("odds")))
              .withColumn("bin", F.coalesce(F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)), F.lit(BINS)).cast("int")))

    bins = ranked.groupBy("key", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    in_order = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (bins.where(f"bin < {BINS}").withColumn("before", F.coalesce(F.sum("words").over(in_order), F.lit(0)))
           .where("before + words > rest and before <= rest").groupBy("key")
           .agg(F.min("bin").alias("cut_bin"), F.min_by("before", "bin").alias("cut_before")))
    ranked = B.attach(ranked, cut, "key", "row", "left").withColumn("cut_bin", F.coalesce("cut_bin", F.lit(BINS)))
    edge = Window.partitionBy("key", "bin").orderBy("rank", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = ranked.where("bin = cut_bin and odds is not null").withColumn(
        "drawn", F.col("cut_before") + F.sum("size").over(edge) <= F.col("rest"))
    clear = ranked.where("bin <> cut_bin or odds is null").withColumn(
        "drawn", F.col("odds").isNotNull() & (F.col("bin") < F.col("cut_bin")))
    drawn = B.stored(clear.unionByName(at_edge))

    missing = drawn.groupBy("key").agg(
        (F.first("rest") - F.coalesce(F.sum(F.when(F.col("drawn"), F.col("size"))), F.lit(0))).alias("missing"))
    off = F.abs(F.col("size") - F.col("missing"))
    last = (B.attach(drawn.where("not drawn and size > 0 and odds is not null"), missing, "key", "row", "inner").where(off < F.col("missing"))
            .groupBy("key").agg(F.min(F.struct(off.alias("off"), "rank", "row")).alias("last")))
    copies = F.col("whole") + F.when(F.col("drawn") | F.coalesce(F.col("row") == F.col("last.row"), F.lit(False)), 1).otherwise(0)
    return (B.attach(drawn, last, "key", "row", "left").withColumn("copies", copies.cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))
