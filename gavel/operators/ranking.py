"""Pairwise judging and win/loss rankings.

A source holds the candidate translations of one sentence. Every aggregate here is
keyed by (source[, translation]); dense ranks run on the distinct (source, score)
values, and top-n is limited before the shuffle, so a hot source never lands whole in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.votes import vote_points
from .ordering import global_rank


def pair_ratings(votes: DataFrame, pairs: DataFrame, repeat: int) -> DataFrame:
    """Swap-debiased preference score per pair.

    ``votes``: pair_id, repeat, swapped, response (one row per reply; a missing reply
    scores nothing). ``pairs``: pair_id, source_id, translation_id_1/2 (1 = worse by
    human score), human_score_1/2. score = correction points / (2 * repeat).
    """
    pts = votes.select("pair_id", vote_points("response", "swapped").alias("p"))
    agg = pts.groupBy("pair_id").agg(F.sum("p.corr").alias("_corr"), F.sum("p.trans").alias("_trans"))
    out = pairs.join(agg, "pair_id", "left")
    score = F.coalesce(F.col("_corr"), F.lit(0.0)) / F.lit(2.0 * repeat)
    return (out.withColumn("model_preference_score", score)
               .withColumn("model_agrees", F.col("model_preference_score") > 0.5)
               .drop("_corr", "_trans"))


def pair_ratings_inline(pairs: DataFrame, replies_col: str, repeat: int) -> DataFrame:
    """A19 when the replies sit on the pair row (e.g. the injected scorer's output as an
    array of struct(repeat, swapped, response)): the points are folded inside the row,
    so no shuffle and no join back to the pairs."""
    # a pair has 2 * repeat replies: the sum is unrolled over the positions so it stays
    # in generated code (a lambda fold would be interpreted); missing replies count 0
    corr = F.lit(0.0)
    for i in range(2 * repeat):
        v = F.try_element_at(F.col(replies_col), F.lit(i + 1))
        corr = corr + F.coalesce(vote_points(v["response"], v["swapped"])["corr"], F.lit(0.0))
    score = corr / F.lit(2.0 * repeat)
    return (pairs.withColumn("model_preference_score", score)
                 .withColumn("model_agrees", F.col("model_preference_score") > 0.5))


def three_way_verdict(votes: DataFrame, tie_words=("equal",)) -> DataFrame:
    """Better / worse / equal for the correction from the same vote sums."""
    pts = votes.select("pair_id", vote_points("response", "swapped", tie_words, winner_tag=False).alias("p"))
    agg = pts.groupBy("pair_id").agg(F.sum("p.corr").alias("corr"), F.sum("p.trans").alias("trans"))
    v = F.when(F.col("corr") > F.col("trans"), "better").when(F.col("trans") > F.col("corr"), "worse").otherwise("equal")
    return agg.select("pair_id", v.alias("verdict"))


def agreement_by_source(ratings: DataFrame, sources: DataFrame) -> DataFrame:
    """Agreeing / compared per source; null when the source had no comparison."""
    rate = ratings.groupBy("source_id").agg(F.avg(F.col("model_agrees").cast("double")).alias("agreement_rate"),
                                            F.count(F.lit(1)).alias("n_compared"))
    return sources.join(rate, "source_id", "left").withColumn("n_compared", F.coalesce("n_compared", F.lit(0)))


def win_loss(ratings: DataFrame) -> DataFrame:
    """Wins / losses / win share per (source, translation), with its human score and
    text. The model agreeing means translation 2 (the human-better one) wins."""
    agree = F.col("model_agrees")
    sides = F.array(
        F.struct(F.col("translation_id_1").alias("translation_id"), F.col("translation_1").alias("translation"),
                 F.col("human_score_1").alias("human_score"), F.when(agree, 0).otherwise(1).alias("w"),
                 F.when(agree, 1).otherwise(0).alias("l")),
        F.struct(F.col("translation_id_2").alias("translation_id"), F.col("translation_2").alias("translation"),
                 F.col("human_score_2").alias("human_score"), F.when(agree, 1).otherwise(0).alias("w"),
                 F.when(agree, 0).otherwise(1).alias("l")))
    long = ratings.select("source_id", F.inline(sides))
    agg = long.groupBy("source_id", "translation_id").agg(
        F.sum("w").alias("wins"), F.sum("l").alias("losses"),
        F.first("human_score").alias("human_score"), F.first("translation").alias("translation"))
    total = F.col("wins") + F.col("losses")
    return agg.withColumn("fluency_score", F.when(total > 0, F.col("wins") / total).otherwise(F.lit(0.0)))


def human_ranks(ratings: DataFrame) -> DataFrame:
    """W2 + U1: dense rank of human scores per source (high = 1) over both pair sides,
    computed on the distinct (source, score) values."""
    u = (ratings.select("source_id", F.col("human_score_1").alias("human_score"))
                .unionByName(ratings.select("source_id", F.col("human_score_2").alias("human_score")))
                .distinct())
    w = Window.partitionBy("source_id").orderBy(F.col("human_score").desc())
    return u.withColumn("human_rank", F.dense_rank().over(w))


def item_ranks(items: DataFrame, group: str = "group_key", score: str = "score") -> DataFrame:
    """W2 from the items themselves: dense rank of the distinct scores of a source (high = 1).
    The same ranks as over all pairs of the source, without its pairs."""
    u = items.select(F.col(group).alias("source_id"), F.col(score).alias("human_score")).distinct()
    return u.withColumn("human_rank", F.dense_rank().over(Window.partitionBy("source_id").orderBy(F.col("human_score").desc())))


def top_n(scores: DataFrame, n: int, best: bool = True) -> DataFrame:
    """N best (or worst) translations per source by win share, ties by id. Spark limits the
    rows of a source before and after the shuffle (a literal n), so a hot source is no burden."""
    order = [F.col("fluency_score").desc() if best else F.col("fluency_score").asc(), F.col("translation_id")]
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    return scores.withColumn("position", place).filter(F.col("position") <= n)


def top_n_human_rank(scores: DataFrame, ranks: DataFrame, n: int, best: bool = True) -> DataFrame:
    """The human rank (``item_ranks`` or ``human_ranks``) of the model's n best (or worst)
    translations per source."""
    return top_n(scores, n, best).join(ranks, ["source_id", "human_score"], "left")


def candidate_positions(candidates: DataFrame, order_col: str = "translation_id") -> DataFrame:
    """1-based position of each candidate inside its source (by ``order_col``), from one
    exact global rank minus the source's first rank: no per-source window sort."""
    r = global_rank(candidates, ["source_id", order_col], "_cp_rank")
    first = r.groupBy("source_id").agg(F.min("_cp_rank").alias("_cp_first"), F.count(F.lit(1)).alias("n_candidates"))
    return (r.join(first, "source_id")
             .withColumn("position", (F.col("_cp_rank") - F.col("_cp_first") + 1).cast("int"))
             .drop("_cp_rank", "_cp_first"))


def ranking_list_ranks(replies: DataFrame, candidates: DataFrame, ranks: DataFrame, n: int | None = None) -> DataFrame:
    """W8 + X12: a reply's ``<rankings>`` list (1-based candidate positions) re-ordered
    against human ranks: (source_id, list_pos, position, human_rank); entries that do
    not parse or point nowhere are skipped; ``n`` keeps the first n list entries."""
    from ..functions.text import first_tag_text, rank_list
    lst = rank_list(first_tag_text("response", "rankings"))
    ex = replies.select("source_id", F.posexplode(lst).alias("list_pos", "position"))
    ex = ex.filter(F.col("position").isNotNull()).withColumn("list_pos", (F.col("list_pos") + 1).cast("int"))
    if n is not None:
        ex = ex.filter(F.col("list_pos") <= n)
    return ex.join(candidates, ["source_id", "position"]).join(ranks, ["source_id", "human_score"], "left")


def winner_rank(replies: DataFrame, candidates: DataFrame, ranks: DataFrame) -> DataFrame:
    """A reply's winner index (1-based position among the source's candidates) ->
    that candidate's human rank; unparsable winners are skipped."""
    idx = F.regexp_extract("response", r"(?is)<winner>\s*(\d+)\s*</winner>", 1).try_cast("int")
    r = replies.select("source_id", idx.alias("position")).filter(F.col("position").isNotNull())
    return r.join(candidates, ["source_id", "position"]).join(ranks, ["source_id", "human_score"], "left")


def references_long(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """J6 + A21 in long form: (source_id, reference) for every reference of a source, plus
    the row's target when it is not already among them (a null list becomes [target])."""
    have = refs.select("source_id", "reference").distinct()
    t = targets.select("source_id", F.col("target").alias("reference")).distinct()
    missing = t.join(have, ["source_id", "reference"], "left_anti")
    return have.unionByName(missing)
