"""Fusing ranked lists, and re-scoring by graph and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The constant of reciprocal ranks, and the weight of each list.
RRF_K = 60
WEIGHTS = {"dense": 0.5, "sparse": 0.3, "graph": 0.2}
# Weights of the fused score, PageRank and proximity; of age, and its slope a year.
SEMANTIC, RANK, NEAR, RECENCY, SLOPE = 0.5, 0.2, 0.2, 0.1, 0.15
DIGITS = 9


def fused(lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(qid, key, score, arxiv_id, source, rank): the sum of weight / (60 + rank) over the lists.

    lists has (qid, source, rank, key, arxiv_id), rank from 1. Text hits are
    keyed by chunk and graph hits by paper, so these do not meet. A row's
    attributes come from its first list (dense, sparse, graph).
    """
    weights = weights or WEIGHTS
    weight, place = F.lit(0.0), F.lit(len(weights))
    for i, (source, w) in enumerate(weights.items()):
        weight = F.when(F.col("source") == source, F.lit(w)).otherwise(weight)
        place = F.when(F.col("source") == source, F.lit(i)).otherwise(place)
    sums = (
        lists.withColumn("_place", place)
        .groupBy("qid", "key")
        .agg(
            F.round(F.sum(weight / (RRF_K + F.col("rank"))), DIGITS).alias("score"),
            F.min(F.struct("_place", "rank", "source", "arxiv_id")).alias("f"),
        )
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "f._place", "f.rank", "key")
    return sums.select(
        "qid",
        "key",
        "score",
        F.col("f.arxiv_id").alias("arxiv_id"),
        F.col("f.source").alias("source"),
        F.row_number().over(order).alias("rank"),
    )


def graph_scored(
    results: DataFrame, ranks: DataFrame, near: DataFrame, seeded: DataFrame | None = None
) -> DataFrame:
    """results with pagerank, proximity and the combined score, ranked again.

    .5 score + .2 pagerank over the largest + .2 proximity; both are 0 where a
    paper has none. With seeded (qid) the scores of other queries stay.
    """
    largest = ranks.agg(F.max("pagerank").alias("largest"))
    joined = (
        results.join(ranks.select(F.col("id").alias("arxiv_id"), "pagerank"), "arxiv_id", "left")
        .join(near.select("qid", F.col("id").alias("arxiv_id"), "proximity"), ["qid", "arxiv_id"], "left")
        .join(F.broadcast(largest), how="cross")  # one row
        .withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
        .withColumn("proximity", F.coalesce("proximity", F.lit(0.0)))
    )
    part = F.coalesce(F.try_divide("pagerank", "largest"), F.lit(0.0))
    score = F.round(SEMANTIC * F.col("score") + RANK * part + NEAR * F.col("proximity"), DIGITS)
    if seeded is not None:
        joined = joined.join(seeded.withColumn("_seeded", F.lit(True)), "qid", "left")
        score = F.when(F.col("_seeded"), score).otherwise(F.col("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    return (
        joined.withColumn("score", score)
        .withColumn("rank", F.row_number().over(order))
        .drop("largest", "_seeded")
    )


def recent(score: Column, published: Column, this_year: int) -> Column:
    """Nine tenths of a score and a tenth of how recent; the score alone without a year."""
    year = F.try_to_number(F.substring(published, 1, 4), F.lit("9999")).cast("int")
    fresh = F.greatest(F.lit(0.0), 1 - SLOPE * (this_year - year))
    return F.when(year.isNotNull(), (1 - RECENCY) * score + RECENCY * fresh).otherwise(score)


def first_seen(results: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """The best-ranked result of each paper and query."""
    w = Window.partitionBy("qid", key).orderBy("rank")
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cascade(results: DataFrame, scorer: Column, threshold: int = 20, final: int = 10) -> DataFrame:
    """results re-ranked by a scorer where a query has more than threshold of them, cut to final.

    Only the first 100 are scored, the best `threshold` stay, then the best
    `final`; shorter lists keep their order.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    counted = results.withColumn("_n", n).where("rank <= 100")
    judged = counted.withColumn(
        "rerank_score", F.when(F.col("_n") > threshold, F.round(scorer, DIGITS))
    )
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return (
        judged.withColumn("final_rank", F.row_number().over(order))
        .where(F.col("final_rank") <= min(threshold, final))
        .drop("_n")
    )
