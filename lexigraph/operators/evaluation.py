"""Quality of rankings and of answers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import words


def ranking_metrics(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row per (method, qid) of relevant queries: P@1/5/10/20, R@5/10/20, MRR, nDCG@10, MAP.

    results has (method, qid, rank, item), relevant (qid, item), distinct. An
    item that is listed twice counts twice, so recall can exceed 1. The ideal of
    nDCG is the retrieved gains sorted. Queries without results of a method are
    missing there; queries without relevant items are missing.
    """
    sizes = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"))
    hits = results.join(relevant.withColumn("hit", F.lit(1)), ["qid", "item"], "left").join(sizes, "qid")
    order = Window.partitionBy("method", "qid").orderBy("rank")
    flagged = hits.withColumn("hit", F.coalesce("hit", F.lit(0))).withColumn(
        "nth", F.sum("hit").over(order)
    )

    def at(k: int) -> Column:
        return F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))

    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    best = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("h10"), F.lit(1))),
        F.lit(0.0),
        lambda a, i: a + 1 / F.log2(i + F.lit(1.0)),
    )
    sums = flagged.groupBy("method", "qid").agg(
        F.max("relevant").alias("n"),
        *[at(k).alias(f"h{k}") for k in (1, 5, 10, 20)],
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 10, gain)).alias("dcg"),
        F.sum(F.when(F.col("hit") == 1, F.col("nth") / F.col("rank")).otherwise(0.0)).alias("precisions"),
    )
    return sums.select(
        "method",
        "qid",
        *[(F.col(f"h{k}") / k).alias(f"p_at_{k}") for k in (1, 5, 10, 20)],
        *[(F.col(f"h{k}") / F.col("n")).alias(f"r_at_{k}") for k in (5, 10, 20)],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("h10") > 0, F.col("dcg") / best).otherwise(0.0).alias("ndcg_10"),
        (F.col("precisions") / F.col("n")).alias("average_precision"),
    )


def ablation(metrics: DataFrame) -> DataFrame:
    """The mean of every metric by method, rounded, and the number of queries."""
    names = [c for c in metrics.columns if c not in ("method", "qid")]
    return metrics.groupBy("method").agg(
        F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in names]
    )


def report(means: DataFrame) -> str:
    """The ablation as a Markdown table; one row per method reaches the driver."""
    rows = means.orderBy("method").collect()
    names = means.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(x) for x in r) + " |" for r in rows])


def report_json(means: DataFrame) -> str:
    """The ablation as a JSON object by method; one row per method reaches the driver."""
    rows = means.orderBy("method").collect()
    return json.dumps({r["method"]: {c: r[c] for c in means.columns if c != "method"} for r in rows})


def _keywords(text: Column, least: int) -> Column:
    return F.array_distinct(F.filter(words(F.lower(text)), lambda w: F.length(w) > least))


def _share_in(keywords: Column, text: Column) -> Column:
    found = F.filter(keywords, lambda w: F.lower(text).contains(w))
    return F.size(found) / F.size(keywords)


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of an answer's sentences with over .3 of their words in the context; 0 without any."""
    sentences = F.filter(
        F.transform(F.split(answer, r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > 10
    )
    supported = F.filter(
        sentences,
        lambda s: (F.size(_keywords(s, 4)) == 0) | (_share_in(_keywords(s, 4), context) > 0.3),
    )
    return F.coalesce(F.try_divide(F.size(supported), F.size(sentences)), F.lit(0.0))


def answer_relevance(query: Column, answer: Column) -> Column:
    """Share of the query's words of over three letters that the answer has; .5 without such words."""
    asked = _keywords(query, 3)
    got = F.size(F.array_intersect(asked, words(F.lower(answer))))
    return F.when(F.size(asked) == 0, F.lit(0.5)).otherwise(got / F.size(asked))


def context_precision(query: Column, texts: Column) -> Column:
    """Share of texts that hold over .2 of the query's words; .5 without words, 0 without texts."""
    asked = _keywords(query, 3)
    good = F.filter(texts, lambda t: _share_in(asked, t) > 0.2)
    share = F.coalesce(F.try_divide(F.size(good), F.size(texts)), F.lit(0.0))
    return F.when(F.size(asked) == 0, F.lit(0.5)).otherwise(share)
