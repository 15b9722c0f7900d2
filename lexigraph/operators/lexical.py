"""Lexical ranking: postings, inverse document frequencies and BM25."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import tokens
from lexigraph.session import cut, spread

# Saturation, length normalisation and the floor of negative weights.
K1 = 1.5
B = 0.75
EPSILON = 0.25
#: Digits to which scores are rounded before they are ranked, so that ties are ties.
DIGITS = 9
#: Terms of more than this share of the documents are looked up last, for documents that can still be among the best.
COMMON = 0.05


def postings(corpus: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, key, tf, dl): how often each document holds each term, and its length."""
    # a step of its own, so that the lengths are not worked out beside the exploded lists
    t = spread(corpus).select(key, tokens(text).alias("t")).select(key, F.size("t").alias("dl"), "t")
    # outer, as a filter on the size of the lists would be worked out before they are dealt to all cores
    return (
        t.select(key, "dl", F.explode_outer("t").alias("term"))
        .where("term is not null")
        .groupBy("term", key, "dl")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def corpus_size(corpus: DataFrame, posts: DataFrame) -> DataFrame:
    """One row (n, avgdl) of all documents, empty ones included; lengths come from the postings."""
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    total = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return n.join(F.broadcast(total), how="cross").select(  # one row each
        "n", F.try_divide("total", "n").alias("avgdl")
    )


def weights(posts: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, idf): negative weights become EPSILON times the mean over all terms."""
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(F.broadcast(size.select("n")), how="cross").select(  # one row
        "term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")
    )
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), how="cross").select(  # one row
        "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")
    )


def impacts(posts: DataFrame, size: DataFrame, key: str, idf: DataFrame | None = None) -> DataFrame:
    """(term, key, part): what a term adds to a document's score each time that a query has it.

    idf has the weights of posts where they are written already.
    """
    length = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + length)
    joined = posts.join(weights(posts, size) if idf is None else idf, "term").join(F.broadcast(size), how="cross")  # one row
    return joined.select("term", key, part.alias("part"))


def bounds(parts: DataFrame, size: DataFrame) -> DataFrame:
    """(term, most, common): the largest part of each term; common tells the terms of over COMMON of all documents.

    A term that lowers scores is never common.
    """
    found = parts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.max("part").alias("most"), F.min("part").alias("least")
    )
    common = (F.col("df") > COMMON * F.col("n")) & (F.col("least") >= 0)
    return found.join(F.broadcast(size.select("n")), how="cross").select("term", "most", common.alias("common"))  # one row


def ranked(
    queries: DataFrame,
    parts: DataFrame,
    limits: DataFrame,
    key: str,
    k: int,
    excluded: DataFrame | None = None,
    rows_a_block: int = 1_000_000,
) -> DataFrame:
    """(qid, key, rank, score, normalized): the k best documents with a positive score.

    queries has (qid, query), parts is of impacts, limits (term) of weights or bounds. Every query
    term counts as often as the query has it. Ties go to the smaller key.
    excluded (qid, key) is taken out before the cut, so that k results remain
    where there are as many. normalized divides by the best score of the query.

    Documents are dealt to blocks with all their parts, and queries to blocks.
    Each pair of blocks is one task, in which every query adds up the parts of
    its terms in an array over the block's documents; only its k best (and as
    many more as are excluded for it) go on, so no row stands for a query and
    a document that have a word in common.
    """
    terms = queries.where("qid is not null").select("qid", F.explode(tokens(F.col("query"))).alias("term"))
    times = cut(terms.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times")).join(limits.select("term"), "term"))
    # short numbers in place of terms in all that follows
    numbers = cut(times.select("term").distinct().withColumn("no", F.monotonically_increasing_id()))
    asked = times.join(numbers, "term").select("qid", "no", "times", F.lit(k).cast("bigint").alias("most"))
    if excluded is not None:
        excluded = excluded.select("qid", key).distinct()
        more = excluded.groupBy("qid").agg(F.count(F.lit(1)).alias("more"))
        most = F.col("most") + F.coalesce("more", F.lit(0))
        asked = asked.join(more, "qid", "left").select("qid", "no", "times", most.alias("most"))
    found = _best_of_blocks(cut(asked), cut(parts.join(numbers, "term").select("no", key, "part")), key, rows_a_block)
    if excluded is not None:
        found = found.join(excluded, ["qid", key], "left_anti")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    top = F.max("score").over(Window.partitionBy("qid"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("qid", key, "rank", "score", (F.col("score") / top).alias("normalized"))
    )


def _best_of_blocks(asked: DataFrame, held: DataFrame, key: str, rows_a_block: int) -> DataFrame:
    """(qid, key, score): of each block of documents the best of every query, `most` of them.

    asked has (qid, no, times, most), held (no, key, part); both are read twice.
    """
    rows = held.count()
    # small tables are dealt further, so that every core has a block
    spread = min(3 * held.sparkSession.sparkContext.defaultParallelism, rows // 20_000)
    d_blocks = max(1, -(-rows // rows_a_block), spread)
    q_blocks = max(1, -(-asked.count() // rows_a_block))

    def dealt(df: DataFrame, by: str, mine: str, n: int, other: str, others: int) -> DataFrame:
        own = F.pmod(F.xxhash64(by), F.lit(n)).cast("int").alias(mine)
        placed = df.select("*", own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return placed.repartition(d_blocks * q_blocks, "qb", "db")

    q = dealt(asked, "qid", "qb", q_blocks, "db", d_blocks)
    d = dealt(held, key, "db", d_blocks, "qb", q_blocks)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        # documents in order of their keys, so that a stable sort by score breaks ties
        right = right.take(pc.sort_indices(right, sort_keys=[(key, "ascending")], null_placement="at_start"))
        coded = right[key].combine_chunks().dictionary_encode(null_encoding="encode")
        no = right["no"].to_numpy()
        by_term = np.argsort(no, kind="stable")
        known, start = np.unique(no[by_term], return_index=True)
        stop = np.append(start[1:], len(no))
        doc = coded.indices.to_numpy()[by_term]
        part = right["part"].to_numpy()[by_term]
        left = left.sort_by([("qid", "ascending"), ("no", "ascending")])
        qids = left["qid"].combine_chunks().dictionary_encode()
        first = np.unique(qids.indices.to_numpy(), return_index=True)[1]
        times, most = left["times"].to_numpy(), left["most"].to_numpy()
        at = np.searchsorted(known, left["no"].to_numpy())
        there = at < len(known)
        there[there] = known[at[there]] == left["no"].to_numpy()[there]
        sums = np.empty(len(coded.dictionary))
        whose, docs, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for q, (a, b) in enumerate(zip(first, np.append(first[1:], len(left)))):
            sums[:] = 0
            for i in range(a, b):
                if there[i]:
                    span = slice(start[at[i]], stop[at[i]])
                    sums[doc[span]] += times[i] * part[span]  # a term has a document once
            n = min(int(most[a]), len(sums))
            least = np.partition(sums, -n)[-n] if n else np.inf
            # a little below, as rounding makes ties
            best = np.flatnonzero((sums >= least - 2 * 10.0**-DIGITS) & (sums > 0))
            score = np.round(sums[best], DIGITS)
            order = np.argsort(-score, kind="stable")[:n]
            order = order[score[order] > 0]
            whose.append(np.full(len(order), q))
            docs.append(best[order])
            scores.append(score[order])
        return pa.table(
            {
                "qid": qids.dictionary.take(pa.array(np.concatenate(whose))),
                key: coded.dictionary.take(pa.array(np.concatenate(docs))),
                "score": pa.array(np.concatenate(scores), pa.float64()),
            }
        )

    types = [df.schema[c].dataType.simpleString() for df, c in ((asked, "qid"), (held, key))]
    return q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInArrow(search, f"qid {types[0]}, `{key}` {types[1]}, score double")
