"""Drawing documents so that every source has its target share of all tokens.

Weighted fair queueing: the documents of a source are shuffled by a hash, and a
document's virtual finish time is the number of its source's tokens up to and
with it, divided by the source's weight. A further use of the source starts
where the last one ended. In the order of finish times every prefix has the
target shares (but for one document a source), and the mix is the prefix that
the total budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.operators.running import running_total
from lexigraph.session import cut

#: Tasks over which one source, or one mix, is spread.
BUCKETS = 1024
#: Rows (mix, source, use) from which they are no longer broadcast.
MANY_USES = 50_000


def source_key(source: Column) -> Column:
    """One spelling of a source's name: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def shuffled(sized: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, n_tokens, upto): shuffled documents with running tokens per source."""
    hashed = sized.where("source is not null and n_tokens > 0").select(
        source_key(F.col("source")).alias("source"),
        "doc_id",
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.xxhash64(F.lit(seed), "doc_id").alias("_h"),
    )
    # the bits of the hash, highest first, are the order: buckets are its highest ten
    bucket = F.shiftrightunsigned(F.col("_h"), 64 - (BUCKETS - 1).bit_length())
    placed = hashed.select(
        "source", "doc_id", "n_tokens", bucket.alias("_b"), F.shiftleft("_h", 10).alias("_o")
    )
    return running_total(placed, ["source"], "_b", ["_o", "doc_id"], "n_tokens", "upto").drop(
        "_b", "_o"
    )


def plan(order: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """(mix_name, source, weight, max_repeats, supply, budget): what each mix draws from.

    Weights are the target shares of the sources that have documents, scaled to
    sum 1. The budget is total_tokens or, without it, the largest total at which
    every such source still reaches its share within its repeats.
    """
    supply = order.groupBy("source").agg(
        F.sum("n_tokens").alias("supply"), F.max("n_tokens").alias("longest")
    )
    wanted = (
        targets.where("mix_name is not null and source is not null and target_share > 0")
        .groupBy("mix_name", source_key(F.col("source")).alias("source"))
        .agg(
            F.sum("target_share").alias("share"),
            F.max(F.coalesce(F.col("max_repeats"), F.lit(1))).alias("max_repeats"),
        )
        .where("max_repeats > 0")
    )
    mix = Window.partitionBy("mix_name")
    weighted = wanted.join(supply, "source").withColumn(
        "weight", F.col("share") / F.sum("share").over(mix)
    )
    reach = F.floor(F.min(F.col("supply") * F.col("max_repeats") / F.col("weight")).over(mix))
    budget = F.lit(total_tokens).cast("bigint") if total_tokens is not None else reach
    slack = F.sum("longest").over(mix)
    return weighted.select(
        "mix_name",
        "source",
        "weight",
        "max_repeats",
        "supply",
        budget.alias("budget"),
        # no record that finishes later can lie within the budget, as all sources run on till then
        F.when(budget <= reach, budget + slack).alias("horizon"),
    )


def mixed(
    sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11
) -> DataFrame:
    """(mix_name, source, doc_id, use, n_tokens, finish): the drawn records of every mix.

    sized has (doc_id, source, n_tokens), doc_id unique. use counts a record's
    uses from 0. Sources are told apart by source_key; documents of a null
    source or without tokens are not drawn, nor are sources that a mix doesn't
    list or whose share isn't positive; listed sources without documents leave
    their share to the others. If total_tokens is more than a source can give,
    the other sources go on and the shares drift, as the report shows.
    """
    order = shuffled(sized, seed)
    settings = cut(plan(order, targets, total_tokens))
    uses = settings.withColumn(
        "use", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1))
    ).where("horizon is null or use * supply / weight <= horizon")
    finish = (F.col("use") * F.col("supply") + F.col("upto")) / F.col("weight")
    # a few mixes of a few sources, times repeats; more are joined like any table
    few = uses.limit(MANY_USES).count() < MANY_USES
    queue = (
        order.join(F.broadcast(uses) if few else uses, "source")
        .withColumn("finish", finish)
        .where("horizon is null or finish <= horizon")
        .withColumn("_b", F.floor(F.col("finish") * BUCKETS / F.greatest("budget", F.lit(1))))
    )
    ordered = running_total(
        queue, ["mix_name"], "_b", ["finish", "source", "doc_id", "use"], "n_tokens", "_total"
    )
    return ordered.where(F.col("_total") <= F.col("budget")).select(
        "mix_name", "source", "doc_id", "use", "n_tokens", "finish"
    )


def share_report(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, records, most_uses).

    One row per target; targets without drawn records have an actual share of 0.
    """
    drawn = records.groupBy("mix_name", "source").agg(
        F.sum("n_tokens").alias("tokens"),
        F.count(F.lit(1)).alias("records"),
        (F.max("use") + 1).alias("most_uses"),
    )
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    wanted = targets.where("mix_name is not null and source is not null").groupBy(
        "mix_name", source_key(F.col("source")).alias("source")
    ).agg(F.sum("target_share").alias("target_share"))
    zero = F.lit(0).cast("bigint")
    return wanted.join(drawn, ["mix_name", "source"], "left").select(
        "mix_name",
        "source",
        "target_share",
        F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("records", zero).alias("records"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
