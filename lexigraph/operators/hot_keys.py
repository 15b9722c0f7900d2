"""Per-key results over tables in which a few keys hold most of the records.

Counts are algebraic: every map task folds its rows into a hash table of
mergeable states (Spark's partial hash aggregate, which spills when it is
full), and only one compact state per key and task is shuffled. A key that
holds half of all rows costs one state per task, not half of the rows.
Results that are not algebraic (the list of a key's partners) come in pieces
of bounded length, so no task ever holds the whole list of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_version(arxiv_id: Column) -> Column:
    """An arXiv id without its version suffix."""
    return F.regexp_replace(arxiv_id, r"v\d+$", "")


def citation_pairs(citations: DataFrame) -> DataFrame:
    """Distinct (src, dst) citation pairs.

    src is the citing arxiv_id as stored, dst a cited id without version.
    Null ids, null arrays, blank ids and self-citations give no pair; repeated
    ids, repeated batches and versions of one id give one pair.

    The shuffle is on both columns together, so a hot src or dst is spread
    over all tasks, and partial aggregation removes repeats before it.
    """
    exploded = citations.select(
        F.col("arxiv_id").alias("src"), F.explode("cited_arxiv_ids").alias("cited")
    )
    return (
        exploded.select("src", without_version(F.trim("cited")).alias("dst"))
        .where("src is not null and dst is not null and dst <> '' and src <> dst")
        .distinct()
    )


def count_per_key(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Rows per key by partial and final aggregation. Null keys are one key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def heavy_hitters(df: DataFrame, keys: dict[str, str], share: float) -> DataFrame:
    """(side, arxiv_id, n): the keys that hold at least share of all rows of df.

    keys maps a side's name to its column. All sides are counted in one pass:
    grouping sets over the rows, combined before the shuffle. An empty df gives
    no rows.
    """
    sides = F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(c).alias("arxiv_id")) for s, c in keys.items()]
    )
    counts = (
        df.select(F.explode(sides).alias("k"))
        .groupBy("k.side", "k.arxiv_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # every row counts once on each side, so the sum over one side is the number of rows
    totals = counts.groupBy("side").agg(F.sum("n").alias("total"))
    return (
        counts.join(F.broadcast(totals), "side")  # one row per side
        .where(F.col("n") >= F.lit(share) * F.col("total"))
        .select("side", "arxiv_id", "n")
    )


def lists_per_key(
    pairs: DataFrame, key: str, value: str, piece: int = 1000, salts: int = 256
) -> DataFrame:
    """(key, piece, n, values): each key's sorted values in pieces of about `piece`.

    Keys with at most `piece` values come as piece 0. A larger key is split by
    a hash of its values into ceil(n / piece) pieces. Its piece count is joined
    to its rows on (key, salt): the small side repeats a hot key's one row per
    salt, so that its rows are spread over `salts` join tasks.
    """
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    hot = (
        salted.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > piece)
        .select(
            key,
            F.ceil(F.col("_n") / piece).alias("_pieces"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("_salt"),
        )
    )
    return (
        salted.join(hot, [key, "_salt"], "left")
        .withColumn(
            "piece",
            F.coalesce(F.pmod(F.xxhash64(value, F.lit(7)), F.col("_pieces")), F.lit(0)).cast("int"),
        )
        .groupBy(key, "piece")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array_sort(F.collect_list(value)).alias("values"),
        )
    )
