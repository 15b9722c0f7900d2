"""From ranked results to what is shown: context within a budget, paper lists, extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import snippet
from lexigraph.operators.fusion import first_seen

# Characters of a context, and the least that is worth a cut entry.
BUDGET, LEAST = 8000, 200
NOTHING = "No relevant passages were found."


def context(results: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(qid, rank, entry): entries in order of rank up to budget characters.

    results has (qid, rank, entry). The first entry that does not fit is cut and
    marked with '...' if more than LEAST characters are left; all later ones drop.
    """
    order = Window.partitionBy("qid").orderBy("rank")
    size = F.length("entry")
    used = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = results.withColumn("used", used)
    fits = F.col("used") + size <= budget
    left = F.lit(budget) - F.col("used")
    return placed.where(fits | (left > LEAST)).select(
        "qid",
        "rank",
        F.when(fits, F.col("entry"))
        .otherwise(F.concat(F.substr("entry", F.lit(1), left), F.lit("...")))
        .alias("entry"),
    )


def paper_list(results: DataFrame) -> DataFrame:
    """(qid, papers): titles of each query's papers in order of first appearance, one a line."""
    lines = F.array_sort(
        F.collect_list(
            F.struct("rank", F.concat(F.lit("- "), "title", F.lit(" ("), "arxiv_id", F.lit(")")).alias("line"))
        )
    )
    return first_seen(results).groupBy("qid").agg(lines.alias("l")).select(
        "qid", F.array_join("l.line", "\n").alias("papers")
    )


def extract_answer(results: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(qid, answer): the extracts of the best k results' papers; the answer without a generator.

    queries has qid; a query without results gets NOTHING.
    """
    shown = first_seen(results.where(F.col("rank") <= k))
    line = F.concat(F.lit("**"), "title", F.lit("** ("), "arxiv_id", F.lit(")\n"), snippet(F.col("text")))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    head = F.lit("Relevant passages:\n\n")
    found = shown.groupBy("qid").agg(lines.alias("l")).select(
        "qid", F.concat(head, F.array_join("l.line", "\n\n")).alias("answer")
    )
    every = queries.select("qid").join(found, "qid", "left")
    return every.withColumn("answer", F.coalesce("answer", F.lit(NOTHING)))
