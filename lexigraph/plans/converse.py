"""A turn of every conversation at once: rewrite, search, learn, sum up, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.operators import answers, dialogue
from lexigraph.plans.engine import Engine
from lexigraph.session import cut


def session_search(
    engine: Engine, messages: DataFrame, queries: DataFrame, method: str = "hybrid_graph", k: int = 50
) -> DataFrame:
    """The engine's results for queries (qid, query, vec), seeded by the papers that each conversation last discussed.

    qid is the conv_id. Conversations that have discussed no paper are seeded by
    their dense list, as queries without a conversation are.
    """
    last = dialogue.papers_discussed(messages, dialogue.SEEDS)
    own = cut(last.select(F.col("conv_id").alias("qid"), F.col("arxiv_id").alias("id")))
    fresh = queries.join(own.select("qid").distinct(), "qid", "left_anti")
    seeds = own.join(queries.select("qid"), "qid", "left_semi").unionByName(engine.seeds(cut(fresh)))
    return engine.search(queries, method, k, seeds=cut(seeds))


def turn(
    engine: Engine, messages: DataFrame, entities: DataFrame, vectors: DataFrame | None = None, k: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(conv_id, query, rewritten, kind, context, answer, arxiv_ids) of the current query of each conversation, and what was learned.

    messages and entities are those of operators.dialogue; vectors (conv_id,
    vec) are the encoded queries, where there are any. context is null up to two
    messages. The second table (conv_id, ord, short, full) has the meanings of
    acronyms that the results gave.
    """
    asked = cut(dialogue.rewritten_queries(messages, entities))
    queries = asked.select(F.col("conv_id").alias("qid"), F.col("rewritten").alias("query"))
    if vectors is None:
        queries = queries.withColumn("vec", F.lit(None).cast("array<double>"))
    else:
        queries = queries.join(vectors.select(F.col("conv_id").alias("qid"), "vec"), "qid", "left")
    queries = cut(queries)
    found = session_search(engine, messages, queries, k=5 * k).where(F.col("rank") <= k)
    texts = engine.chunks.select(F.col("chunk_id").alias("key"), "text")
    titles = engine.nodes.select(F.col("id").alias("arxiv_id"), "title")
    shown = cut(
        found.join(texts, "key", "left")
        .join(titles, "arxiv_id", "left")
        .select("qid", "rank", "arxiv_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    )
    learned = dialogue.extracted_entities(
        asked.select("conv_id", "query"), shown.select(F.col("qid").alias("conv_id"), "rank", "text")
    )
    long = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("conv_id")
    context = dialogue.assembled_context(messages, entities, dialogue.papers_discussed(messages)).join(
        long, "conv_id", "left_semi"
    )
    ids = shown.where("arxiv_id is not null").groupBy("qid").agg(F.array_sort(F.collect_set("arxiv_id")).alias("arxiv_ids"))
    said = answers.extract_answer(shown, queries).join(ids, "qid", "left").withColumnRenamed("qid", "conv_id")
    turns = (
        asked.withColumn("kind", dialogue.query_kind(F.col("rewritten")))
        .join(context, "conv_id", "left")
        .join(said, "conv_id")
        .select("conv_id", "query", "rewritten", "kind", "context", "answer", "arxiv_ids")
    )
    return turns, learned
