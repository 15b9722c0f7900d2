"""Session store as an append-only table: the newest row of an id is its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "conversation_id string, data string, created_at string, updated_at string"


def newest(store: DataFrame) -> DataFrame:
    """The newest row per conversation; of equal times the largest data counts."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("updated_at"), F.desc("data"))
    return store.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upserted(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after changes: one row per conversation."""
    return newest(store.unionByName(changes))


def found(store: DataFrame, conversation_id: str) -> DataFrame:
    """One conversation's state; the filter reaches the scan before the ranking."""
    return newest(store.where(F.col("conversation_id") == conversation_id))


def listed(store: DataFrame, n: int = 50) -> DataFrame:
    """The n conversations updated last."""
    return newest(store).orderBy(F.desc("updated_at"), "conversation_id").limit(n)


def deleted(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the given conversation_ids."""
    return store.join(ids, "conversation_id", "left_anti")


def created(spark: SparkSession, n: int, now: str) -> DataFrame:
    """n new sessions with random ids and an empty state."""
    return spark.range(n).select(
        F.uuid().alias("conversation_id"), F.lit("{}").alias("data"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at")
    )


def appended(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, content, arxiv_ids) with new ones (without turn, in order of at) as each conversation's next turns."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))
    numbered = new.withColumn("_n", place).join(last, "conv_id", "left")
    turn = (F.coalesce("last", F.lit(0)) + F.col("_n")).cast("bigint").alias("turn")
    return messages.select("conv_id", "turn", "role", "content", "arxiv_ids").unionByName(
        numbered.select("conv_id", turn, "role", "content", "arxiv_ids")
    )


STATE = "messages array<struct<turn:bigint,role:string,content:string>>, papers array<string>, entities map<string,string>"


def saved(tail: DataFrame, discussed: DataFrame, entities: DataFrame, now: str) -> DataFrame:
    """Rows of the store: each conversation's last messages, papers and entities as JSON (STATE).

    tail and discussed are cut to a few rows a conversation by the caller
    (dialogue.last_messages, dialogue.papers_discussed with n); entities are few.
    """
    messages = tail.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("messages")
    )
    placed = F.array_sort(F.collect_list(F.struct("place", "arxiv_id")))
    papers = discussed.groupBy("conv_id").agg(placed["arxiv_id"].alias("papers"))
    one = entities.groupBy("conv_id", "short").agg(F.max_by("full", "ord").alias("full"))
    known = one.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("short", "full")))).alias("entities"))
    state = messages.join(papers, "conv_id", "left").join(known, "conv_id", "left")
    return state.select(
        F.col("conv_id").alias("conversation_id"),
        F.to_json(F.struct("messages", "papers", "entities")).alias("data"),
        F.lit(now).alias("created_at"),
        F.lit(now).alias("updated_at"),
    )


def parsed(store: DataFrame) -> DataFrame:
    """(conversation_id, messages, papers, entities) of stored states; null parts where the data is no such JSON."""
    state = F.from_json("data", STATE)
    return store.select("conversation_id", state.alias("s")).select("conversation_id", "s.*")
