"""Conversations as tables of messages: tails, rewriting, entities, context, state.

messages has (conv_id, turn, role, content) and, where asked for, arxiv_ids, the
papers a message names; (conv_id, turn) is unique. The newest message of a
conversation is its current query. Every operator first cuts a conversation to
its last few messages (the limit on the rank works before the shuffle), so a
conversation that holds most messages costs no task more than another.
entities has (conv_id, ord, short, full) in the order in which they were learned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import words

# Substrings that tell the kind of a question, in the order they are tried.
KINDS = {
    "comparative": ["compare", "versus", "vs", "difference between", "better"],
    "survey": ["survey", "overview", "recent advances", "state of the art", "review"],
    "author": ["papers by", "author", "wrote", "published by"],
    "temporal": ["when", "timeline", "history", "evolution", "trend"],
    "graph": ["citing", "cited by", "related papers", "builds on", "extends"],
    "factual": ["what is", "define", "explain", "how does", "describe"],
}
# Words that refer back, and phrases that are replaced, in order.
PRONOUNS = ["it", "its", "this", "that", "these", "those", "they", "them", "their", "he", "she", "his", "her"]
PHRASES = ["it", "its", "this method", "this approach", "this paper", "the paper", "the method"]
# Nouns and words that refer back, phrases that make a question a definition, openings of a follow-up.
REFERRING = (
    r"\b(?:paper|method|approach|model|system|technique|framework|algorithm"
    r"|same|previous|above|mentioned|discussed|it|its|this|that|these|those)\b"
)
DEFINING = ["what is a", "define", "explain what"]
FOLLOWING = (
    r"^(?:give|show|list|provide|tell)\s+|\b(?:more|examples|details|elaborate|expand|clarify|explain further)\b"
    r"|^(?:how|why|what)\s+about\b|^(?:and|also|but|however|what about)\b"
    r"|^(?:can you|could you|please)\s+(?:give|show|list|explain|elaborate)"
)
# Acronyms whose meaning is known without a text.
WELL_KNOWN = {
    "DPR": "Dense Passage Retrieval",
    "RAG": "Retrieval-Augmented Generation",
    "BM25": "BM25 (Best Match 25)",
    "REALM": "Retrieval-Augmented Language Model",
    "FiD": "Fusion-in-Decoder",
    "HyDE": "Hypothetical Document Embeddings",
    "ColBERT": "Contextualized Late Interaction over BERT",
    "RETRO": "Retrieval Enhanced Transformer",
}
# Messages looked at for papers and for entities, characters of a topic, seeds of a search.
PAPER_TAIL, ENTITY_TAIL, TOPIC, SEEDS = 6, 4, 150, 5
# Messages kept verbatim, points, and names of each kind in a summary.
VERBATIM, POINTS, NAMED = 5, 5, 10


def query_kind(query: Column) -> Column:
    """The first kind one of whose substrings the query holds, else 'general'."""
    q = F.lower(query)
    kind = F.lit("general")
    for name, parts in reversed(KINDS.items()):
        hit = F.lit(False)
        for p in parts:
            hit = hit | q.contains(p)
        kind = F.when(hit, F.lit(name)).otherwise(kind)
    return kind


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of each conversation; the limit cuts each map task's rows first."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def conversation_text(messages: DataFrame, n: int = 10) -> DataFrame:
    """(conv_id, text): 'role: content' of the last n messages, one a line."""
    lines = F.array_sort(
        F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "content").alias("line")))
    )
    return (
        last_messages(messages, n)
        .groupBy("conv_id")
        .agg(lines.alias("l"))
        .select("conv_id", F.array_join("l.line", "\n").alias("text"))
    )


def refers_back(content: Column) -> Column:
    """Whether a query needs an earlier message: it has a word that refers back, a noun that may, or opens as a follow-up.

    Nouns and referring words inside it don't count in a question for a definition.
    """
    low = F.lower(content)
    pronoun = F.arrays_overlap(words(low), F.array(*[F.lit(p) for p in PRONOUNS]))
    defining = F.lit(False)
    for phrase in DEFINING:
        defining = defining | low.contains(phrase)
    return pronoun | (low.rlike(REFERRING) & ~defining) | low.rlike(FOLLOWING)


def rewritten(query: Column, entity: Column, whole_words: bool = False) -> Column:
    """query with the first phrase it holds replaced, once, by entity; the query alone without one.

    With whole_words=False a phrase is found inside words, too.
    """
    edge = r"\b" if whole_words else ""
    result = query
    for phrase in reversed(PHRASES):
        at = F.regexp_instr(query, F.lit(f"(?i){edge}{phrase}{edge}"))
        once = F.concat(
            F.substr(query, F.lit(1), at - 1), entity, F.substr(query, at + len(phrase))
        )
        result = F.when((at > 0) & entity.isNotNull(), once).otherwise(result)
    return result


def _tail(messages: DataFrame) -> DataFrame:
    """(conv_id, tail): the last messages of each conversation, the newest first."""
    of = F.struct((-F.col("turn")).alias("_o"), "turn", "role", "content", "arxiv_ids")
    return (
        last_messages(messages, PAPER_TAIL)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(of)).alias("tail"))
    )


def _listed_entities(entities: DataFrame) -> DataFrame:
    """(conv_id, entities): each conversation's entities in the order they were learned."""
    return entities.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "short", "full"))).alias("entities")
    )


def _known(df: DataFrame, entities: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<ord:int,short:string,full:string>>")
    listed = _listed_entities(entities.select("conv_id", F.col("ord").cast("int").alias("ord"), "short", "full"))
    return df.join(listed, "conv_id", "left").withColumn("entities", F.coalesce("entities", none))


def previous_topics(messages: DataFrame) -> DataFrame:
    """(conv_id, topic): the latest user message before the last message, cut to TOPIC characters."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    users = last_messages(messages.where("role = 'user'"), 2).join(last, "conv_id").where("turn < last")
    return users.groupBy("conv_id").agg(F.substring(F.max_by("content", "turn"), 1, TOPIC).alias("topic"))


def rewritten_queries(messages: DataFrame, entities: DataFrame) -> DataFrame:
    """(conv_id, query, rewritten): the current query of each conversation, made to stand alone.

    A query that refers back has its first referring phrase replaced by the
    entity last spoken of: the first known entity of the newest assistant
    message that names one, else the first capitalised word of the query. The
    papers last named are appended to a question for related ones. A query that
    stays as it is gets the previous topic, if any entity or paper is at hand.
    The first message of a conversation is never rewritten.
    """
    base = _known(_tail(messages).join(previous_topics(messages), "conv_id", "left"), entities)

    def named(m: Column) -> Column:
        return F.filter("entities", lambda e: F.lower(m["content"]).contains(F.lower(e["short"])))

    recent = F.slice("tail", 1, ENTITY_TAIL)
    spoken = F.flatten(
        F.transform(F.filter(recent, lambda m: m["role"] == "assistant"), lambda m: named(m)["full"])
    )
    asked = F.get(F.filter(recent, lambda m: m["role"] == "user")["content"], F.lit(0))
    capital = F.filter(words(asked), lambda w: (F.length(w) > 3) & w.rlike(r"^\p{Lu}"))
    papers = F.filter("tail", lambda m: m["arxiv_ids"].isNotNull())
    query = F.get("tail", F.lit(0))["content"]
    found = base.select(
        "conv_id",
        query.alias("query"),
        F.coalesce("topic", F.lit("")).alias("topic"),
        F.coalesce(F.get(spoken, F.lit(0)), F.get(capital, F.lit(0))).alias("entity"),
        F.get(papers, F.lit(0))["arxiv_ids"].alias("papers"),
        ((F.size("tail") >= 2) & refers_back(query)).alias("back"),
    ).withColumn("papers", F.when(F.size("papers") > 0, F.col("papers")))
    replaced = rewritten(F.col("query"), F.col("entity"))
    also = F.concat(F.lit(" (related to papers: "), F.array_join(F.slice("papers", 1, 3), ", "), F.lit(")"))
    related = F.when(F.lower("_q").contains("related") & F.col("papers").isNotNull(), also).otherwise("")
    about = F.concat("query", F.lit(" (regarding "), "topic", F.lit(")"))
    at_hand = F.col("entity").isNotNull() | F.col("papers").isNotNull()
    return (
        found.withColumn("_q", replaced)
        .withColumn("_q", F.concat("_q", related))
        .withColumn("_q", F.when((F.col("_q") == F.col("query")) & at_hand & (F.col("topic") != ""), about).otherwise(F.col("_q")))
        .select("conv_id", "query", F.when(F.col("back"), F.col("_q")).otherwise(F.col("query")).alias("rewritten"))
    )


def acronyms(text: Column) -> Column:
    """Distinct words of two and more capitals, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,})\b")))


def extracted_entities(queries: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """(conv_id, ord, short, full): meanings of the acronyms of each query, from its best k results.

    queries has (conv_id, query), results (conv_id, rank, text). A text gives
    the meaning where it says 'ACR (meaning)' or 'meaning (ACR)', whatever the
    case; of several texts the last one counts. What no text says is taken from
    WELL_KNOWN. ord is the place of the acronym in the query.
    """
    asked = queries.select("conv_id", F.posexplode(acronyms(F.col("query"))).alias("ord", "acronym"))
    texts = results.where((F.col("rank") <= k) & F.col("text").isNotNull()).select("conv_id", "rank", "text")
    # what stands before '(ACR)' begins after a bracket or with the text: asked for in the pattern, as it is
    # tried at each of a long text's letters else, to the same end
    pattern = "concat('(?i)(', acronym, ')\\\\s*[\\\\(\\\\[]([^)]+)[\\\\)\\\\]]|(?<![^(])([^(]+)\\\\s*[\\\\(\\\\[](', acronym, ')[\\\\)\\\\]]')"

    def part(i: int) -> Column:
        return F.expr(f"regexp_extract(text, {pattern}, {i})")

    # the dear pattern runs on texts only that have the acronym beside or within brackets
    near = F.expr("text rlike concat('(?i)', acronym, '\\\\s*[\\\\(\\\\[]|[\\\\(\\\\[]', acronym, '[\\\\)\\\\]]')")
    said = (
        asked.join(texts, "conv_id")
        .where(near)
        .select(
            "conv_id",
            "ord",
            "rank",
            F.when(part(1) != "", part(1)).otherwise(part(4)).alias("short"),
            F.when(part(1) != "", part(2)).otherwise(F.trim(part(3))).alias("full"),
        )
        .where("short <> ''")
        .groupBy("conv_id", "short")
        .agg(F.min("ord").alias("ord"), F.max_by("full", "rank").alias("full"))
    )
    table = F.create_map(*[F.lit(x) for pair in WELL_KNOWN.items() for x in pair])
    known = (
        asked.select("conv_id", "ord", F.col("acronym").alias("short"), table[F.col("acronym")].alias("full"))
        .where("full is not null")
        .join(said.select("conv_id", "short"), ["conv_id", "short"], "left_anti")
    )
    return said.select("conv_id", "ord", "short", "full").unionByName(known.select("conv_id", "ord", "short", "full"))


def with_entity_terms(query: Column, entities: Column, most: int = 3) -> Column:
    """query with up to `most` meanings (an array) that it lacks appended."""
    new = F.slice(F.filter(entities, lambda e: ~F.lower(query).contains(F.lower(e))), 1, most)
    return F.when(F.size(new) > 0, F.concat_ws(" ", query, F.array_join(new, " "))).otherwise(query)


def recent_topics(messages: DataFrame, n: int = 4, most: int = 5) -> DataFrame:
    """(conv_id, topics): capitalised words of over four letters of the user's last messages, distinct, sorted."""
    w = F.filter(words(F.col("content")), lambda w: (F.length(w) > 4) & w.rlike(r"^\p{Lu}"))
    mine = F.flatten(F.collect_list(F.when(F.col("role") == "user", w)))
    return last_messages(messages, n).groupBy("conv_id").agg(F.slice(F.array_sort(F.array_distinct(mine)), 1, most).alias("topics"))


def papers_discussed(messages: DataFrame, n: int | None = None) -> DataFrame:
    """(conv_id, place, arxiv_id): papers in the order in which a conversation first named them, each once.

    With n only the last n of each conversation, place 1 for the newest; else
    every paper, place from 1 for the oldest. Papers are aggregated per
    (conversation, paper) before any order is made.
    """
    named = messages.select("conv_id", "turn", F.posexplode("arxiv_ids").alias("pos", "arxiv_id")).where("arxiv_id is not null")
    first = named.groupBy("conv_id", "arxiv_id").agg(F.min(F.struct("turn", "pos")).alias("at"))
    order = F.desc("at") if n else F.asc("at")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(order)))
    return (placed.where(F.col("place") <= n) if n else placed).select("conv_id", "place", "arxiv_id")


def retrieval_context(messages: DataFrame, entities: DataFrame) -> DataFrame:
    """(conv_id, query, entities, topics): what a search may know of a conversation; entities is a map."""
    query = messages.groupBy("conv_id").agg(F.max_by("content", "turn").alias("query"))
    pairs = F.map_from_entries(F.transform("entities", lambda e: F.struct(e["short"], e["full"])))
    return _known(query.join(recent_topics(messages), "conv_id"), entities).select(
        "conv_id", "query", pairs.alias("entities"), "topics"
    )


def _points(content: Column, role: Column) -> Column:
    first = F.trim(F.get(F.split(content, r"\."), F.lit(0)))
    return F.when(role == "user", F.concat(F.lit("Q: "), F.substring(content, 1, TOPIC))).when(
        (role == "assistant") & (F.length(content) > 100), F.concat(F.lit("A: "), first)
    )


def compressed(messages: DataFrame, entities: DataFrame, discussed: DataFrame) -> DataFrame:
    """(conv_id, summary): the topics, papers and last points of messages.

    Topics are the known entities some message names, papers those of discussed
    (conv_id, arxiv_id) some message names, NAMED of each in order of their
    text; points are 'Q: ' with TOPIC characters and 'A: ' with the first
    sentence of an answer of over 100 characters. Parts that are empty are left
    out. A message meets the few entities of its conversation as one array, and
    papers by (conversation, id).
    """

    def listed(found: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("conv_id").orderBy("name")
        best = found.distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= NAMED)
        return best.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias(part))

    low = F.lower("content")
    spoken = F.filter("entities", lambda e: low.contains(F.lower(e["short"])))
    topics = _known(messages.select("conv_id", "content"), entities).select("conv_id", F.explode(spoken["full"]).alias("name"))
    ids = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\d{4}\.\d{4,5})"))))
    papers = messages.select("conv_id", ids.alias("name")).join(
        discussed.select("conv_id", F.col("arxiv_id").alias("name")), ["conv_id", "name"], "left_semi"
    )
    kept = messages.withColumn("point", _points(F.col("content"), F.col("role"))).where("point is not null")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("  - "), "point").alias("line"))))
    points = last_messages(kept, POINTS).groupBy("conv_id").agg(F.array_join(lines["line"], "\n").alias("points"))
    return (
        messages.select("conv_id")
        .distinct()
        .join(listed(topics, "topics"), "conv_id", "left")
        .join(listed(papers, "papers"), "conv_id", "left")
        .join(points, "conv_id", "left")
        .select(
            "conv_id",
            F.concat_ws(
                "\n",
                F.concat(F.lit("Topics discussed: "), "topics"),
                F.concat(F.lit("Papers referenced: "), "papers"),
                F.concat(F.lit("Key exchanges:\n"), "points"),
            ).alias("summary"),
        )
    )


def assembled_context(messages: DataFrame, entities: DataFrame, discussed: DataFrame) -> DataFrame:
    """(conv_id, context): up to VERBATIM messages as they are; of longer conversations a summary of the older ones first."""
    n = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    newest = last_messages(messages, VERBATIM)
    older = messages.join(newest.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "content").alias("line"))))
    recent = newest.groupBy("conv_id").agg(F.array_join(lines["line"], "\n").alias("recent"))
    head = F.when(
        F.coalesce("summary", F.lit("")) != "",
        F.concat(F.lit("[Previous context summary]\n"), "summary", F.lit("\n\n")),
    ).otherwise("")
    whole = F.concat(head, F.lit("[Recent messages]\n"), "recent", F.lit("\n"))
    return (
        n.join(recent, "conv_id")
        .join(compressed(older, entities, discussed), "conv_id", "left")
        .select("conv_id", F.when(F.col("n") <= VERBATIM, F.col("recent")).otherwise(whole).alias("context"))
    )
