import time

from pyspark.sql import functions as F

from lexigraph.operators import dialogue

MESSAGES = "conv_id string, turn bigint, role string, content string, arxiv_ids array<string>, ord string"
ENTITIES = "conv_id string, ord int, short string, full string, turn int"


def rewritten(spark, messages, entities=()):
    m = spark.createDataFrame([(*x, "o") for x in messages], MESSAGES)
    e = spark.createDataFrame([(*x, 1) for x in entities], ENTITIES)
    return {r.conv_id: r.rewritten for r in dialogue.rewritten_queries(m, e).collect()}


def test_queries_are_made_to_stand_alone(spark):
    entities = [(c, 0, "DPR", "Dense Passage Retrieval") for c in "abcde"]
    messages = [
        ("a", 1, "user", "What is DPR", None), ("a", 2, "assistant", "dpr is a retriever", ["2004.04906"]), ("a", 3, "user", "How fast is it", None),
        ("b", 1, "user", "Tell me about it", None),
        ("c", 1, "user", "What is DPR", None), ("c", 2, "assistant", "DPR finds.", ["1", "2", "3", "4"]), ("c", 3, "user", "more related work", None),
        ("d", 1, "user", "What is Ranking", None), ("d", 2, "assistant", "Nothing known.", None), ("d", 3, "user", "give examples of Ranking", None),
        ("e", 1, "user", "What is a method", None), ("e", 2, "assistant", "A way.", None), ("e", 3, "user", "name colours", None),
        ("f", 1, "user", None, None), ("f", 2, "user", "", None),
    ]
    got = rewritten(spark, messages, entities)
    assert got["a"] == "How fast is Dense Passage Retrieval"
    assert got["b"] == "Tell me about it"
    assert got["c"] == "more related work (related to papers: 1, 2, 3)"
    assert got["d"] == "give examples of Ranking (regarding What is Ranking)"
    assert got["e"] == "name colours" and got["f"] == ""
    assert rewritten(spark, []) == {}


def test_long_conversations_are_summed_up(spark):
    long = "An answer that is long enough to be worth a point, as it has over a hundred characters in all. More."
    messages = [("a", i, "user" if i % 2 else "assistant", f"Question {i}" if i % 2 else long + " DPR 2004.04906", ["2004.04906"], "o") for i in range(1, 10)]
    m = spark.createDataFrame([*messages, ("b", 1, "user", "only one", None, "o")], MESSAGES)
    e = spark.createDataFrame([("a", 0, "dpr", "Dense Passage Retrieval", 1)], ENTITIES)
    discussed = dialogue.papers_discussed(m)
    out = {r.conv_id: r.context for r in dialogue.assembled_context(m, e, discussed).collect()}
    assert out["b"] == "user: only one"
    assert out["a"].startswith("[Previous context summary]\nTopics discussed: Dense Passage Retrieval\nPapers referenced: 2004.04906\nKey exchanges:\n  - Q: Question 1\n  - A: An answer")
    assert out["a"].count("user: ") == 3 and out["a"].endswith("user: Question 9\n")
    assert [(r.place, r.arxiv_id) for r in discussed.collect()] == [(1, "2004.04906")]


def test_acronyms_get_their_meaning(spark):
    q = spark.createDataFrame([("a", "How do DPR and RAG and XYZ compare", 1), ("b", None, 1), ("c", "none", 1)], "conv_id string, query string, ord int")
    r = spark.createDataFrame(
        [("a", 1, "first dpr (Dense Things) here"), ("a", 2, "[DPR (Deep Retrieval)]. Cross Yard Zone (XYZ)"), ("a", 6, "RAG (too far down)"), ("a", 3, None)],
        "conv_id string, rank int, text string",
    )
    got = {(x.short, x.full) for x in dialogue.extracted_entities(q, r).collect()}
    assert ("DPR", "Deep Retrieval") in got and ("dpr", "Dense Things") in got
    assert ("RAG", "Retrieval-Augmented Generation") in got
    assert any(s == "XYZ" and f.endswith("Cross Yard Zone") for s, f in got)


def test_meanings_are_sought_in_long_texts(spark):
    long = "word " * 80_000
    q = spark.createDataFrame([("a", "What is ABC?"), ("b", "What is XYZ?")], "conv_id string, query string")
    r = spark.createDataFrame(
        [("a", 1, long + "ABC ( is never said"), ("b", 1, "(first) " + long + "(Some) Extra Yard [XYZ] or (else"), ("b", 2, long + "XYZ [")],
        "conv_id string, rank int, text string",
    )
    start = time.time()
    got = {(x.conv_id, x.short, x.full) for x in dialogue.extracted_entities(q, r).collect()}
    assert got == {("b", "XYZ", "Some) Extra Yard")} and time.time() - start < 20


def test_a_query_gets_what_it_lacks(spark):
    row = spark.createDataFrame([("about rag", ["RAG", "DPR", "a", "b", "c"])], "q string, e array<string>")
    assert row.select(dialogue.with_entity_terms(F.col("q"), F.col("e")).alias("x")).first().x == "about rag DPR c"


def test_sessions_are_created_saved_and_read_back(spark):
    from lexigraph.sources import sessions

    new = sessions.created(spark, 3, "t0").collect()
    assert len({r.conversation_id for r in new}) == 3 and new[0].data == "{}"
    m = spark.createDataFrame([("a", 1, "user", "What", None), ("a", 2, "assistant", "That", ["1"])], "conv_id string, turn bigint, role string, content string, arxiv_ids array<string>")
    more = spark.createDataFrame([("a", 5, "user", "Why", None), ("b", 1, "user", "New", None), ("a", 4, "user", "How", None)], "conv_id string, at int, role string, content string, arxiv_ids array<string>")
    every = sessions.appended(m, more)
    assert [(r.turn, r.content) for r in every.where("conv_id = 'a'").orderBy("turn").collect()] == [(1, "What"), (2, "That"), (3, "How"), (4, "Why")]
    e = spark.createDataFrame([("a", 0, "X", "Ex"), ("a", 1, "X", "Later")], "conv_id string, ord int, short string, full string")
    store = sessions.saved(dialogue.last_messages(every), dialogue.papers_discussed(every, 5), e, "t1")
    got = {r.conversation_id: r for r in sessions.parsed(store.unionByName(sessions.created(spark, 1, "t").withColumn("data", F.lit("no json")))).collect()}
    assert got["a"].papers == ["1"] and got["a"].entities == {"X": "Later"} and len(got["a"].messages) == 4
    assert got["b"].papers is None and len(got) == 3


def test_latency_adds_up():
    from lexigraph.plans.latency import Latency

    tracker = Latency()
    for name in ("search", "answer", "search"):
        with tracker.stage(name):
            pass
    found = tracker.metrics()
    assert set(found) == {"search", "answer", "total"} and found["total"] == found["search"] + found["answer"]
