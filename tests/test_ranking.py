import random

import pytest
from pyspark.sql import functions as F

from lexigraph.operators import answers, dense, dialogue, evaluation, fusion, lexical
from lexigraph.operators.running import running_total
from lexigraph.sources import sessions


def test_fusion_by_hand(spark):
    lists = spark.createDataFrame(
        [("q", "dense", 1, "c1", "p1"), ("q", "dense", 2, "c2", "p2"), ("q", "sparse", 1, "c2", "p2"), ("q", "sparse", 2, "c3", "p9"), ("q", "graph", 1, "p9", "p9")],
        "qid string, source string, rank int, key string, arxiv_id string",
    )
    got = {r.key: (r.rank, round(r.score, 7)) for r in fusion.fused(lists).collect()}
    assert got == {"c2": (1, 0.0129825), "c1": (2, 0.0081967), "c3": (3, 0.0048387), "p9": (4, 0.0032787)}


def test_recency(spark):
    df = spark.createDataFrame([("2024-01-01",), ("",), (None,), ("n.d.",)], "d string")
    got = [r.x for r in df.select(fusion.recent(F.lit(0.5), F.col("d"), 2026).alias("x")).collect()]
    assert got == [pytest.approx(0.52), 0.5, 0.5, 0.5]


def test_metrics_by_hand(spark):
    results = spark.createDataFrame(
        [("m", "q", i + 1, x) for i, x in enumerate("abac")] + [("m", "r", 1, "x")],
        "method string, qid string, rank int, item string",
    )
    relevant = spark.createDataFrame([("q", "a"), ("q", "d"), ("s", "x")], "qid string, item string")
    rows = evaluation.ranking_metrics(results, relevant).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.p_at_1, r.p_at_5, r.r_at_5, r.mrr) == (1, 0.4, 1.0, 1)
    assert r.ndcg_10 == pytest.approx(0.9197208, abs=1e-6)
    assert r.average_precision == pytest.approx(0.8333333, abs=1e-6)


def test_answer_measures(spark):
    df = spark.createDataFrame([("What about retrieval models", "Retrieval models work well here. Yes.", ["retrieval", "other"])], "q string, a string, t array<string>")
    r = df.select(
        evaluation.faithfulness(F.col("a"), F.lit("retrieval models")).alias("f"),
        evaluation.answer_relevance(F.col("q"), F.col("a")).alias("r"),
        evaluation.context_precision(F.col("q"), F.col("t")).alias("c"),
    ).first()
    assert (r.f, r.r, r.c) == (1.0, 0.5, 0.5)
    assert "| m |" in evaluation.report(spark.createDataFrame([("m", 1)], "method string, queries int"))


def test_context_budget(spark):
    df = spark.createDataFrame([("q", 1, "a" * 5000), ("q", 2, "b" * 4000), ("q", 3, "c")], "qid string, rank int, entry string")
    got = [(r.rank, len(r.entry)) for r in answers.context(df).orderBy("rank").collect()]
    assert got == [(1, 5000), (2, 3003)]


def index(docs):
    posts = lexical.postings(docs, "id", F.col("text"))
    size = lexical.corpus_size(docs, posts)
    parts = lexical.impacts(posts, size, "id")
    return parts, lexical.bounds(parts, size)


def test_pruned_ranking_is_that_of_all_documents(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 60:02d}" for _ in range(4000)]
    texts = [(i, " ".join(words[i * 12 : i * 12 + rng.randrange(0, 13)])) for i in range(300)]
    docs = spark.createDataFrame([*texts, (900, None), (901, ""), (902, texts[7][1])], "id int, text string")
    queries = spark.createDataFrame([(q, " ".join(rng.choices(words, k=1 + q % 5))) for q in range(30)], "qid int, query string")
    pruned = lexical.ranked(queries, *index(docs), "id", 7).orderBy("qid", "rank").collect()
    monkeypatch.setattr(lexical, "COMMON", 2.0)
    whole = lexical.ranked(queries, *index(docs), "id", 7).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id, r["rank"]) for r in pruned] == [(r.qid, r.id, r["rank"]) for r in whole] and len(whole) > 100


def test_bm25_of_many_blocks_is_that_of_every_pair(spark):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7)) % 60:02d}" for _ in range(4000)]
    texts = [(i, " ".join(words[i * 12 : i * 12 + rng.randrange(0, 13)])) for i in range(300)]
    docs = spark.createDataFrame([*texts, (None, "w01 w02"), (901, ""), (902, texts[7][1])], "id int, text string")
    queries = spark.createDataFrame([(q, " ".join(rng.choices(words, k=1 + q % 5))) for q in range(30)], "qid int, query string")
    parts, limits = index(docs)
    part = {(r.term, r.id): r.part for r in parts.collect()}
    excluded = {(q, d) for q in range(30) for d in range(q, 300, 5)}
    out = spark.createDataFrame(sorted(excluded), "qid int, id int")
    for banned, table in ((set(), None), (excluded, out)):
        expected = []
        for q in queries.collect():
            scores = {}
            for term in q.query.split():
                for (t, d), x in part.items():
                    if t == term and (q.qid, d) not in banned:
                        scores[d] = scores.get(d, 0) + x
            order = sorted((-round(x, 9), -1 if d is None else d) for d, x in scores.items() if round(x, 9) > 0)[:7]
            expected += [(q.qid, d, i + 1) for i, (_, d) in enumerate(order)]
        found = lexical.ranked(queries, parts, limits, "id", 7, table, rows_a_block=200).orderBy("qid", "rank").collect()
        assert [(r.qid, -1 if r.id is None else r.id, r["rank"]) for r in found] == expected and len(expected) > 100


def test_bm25_of_an_empty_corpus_and_query(spark):
    docs = spark.createDataFrame([], "id int, text string")
    queries = spark.createDataFrame([(1, "word"), (2, ""), (3, None)], "qid int, query string")
    assert lexical.ranked(queries, *index(docs), "id", 5).count() == 0


def test_exclusion_comes_before_the_cut(spark):
    docs = spark.createDataFrame([(1, "xx yy"), (2, "xx"), (3, "zz"), (4, "ww"), (5, None)], "id int, text string")
    queries = spark.createDataFrame([(1, "xx")], "qid int, query string")
    args = *index(docs), "id", 1
    first = lexical.ranked(queries, *args).first()
    assert first.id == 2 and first.normalized == 1
    out = spark.createDataFrame([(1, 2)], "qid int, id int")
    assert lexical.ranked(queries, *args, out).first().id == 1


def test_dense_blocks_give_the_same(spark):
    rows = [(i, [float((i * 7 + j * j) % 11 - 5) for j in range(64)]) for i in range(60)] + [(99, None), (98, [0.0] * 64), (97, [1.0])]
    data = dense.unit_vectors(spark.createDataFrame(rows, "id int, embedding array<float>"), "id")
    assert data.count() == 60
    queries = data.where("id < 9").select(F.col("id").alias("qid"), "vec")
    whole = dense.nearest(queries, data, "id", 4, same=True).orderBy("qid", "rank").collect()
    parts = dense.nearest(queries, data, "id", 4, rows_a_block=7, same=True).orderBy("qid", "rank").collect()
    assert whole == parts and len(whole) == 36 and all(r.qid != r.id for r in whole)


def test_running_total_is_the_plain_one(spark):
    rows = [("k", i // 10, i, i % 4) for i in range(100)] + [("l", 0, 1, 5)]
    df = spark.createDataFrame(rows, "k string, b int, o int, v int")
    got = running_total(df, ["k"], "b", ["o"], "v", "t").where("k = 'k'").orderBy("o").collect()
    total, expected = 0, []
    for i in range(100):
        total += i % 4
        expected.append(total)
    assert [r.t for r in got] == expected


def test_dialogue(spark):
    df = spark.createDataFrame([("Compare A vs B",), ("What papers build on X?",), ("What is X?",), ("How does it work",)], "q string")
    got = [r.k for r in df.select(dialogue.query_kind(F.col("q")).alias("k")).collect()]
    assert got == ["comparative", "general", "factual", "factual"]
    r = df.where("q like 'How%'").select(
        dialogue.rewritten(F.col("q"), F.lit("RAG")).alias("a"), dialogue.rewritten(F.col("q"), F.lit(None).cast("string")).alias("b")
    ).first()
    assert (r.a, r.b) == ("How does RAG work", "How does it work")


def test_sessions(spark):
    store = spark.createDataFrame([("a", "1", "t0", "t1"), ("a", "2", "t0", "t2"), ("b", "3", "t0", "t0")], sessions.SCHEMA)
    change = spark.createDataFrame([("b", "4", "t0", "t9")], sessions.SCHEMA)
    got = {r.conversation_id: r.data for r in sessions.upserted(store, change).collect()}
    assert got == {"a": "2", "b": "4"}
    assert sessions.found(store, "a").first().data == "2" and sessions.found(store, "zz").count() == 0
    assert sessions.listed(store, 1).first().conversation_id == "a"
