import random

import pytest

from lexigraph.operators import dense, graph, graph_retrieval


def tables(spark, edges, nodes):
    return (
        spark.createDataFrame([(n,) for n in nodes], "id string"),
        spark.createDataFrame(edges, "src string, dst string"),
    )


def test_pagerank_keeps_its_mass_with_dangling_nodes(spark):
    nodes, edges = tables(spark, [("a", "b"), ("b", "c"), ("a", "c")], "abcd")
    ranks = {r.id: r.pagerank for r in graph.pagerank(nodes, edges, 1e-9).collect()}
    pieces = {r.id: r.pagerank for r in graph.pagerank(nodes, edges, 1e-9, piece=1).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and pieces == pytest.approx(ranks)
    with pytest.raises(RuntimeError, match="settled"):
        graph.pagerank(nodes, edges, 1e-12, most=2)
    assert ranks["c"] > ranks["b"] > ranks["a"]


def test_pagerank_of_nothing(spark):
    nodes, edges = tables(spark, [], [])
    assert graph.pagerank(nodes, edges).count() == 0


def test_components_of_a_long_path(spark):
    names = [f"n{i:02d}" for i in range(40)]
    nodes, edges = tables(spark, list(zip(names, names[1:], strict=False)) + [("x", "y"), ("z", "z")], [*names, "x", "y", "z"])
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert {got[n] for n in names} == {"n00"} and got["y"] == "x" and got["z"] == "z"


def test_distances_and_proximity(spark):
    nodes, edges = tables(spark, [("1", "2"), ("1", "3"), ("2", "3"), ("4", "1"), ("5", "4")], "12345")
    seeds = spark.createDataFrame([("q", "1")], "qid string, id string")
    d = graph.distances(seeds, edges, 2)
    assert {r.id: r.distance for r in d.collect()} == {"1": 0, "2": 1, "3": 1, "4": 1, "5": 2}
    near = {r.id: r.proximity for r in graph_retrieval.proximity(d).collect()}
    assert near == {"2": 0.5, "3": 0.5, "4": 0.5, "5": pytest.approx(1 / 3)}


def test_expansion_scores(spark):
    _, edges = tables(spark, [("1", "2"), ("1", "3"), ("2", "3"), ("4", "1")], "1234")
    seeds = spark.createDataFrame([("q", "1")], "qid string, id string")
    got = {r.id: r.score for r in graph_retrieval.expansion(seeds, edges).collect()}
    assert got == {"2": 0.8, "3": 0.8, "4": 0.7}


def test_communities_are_stable(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]
    nodes, e = tables(spark, edges, "abcxyz")
    got = {r.id: r.community for r in graph.communities(nodes, e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}


def test_peers_never_hold_the_seed(spark):
    seeds = spark.createDataFrame([("q", "a"), ("q", "b")], "qid string, id string")
    member = spark.createDataFrame([(x, "m") for x in "abcd"], "id string, community string")
    ranks = spark.createDataFrame([("a", 0.4), ("b", 0.3), ("c", 0.2), ("d", 0.1)], "id string, pagerank double")
    got = graph_retrieval.community_peers(seeds, member, ranks, 1).collect()
    assert [(r.id, r.score) for r in got] == [("c", 1.0)]


def test_pair_distances_are_those_of_the_search(spark):
    rng = random.Random(8)
    links = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(38)] + [(f"n{i:02d}", "hub") for i in range(12)]
    _, edges = tables(spark, [*links, ("lone1", "lone2")], "a")
    seeds = spark.createDataFrame([("q", "n01"), ("q", "n30"), ("r", "hub"), ("s", "lone1"), ("t", "nowhere")], "qid string, id string")
    every = {(r.qid, r.id): r.distance for r in graph.distances(seeds, edges).collect()}
    ids = {x for pair in links for x in pair} | {"lone1", "lone2", "nowhere"}
    pairs = spark.createDataFrame([(q, i) for q in "qrst" for i in ids], "qid string, id string")
    got = {(r.qid, r.id): r.distance for r in graph.pair_distances(pairs, seeds, edges).collect()}
    assert got == every and max(got.values()) >= 3


def test_walks_prefer_papers_like_the_query(spark):
    edges = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("d", "b"), ("e", "a")]
    like = {("q", "b"): 0.9, ("q", "c"): -0.5, ("q", "d"): 0.2}
    out: dict = {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
        out.setdefault(d, []).append(s)
    mass, visits = {"a": 0.5, "e": 0.5}, {}
    for step in range(5):
        after: dict = {}
        for node, m in mass.items():
            w = [max(like[("q", n)], 0.01) if ("q", n) in like else 0.1 for n in out[node]]
            for n, x in zip(out[node], w, strict=True):
                after[n] = after.get(n, 0) + m * x / sum(w)
        mass = after
        for n, m in mass.items():
            visits[n] = visits.get(n, 0) + m / (step + 1)
    visits = {n: v for n, v in visits.items() if n not in "ae"}
    expected = {n: v / max(visits.values()) for n, v in visits.items()}
    _, e = tables(spark, edges, "a")
    seeds = spark.createDataFrame([("q", "a"), ("q", "e"), ("u", "a")], "qid string, id string")
    likeness = spark.createDataFrame([(*k, v) for k, v in like.items()], "qid string, id string, cosine double")
    got = graph_retrieval.expected_walk(seeds, e, likeness).collect()
    assert {r.id: r.score for r in got if r.qid == "q"} == pytest.approx(expected, abs=1e-8)
    uniform = graph_retrieval.expected_walk(seeds, e).collect()
    assert {(r.id, r.score) for r in got if r.qid == "u"} == {(r.id, r.score) for r in uniform if r.qid == "u"}


def test_walks_work_out_cosines_in_their_blocks(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(70)]
    _, e = tables(spark, [x for x in edges if x[0] != x[1]], "a")
    rows = [(f"n{i:02d}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(0, 33) if i % 7]  # three have no links
    papers = dense.unit_vectors(spark.createDataFrame(rows, "id string, embedding array<double>"), "id", dim=4)
    asked = [(f"q{i:02d}", [rng.gauss(0, 1) for _ in range(4)] if i % 5 else None) for i in range(40)]
    queries = dense.unit_vectors(spark.createDataFrame(asked, "qid string, embedding array<double>"), "qid", dim=4)
    queries = queries.unionByName(spark.createDataFrame([(q, v) for q, v in asked if v is None], "qid string, vec array<double>"))
    seeds = spark.createDataFrame([(q, f"n{rng.randrange(30):02d}") for q, _ in asked[:-1] for _ in range(2)], "qid string, id string")
    likeness = dense.similarities(queries.where("vec is not null"), papers, "id")
    expected = {(r.qid, r.id): (r.rank, r.score) for r in graph_retrieval.expected_walk(seeds, e, likeness, 9).collect()}
    written = []
    monkeypatch.setattr(graph_retrieval, "cut", lambda df, cut=graph_retrieval.cut: written.append(cut(df)) or written[-1])
    got = graph_retrieval.expected_walk(seeds, e, k=9, vectors=(queries, papers)).collect()
    assert {(r.qid, r.id): (r.rank, pytest.approx(r.score, abs=1e-8)) for r in got} == expected and len({q for q, _ in expected}) == 39
    # a row a seed and a query with a vector, none a query and a paper
    assert max(df.count() for df in written if "qid" in df.columns) <= 2 * len(asked) + 40


def test_papers_are_looked_up_with_or_without_version(spark):
    papers = spark.createDataFrame([("1", "One"), ("2v3", "Two"), ("2", None)], "id string, title string")
    none = spark.createDataFrame([], "id string, in_degree bigint, pagerank double, community string")
    asked = spark.createDataFrame([("1v2",), ("2v3",), ("2v9",), ("9",), (None,)], "asked string")
    got = {(r.asked, r.id, r.citations) for r in graph_retrieval.looked_up(asked, papers, none, none, none.select("id", "community")).collect()}
    assert got == {("1v2", "1", 0), ("2v3", "2v3", 0), ("2v9", "2", 0)}
    _, edges = tables(spark, [("1", "2"), ("3", "1")], "1")
    member = spark.createDataFrame([("1", "m"), ("2", "m"), ("3", "m")], "id string, community string")
    view = graph_retrieval.citation_view(asked.selectExpr("'1' as id"), edges, member, none, papers, 1).collect()
    assert {(r.side, r.neighbour, r.title) for r in view} == {("cites", "2", "Unknown"), ("cited_by", "3", "Unknown"), ("community", "2", "Unknown")}


def test_a_long_path_is_walked_without_a_table_a_step(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(90)], "src string, dst string")
    seeds = spark.createDataFrame([("q", "n000"), ("r", "n090"), ("r", "alone")], "qid string, id string")
    written = []
    for module in (graph, graph_retrieval):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: written.append(1) or cut(df))
    got = {(r.qid, r.id): r.distance for r in graph.distances(seeds, edges).collect()}
    assert len(got) == 183 and got["q", "n090"] == 90 and got["r", "n000"] == 90 and got["r", "alone"] == 0
    assert len(written) <= 4
    pairs = spark.createDataFrame([("q", "n070"), ("r", "alone"), ("q", "none")], "qid string, id string")
    near = {(r.qid, r.id): r.distance for r in graph.pair_distances(pairs, seeds, edges).collect()}
    assert near == {("q", "n070"): 70, ("r", "alone"): 0}
    written.clear()
    walked = {(r.qid, r.id) for r in graph_retrieval.expected_walk(seeds, edges).collect()}
    assert walked == {("q", f"n{i:03d}") for i in range(1, 6)} | {("r", f"n{90 - i:03d}") for i in range(1, 6)}
    assert len(written) <= 4
