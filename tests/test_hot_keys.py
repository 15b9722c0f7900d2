from pyspark.sql import functions as F

from lexigraph.operators import hot_keys

SCHEMA = "arxiv_id string, cited_arxiv_ids array<string>, extra int, side string"


def pairs(spark, data):
    return hot_keys.citation_pairs(spark.createDataFrame([(*r, 1, "x") for r in data], SCHEMA))


def test_pairs_are_distinct_and_clean(spark):
    data = [
        ("a", ["b", "bv2", None, "a", "av3", "", "c"]),
        ("a", ["b", "c"]),
        (None, ["b"]),
        ("d", None),
        ("e", []),
    ]
    found = {tuple(r) for r in pairs(spark, data).collect()}
    assert found == {("a", "b"), ("a", "c")}


def test_heavy_hitters_by_brute_force(spark):
    data = [(f"p{i % 7}", [f"q{i % 5}", f"q{i}"]) for i in range(200)]
    p = pairs(spark, data)
    raw = [tuple(r) for r in p.collect()]
    expected = set()
    for side, at in (("citing", 0), ("cited", 1)):
        for key in {r[at] for r in raw}:
            if sum(r[at] == key for r in raw) >= 0.1 * len(raw):
                expected.add((side, key))
    got = hot_keys.heavy_hitters(p, {"citing": "src", "cited": "dst"}, 0.1)
    assert {(r.side, r.arxiv_id) for r in got.collect()} == expected


def test_heavy_hitters_of_nothing(spark):
    got = hot_keys.heavy_hitters(pairs(spark, []), {"citing": "src", "cited": "dst"}, 0.03)
    assert got.count() == 0


def test_lists_come_in_bounded_pieces(spark):
    data = [("hot", [f"x{i:04d}" for i in range(3000)]), ("cold", ["b", "a"])]
    lists = hot_keys.lists_per_key(pairs(spark, data), "src", "dst", piece=500)
    sizes = lists.groupBy("src").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max("n").alias("m"))
    got = {r.src: (r.n, r.k, r.m) for r in sizes.collect()}
    assert got["cold"][:2] == (2, 1)
    assert got["hot"][:2] == (3000, 6) and got["hot"][2] < 700
    assert lists.where("src = 'cold'").first()["values"] == ["a", "b"]


def test_counts_keep_the_null_key(spark):
    df = spark.createDataFrame([(None,), ("a",), ("a",)], "k string")
    assert {tuple(r) for r in hot_keys.count_per_key(df, "k").collect()} == {(None, 1), ("a", 2)}
