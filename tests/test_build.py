import os
import threading

from conftest import SF_DIR

import pytest
from pyspark.sql import functions as F

from lexigraph import session
from lexigraph.plans.build import add_vectors, build_index, search_index
from lexigraph.plans.engine import Engine
from lexigraph.sources.metadata import read_metadata, write_metadata
from lexigraph.sources.tables import read_table


def test_the_index_is_built_and_grows(spark, tmp_path):
    paths = build_index(spark, SF_DIR, str(tmp_path))
    counts = {name: spark.read.parquet(path).count() for name, path in paths.items()}
    assert min(counts.values()) > 0
    nodes = spark.read.parquet(paths["nodes"])
    assert abs(nodes.agg({"pagerank": "sum"}).first()[0] - 1) < 1e-6
    new = spark.createDataFrame([("new", [1.0] * 64), ("new", [1.0] * 64), ("bad", None)], "chunk_id string, embedding array<float>")
    add_vectors(spark, str(tmp_path), new)
    assert spark.read.parquet(paths["vectors"]).count() == counts["vectors"] + 1


def test_metadata_round_trip(spark, tmp_path):
    papers = read_table(spark, SF_DIR, "papers")
    write_metadata(papers, str(tmp_path / "m"))
    again = read_metadata(spark, str(tmp_path / "m"))
    assert again.count() == papers.count() and "reference_ids" not in again.columns


def test_a_single_search_is_a_table_of_one_row(spark):
    engine = Engine(spark, search_index(spark, SF_DIR))
    one = engine.paper_queries().where("vec is not null").orderBy("qid").limit(1)
    found = engine.search(one, "hybrid_graph", 5)
    assert [r["rank"] for r in found.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="method"):
        engine.search(one, "other")


def test_queries_without_vector_seeds_and_exclusions(spark):
    engine = Engine(spark, search_index(spark, SF_DIR))
    one = engine.paper_queries().orderBy("qid").limit(1)
    bare = one.withColumn("vec", F.lit(None).cast("array<double>"))
    assert engine.search(bare, "dense").count() == 0
    sparse = {r.key for r in engine.search(bare, "sparse").collect()}
    plain = engine.search(bare, "hybrid_graph").collect()
    assert sparse and {r.key for r in plain} == sparse
    seed = engine.edges.select(F.col("src").alias("id")).orderBy("id").limit(1)
    seeds = one.select("qid").join(seed)
    found = engine.search(bare, "hybrid_graph", 200, seeds=seeds)
    assert {r.key for r in found.collect()} > sparse
    gone = found.where("arxiv_id is not null").orderBy("rank").limit(1).select("qid", "arxiv_id")
    left = engine.search(bare, "hybrid", 200, excluded=gone).collect()
    assert gone.first().arxiv_id not in {r.arxiv_id for r in left} and left


def test_searches_without_the_graph_build_but_the_texts(spark, tmp_path):
    os.symlink(SF_DIR, tmp_path / "tables")
    path = search_index(spark, str(tmp_path / "tables"), with_graph=False)
    assert not os.path.exists(f"{path.removeprefix('file:')}/nodes")
    engine = Engine(spark, path)
    found = engine.search(engine.paper_queries(), "hybrid", 3)
    assert found.groupBy("qid").count().count() == engine.paper_queries().count() > 0


def test_independent_jobs_run_at_once():
    both = threading.Barrier(2, timeout=20)
    assert session.together(lambda: both.wait() >= 0, lambda: both.wait() >= 0) == [True, True]
    with pytest.raises(ZeroDivisionError):
        session.together(lambda: 1 / 0, lambda: 2)
