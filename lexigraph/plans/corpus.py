"""The engine's standard inputs, derived from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators import graph, hot_keys
from lexigraph.session import cut
from lexigraph.sources.tables import read_table


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, published) of every paper once, as harvested last; then the reading list's."""
    columns = ["arxiv_id", "title", "published"]
    rows = read_table(spark, sf_dir, "papers", *columns, "updated").withColumn("own", F.lit(1))
    more = read_table(spark, sf_dir, "reading_list", *columns).withColumns(
        {"updated": F.lit(""), "own": F.lit(0)}
    )
    newest = F.max_by(F.struct("title", "published"), F.struct("own", "updated", "title", "published"))
    return (
        rows.unionByName(more)
        .where("arxiv_id is not null")
        .groupBy(F.col("arxiv_id").alias("id"))
        .agg(newest.alias("r"))
        .select("id", F.trim("r.title").alias("title"), F.col("r.published").alias("published"))
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arxiv_id, title, authors, published) of every paper once, as harvested last."""
    columns = ["arxiv_id", "title", "authors", "published"]
    rows = read_table(spark, sf_dir, "papers", *columns, "updated").where("arxiv_id is not null")
    newest = F.max_by(F.struct("title", "authors", "published"), F.struct("updated", "title", "published"))
    return rows.groupBy("arxiv_id").agg(newest.alias("r")).select("arxiv_id", "r.*")


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the citation graph, edges written once as every operator reads them often."""
    known = (
        read_table(spark, sf_dir, "papers", "arxiv_id")
        .unionByName(read_table(spark, sf_dir, "reading_list", "arxiv_id"))
        .where("arxiv_id is not null")
        .select(F.col("arxiv_id").alias("id"))
        .distinct()
    )
    rows = read_table(spark, sf_dir, "citations", "arxiv_id", "cited_arxiv_ids")
    edges = cut(graph.known_edges(hot_keys.citation_pairs(rows), known))
    return cut(graph.all_nodes(known, edges)), edges


def seeds(nodes: DataFrame) -> DataFrame:
    """(qid, id): the stated query set, one paper in sixteen, those whose id's MD5 begins with 0.

    arXiv ids of a month end alike, so their numbers can't be taken modulo.
    """
    return nodes.where(F.md5("id").startswith("0")).select(F.col("id").alias("qid"), "id")
