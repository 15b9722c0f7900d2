"""Queries and comparison SQL of this folder's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigraph.llm import linkage, lookalike, mixing, nearest, packing, quality, scans, tokens
from lexigraph.session import settled
from lexigraph.sources.tables import read_table


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_units(
        read_table(spark, sf_dir, "chunks", "chunk_id", "text"),
        read_table(spark, sf_dir, "extracted", "arxiv_id", "sections"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(_units(spark, sf_dir))


def p1_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_units(spark, sf_dir))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(
        spark, sf_dir, "extracted", "arxiv_id", "full_text", "references_text", "sections"
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repairs(_extracted(spark, sf_dir))[0].drop("stored").distinct()


def p2_reflowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.reflowed(_extracted(spark, sf_dir))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read_table(
        spark, sf_dir, "parsed_refs", "ref_id", "raw_text", "arxiv_id", "doi", "title", "authors", "year"
    )
    papers = read_table(spark, sf_dir, "papers", "arxiv_id", "title", "authors", "published", "updated")
    return linkage.linked(refs, papers, read_table(spark, sf_dir, "reading_list"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).where("confidence >= 0.5").select("ref_id", "arxiv_id")


def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("ref_id", "arxiv_id", "confidence")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "vector_index", "chunk_id", "embedding")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.mutual_pairs(_vectors(spark, sf_dir), 0.9).drop("cosine")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_chunks(_vectors(spark, sf_dir))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.sized_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    budgets = read_table(spark, sf_dir, "token_budgets")
    return packing.packed(sized, budgets), budgets


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_report(*_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    targets = read_table(spark, sf_dir, "mix_targets")
    return mixing.mixed(tokens.sized_documents(documents, "source"), targets), targets


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(*_mixed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_reading_pairs(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def p8_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.normalized_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))


_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_scored": p1_scored,
    "p2_found": p2_found,
    "p2_reflowed": p2_reflowed,
    "p3_found": p3_found,
    "p3_confidence": p3_confidence,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p6_packed": p6_packed,
    "p6_containers": p6_containers,
    "p7_mixed": p7_mixed,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_normalized": p8_normalized,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: (lambda spark, sf_dir, f=f: f(settled(spark), sf_dir)) for name, f in _ALL.items()
}

ORACLES: dict[str, str] = {
    "p5_found": """
    WITH one AS (
      SELECT chunk_id, list_transform(any_value(embedding), lambda x: x::double) AS e FROM vector_index
      WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL)) = 64
      GROUP BY chunk_id),
    v AS (SELECT chunk_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM one WHERE list_dot_product(e, e) > 0),
    n AS (
      SELECT a, b, c FROM (
        SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS r FROM (
          SELECT x.chunk_id AS a, y.chunk_id AS b, list_dot_product(x.v, y.v) AS c FROM v x, v y WHERE x.chunk_id <> y.chunk_id))
      WHERE r <= 5 AND c >= 0.9)
    SELECT n.a AS chunk_id_a, n.b AS chunk_id_b FROM n JOIN n m ON m.a = n.b AND m.b = n.a WHERE n.a < n.b""",
}
