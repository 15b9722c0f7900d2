"""Paper metadata as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "arxiv_id string, title string, authors array<string>, abstract string, published string,"
    " updated string, categories array<string>, primary_category string, pdf_url string,"
    " comment string, journal_ref string, doi string, pdf_path string"
)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Papers from JSON lines; unknown fields are dropped, missing ones are null."""
    return spark.read.schema(SCHEMA).json(path)


def write_metadata(papers: DataFrame, path: str) -> None:
    """Papers as JSON lines."""
    papers.write.mode("overwrite").json(path)
