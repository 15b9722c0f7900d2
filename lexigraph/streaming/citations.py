"""Citation batches as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators.hot_keys import without_version


def citation_stream(spark: SparkSession, folder: str, schema: str, files: int = 8) -> DataFrame:
    """A stream of the citation files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def counted_by_window(stream: DataFrame, window: str = "30 days", late: str = "365 days") -> DataFrame:
    """(window_start, dst, citations): references parsed per cited paper and time window.

    Batches come twice or months late: a pair of batch and cited paper counts
    once within the watermark, later rows are dropped.
    """
    events = stream.select(
        F.col("parsed_at").cast("timestamp").alias("ts"),
        F.col("arxiv_id").alias("src"),
        F.explode("cited_arxiv_ids").alias("cited"),
    ).select("ts", "src", without_version(F.trim("cited")).alias("dst"))
    return (
        events.where("ts is not null and src is not null and dst <> '' and src <> dst")
        .withWatermark("ts", late)
        .dropDuplicates(["ts", "src", "dst"])
        .groupBy(F.window("ts", window), "dst")
        .agg(F.count(F.lit(1)).alias("citations"))
        .select(F.col("window.start").alias("window_start"), "dst", "citations")
    )
