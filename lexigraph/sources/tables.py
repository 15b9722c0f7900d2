"""Reading and writing the engine's tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table; naming columns keeps the read schema narrow."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, warehouse: str, name: str, mode: str = "overwrite") -> None:
    """Persist one table of the warehouse."""
    df.write.mode(mode).parquet(f"{warehouse}/{name}")
