"""Running totals over partitions that one task cannot hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str
) -> DataFrame:
    """df with out, the running sum of value within keys in the order (bucket, *order).

    bucket must rise with the order. Sums per (keys, bucket) are pre-aggregated
    and accumulated over the buckets; the window over rows then stays inside
    one bucket, so a key that holds most rows is spread over its buckets. A row
    counts in its own total. order must tell rows apart for a repeatable result.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *keys, bucket, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start")
    )
    within = (
        Window.partitionBy(*keys, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = df.withColumn("_in", F.sum(value).over(within))
    return (
        inside.join(starts, [*keys, bucket])
        .withColumn(out, F.col("_start") + F.col("_in"))
        .drop("_start", "_in")
    )
