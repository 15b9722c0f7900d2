"""Exact nearest vectors for a set of queries, block against block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unit_vectors(df: DataFrame, key: str, vector: str = "embedding", dim: int = 64) -> DataFrame:
    """(key, vec): rows with a full, finite, non-zero vector, at length 1 in double precision."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return (
        df.where(F.col(key).isNotNull() & (F.size(vector) == dim))
        .where(~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
        .select(key, v.alias("vec"), norm.alias("norm"))
        .where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
        .select(key, F.transform("vec", lambda x: x / F.col("norm")).alias("vec"))
    )


def first_of_each(chunks: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row per key in the given order: what an index keeps of repeated ids."""
    w = Window.partitionBy(key).orderBy(*order)
    return chunks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with their keys. Nothing is deleted."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix, without a Python object per number."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _found(
    queries: DataFrame, data: DataFrame, key: str, k: int, rows_a_block: int = 20_000, same: bool = False
) -> DataFrame:
    """(qid, key, score): the k best of each pair of a query and a block of data."""
    d_blocks = max(1, -(-data.count() // rows_a_block))
    q_blocks = max(1, -(-queries.count() // rows_a_block))
    key_type = data.schema[key].dataType.simpleString()

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # fresh columns, as queries are often a part of data
    queries = queries.select(F.col("qid").alias("qid"), F.col("vec").alias("vec"))
    data = data.select(F.col(key).alias(key), F.col("vec").alias("vec"))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).cast("int")).withColumn(
        "db", every(d_blocks)
    )
    d = data.withColumn("db", F.pmod(F.xxhash64(key), F.lit(d_blocks)).cast("int")).withColumn(
        "qb", every(q_blocks)
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        # rows in order of their keys, so that a stable sort by score breaks ties
        right = right.sort_by(key)
        a, b = matrix(left["vec"]), matrix(right["vec"])
        rows, columns, scores = [], [], []
        for start in range(0, len(a) if len(b) else 0, 512):
            tile = np.round(a[start : start + 512] @ b.T, 9)
            if same:
                own = pc.index_in(left["qid"].slice(start, 512).cast(right[key].type), right[key])
                own = own.to_numpy(zero_copy_only=False)
                there = np.nonzero(~np.isnan(own.astype(float)))[0]
                tile[there, own[there].astype(np.int64)] = -9
            most = min(k, tile.shape[1])
            cut = np.partition(tile, -most, axis=1)[:, -most]
            row, column = np.nonzero((tile >= cut[:, None]) & (tile > -9))
            order = np.lexsort((column, -tile[row, column], row))
            row, column = row[order], column[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, column = row[place < k], column[place < k]
            rows.append(row + start)
            columns.append(column)
            scores.append(tile[row, column])
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        columns = np.concatenate(columns) if columns else np.empty(0, np.int64)
        scores = np.concatenate(scores) if scores else np.empty(0)
        return pa.table(
            {"qid": left["qid"].take(pa.array(rows)), key: right[key].take(pa.array(columns)), "score": pa.array(scores, pa.float64())}
        )

    qid_type = queries.schema["qid"].dataType.simpleString()
    return (
        q.groupBy("qb", "db")
        .cogroup(d.groupBy("qb", "db"))
        .applyInArrow(search, f"qid {qid_type}, {key} {key_type}, score double")
    )

def nearest(
    queries: DataFrame, data: DataFrame, key: str, k: int, rows_a_block: int = 20_000, same: bool = False
) -> DataFrame:
    """(qid, key, rank, score): the k data vectors of largest cosine for each query.

    queries has (qid, vec), data (key, vec), both of unit_vectors; key columns
    are of one type. Queries and data are dealt to blocks, every pair of blocks
    is one matrix product in one task, and only the k best per query and block
    go on. Ties go to the smaller key. With same=True a query skips its own id.
    """
    found = _found(queries, data, key, k, rows_a_block, same)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", key, "rank", "score")


def similarities(queries: DataFrame, data: DataFrame, key: str, rows_a_block: int = 5_000) -> DataFrame:
    """(qid, key, cosine) of every query with every data vector, in blocks."""
    return _found(queries, data, key, 1 << 31, rows_a_block).withColumnRenamed("score", "cosine")
