"""Session helpers: building a local session, and cutting lineage safely."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexigraph")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def settled(spark: SparkSession) -> SparkSession:
    """The session with the one setting that right results need on Spark 4.1.

    There a union whose inputs are partitioned alike counts as partitioned, too,
    even where adaptive execution has merged their partitions differently; an
    aggregation after it then gives several rows for a key.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-lexigraph-")
    sc.setCheckpointDir(shared)


_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end all tables that cut() has written within; results must be written by then."""
    _scratches.append([])
    try:
        yield
    finally:
        for name in _scratches.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df in partitions enough for all cores: a small file, or one that can't be split, is else read and worked on by one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(3 * cores)


def together(*jobs: Callable[[], T]) -> list[T]:
    """The results of jobs that do not need each other, run at once: small ones alone leave most cores idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [x.result() for x in [pool.submit(job) for job in jobs]]


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and go on from the written rows.

    Survives the loss of executors, unlike a local checkpoint. The tables stay
    until the folder is emptied after the application, as checkpoints do, or
    until the end of the scratch() in which they were written.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4()}"
    df.write.parquet(path)
    if _scratches:
        _scratches[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
