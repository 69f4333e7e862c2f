"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only on one machine (a local master, as in tests) may that setting be absent; a temporary folder is used then.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("inkwell.local.dir", None)
        if not base:
            base = tempfile.mkdtemp(prefix="inkwell-")
            spark.conf.set("inkwell.local.dir", base)
    return f"{base.rstrip('/')}/inkwell-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, codec: str | None = None) -> DataFrame:
    """df as a table written in the shared folder: it is made once, cuts the lineage and survives lost executors. A table of texts is
    smaller with zstd as codec."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files give fewer tasks than that (a small file is one task); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_keys(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many partitions as shuffles have, which are not merged where they are small: for Python work on groups."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def trimmed() -> None:
    """Hands memory that a Python worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, after which the Python worker hands freed memory back: workers outlive their tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trimmed()

    return run
