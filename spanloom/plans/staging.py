"""Tables that several plans read are written once, to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written within each open released() block, the innermost last.
_blocks: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, where all is one machine, may do without; on a cluster a
    folder of the driver's own would be read by executors that never wrote to it."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/spanloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, what: str, outlive: bool = False) -> DataFrame:
    """Write df under shared_dir() and read it again: worked out once whatever reads it, lineage cut, survives lost executors, sizes known. The files go
    when the released() block around ends (with `outlive`, the one around that), else when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    if len(_blocks) > outlive:
        _blocks[-1 - outlive].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes what is staged inside, so that a long session keeps no more than it still reads. Results have to be written, or staged to outlive the block,
    before it ends."""
    _blocks.append([])
    try:
        yield
    finally:
        for path in _blocks.pop():
            where, files = _files(spark, path)
            files.delete(where, True)
