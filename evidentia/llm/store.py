"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Only where that is unset and the master is local (tests) a temporary one is
made; elsewhere it is an error, since executors would not see each other's files.
Tables written there cut the lineage: a lost executor costs a re-read, not a recomputation.  An operator deletes those that only
its own steps read (``Scratch``); those that its result still reads stay.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches of this session to ``BATCH_BYTES``, so that long texts don't fill a Python worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session as a URI or path without a trailing slash."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    return _LOCAL[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once and return (the table as read back, its path)."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, label: str) -> DataFrame:
    return write_table(df, label)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Tables by name that are deleted once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, label: str) -> DataFrame:
        found, self.paths[label] = write_table(df, label)
        return found

    def drop(self, *labels: str) -> None:
        drop(self.spark, *(self.paths.pop(x) for x in labels))
