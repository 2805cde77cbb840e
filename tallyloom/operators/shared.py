"""Intermediate tables in the folder that driver and executors share, so that a lost executor costs a retry only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only where its measured size stays below this many bytes.
BROADCAST_BYTES = 48 << 20


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which the JVM removes at its end.

    Local sessions without the setting get a temporary folder, as driver and executors are one machine; a cluster must set it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        top = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    own = f"{top.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return own


def fresh(spark: SparkSession, tag: str) -> str:
    """A path of the shared folder that nothing has been written to."""
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read back: what follows neither repeats nor depends on what made it."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if its measured rows of about row_bytes stay within BROADCAST_BYTES; else as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def pieces(df: DataFrame, each: int) -> int:
    """Partitions of about ``each`` bytes that df makes, by Catalyst's estimate of it (file sizes for tables)."""
    return max(1, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // each))
