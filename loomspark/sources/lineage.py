"""Cutting a plan's lineage where what follows uses a frame many times: it is written to the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where none is set, one of our own is made, but only if
    driver and executors are one process."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomspark-")
    spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: what follows reads only the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/cuts/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_bytes(df: DataFrame) -> int:
    """The bytes of the files that a frame's plan scans; what has no known size counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 50)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, in partitions that become more with the files that it comes from: the bytes of a shuffle pack well and do
    not tell how many rows a task then sorts. What is small stays as it is."""
    n = min(files_bytes(df) >> 21, 1 << 14)
    return df if n <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(n, *keys)


#: What cut() has written, by session.
_made: list[tuple[SparkSession, str]] = []


def release(spark: SparkSession) -> None:
    """Removes all that cut() wrote in a session; what reads it can't be asked after that."""
    for own, path in [x for x in _made if x[0] is spark]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _made.remove((own, path))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def mark(df: DataFrame) -> str:
    """A name for what a scan reads: its files with their sizes and times."""
    spark, found = df.sparkSession, []
    for f in sorted(df.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        found.append((f, s.getLen(), s.getModificationTime()))
    return uuid.uuid5(uuid.NAMESPACE_OID, repr(found)).hex
