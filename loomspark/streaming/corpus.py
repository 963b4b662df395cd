"""An extension: files that land in a folder are ingested batch by batch, behind the same checks as any other batch. Each
batch is one commit, so a batch that is run again after a failure changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.sources.lineage import cut
from loomspark.sources.snapshots import Store

SCHEMA = "rel_path string, text string"


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, branch: str = "main", checks: Callable[[DataFrame], DataFrame] | None = None, rejected: str | None = None) -> StreamingQuery:
    """Parquet files of (rel_path, text) on top of the branch; of a path's several rows in a batch the one whose file was
    written last counts (of one file's, the last by text). checks(files) -> findings (level, path, ...), such as gate.rejecting(): files with a
    finding of level `fail` stay out, the others go in; findings are written to the folder `rejected`, one table a batch."""

    def commit(batch: DataFrame, number: int) -> None:
        rows = cut(batch.groupBy("rel_path").agg(F.max_by("text", F.struct("written", "text")).alias("text")))
        if checks is not None:
            findings = cut(checks(rows))
            if rejected:
                findings.write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/batch={number}")
            rows = rows.join(findings.filter("level = 'fail'").select(F.col("path").alias("rel_path")).distinct(), "rel_path", "left_anti")
        if rows.limit(1).count():
            store.commit(rows, branch, store.tip(branch))

    stream = spark.readStream.schema(SCHEMA).parquet(folder).select("rel_path", "text", F.col("_metadata.file_modification_time").alias("written"))
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
