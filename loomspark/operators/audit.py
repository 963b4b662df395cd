"""The hash-chain audit, in blocks of sequence numbers so that no task sees the whole chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.hashing import GENESIS, chain_hash


def links(chain: DataFrame, block: int = 100_000) -> DataFrame:
    """chain (sequence, payload, timestamp, prev_hash, hash) with `fault`: gap, link, hash or null.

    A row is held against the one before it: inside a block by a window, across blocks by a join of last rows. A null
    hash is a fault of its row; a repeated sequence number is a gap."""
    rows = chain.withColumn("block", F.floor(F.col("sequence") / block))
    w = Window.partitionBy("block").orderBy("sequence")
    rows = rows.withColumns({"before": F.lag("sequence").over(w), "before_hash": F.lag("hash").over(w)})
    last = rows.groupBy("block").agg(F.max("sequence").alias("last"), F.max_by("hash", "sequence").alias("last_hash")).withColumn("block", F.col("block") + 1)
    rows = rows.join(last, "block", "left")
    before, known = F.coalesce("before", "last"), F.coalesce("before_hash", "last_hash")
    first = F.col("sequence") == 0
    fault = (
        F.when(~first & ~before.eqNullSafe(F.col("sequence") - 1), "gap")
        .when(~F.col("prev_hash").eqNullSafe(F.when(first, F.lit(GENESIS)).otherwise(known)), "link")
        .when(F.col("hash").isNull() | ~F.col("hash").eqNullSafe(chain_hash(F.col("payload"), F.col("timestamp"), F.col("sequence"), F.col("prev_hash"))), "hash")
    )
    return rows.withColumn("fault", fault).drop("block", "before", "before_hash", "last", "last_hash")


def first_break(chain: DataFrame) -> DataFrame:
    """One row: the lowest sequence with a fault, and the fault; nulls where the chain holds."""
    bad = links(chain).filter("fault is not null")
    return bad.agg(F.min("sequence").alias("sequence"), F.min_by("fault", "sequence").alias("fault"))
