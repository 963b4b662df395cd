"""The streamed audit against the batch audit, however rows are split into batches."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions.hashing import GENESIS, chain_hash
from loomspark.operators import audit
from loomspark.streaming.audit import PROVIDER, audited, current

EVENT = "chain string, sequence long, payload string, timestamp string, prev_hash string, hash string"


def chains(spark, seed):
    """Three chains with rows that lack, are altered, have no hash, and one that does not begin at 0."""
    import hashlib

    rnd, rows = random.Random(seed), []
    for c, first in (("a", 0), ("b", 0), ("c", 5)):
        before = GENESIS
        for s in range(first, first + 25):
            payload, stamp = f"p{s}", str(s)
            own = hashlib.sha256("\x00".join((payload, stamp, str(s), before)).encode()).hexdigest()
            kind = rnd.random()
            if kind < 0.12:
                pass  # lost
            elif kind < 0.2:
                rows.append((c, s, payload + "!", stamp, before, own))
            elif kind < 0.25:
                rows.append((c, s, payload, stamp, before, None))
            elif kind < 0.3:
                rows.append((c, s, payload, stamp, "other", own))
            else:
                rows.append((c, s, payload, stamp, before, own))
            before = own
    return rows


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def run(spark, folder, name, wait=0, seconds=None):
    """Runs over what there is, and stops: called again, it starts from the checkpoint."""
    stream = audited(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), wait)

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    # Timers ask for batches without data for ever: a run over what there is has none.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(seconds is not None).lower())
    q = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/cp")
    if seconds is None:
        q.trigger(availableNow=True).start().awaitTermination()
    else:
        q = q.trigger(processingTime="1 second").start()
        q.awaitTermination(seconds)
        q.stop()


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/new-{name}")
    part = next((folder / f"new-{name}").glob("part-*.parquet"))
    (folder / "in").mkdir(exist_ok=True)
    part.rename(folder / "in" / f"{name}.parquet")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_batch_audit(spark, store, tmp_path, seed):
    rows = chains(spark, seed)
    want = set()
    for c in "abc":
        own = spark.createDataFrame([r for r in rows if r[0] == c], EVENT)
        want |= {(c, r.sequence, r.fault) for r in audit.links(own, 7).collect()}
    rnd = random.Random(seed + 10)
    rnd.shuffle(rows)
    for n in range(3):
        put(spark, tmp_path, n, rows[n::4])
    run(spark, tmp_path, "q")
    put(spark, tmp_path, 3, rows[3::4])
    run(spark, tmp_path, "q")
    got = {tuple(r) for r in current(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == want and {f for _, _, f in want} >= {None, "gap", "link", "hash"}


def test_a_gap_is_given_up_in_time_and_mended_later(spark, store, tmp_path):
    import hashlib

    rows, before = [], GENESIS
    for s in range(5):
        own = hashlib.sha256("\x00".join((f"p{s}", str(s), str(s), before)).encode()).hexdigest()
        rows.append(("a", s, f"p{s}", str(s), before, own))
        before = own
    put(spark, tmp_path, 0, [rows[0], rows[1], rows[4]])
    run(spark, tmp_path, "q", wait=10**9)
    assert {tuple(r)[1:3] for r in current(spark.read.parquet(f"{tmp_path}/out")).collect()} == {(0, None), (1, None)}  # 4 waits
    put(spark, tmp_path, 1, [rows[2]])
    run(spark, tmp_path, "q", wait=10**9)
    put(spark, tmp_path, 2, [rows[3], rows[3]])
    run(spark, tmp_path, "q", wait=10**9)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {tuple(r)[1:3] for r in current(got.filter("sequence <> 3 or fault is distinct from 'gap'")).collect()} == {(s, None) for s in range(5)}
    assert got.filter("sequence = 3 and fault = 'gap'").count() == 1  # the repeated row


def test_timers(spark, store, tmp_path):
    put(spark, tmp_path, 0, [("a", 3, "p", "t", "x", "h")])
    run(spark, tmp_path, "q", wait=500, seconds=25)
    assert [(r.sequence, r.fault) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(3, "gap")]
