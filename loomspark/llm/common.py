"""What the training-data operators share: shared scratch tables, row keys, word hashing.

Rows are keyed inside operators by (doc key, text hash), so that rows that repeat a doc_id with
another text stay apart and identical rows get identical results. A null doc_id is carried as the
smallest long and turned back into null in results.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for a null doc_id inside operators; it sorts before every other.
NULL_ID = -(2**63)

DOC_COLUMNS = ("doc_id", "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own, but only if driver
    and executors are one process; on a cluster that folder would be another one on each machine, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/") if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


class Scratch:
    """Tables of one run in the shared folder. They outlive lost executors; drop() removes what is read no more.

    Results read some of them, so they stay until the caller, done with the results, calls release()."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/loomspark/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []
        Scratch.made.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, codec: str = "snappy", free: bool = False) -> DataFrame:
        """Writes df and returns the table read again: lineage ends here. free: df took large shuffles, so their files are
        freed now, as they would be once the driver happens to collect its garbage."""
        self.tables.append(table)
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(table))
        schema = df.schema
        del df
        if free:
            self.tidy()
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for t in tables:
            self._delete(self.path(t))

    def drop_others(self, *kept: str) -> None:
        """Removes all tables but those kept."""
        self.drop(*(t for t in self.tables if t not in kept))

    def close(self) -> None:
        """Removes all tables of the run."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def tidy(self) -> None:
        """Lets Spark's cleaner free the shuffle files of frames that are gone."""
        gc.collect()
        self.spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Removes the scratch tables of all runs of a session. Their results can't be read after that."""
    for s in [s for s in Scratch.made if s.spark is spark]:
        s.close()
        Scratch.made.remove(s)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut where `most` bytes of a column (text, or lists of longs) are full, a row at least each: what a worker holds at a time does not
    grow with the texts' length times Arrow's rows a batch."""
    held = batch.column(column)
    sizes = pc.list_value_length(held) if pa.types.is_list(held.type) else pc.binary_length(held.cast(pa.binary()))
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False) * (8 if pa.types.is_list(held.type) else 1)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


#: Bytes of an Arrow batch that Spark hands to a worker.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """rows.mapInArrow(run, schema) for rows that hold texts: Arrow's 10,000 rows a batch are tens of MB of them, in the executor
    twice while its buffer grows and in the worker once more. So the session's batches end at BATCH_BYTES, unless its user set
    their size; and a worker, which Spark uses again, gives back what a task took."""
    conf = rows.sparkSession.conf
    if _BATCH_CONF not in conf.getAll:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def whole(batches):
        yield from run(batches)
        give_back()

    return rows.mapInArrow(whole, schema)


def give_back() -> None:
    """Returns free memory to the system, where the C library can; it keeps what lies below anything still in use otherwise."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keyed(docs: DataFrame) -> DataFrame:
    """(k, th, text): the row key and the whole text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """names as none of docs' columns is called, whatever their case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        name = f"__{n}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def doc_id(k: str = "k") -> Column:
    """The doc_id of a key."""
    return F.when(F.col(k) != NULL_ID, F.col(k)).alias("doc_id")


def slots(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_of(docs: DataFrame) -> int:
    """Bytes of a frame, as Spark estimates them from its files; 0 where it can't."""
    found = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 0


def to_ids(col) -> list:
    """An Arrow column of keys as a list, NULL_ID turned into None."""
    return [None if x == NULL_ID else x for x in col.to_pylist()]


def bitmap(hashes: DataFrame, bits: int = 1 << 23) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(one row with __bits, test): which of `bits` bits the hashes (a column `h` of longs) fall on, and whether the bit of
    a hash is set beside such a row. The row is of fixed size, so it may be broadcast. Built-in functions only."""
    at = F.pmod(F.col("h"), F.lit(bits))
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("b"))
    every = hashes.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    dense = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("__bits"))  # bits / 64 words

    def test(h: Column) -> Column:
        at = F.pmod(h, F.lit(bits))
        return F.call_function("shiftright", F.get("__bits", F.shiftright(at, 6).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return dense, test


def likely(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = 1 << 23) -> DataFrame:
    """rows that may have a key of wanted: none of those is missed, few others pass while wanted is small against bits.

    wanted becomes a bitmap of at most `bits` bits, one broadcast row, so a join that follows shuffles only what passes.
    The bitmap's size is fixed: a larger wanted lets more rows pass and changes no result."""
    dense, test = bitmap(wanted.select(F.xxhash64(*keys).alias("h")), bits)
    return rows.crossJoin(F.broadcast(dense)).filter(test(F.xxhash64(*keys))).drop("__bits")


def unlikely(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = 1 << 23) -> DataFrame:
    """The rows that likely() leaves out."""
    dense, test = bitmap(wanted.select(F.xxhash64(*keys).alias("h")), bits)
    return rows.crossJoin(F.broadcast(dense)).filter(~test(F.xxhash64(*keys))).drop("__bits")


class WordHash(dict):
    """word (bytes) -> 64-bit hash, kept for words seen of late."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Words of more bytes are hashed one by one.
_LONG = 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of texts one after the other, how many words each text has). Words are runs without ASCII
    white space, A-Z lower-cased. All words are hashed at once, eight bytes a round, so nothing is kept or looked up."""
    data = b"\n" + b"\n".join(texts).lower() + b"\n" * 9  # the last words are read eight bytes a time too
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, length = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix((eight[start] & _MASKS[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * np.uint64(_STEP)))
    at = 8
    left = np.flatnonzero((length > at) & (length <= _LONG))
    while len(left):
        part = eight[start[left] + at] & _MASKS[np.minimum(length[left] - at, 8)]
        h[left] = mix(h[left] * np.uint64(_STEP) + mix(part + np.uint64(at)))
        at += 8
        left = left[length[left] > at]
    for i in np.flatnonzero(length > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + length[i]])
    ends = np.searchsorted(start, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) + 1)
    return h, np.diff(ends, prepend=0)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(29))
    h = h * _M2
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words; the order of words counts. For long n by doubling: log n passes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    powers, width, cur = [], 1, words
    while True:
        powers.append((width, cur))
        if width * 2 > n:
            break
        cur = mix(cur[: len(cur) - width] * np.uint64(_STEP) + mix(cur[width:] + np.uint64(width)))
        width *= 2
    count, out, at = len(words) - n + 1, None, 0
    for width, cur in reversed(powers):
        if n - at >= width:
            part = cur[at : at + count]
            out = part if out is None else mix(out * np.uint64(_STEP | 2) + mix(part + np.uint64(at)))
            at += width
    return mix(out + np.uint64(n))
