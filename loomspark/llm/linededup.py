"""Line dedup: lines found in many documents go.

Two Bloom filters (seen.py) tell which lines can repeat: one of hashes seen once, one of hashes seen twice. A line that
two documents share is always in the second filter. Only lines that it holds (suspected repeats) are shuffled, as
128-bit digests, to be counted exactly; of those confirmed, all lines go, or all but the first occurrence. Confirmed
lines are a table with a row for each, so a line of very many documents is joined in as many tasks as it needs.

The second filter has a fixed greatest size (max_bits), so it may be broadcast; a corpus that outgrows it gets more
false suspects, which cost shuffle and change no result.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Lines with an empty key stay. A null
or empty text is one empty line. Whole texts are read, in batches of a few MB; a text without line ends is one line,
however long. Ties for the first occurrence go to the lowest (doc_id, text hash). Each row counts as a document, so repeated rows count each. An empty table gives no
rows. Other columns are kept as they are by without_repeats(), ignored by the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import NULL_ID, Scratch, doc_id, free_names, keyed, mapped, slices
from loomspark.llm.seen import size_for, twice_seen


def keys_of(text: bytes) -> list[bytes]:
    """The key of each line; bytes.lower and bytes.strip know ASCII only."""
    return [x.strip() for x in text.lower().split(b"\n")]


def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The hashes of the distinct keys of each text."""
    for part in slices(batch):
        for t in part.column("text").cast(pa.binary()).to_pylist():
            ks = {k for k in keys_of(t) if k}
            yield np.fromiter(map(xxhash.xxh3_64_intdigest, ks), np.uint64, len(ks))


SUSPECTS = "d1 long, d2 long, k long, th long, lines array<int>"


def suspects(rows: DataFrame, known) -> DataFrame:
    """A row for each document and suspected key: its digest and the lines that have it."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            out = {x: [] for x in ("d1", "d2", "k", "th", "lines")}
            ks, ths = b.column("k").to_pylist(), b.column("th").to_pylist()
            for k, th, t in zip(ks, ths, b.column("text").cast(pa.binary()).to_pylist()):
                at: dict[bytes, list[int]] = {}
                for i, x in enumerate(keys_of(t)):
                    if x:
                        at.setdefault(x, []).append(i)
                if not at:
                    continue
                found = known.value.has(np.fromiter(map(xxhash.xxh3_64_intdigest, at), np.uint64, len(at)))
                for x, hit in zip(at, found.tolist()):
                    if hit:
                        d = np.frombuffer(hashlib.blake2b(x, digest_size=16).digest(), "<i8")
                        for c, v in zip(out.values(), (int(d[0]), int(d[1]), k, th, at[x])):
                            c.append(v)
            if out["k"]:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.list_(pa.int32()) if c == "lines" else pa.int64()) for c, v in out.items()})

    return mapped(rows, run, SUSPECTS)


def filter_bits(rows: DataFrame, per_line: int = 16, max_bits: int = 1 << 29) -> int:
    """A power of two: per_line bits for each line of the corpus, max_bits at most."""
    n = rows.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0] or 0
    return size_for(int(n), per_line, max_bits)


def repeated_lines(docs: DataFrame, scratch: Scratch, min_docs: int = 10, keep_first: bool = False, max_bits: int = 1 << 29) -> DataFrame:
    """(k, th, gone): the numbers of lines that each text loses; texts that lose none are not there."""
    spark, rows = docs.sparkSession, keyed(docs)
    bits = filter_bits(rows, max_bits=max_bits)
    known = spark.sparkContext.broadcast(twice_seen(rows.select("text"), hashes, bits))
    found = scratch.write(suspects(rows, known), "suspects")
    known.unpersist()
    counts = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("k", "th")).alias("first") if keep_first else F.lit(0).alias("first"))
    # Written first: of a join of two tables Spark splits what a hot line has too many rows of.
    hit = found.join(scratch.write(counts.filter(F.col("n") >= min_docs), "confirmed"), ["d1", "d2"])
    lines = F.col("lines")
    if keep_first:
        lines = F.when(F.struct("k", "th") == F.col("first"), F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))
    return hit.select("k", "th", lines.alias("lines")).groupBy("k", "th").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(k, th, n_lines, n_dropped, kept): the text without lines whose key min_docs documents or more have."""
    scratch = Scratch(spark, "lines")
    gone = scratch.write(repeated_lines(docs, scratch, min_docs, keep_first), "gone")

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            n, dropped, kept = [], [], []
            for t, g in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("gone").to_pylist()):
                lines = t.split(b"\n")
                g = set(g or ())
                n.append(len(lines))
                dropped.append(len(g))
                kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in g]) if g else t)
            yield pa.RecordBatch.from_pydict({"k": b.column("k"), "th": b.column("th"), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return mapped(keyed(docs).join(gone, ["k", "th"], "left").select("k", "th", "text", "gone"), run, "k long, th long, n_lines long, n_dropped long, kept string")


def without_repeats(spark: SparkSession, docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """docs with its columns, lines that repeat taken out of text. n_chars, where it is there, counts the new text.
    A null text stays null; a text of which nothing is left stays as an empty one."""
    scratch = Scratch(spark, "lines")
    columns = docs.columns
    at, (k, th, lost) = columns.index("text"), free_names(docs, "k", "th", "gone")
    gone = scratch.write(repeated_lines(docs, scratch, min_docs, keep_first), "gone").select(F.col("k").alias(k), F.col("th").alias(th), F.col("gone").alias(lost))

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            texts = b.column("text")
            if b.column(lost).null_count < b.num_rows:
                out = []
                for t, g in zip(texts.cast(pa.binary()).to_pylist(), b.column(lost).to_pylist()):
                    g = set(g or ())
                    out.append(b"\n".join([x for i, x in enumerate(t.split(b"\n")) if i not in g]) if g else t)
                texts = pa.array(out, pa.binary()).cast(pa.string())
            arrays = [b.column(c) for c in columns]
            arrays[at] = texts
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce("text", F.lit("")))
    rows = mapped(docs.withColumns({k: key[0], th: key[1]}).join(gone, [k, th], "left").select(*columns, lost), run, docs.schema)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else rows


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(doc_id(), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
