"""Substring dedup: words in long passages that an earlier document has too are removed.

Difference-cover anchors: a document's words are hashed in short windows, but only where the position modulo a period
is in a difference cover. For any two positions some shift below the period moves both into the cover, so any two equal
passages of `span` words share an anchor of span - period + 1 words at a common place. Anchors that two documents
share are found by an aggregation; only passages around them are extended: each window of `span` words near one is
hashed in full (96 bits), the lowest document of each hash is found by an aggregation too, and no pairs are made.

Words are runs without ASCII white space, unchanged. Windows are judged on the input. Documents with one doc_id are no
copies of each other; a null doc_id counts as the lowest. A null text has no words. Whole texts are read, a few MB at a
time. Equal rows get equal results, so a passage that several documents have stays in the lowest alone; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, WordHash, doc_id, gram_hashes, keyed, likely, mix, slices, unlikely

SPAN = 50
#: A perfect difference set, every residue modulo the period is a difference of two of them.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def anchors(rows: DataFrame, span: int = SPAN, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(a, k, p): the hash of each anchor, its document and position."""
    size = span - period + 1

    def run(batches):
        known, chosen = WordHash(), np.zeros(period, bool)
        chosen[list(cover)] = True
        for b in (part for whole in batches for part in slices(whole)):
            hs, ks, ps = [], [], []
            for k, t in zip(b.column("k").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                words = t.split()
                if len(words) < span:
                    continue
                g = gram_hashes(known.of(words), size)
                at = np.flatnonzero(np.resize(chosen, len(g)))
                hs.append(g[at])
                ps.append(at)
                ks.append(np.full(len(at), k))
            if hs:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(hs).view(np.int64), "k": np.concatenate(ks), "p": np.concatenate(ps).astype(np.int32)})

    return rows.select("k", "text").mapInArrow(run, "a long, k long, p int")


def copies(rows: DataFrame) -> DataFrame:
    """(k, th): documents whose whole text a lower document has too. All their windows start there."""
    marks = rows.select("k", "th", F.xxhash64(F.lit(1), "text").alias("th2"))
    low = marks.groupBy("th", "th2").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("th", "th2", "lo")
    return marks.join(low, ["th", "th2"]).filter("k > lo").select("k", "th").distinct()


def near_windows(rows: DataFrame, span: int = SPAN, period: int = PERIOD) -> DataFrame:
    """(h1, h2, k, th, s): every window that one of its document's shared anchors `ps` lies in the first `period` words of.
    The hash has 96 bits. th is 0 but for documents whose doc_id others have too (`many`): it would cost its 8 bytes a row."""

    def run(batches):
        known = WordHash()
        for b in (part for whole in batches for part in slices(whole)):
            out = [[] for _ in range(5)]
            for k, th, t, ps in zip(*(b.column(c).to_pylist() for c in ("k", "own")), b.column("text").cast(pa.binary()).to_pylist(), b.column("ps").to_pylist()):
                words = t.split()
                n = len(words) - span + 1
                if n < 1:
                    continue
                marks = np.zeros(n + period + 1, np.int32)
                p = np.array(ps)
                p = p[p < n + period - 1]
                np.add.at(marks, np.maximum(p - period + 1, 0), 1)
                np.add.at(marks, np.minimum(p + 1, n), -1)
                s = np.flatnonzero(np.cumsum(marks[:n]) > 0)
                w = known.of(words)
                h1, h2 = gram_hashes(w, span)[s], gram_hashes(mix(w + np.uint64(0x51ED270B)), span)[s]
                for c, v in zip(out, (h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(s), k), np.full(len(s), th), s.astype(np.int32))):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in zip(("h1", "h2", "k", "th", "s"), out)})

    own = F.when(F.col("many"), F.col("th")).otherwise(F.lit(0)).alias("own")
    return rows.select("k", own, "text", "ps").mapInArrow(run, "h1 long, h2 int, k long, th long, s int")


def repeated_windows(rows: DataFrame, every: DataFrame, scratch: Scratch, span: int = SPAN) -> DataFrame:
    """(k, th, starts): starts of windows of rows that start in an earlier row too; th is 0 where k tells the text among
    every row. What is shared is written before it is joined with: of a join of two tables Spark splits what a hot passage has."""
    shared = anchors(rows, span).groupBy("a").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("a")
    shared = scratch.write(shared, "shared", free=True)
    near = anchors(rows, span).join(shared, "a").groupBy("k").agg(F.collect_set("p").alias("ps"))
    near = scratch.write(near.join(every.select("k").groupBy("k").agg((F.count("*") > 1).alias("many")), "k"), "anchors", free=True)
    scratch.drop("shared")
    windows = scratch.write(near_windows(likely(rows, near, ["k"], 1 << 25).join(near, "k"), span), "windows", "zstd", free=True)
    scratch.drop("anchors")
    first = windows.groupBy("h1", "h2").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("h1", "h2", "lo")
    first = scratch.write(first, "first", "zstd", free=True)
    again = windows.join(first, ["h1", "h2"]).filter("k > lo").groupBy("k", "th").agg(F.collect_set("s").alias("starts"))
    out = scratch.write(again, "starts", free=True)
    scratch.drop("windows", "first")
    return out


def dedup_substrings(spark: SparkSession, docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(k, th, n_words, n_removed, kept): the words that stay, joined by spaces."""
    scratch, rows = Scratch(spark, "substrings"), keyed(docs)
    # Of equal texts the lowest document's alone is compared: the others lose what windows cover, which is all or nothing.
    same = scratch.write(copies(rows), "copies")
    own = likely(rows, same, ["k"]).join(same, ["k", "th"], "left_anti").unionByName(unlikely(rows, same, ["k"]))
    starts = repeated_windows(own, rows, scratch, span).select("k", F.col("th").alias("sth"), "starts")
    lost = scratch.write(starts.unionByName(same.select("k", F.col("th").alias("sth"), F.lit(None).cast("array<int>").alias("starts"))), "lost")

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            n, removed, kept = [], [], []
            for t, hit, starts in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("hit").to_pylist(), b.column("starts").to_pylist()):
                words = t.split()
                n.append(len(words))
                if starts:
                    s, marks = np.array(starts), np.zeros(len(words) + 1, np.int32)
                    np.add.at(marks, s, 1)
                    np.add.at(marks, s + span, -1)
                    stay = np.cumsum(marks[:-1]) == 0
                    words = [w for w, y in zip(words, stay.tolist()) if y]
                elif hit and len(words) >= span:
                    words = []
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_pydict({"k": b.column("k"), "th": b.column("th"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    # Only texts that may lose words are shuffled. A row's text is its own where th tells it apart.
    hits = lost.select(F.col("k").alias("sk"), "sth", "starts", F.lit(True).alias("hit"))
    mine = (F.col("k") == F.col("sk")) & ((F.col("sth") == 0) | (F.col("sth") == F.col("th")))
    met = likely(rows, lost, ["k"]).join(hits, mine, "left").select("k", "th", "text", F.coalesce("hit", F.lit(False)).alias("hit"), "starts")
    rest = unlikely(rows, lost, ["k"]).select("k", "th", "text", F.lit(False).alias("hit"), F.lit(None).cast("array<int>").alias("starts"))
    return met.unionByName(rest).mapInArrow(run, "k long, th long, n_words long, n_removed long, kept string")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(doc_id(), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
