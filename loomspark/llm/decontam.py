"""Benchmark decontamination by winnowing. DataFrame functions only.

Of every 13 consecutive words, the least of their nine 5-gram hashes is kept: whatever document and benchmark share
for 13 words or more, they share a kept hash of it. Kept hashes of documents meet those of the benchmark in an
equi-join; hits are extended to the windows around them, which are compared as words, so nothing rests on hashes.
Items of fewer words are one window each: their anchor is looked up at every position, in one pass for all gram sizes,
behind a bitmap of fixed size.

Words: A-Z lower-cased, runs of digits, letters and all above U+007F. A null text has no words, so do empty ones;
an item without words is no window. A null item_id counts as ''. Whole texts are compared, however long. Of equal least
hashes the first position is kept; equal items count each. Equal rows get equal results; empty tables give
no rows (documents) or no hits (benchmark). Other columns are ignored.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import NULL_ID, Scratch, bitmap, doc_id, free_names, keyed, likely

SPAN_WORDS = 13
GRAM = 5
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order; empty strings may stand at the ends."""
    return F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _SEPARATORS)


def _trimmed(cut: str) -> Column:
    """What split gave, without the empty strings at its ends."""
    c = F.col(cut)
    head, tail = (F.get(c, F.lit(0)) == "").cast("int"), (F.get(c, F.size(c) - 1) == "").cast("int")
    return F.slice(c, head + 1, F.greatest(F.size(c) - head - tail, F.lit(0)))


def worded(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, w (words), n (how many)."""
    rows = rows.select(*keep, words(F.col("text")).alias("w")).select(*keep, _trimmed("w").alias("w"))
    return rows.select(*keep, "w", F.size("w").alias("n"))


def grams(size: int) -> Column:
    """The hash of every `size` consecutive words of w."""
    at = F.sequence(F.lit(0), F.col("n") - size)
    return F.when(F.col("n") >= size, F.transform(at, lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def winnowed(span: int, gram: int) -> Column:
    """Positions (from 0) of kept hashes among g: of each span of words, the first of the least."""
    per = span - gram + 1

    def least(i: Column) -> Column:
        part = F.slice("g", i + 1, F.lit(per))
        return (i + F.array_position(part, F.array_min(part)) - 1).cast("int")

    return F.when(F.col("n") >= span, F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - span), least))).otherwise(F.array().cast("array<int>"))


def fingerprints(rows: DataFrame, *keep: str, span: int = SPAN_WORDS, gram: int = GRAM) -> DataFrame:
    """keep, n, at (positions), fp (their hashes)."""
    rows = rows.select(*keep, "n", "w", grams(gram).alias("g"))
    rows = rows.select(*keep, "n", "g", winnowed(span, gram).alias("at"))
    return rows.select(*keep, "n", "at", F.transform("at", lambda p: F.get("g", p)).alias("fp"))


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, scratch: Scratch, span: int = SPAN_WORDS, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(k, th, n) of all documents; (k, th, s, m, win) of occurring windows: start, words, text."""
    items = worded(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "item").filter("n > 0")
    items = scratch.write(items, "items")
    rows = keyed(docs)
    kept = scratch.write(fingerprints(worded(rows, "k", "th"), "k", "th", span=span, gram=gram), "fingerprints")
    marks = fingerprints(items, "item", span=span, gram=gram).select(F.explode("fp").alias("fp")).distinct()
    near = kept.filter(F.size("at") > 0).select("k", "th", "n", F.explode(F.arrays_zip("at", "fp")).alias("x")).select("k", "th", "n", F.col("x.at").alias("p"), F.col("x.fp").alias("fp"))
    near = near.join(marks, "fp").groupBy("k", "th", "n").agg(F.collect_set("p").alias("ps"))
    # Every span that holds a hit's gram.
    starts = F.array_distinct(F.flatten(F.transform("ps", lambda p: F.sequence(F.greatest(p - (span - gram), F.lit(0)), F.least(p, F.col("n") - span)))))
    at = near.select("k", "th", F.transform(starts, lambda s: F.struct(s.alias("s"), F.lit(span).alias("m"))).alias("at"))
    short = items.filter(F.col("n") < span)
    sizes = sorted(r[0] for r in short.select(F.least("n", F.lit(gram)).alias("size")).distinct().collect())  # `gram` sizes at most
    if sizes:
        # An item's anchor is its least gram. Documents are read once for all sizes, and what a bitmap of the anchors
        # rules out is dropped before any position becomes a row.
        per_size = [short.filter(F.least("n", F.lit(gram)) == size).select(F.lit(size).alias("size"), "n", grams(size).alias("g")) for size in sizes]
        anchors = functools.reduce(DataFrame.unionByName, per_size)
        anchors = anchors.select("size", F.col("n").alias("m"), (F.array_position("g", F.array_min("g")) - 1).cast("int").alias("a"), F.array_min("g").alias("fp")).distinct()
        anchors = scratch.write(anchors, "anchors")
        dense, hit = bitmap(anchors.select(F.col("fp").alias("h")))
        wide = worded(rows, "k", "th").crossJoin(F.broadcast(dense))
        place = lambda size: lambda fp, p: F.struct(F.lit(size).alias("size"), p.alias("p"), fp.alias("fp"))
        found = F.concat(*[F.filter(F.transform(grams(size), place(size)), lambda x: hit(x["fp"])) for size in sizes])
        met = wide.select("k", "th", "n", F.explode(found).alias("x")).select("k", "th", "n", "x.*")
        own = met.join(anchors, ["size", "fp"]).select("k", "th", "n", (F.col("p") - F.col("a")).alias("s"), "m").filter("s >= 0 and s + m <= n")
        at = at.unionByName(own.groupBy("k", "th").agg(F.collect_set(F.struct("s", "m")).alias("at")))
    at = scratch.write(at.groupBy("k", "th").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")), "candidates")
    spans = worded(likely(rows, at, ["k", "th"]).join(at, ["k", "th"]), "k", "th", "at").select("k", "th", "w", F.explode("at").alias("x"))
    spans = spans.select("k", "th", "x.s", "x.m", F.array_join(F.slice("w", F.col("x.s") + 1, F.col("x.m")), " ").alias("win"))
    windows = window_items(items, span).select("win").distinct()
    return kept.select("k", "th", "n"), scratch.write(spans.join(windows, "win"), "hits")


def window_items(items: DataFrame, span: int) -> DataFrame:
    """(win, item): the windows of each item, as text."""
    size = F.least("n", F.lit(span))
    each = F.transform(F.sequence(F.lit(0), F.col("n") - size), lambda i: F.array_join(F.slice("w", i + 1, size), " "))
    return items.select("item", F.explode(F.array_distinct(each)).alias("win"))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, span: int = SPAN_WORDS, gram: int = GRAM) -> DataFrame:
    """One row a document: k, th, n_words, n_hit, items (sorted ids), contaminated (hits in a twentieth of its words)."""
    scratch = Scratch(spark, "decontam")
    counts, found = hits(spark, docs, benchmark, scratch, span, gram)
    items = spark.read.parquet(scratch.path("items"))

    def cover(acc: Column, x: Column) -> Column:
        end = x["s"] + x["m"]
        return F.struct((acc["c"] + F.greatest(end - F.greatest(x["s"], acc["e"]), F.lit(0))).alias("c"), F.greatest(acc["e"], end).alias("e"))

    covered = F.aggregate(F.sort_array(F.collect_set(F.struct("s", "m"))), F.struct(F.lit(0).alias("c"), F.lit(0).alias("e")), cover, lambda a: a["c"])
    hit = found.groupBy("k", "th").agg(covered.cast("long").alias("n_hit"))
    named = found.select("k", "th", "win").distinct().join(window_items(items, span), "win").groupBy("k", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = counts.join(hit, ["k", "th"], "left").join(named, ["k", "th"], "left")
    n, h = F.col("n").cast("long"), F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("k", "th", n.alias("n_words"), h.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((h > 0) & (20 * h >= n)).alias("contaminated"))


def uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated."""
    k, th = free_names(docs, "k", "th")
    bad = contamination(spark, docs, benchmark).filter("contaminated").select(F.col("k").alias(k), F.col("th").alias(th))
    key = {k: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), th: F.xxhash64(F.coalesce("text", F.lit("")))}
    return docs.withColumns(key).join(bad, [k, th], "left_anti").select(*docs.columns)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(doc_id(), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
