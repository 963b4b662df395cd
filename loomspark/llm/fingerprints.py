"""Document fingerprints: threshold-scaled sketches. DataFrame functions only.

A sketch keeps every hash of a text's shingles (five words; a shorter text is one shingle) below a fixed fraction of all
hashes, so it grows with the text, sketches of unequal documents are compared on one scale, and the sketch of a union is
made of the sketches alone. Texts of few shingles would keep hardly any: the LEAST lowest hashes are always kept, which
merges as exactly (the lowest of a union are among the lowest of its parts).

A sketch knows all of its document's hashes up to its limit: the threshold, the highest of LEAST, or any hash where it is
smaller than that. Two sketches are compared up to the lower of their limits. containment(a, b) is the share of a's hashes
that b has; where a has none up to that limit, nothing is known to be shared and it is 0. Of texts without words, two are
alike (1), and one is in no other (0).

Words are runs without ASCII white space, in lower case. Null texts are empty ones. Whole texts of any length count. Equal texts
have equal fingerprints; an empty table gives no rows; other columns are ignored. with_next() takes documents in the order of
(doc_id, text hash), null first; rows that repeat both are one document there and get one result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import NULL_ID, Scratch, doc_id, keyed, likely, unlikely
from loomspark.llm.quality import words
from loomspark.llm.radix import BUCKET, bucketed

SHINGLE = 5
#: One hash of so many is kept.
SCALE = 16
LEAST = 64
LOWEST, HIGHEST = -(2**63), 2**63 - 1
SKETCH = "array<bigint>"


def threshold(scale: int = SCALE) -> int:
    return LOWEST + 2**64 // scale


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The hash of every `size` consecutive words; of all words where they are fewer; none of no words."""

    def of(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        return F.when(F.size(w) >= size, every).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast(SKETCH))

    return F.get(F.transform(F.array(words(F.lower(text))), of), F.lit(0))


def _kept(hashes: Column, scale: int, least: int) -> Column:
    below = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(threshold(scale)))))

    def enough(kept: Column) -> Column:
        return F.when(F.size(kept) >= least, kept).otherwise(F.slice(F.array_sort(F.array_distinct(hashes)), 1, F.lit(least)))

    return F.get(F.transform(F.array(below), enough), F.lit(0))


def sketched(rows: DataFrame, text: str, name: str, size: int = SHINGLE, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """rows with the sketch of a text column: its kept hashes, ascending."""
    hashed = rows.withColumn(f"__{name}", shingle_hashes(F.col(text), size))
    return hashed.withColumn(name, _kept(F.col(f"__{name}"), scale, least)).drop(f"__{name}")


def merged(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The sketch of what two sketches' documents hold together."""
    return _kept(F.concat(a, b), scale, least)


def shown(sketch: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def limit(sketch: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Up to where a sketch knows all hashes of its document."""
    return F.when(F.size(sketch) < least, F.lit(HIGHEST)).otherwise(F.greatest(F.lit(threshold(scale) - 1), F.element_at(sketch, -1)))


def containment(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The share of a's hashes that b has, from 0 to 1."""
    upto = F.least(limit(a, scale, least), limit(b, scale, least))
    own = F.filter(a, lambda h: h <= upto)
    share = F.size(F.array_intersect(own, b)) / F.nullif(F.size(own), F.lit(0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.coalesce(share, F.lit(0.0)))


def with_next(spark: SparkSession, docs: DataFrame, scratch: Scratch, target: int = 32) -> DataFrame:
    """(k, th, text, sketch, next_text, next_sketch) of each document; the first follows the last.

    Texts are shuffled once, into buckets of consecutive documents; a bucket's first document goes to the bucket before
    it too. Where buckets begin is told by counts of the digits of (k, th)."""
    rows = keyed(docs)
    # One row a document, and how many rows it stands for.
    keys = scratch.write(rows.groupBy("k", "th").agg(F.count("*").alias("rows")), "keys", free=True)
    low = keys.filter(F.col("k") != NULL_ID).agg(F.min("k")).first()[0]
    near_null = F.lit(max(low - 1, NULL_ID) if low is not None else 0)

    def ordered(frame: DataFrame) -> DataFrame:
        # Null ids stand just below the others: as the smallest long they would spread the digits over all 64 bits.
        return frame.withColumns({"g": F.lit(""), "o": F.when(F.col("k") == NULL_ID, near_null).otherwise(F.col("k"))})

    found = bucketed(ordered(keys), ["o", "th"], scratch, "buckets", target)
    table = found.table
    every = table.groupBy("g").agg(F.sum("n").alias("total"))
    firsts = found.tag(ordered(keys)).groupBy("g", *BUCKET).agg(F.min(F.struct("o", "th", "k")).alias("first"))
    firsts = firsts.join(table.select("g", *BUCKET, "base"), ["g", *BUCKET]).select("base", "first.k", "first.th")
    # The bucket before the one that begins at a base ends there; before the first stands the last.
    ends = table.join(every, "g").select(*BUCKET, F.when(F.col("base") + F.col("n") == F.col("total"), F.lit(0)).otherwise(F.col("base") + F.col("n")).alias("base"))
    halo = scratch.write(firsts.join(ends, "base").select("k", "th", *BUCKET), "halo")
    again = keys.filter("rows > 1").select("k", "th")
    texts = rows
    if again.limit(1).count():
        # Rows that repeat one are told apart from the rest by a bitmap; each task keeps one before they are shuffled.
        again = scratch.write(again, "again")
        few = likely(rows, again, ["k", "th"]).groupBy("k", "th").agg(F.first("text").alias("text"))
        texts = unlikely(rows, again, ["k", "th"]).unionByName(few)
    own = found.tag(ordered(sketched(texts, "text", "sketch"))).select("k", "th", "o", *BUCKET, "text", "sketch", F.lit(False).alias("extra"))
    extra = likely(texts, halo, ["k", "th"]).join(halo, ["k", "th"])
    extra = ordered(sketched(extra, "text", "sketch")).select("k", "th", "o", *BUCKET, "text", "sketch", F.lit(True).alias("extra"))
    after = Window.partitionBy(*BUCKET).orderBy("extra", "o", "th")
    both = own.unionByName(extra).withColumns({"next_text": F.lead("text").over(after), "next_sketch": F.lead("sketch").over(after)})
    return both.filter("not extra").select("k", "th", "text", "sketch", "next_text", "next_sketch")


def fingerprinted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each of docs: doc_id, text, sketch, edited (the text whose last half of code points is replaced by the
    first as many of the next document), edited_sketch, near_edited, near_next."""
    scratch = Scratch(spark, "fingerprints")
    rows = with_next(spark, docs, scratch)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = sketched(rows, "edited", "edited_sketch")
    rows = rows.withColumns({"near_edited": containment(F.col("sketch"), F.col("edited_sketch")), "near_next": containment(F.col("sketch"), F.col("next_sketch"))})
    rows = rows.select("k", "th", "text", "sketch", "edited", "edited_sketch", "near_edited", "near_next")
    again = spark.read.parquet(scratch.path("keys")).filter("rows > 1")
    if again.limit(1).count():
        # The rows of a document get its result by a join that Spark can split.
        rows = scratch.write(rows, "results")
        copies = likely(keyed(docs).select("k", "th"), again, ["k", "th"]).join(again.select("k", "th"), ["k", "th"], "left_semi")
        rows = unlikely(rows, again, ["k", "th"]).unionByName(copies.join(rows, ["k", "th"]).select(rows.columns)).unionByName(likely(rows, again, ["k", "th"]).join(again.select("k", "th"), ["k", "th"], "left_anti"))
    return rows.select(doc_id(), "text", "sketch", "edited", "edited_sketch", "near_edited", "near_next")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("sketch")).alias("fingerprint"), shown(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
