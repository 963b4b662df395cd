"""Ranked lexical search over a tiered index.

Every posting has an impact of its own, so a term's postings are dealt into tiers by it: the highest FIRST of a term at
most, then GROWTH times as many, and so on; the last tier has the rest. Beside each term stands the residual bound of each
tier: the highest impact of any of its postings further down. Where tiers begin is read off histograms of impacts, so a
frequent word's postings are never put in order in one place.

A batch of items starts on the first tier. What its terms have there are candidates, scored exactly from the forward
index (a row a document). An item is proven when the sum of its terms' residual bounds is below its lowest score kept: no
document unseen can reach it. Items that lack that proof fall through to the next tier, there with only those of their
terms whose bounds together could still reach that score (a document without any of these can't), until all are proven;
the last tier leaves no bound. A document is scored only where the postings just read, with the bounds of the other terms,
can reach the lowest score kept. So scores and order are those of a full scan, and each result tells its tier.

Scores are whole numbers: a term's weight floor(1000 ln((2N + 2) / (2 df + 1))), times 10^9 tf div (1000 tf + 8 m), where
m is 10 + 90 n N div L. Terms are runs of letters, digits and all above U+007F, A-Z lower-cased; an item's count once.
Statistics count all documents.

A null text has no terms; a null doc_id is a document like any other and comes first among equal scores; rows that repeat
a doc_id, or all, are documents of their own, in the order of their texts' hashes. Items that repeat get a result each; an item
without terms, or whose terms no document has, gets no rows, nor do empty tables. Whole texts of any length count. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, doc_id, keyed, slices

K = 10
FIRST, GROWTH = 32, 8
#: Items are searched in blocks of so many terms, and items, at most.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 10_000
#: Impacts of weight one lie below 10^6; a histogram has a count for each of so many.
STEP = 4096
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bits of the filter that keeps terms nobody asks for out of an index.
ASKED_BITS = 1 << 22


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(q, item_id, term) of items (q, item_id, text): a row a distinct term."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            each = [sorted(set(terms_of(t or b""))) for t in b.column("text").cast(pa.binary()).to_pylist()]
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in each])
            yield pa.RecordBatch.from_pydict({"q": b.column("q").take(pa.array(at)), "term": pa.array([t for x in each for t in x], pa.binary()).cast(pa.string())})

    return items.select("q", F.col("text").cast("string").alias("text")).mapInArrow(run, "q long, term string")


@dataclass
class Index:
    """forward: (d, k, th, n, terms, tfs) a document, all its terms counted in n, those of the index listed; terms: (term, df, w,
    bounds, floors); postings: (tier, term, d, hit), hit without its weight. tiers: how many there are. n, l: documents with terms, terms."""

    forward: DataFrame
    terms: DataFrame
    postings: DataFrame
    tiers: int
    n: int
    l: int


def _asked(terms: DataFrame | None) -> np.ndarray | None:
    """The filter of terms: a bit for each of ASKED_BITS, so of a fixed size."""
    if terms is None:
        return None
    at = F.pmod(F.xxhash64("term"), F.lit(ASKED_BITS))
    bits = np.zeros(ASKED_BITS, bool)
    words = terms.select(F.shiftright(at, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    for w, b in words.collect():  # ASKED_BITS / 32 rows at most
        bits[w * 32 : w * 32 + 32] = [b >> i & 1 for i in range(32)]
    return np.packbits(bits, bitorder="little")


def forward_rows(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(k, th, n, terms, tfs) of each document with a term: its distinct terms (with `terms`, those that may be among
    them) and their counts."""
    bits = _asked(terms)

    def run(batches):
        class Wanted(dict):
            def __missing__(self, word):
                if len(self) >= 300_000:
                    self.clear()
                at = xxhash.xxh64_intdigest(word, 42) % ASKED_BITS
                self[word] = word if bits is None or bits[at >> 3] >> (at & 7) & 1 else None
                return self[word]

        wanted = Wanted()
        for b in (part for whole in batches for part in slices(whole)):
            rows, ns, own, tfs = [], [], [], []
            for i, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                words = terms_of(t)
                if not words:
                    continue
                counts: dict[bytes, int] = {}
                for w in map(wanted.__getitem__, words):
                    if w is not None:
                        counts[w] = counts.get(w, 0) + 1
                rows.append(i)
                ns.append(len(words))
                own.append(list(counts))
                tfs.append(list(counts.values()))
            kept = b.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_pydict({"k": kept.column("k"), "th": kept.column("th"), "n": pa.array(ns, pa.int64()), "terms": pa.array(own, pa.list_(pa.binary())).cast(pa.list_(pa.string())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})

    return keyed(docs).select("k", "th", "text").mapInArrow(run, "k long, th long, n long, terms array<string>, tfs array<bigint>")


def hit(n: Column, tf: Column, docs: int, words: int) -> Column:
    """A posting's impact of weight one."""
    m = 10 + F.call_function("div", 90 * n * F.lit(docs).cast("long"), F.lit(max(words, 1)).cast("long"))
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, 1000 * tf + 8 * m)


def _tiers(n: int, first: int, growth: int) -> list[int]:
    """How many postings of a term all tiers but the last hold at most, each with those above it."""
    out = [first]
    while out[-1] * growth < n:
        out.append(out[-1] * growth)
    return out


def build(spark: SparkSession, docs: DataFrame, scratch: Scratch, terms: DataFrame | None = None, first: int = FIRST, growth: int = GROWTH) -> Index:
    """The index of docs, written. With `terms` (term), of these terms alone: a batch whose items are known needs no others."""
    forward = forward_rows(docs, terms).withColumn("d", F.monotonically_increasing_id())
    forward = scratch.write(forward, "forward")
    n, l = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = forward.select("d", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("d", F.col("x.terms").alias("term"), hit(F.col("n"), F.col("x.tfs"), n, l).alias("hit"))
    # A term's histogram has a row for each step of impacts, made where postings are.
    steps = each.groupBy("term", F.shiftright("hit", STEP.bit_length() - 1).alias("step")).agg(F.count("*").alias("c"), F.max("hit").alias("high"))
    down = Window.partitionBy("term").orderBy(F.desc("step"))
    steps = steps.withColumn("upto", F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    limits = _tiers(n, first, growth)
    floors = [F.min(F.when(F.col("upto") <= m, F.col("step"))).alias(f"f{i}") for i, m in enumerate(limits)]
    bounds = [F.coalesce(F.max(F.when(F.col("upto") > m, F.col("high"))), F.lit(0)).alias(f"r{i}") for i, m in enumerate(limits)]
    # Above all steps: a tier that takes nothing of a term.
    own = steps.groupBy("term").agg(F.sum("c").alias("df"), *floors, *bounds)
    own = own.select("term", "df", F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"), F.array(*[f"r{i}" for i in range(len(limits))], F.lit(0).cast("long")).alias("bounds"), F.array(*[F.coalesce(f"f{i}", F.lit(1 << 40)) for i in range(len(limits))]).alias("floors"))
    if terms is not None:
        own = own.join(terms.select("term").distinct(), "term", "left_semi")
    own = scratch.write(own, "terms")
    tier = F.size(F.filter("floors", lambda f: F.shiftright("hit", STEP.bit_length() - 1) < f))
    postings = each.join(own.filter("w > 0").select("term", "floors"), "term").select("term", "d", "hit", tier.alias("tier"))
    scratch.tables.append("postings")
    postings.write.partitionBy("tier").parquet(scratch.path("postings"))
    postings = spark.read.schema("term string, d long, hit long, tier int").parquet(scratch.path("postings"))
    return Index(forward, own, postings, len(limits) + 1, n, l)


def _blocks(asked: DataFrame) -> list[int]:
    """Blocks of items, in column `block` of the table asked, of BLOCK_TERMS terms and BLOCK_ITEMS items at most (an item
    with more terms is a block of its own)."""
    return [r[0] for r in asked.select("block").distinct().collect()]


def _in_blocks(terms: DataFrame) -> DataFrame:
    """terms (q, term, ...) with the block of each item: items that were read by one task, cut by their terms."""
    sizes = terms.groupBy("q").agg(F.count("*").alias("c"))
    run = Window.partitionBy(F.shiftright("q", 33)).orderBy("q")
    upto = sizes.select("q", F.sum("c").over(run).alias("words"), F.row_number().over(run).alias("items"))
    block = F.xxhash64(F.shiftright("q", 33), F.floor(F.col("words") / BLOCK_TERMS), F.floor(F.col("items") / BLOCK_ITEMS))
    return terms.join(upto.select("q", block.alias("block")), "q")


def _scored(index: Index, candidates: DataFrame, asked: dict[int, tuple[list, list]], k: int) -> DataFrame:
    """(q, d, k, th, score) of candidates (d, qs): each task's k best of an item. asked: the terms and weights of a block's items."""
    n, l = index.n, index.l
    rows = candidates.join(index.forward.select("d", "k", "th", "n", "terms", "tfs"), "d")
    weights = candidates.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        of = {q: list(zip(ts, ws)) for q, (ts, ws) in weights.value.items()}
        best: dict[int, list] = {}
        for b in (part for whole in batches for part in slices(whole, "tfs")):
            for d, key, th, own_n, terms, tfs, qs in zip(*(b.column(c).to_pylist() for c in ("d", "k", "th", "n", "terms", "tfs", "qs"))):
                m = 8 * (10 + 90 * own_n * n // l)
                own = {t: 1_000_000_000 * tf // (1000 * tf + m) for t, tf in zip(terms, tfs)}
                for q in qs:
                    score = 0
                    for t, w in of[q]:
                        if (h := own.get(t)) is not None:
                            score += w * h
                    kept = best.setdefault(q, [])
                    kept.append((-score, key, th, d))
                    if len(kept) >= 8 * k:
                        kept.sort()
                        del kept[k:]
        rows = [(q, d, key, th, -score) for q, kept in best.items() for score, key, th, d in sorted(kept)[:k] if score]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["q", "d", "k", "th", "score"])

    return rows.mapInArrow(run, "q long, d long, k long, th long, score long")


class _Item:
    """What one item of a block has read: terms (term, weight, bounds by tier), and the lowest tier read of each."""

    def __init__(self, terms: list[tuple[str, int, list[int]]]):
        self.terms, self.at, self.floor, self.proven = terms, [-1] * len(terms), 1, None

    def bound(self, i: int) -> int:
        _, w, bounds = self.terms[i]
        return w * bounds[self.at[i]] if self.at[i] >= 0 else 1 << 60

    def wanting(self) -> list[int]:
        """Terms that need more reading: those left when as many as can't reach the floor together, the least first, go."""
        order, total = sorted(range(len(self.terms)), key=self.bound), 0
        for at, i in enumerate(order):
            total += self.bound(i)
            if total >= self.floor:
                return order[at:]
        return []


def _searched(index: Index, rows: list, scratch: Scratch, name: str, k: int) -> DataFrame:
    """(q, rank, k, score, tier) of one block's items; rows: (q, term, w, bounds)."""
    spark, items = index.terms.sparkSession, {}
    for r in rows:
        items.setdefault(r.q, []).append((r.term, r.w, r.bounds))
    asked = {q: ([t for t, *_ in ts], [w for _, w, _ in ts]) for q, ts in items.items()}
    items = {q: _Item(ts) for q, ts in items.items()}
    best = None
    place = Window.partitionBy("q").orderBy(F.desc("score"), "k", "th", "d")
    for t in range(index.tiers):
        reads = []
        for q, item in items.items():
            if item.proven is None:
                need = item.wanting()
                if not need:
                    item.proven = t - 1
                    continue
                before = [item.at[i] for i in need]
                for i in need:
                    item.at[i] = t
                # What a document not seen before can have beside the postings that are read now.
                rest = sum(map(item.bound, range(len(item.terms))))
                reads += [(item.terms[i][0], q, item.terms[i][1], item.bound(i), at, rest, item.floor) for i, at in zip(need, before)]
        if not reads:
            break
        table = spark.createDataFrame(reads, "term string, q long, w long, after long, at int, rest long, floor long")
        own = index.postings.filter(F.col("tier") <= t).join(F.broadcast(table), "term").filter("tier > at")  # BLOCK_TERMS rows
        pairs = own.repartition("d").groupBy("d", "q").agg(F.sum(F.col("w") * F.col("hit") - F.col("after")).alias("gain"), F.first("rest").alias("rest"), F.first("floor").alias("floor"))
        found = pairs.filter("gain + rest >= floor").groupBy("d").agg(F.collect_list("q").alias("qs"))  # a block's items
        found = _scored(index, scratch.write(found, f"{name}-candidates-{t}"), asked, k)
        if best is not None:
            found = found.join(best.select("q", "d"), ["q", "d"], "left_anti").unionByName(best.drop("rank"))
        best = scratch.write(found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k), f"{name}-best-{t}", free=True)
        scratch.drop(f"{name}-candidates-{t}", f"{name}-best-{t - 1}")
        for q, floor in best.filter(F.col("rank") == k).select("q", "score").collect():  # a block's items
            items[q].floor = floor
    tiers = spark.createDataFrame([(q, index.tiers - 1 if i.proven is None else i.proven) for q, i in items.items()], "q long, tier int")
    return best.join(F.broadcast(tiers), "q").select("q", "rank", "k", "score", "tier")


def search(index: Index, items: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
    """(q, rank, k, score, tier) of each item's k best documents; items: (q, text). Items are searched in blocks of a bounded
    size: what each has read, and its lowest score kept, is with the driver, never a document or a posting."""
    terms = item_terms(items).join(index.terms.filter("w > 0"), "term").select("q", "term", "w", "bounds")
    asked = scratch.write(_in_blocks(terms), "asked")
    out = none = index.terms.sparkSession.createDataFrame([], "q long, rank int, k long, score long, tier int")
    for i, block in enumerate(_blocks(asked)):
        rows = asked.filter(F.col("block") == block).drop("block").collect()  # BLOCK_TERMS rows
        found = _searched(index, rows, scratch, f"block-{i}", k)
        out = found if out is none else out.unionByName(found)
    return out


def ranked_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = K, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(item_id, rank, doc_id, score, tier): the k best documents of each item, from an index of the items' terms."""
    scratch = Scratch(spark, "search")
    rows = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("q", F.monotonically_increasing_id())
    rows = scratch.write(rows, "items")
    index = build(spark, docs, scratch, item_terms(rows).select("term").distinct(), first, growth)
    found = search(index, rows, scratch, k)
    return found.join(rows.select("q", "item_id"), "q").select("item_id", "rank", doc_id(), "score", "tier")
