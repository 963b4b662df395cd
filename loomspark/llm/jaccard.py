"""N-gram Jaccard join: documents whose shingle sets are within a Jaccard distance, exactly, and their groups.

Distance is 1 - |x & y| / |x | y|, a metric; eps is the greatest distance of a link. The space is cut twice.

1. Voronoi regions of elementary pivots. Texts that are no copies have distance 1 from any document, so documents as
   first pivots would tell nothing apart: nearly all of them lie within eps of every border and go to every region. The
   first pivots are the shingles themselves, as sets of one: a document lies nearest to those it holds, ties going to the
   rarest. What can be within eps of a document differs from it in less than eps of their union, so the first `common`
   shingles of both are among the rarest floor(eps |x|) + common of either: this window is where a document is
   replicated. A twice-seen filter (seen.py) keeps shingles that one class alone holds out of the shuffle, and a class
   that shares too little of its window is done. Sizes and ranks in the window rule out pairs inside a region.
2. Tiny regions give pairs, which must meet in `common` of them. Larger ones give their middles, members with the
   least of their own in their windows. Each document is compared with the middles of its regions and with its best
   partner; what that links is one group, and its pairs need no further comparison.
3. What lies outside a region's largest group is compared with all that is not of its own group: fixed-size maps of the
   sets first, whole sets of the pairs that these leave. Regions with more than leaf * leaf such pairs are joined
   recursively with document pivots: each round takes four times as many pivots a region, compares all members with them
   and retires them. By the triangle inequality a member within d of a pivot links with no member beyond d + eps: it
   leaves the region unless such a border is near. Rounds go on until no region is that large, so no task gets all pairs
   of an unbounded region. (Many texts of one family that lie just beyond eps of each other still cost the square of
   their number in comparisons of fixed-size maps, spread over rounds and tasks: no exact method is known to avoid it.)

Every link that decides a group is checked with the whole sets; they are fetched only for pairs that fixed-size cell maps
leave. Rarity comes from a counter table of fixed size over all shingles of all documents; any order gives the same
result, rarity only makes regions small. The filter has MAX_BITS at most; beyond that more shingles are shuffled.
Equal sets are one class, and classes are joined; groups come from alternating stars, in Spark.

Words: A-Z lower-cased, runs without ASCII white space. Fewer words than a shingle make one shingle of all. Texts
without words (or null) have an empty set and link with nothing. Rows that share a doc_id are one document with
several texts: it links by any. A null doc_id counts as the lowest. Whole texts are read, a few MB at a time; a very long
one is one set. Ties (of rarity, of middles, of partners) go to the lower hash or doc_id and change no result. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, doc_id, free_names, gram_hashes, keyed, likely, mapped, slices, slots, word_hashes
from loomspark.llm.components import components
from loomspark.llm.seen import size_for, twice_seen

CELLS, SEGMENT = 1 << 20, 1 << 14
MAX_BITS = 1 << 28  # of the twice-seen filter, 32 MB
SIG = 2048
COMMON = 4
TINY = 16
MIDDLES = 16
LEAF = 4096
PIVOTS = 32


def shingle_sets(batch: pa.RecordBatch, size: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The slices of a batch with the sorted distinct 64-bit hashes of each text's shingles."""
    for part in slices(batch, most=most):
        h, n = word_hashes([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
        grams, sets, at = gram_hashes(h, size), [], 0
        for c in n.tolist():
            own = np.sort(grams[at : at + c - size + 1] if c >= size else gram_hashes(h[at : at + c], c) if c else h[:0])
            new = own[1:] != own[:-1]
            sets.append(own if new.all() else own[np.concatenate(([True], new))])
            at += c
        yield part, sets


def rarity(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents hold the shingles of each cell: CELLS counters, whatever the corpus."""

    def count(batches):
        cells = np.zeros(CELLS, np.int64)
        for b in batches:
            for _, sets in shingle_sets(b, size):
                cells += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        for s in range(0, CELLS, SEGMENT):
            part = cells[s : s + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "cells": [zlib.compress(part.tobytes(), 1)]})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                held[r["segment"]] = held.get(r["segment"], 0) + np.frombuffer(zlib.decompress(r["cells"]), np.int64)
        for s, part in held.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "cells": [zlib.compress(part.tobytes(), 1)]})

    kind = "segment int, cells binary"
    out = np.zeros(CELLS, np.int64)
    for r in mapped(rows.select("text"), count, kind).repartition(slots(rows.sparkSession), "segment").mapInArrow(merge, kind).collect():  # CELLS / SEGMENT rows
        out[r.segment : r.segment + SEGMENT] = np.frombuffer(zlib.decompress(r.cells), np.int64)
    return out


def within(both: Column, nx: Column, ny: Column, percent: int) -> Column:
    """Whether sets that share `both` shingles are linked."""
    return F.lit(100).cast("long") * both >= F.lit(percent).cast("long") * (nx + ny - both)


def windows(rows: DataFrame, size: int, percent: int, common: int, cells) -> DataFrame:
    """(k, n, s1, s2, window): set size, 128-bit set digest, the rarest shingles in order. A task gives the window of
    equal sets once."""

    def run(batches):
        order, seen = cells.value, set()
        for b, sets in (part for whole in batches for part in shingle_sets(whole, size)):
            n, s1, s2, win = [], [], [], []
            for h in sets:
                d = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8")
                key = d.tobytes()
                n.append(len(h))
                s1.append(int(d[0]))
                s2.append(int(d[1]))
                if not len(h) or key in seen:
                    win.append(None)
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                length = len(h) - (percent * len(h) + 99) // 100 + common
                rank = order[(h & np.uint64(CELLS - 1)).astype(np.int64)]
                if length < len(h):  # only what can be in the window is sorted; equal ranks go by hash
                    some = np.flatnonzero(rank <= np.partition(rank, length)[length])
                    h, rank = h[some], rank[some]
                win.append(h[np.lexsort((h, rank))[:length]].view(np.int64))
            yield pa.RecordBatch.from_pydict({"k": b.column("k"), "n": pa.array(n, pa.int64()), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "window": pa.array(win, pa.list_(pa.int64()))})

    return mapped(rows.select("k", "text"), run, "k long, n long, s1 long, s2 long, window array<long>")


def batch_windows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The window of each class, as hashes."""
    for part in slices(batch, "window"):
        column = part.column("window")
        flat, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(pc.list_value_length(column).to_numpy())
        yield from np.split(flat, ends[:-1])


def placed(classes: DataFrame, percent: int, common: int, known) -> DataFrame:
    """(x, n, pos, region, early) of window shingles that other classes may hold too. A class that is left with fewer
    than its links must share has none. early: the smaller of two linked sets holds each of the first `common` shingles
    of both so early."""

    def run(batches):
        for whole in batches:
            for b, windows in ((part, list(batch_windows(part))) for part in slices(whole, "window")):
                out = [[] for _ in range(5)]
                for x, n, w in zip(b.column("x").to_pylist(), b.column("n").to_pylist(), windows):
                    pos = np.flatnonzero(known.value.has(w))
                    if len(pos) >= least_shared(n, percent, common):
                        early = (100 + percent) * (pos - common + 1) <= n * (100 - percent)
                        for c, v in zip(out, (np.full(len(pos), x), np.full(len(pos), n, np.int32), pos.astype(np.int32), w[pos].view(np.int64), early)):
                            c.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in zip(("x", "n", "pos", "region", "early"), out)})

    return classes.select("x", "n", "window").mapInArrow(run, "x long, n int, pos int, region long, early boolean")


def least_shared(n: int, percent: int, common: int) -> int:
    """How many shingles of its window a set of n shares with any set that it is linked with, at least."""
    return min(common, -(-percent * n // 100))


def sets_of(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(x, h, n, sig): the shingle hashes of the documents named in ids, how many, and which of SIG cells they fall in.
    Texts are not shuffled: a bitmap picks them, and the few others that it lets pass are never asked for."""

    wanted = ids.select(F.col("x").alias("k"))

    def run(batches):
        for b, hs in (part for whole in batches for part in shingle_sets(whole, size)):
            cells = np.zeros((len(hs), SIG), bool)
            for row, h in zip(cells, hs):
                row[(h & np.uint64(SIG - 1)).astype(np.int64)] = True
            sigs = list(np.packbits(cells, 1, "little").view("<i8"))
            yield pa.RecordBatch.from_pydict({"x": b.column("k"), "h": pa.array([h.view(np.int64) for h in hs], pa.list_(pa.int64())), "n": pa.array([len(h) for h in hs], pa.int64()), "sig": pa.array(sigs, pa.list_(pa.int64()))})

    return mapped(likely(rows.select("k", "text"), wanted, ["k"], 1 << 25), run, "x long, h array<long>, n long, sig array<long>")


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, nx, ny, most): the most shingles that two sets can share. Each cell that only one of them falls in holds a
    shingle of it alone."""
    a, b = sets.select("x", F.col("n").alias("nx"), F.col("sig").alias("sx")), sets.select(F.col("x").alias("y"), F.col("n").alias("ny"), F.col("sig").alias("sy"))

    def alone(p: str, q: str) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j)))), F.lit(0), lambda acc, n: acc + n)

    return pairs.join(a, "x").join(b, "y").select("x", "y", "nx", "ny", F.least(F.col("nx") - alone("sx", "sy"), F.col("ny") - alone("sy", "sx")).alias("most"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, table: str) -> DataFrame:
    """(x, y, d): the pairs that are linked and their distance, from the whole sets. Whole sets are fetched only for
    pairs that the bound leaves."""
    left = bounded(pairs, sets).filter(within(F.col("most"), F.col("nx"), F.col("ny"), percent)).select("x", "y", "nx", "ny")
    left = scratch.write(left, f"{table}-bounded")
    asked = likely(sets.select("x", "h"), left.select("x").unionByName(left.select(F.col("y").alias("x"))), ["x"])
    a, b = asked.select("x", F.col("h").alias("hx")), asked.select(F.col("x").alias("y"), F.col("h").alias("hy"))
    both = left.join(a, "x").join(b, "y").select("x", "y", "nx", "ny", F.size(F.array_intersect("hx", "hy")).cast("long").alias("i"))
    distance = 1 - F.col("i") / (F.col("nx") + F.col("ny") - F.col("i"))
    return scratch.write(both.filter(within(F.col("i"), F.col("nx"), F.col("ny"), percent)).select("x", "y", distance.alias("d")), table, free=True)


def fits(a: str, b: str, percent: int, common: int) -> Column:
    """Whether two members of a region can link there: by size, and by how much may follow their ranks. Fewer than
    `common` shared shingles come before."""
    na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    most = common + F.least(na - F.col(f"{a}.pos") - 1, nb - F.col(f"{b}.pos") - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def smaller(a: str, b: str) -> Column:
    return (F.col(f"{a}.n") < F.col(f"{b}.n")) | ((F.col(f"{a}.n") == F.col(f"{b}.n")) & (F.col(f"{a}.x") < F.col(f"{b}.x")))


def tagged(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """df with the group that `column` is in so far."""
    own = roots.select(F.col("u").alias(column), F.col("v").alias(name))
    return df.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def compared(few: DataFrame, percent: int, common: int) -> DataFrame:
    """(x, y, m): pairs of members of different groups that may be linked, and their greatest likeness. few: members with
    region, x, n, pos, early, tag, top (their region's largest group), held (their regions, in order), sig and met. A link is found in the first region that both are in, if that is among the first `common` shingles of
    both; there it passes what sizes and ranks rule out, which is told before maps are looked at. (Maps are
    one column each: with one for each of their words the join was a method too long for the JVM to compile.)"""
    a, b = few.filter("tag <> top").alias("a"), few.alias("b")
    once = (F.col("b.tag") == F.col("b.top")) | (F.col("a.x") < F.col("b.x"))  # top is the region's
    ranked = fits("a", "b", percent, common) & F.when(smaller("a", "b"), F.col("a.early")).otherwise(F.col("b.early"))
    # Each cell that one map has alone holds a shingle of its set alone; `met` shingles of a set share its cells.
    both = F.zip_with("a.sig", "b.sig", lambda i, j: F.bit_count(i.bitwiseAND(j)))
    most = F.least("a.met", "b.met") + F.aggregate(both, F.lit(0), lambda acc, n: acc + n)
    possible = F.lit(100 + percent) * most >= F.lit(percent) * (F.col("a.n") + F.col("b.n"))
    # Two members that meet in several regions are a pair in one of them. (Windows have one order.)
    here = F.col("a.region") == F.get(F.array_intersect("a.held", "b.held"), F.lit(0))
    pairs = a.join(b, (F.col("a.region") == F.col("b.region")) & (F.col("a.tag") != F.col("b.tag")) & once & ranked & possible & here)
    return pairs.select(F.least("a.x", "b.x").alias("x"), F.greatest("a.x", "b.x").alias("y"), (most / (F.col("a.n") + F.col("b.n") - most)).alias("m"))


def links(rows: DataFrame, classes: DataFrame, scratch: Scratch, size: int, percent: int, leaf: int = LEAF, common: int = COMMON) -> DataFrame:
    """(u, v): edges between classes that connect all that links connect."""
    spark, eps = rows.sparkSession, 1 - percent / 100
    entries = classes.agg(F.sum(F.size("window"))).first()[0] or 0
    known = spark.sparkContext.broadcast(twice_seen(classes.select("window"), batch_windows, size_for(int(entries), 8, MAX_BITS)))
    places = placed(classes, percent, common, known)

    # Regions with an early member and another one; members that share enough of their window with others.
    regions = places.groupBy("region").agg(F.count("*").alias("c"), F.count_if("early").alias("e")).filter("c > 1 and e > 0")
    met = scratch.write(places.join(scratch.write(regions.select("region", "c"), "regions"), "region"), "met", free=True)
    known.unpersist()
    need = F.least(F.lit(common), F.ceil(percent * F.col("n") / 100))
    enough = met.groupBy("x").agg(F.count("*").alias("m"), F.first("n").alias("n")).filter(F.col("m") >= need)
    # What a window holds beyond shared shingles tells how far a member is from its family's middle.
    enough = scratch.write(enough.select("x", (F.ceil((100 - percent) * F.col("n") / 100) - F.col("m")).alias("own")), "enough")
    members = scratch.write(met.join(enough, "x"), "members")
    scratch.drop("classes", "regions", "met", "enough")

    # Pairs of tiny regions: those that share enough of both windows. (All of a link's first `common` shared shingles
    # are in tiny regions, or one is in a larger region, which finds the link by itself.)
    a, b = members.filter(F.col("c") <= TINY).filter("early").alias("a"), members.filter(F.col("c") <= TINY).alias("b")
    larger = F.greatest("a.n", "b.n")
    tiny = a.join(b, (F.col("a.region") == F.col("b.region")) & smaller("a", "b") & fits("a", "b", percent, common))
    tiny = tiny.groupBy(F.col("a.x").alias("x"), F.col("b.x").alias("y")).agg(F.count("*").alias("m"), F.max(F.least(F.lit(common), F.ceil(percent * larger / 100))).alias("need"))
    tiny = scratch.write(tiny.filter("m >= need").select("x", "y", "m"), "tiny")

    # First stars: whom a member shares most with, and the middles of its larger regions. Copies of one text are one
    # group after that, and few of their pairs are left to compare.
    large = members.filter(F.col("c") > TINY)
    ids = tiny.select("x").unionByName(tiny.select(F.col("y").alias("x"))).unionByName(large.select("x")).distinct()
    sets = scratch.write(sets_of(rows, ids, size), "sets")
    both = tiny.unionByName(tiny.select(F.col("y").alias("x"), F.col("x").alias("y"), "m"))
    best = both.groupBy("x").agg(F.max(F.struct("m", F.bitwise_not("y").alias("y"))).alias("b"), F.min("y").alias("low"))
    best = best.select("x", F.explode(F.array_distinct(F.array(F.bitwise_not("b.y"), "low"))).alias("y"))
    share = F.when(F.col("c") > 4 * TINY, F.pmod(F.xxhash64("x"), F.lit(MIDDLES))).otherwise(0)
    middle = large.groupBy("region", share.alias("share")).agg(F.min(F.struct("own", "x", "n", "pos")).alias("p"))
    middle = scratch.write(middle.select("region", F.col("p.x").alias("x"), F.col("p.n").alias("n"), F.col("p.pos").alias("pos")), "middles")
    star = large.alias("a").join(middle.alias("b"), (F.col("a.region") == F.col("b.region")) & (F.col("a.x") != F.col("b.x")) & fits("a", "b", percent, common))
    star = star.select(F.col("a.x").alias("x"), F.col("b.x").alias("y")).unionByName(best)
    star = scratch.write(star.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "stars")

    def joined(near: DataFrame, roots: DataFrame | None, table: str) -> DataFrame:
        edges = near.select(F.col("x").alias("u"), F.col("y").alias("v"))
        return components(edges if roots is None else edges.unionByName(roots), scratch, table)

    roots = joined(linked(star, sets, percent, scratch, "links-star"), None, "groups-star")

    # Larger regions: members of one group need no comparison, so those outside a region's largest group are compared with
    # all that are not of their own. Pivots are retired once compared with all others.
    rest, r = [tiny.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.lit(0.0).alias("m"))], 0
    shared = F.aggregate("sig", F.lit(0), lambda acc, word: acc + F.bit_count(word))
    maps = sets.select("x", F.col("n").cast("int").alias("n"), "sig", (F.col("n") - shared).cast("int").alias("met"))
    state = large.select("region", "x", "n", "pos", "early")
    while True:
        own = tagged(state, roots, "x", "tag")
        live = own.groupBy("region", "tag").agg(F.count("*").alias("t"), F.count_if("early").alias("e"))
        live = live.groupBy("region").agg(F.sum("t").alias("c"), F.sum("e").alias("e"), F.max(F.struct("t", "tag")).alias("top"))
        live = live.filter("e > 0 and top.t < c").select("region", "c", (F.col("c") - F.col("top.t")).alias("apart"), F.col("top.tag").alias("top"))
        live = scratch.write(live, f"live-{r}")
        state = scratch.write(own.join(live, "region"), f"state-{r}")
        work = F.col("apart") * F.col("c")
        # Members carry their cell maps, so pairs that these rule out never become rows.
        few = state.filter(work <= leaf * leaf)
        held = few.groupBy("x").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "region"))), lambda h: h["region"]).alias("held"))  # of one window
        few = scratch.write(few.join(maps, ["x", "n"]).join(held, "x"), f"few-{r}")
        # Tasks by comparisons: the bytes of regions do not tell them.
        total = live.filter(work <= leaf * leaf).agg(F.sum(work)).first()[0] or 0
        pairs = compared(few.repartition(min(max(4 * slots(spark), total >> 24), 1 << 13), "region"), percent, common)
        rest.append(scratch.write(pairs.groupBy("x", "y").agg(F.max("m").alias("m")), f"pairs-{r}"))
        state = state.filter(work > leaf * leaf)
        if not state.limit(1).count():
            break
        # Four times as many pivots a region each round, each the middle of a share of the members: rounds are few.
        share = F.pmod(F.xxhash64("x", F.lit(r)), F.lit(PIVOTS << (2 * r)))
        pivots = state.groupBy("region", share.alias("share")).agg(F.min(F.struct("pos", "x", "n")).alias("p"))
        pivots = scratch.write(pivots.select("region", F.col("p.x").alias("x"), F.col("p.n").alias("n"), F.col("p.pos").alias("pos")), f"pivots-{r}")
        asked = state.alias("a").join(pivots.alias("b"), (F.col("a.region") == F.col("b.region")) & (F.col("a.x") != F.col("b.x")))
        asked = scratch.write(asked.select("a.region", F.col("a.x").alias("x"), F.col("b.x").alias("y")), f"asked-{r}")
        pairs = asked.select("x", "y").distinct()
        near = linked(pairs, sets, percent, scratch, f"links-{r}")
        far = bounded(pairs, sets).select("x", "y", (1 - F.col("most") / (F.col("nx") + F.col("ny") - F.col("most"))).alias("far"))
        # Triangle inequality: a member within d of a pivot whose others are all farther than d + eps links with none of
        # those; with the pivot's own group it needs no further link. It leaves the region.
        seen = asked.join(near, ["x", "y"], "left").join(far, ["x", "y"])
        edge = seen.groupBy("region", "y").agg(F.min(F.when(F.col("d").isNull(), F.col("far"))).alias("edge"))
        deep = seen.filter("d is not null").join(edge, ["region", "y"]).filter(F.col("edge").isNull() | (F.col("d") + eps + 1e-9 < F.col("edge"))).select("region", "x")
        gone = scratch.write(deep.unionByName(pivots.select("region", "x")).distinct(), f"gone-{r}")
        roots, r = joined(near, roots, f"groups-{r}"), r + 1
        state = state.select("region", "x", "n", "pos", "early").join(gone, ["region", "x"], "left_anti")
    # Once more each member's best partner first, then what that leaves apart. (Pairs of regions are of two groups.)
    apart = lambda pairs: tagged(tagged(pairs, roots, "x", "gx"), roots, "y", "gy").filter("gx <> gy")
    left = apart(rest[0]).select("x", "y", "m")
    for p in rest[1:]:
        left = left.unionByName(p)
    left = scratch.write(left, "rest")
    both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y"), "m"))
    best = both.groupBy("x").agg(F.max(F.struct("m", "y")).alias("b")).select(F.least("x", "b.y").alias("x"), F.greatest("x", "b.y").alias("y")).distinct()
    roots = joined(linked(best, sets, percent, scratch, "links-best"), roots, "groups-best")
    left = apart(left).select("x", "y").distinct()
    last = linked(left, sets, percent, scratch, "links-last").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return last.unionByName(roots)


def groups(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, leaf: int = LEAF, common: int = COMMON) -> DataFrame:
    """(k, n, class, component): set size, lowest document with an equal set, lowest document of the group."""
    scratch, rows = Scratch(spark, "jaccard"), keyed(docs)
    cells = spark.sparkContext.broadcast(rarity(rows, size))
    sets = scratch.write(windows(rows, size, percent, common, cells), "windows")
    cells.unpersist()
    full = sets.filter("n > 0")
    classes = scratch.write(full.groupBy("s1", "s2").agg(F.min("k").alias("x"), F.first("n").alias("n"), F.first("window", ignorenulls=True).alias("window")), "classes", free=True)
    names = scratch.write(classes.select("s1", "s2", "x"), "names")
    keys = scratch.write(sets.select("k", "n", "s1", "s2"), "keys")
    scratch.drop("windows")
    edges, full = links(rows, classes, scratch, size, percent, leaf, common), keys.filter("n > 0")
    of = full.select("k", "s1", "s2").join(names, ["s1", "s2"])
    # A doc_id with several texts joins the classes that it is in.
    split = of.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("lo < hi").select("k", "lo")
    bridged = of.join(split, "k").filter("x > lo").select(F.col("lo").alias("u"), F.col("x").alias("v"))
    roots = components(edges.unionByName(bridged), scratch)
    labels = scratch.write(tagged(names, roots, "x", "c"), "labels")
    out = keys.join(labels, ["s1", "s2"], "left")
    scratch.drop_others("labels", "keys")
    own = F.col("n") == 0
    return out.select("k", "n", F.when(own, F.col("k")).otherwise(F.col("x")).alias("class"), F.when(own, F.col("k")).otherwise(F.col("c")).alias("component"))


def one_of_each(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates: the lowest doc_id's. Each text is a document of its own, also
    where several have one doc_id or none: the lowest text hash of an id goes by the id, all other texts by keys of their
    own behind all ids below 2^62, so a group keeps one of them only where none of its members goes by an id. Of equal
    rows one stays. Rows without a doc_id and without words link with nothing and stay."""
    k, th, low = free_names(docs, "k", "th", "low")
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0d]")
    named = F.col("doc_id").isNotNull()
    rows = docs.filter(named | worded).withColumns({k: F.col("doc_id").cast("long"), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    shared = rows.filter(named).groupBy(k).agg(F.min(th).alias(low), F.max(th).alias("high")).filter(F.col(low) < F.col("high")).drop("high")
    # Written, so that its size is known: a few ids are broadcast, and texts are shuffled only where they are many.
    rows = rows.join(Scratch(spark, "ids").write(shared, "shared"), k, "left")
    behind = lambda *x: F.lit(2**63 - 1) - F.shiftrightunsigned(F.xxhash64(*x), 2)
    rows = rows.withColumn(k, F.when(~named, behind(th)).when(F.col(th) > F.col(low), behind(k, th)).otherwise(F.col(k)))
    kept = groups(spark, rows.select(F.col(k).alias("doc_id"), "text"), size, percent).filter("k = component").select(F.col("k").alias(k)).distinct()
    one = rows.join(kept, k).dropDuplicates([k]).select(*docs.columns)
    return one.unionByName(docs.filter(~named & ~worded))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(doc_id(), F.col("n").alias("n_shingles"), doc_id("component").alias("component_id"))
