"""A persisted inverted index: BM25 over units that were tokenised once, kept up to date by segments.

Units lie in ranges of up to RANGE of them. A posting block holds what one term has in one range, beside the greatest count
and the least length in it, whatever the statistics are at query time: from these follows the most that the block can add
to a score. A query reads the heads of its terms' blocks (their bucket alone), sums the bounds of each range, scores the
most promising ranges whole, and then only those whose bound reaches the score found so far; the rest is never read.

    root/segments/<name>/blocks/bucket=<b>   (term, origin, range, n, max_tf, min_len, slots, tfs, lens, kinds)
    root/segments/<name>/terms/bucket=<b>    (term, df): how many more units of the index hold it; an update's may be negative
    root/segments/<name>/units               (origin, range, slot, uid, ord, kind, len, terms)
    root/dead/<name>                         (origin, range, slot): units that a later segment replaced
    root/current/<number>                    the manifest in force

A unit's place is (origin, range, slot); origin is the segment that it was first written to.

An update writes one segment with the changed units, what they change in the frequencies, and the places of those that they
replace; older segments are not touched. merge() makes one segment of all, without the dead. A manifest takes the number
after the one that it was made from and the file system gives a number to one writer, so the later of two fails and can
be run again; readers go on with the version they opened.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import retrieval
from loomspark.sources.lineage import cut

RANGE = 256
BUCKETS = 64
UNIT = ("origin", "range", "slot", "uid", "ord", "kind", "len", "terms")
_BLOCK = "term string, origin string, range long, n int, max_tf int, min_len int, slots array<int>, tfs array<int>, lens array<int>, kinds array<string>, bucket int"
SCHEMAS = {"blocks": _BLOCK, "terms": "term string, df long, bucket int"}
#: Ranges that are scored first, to find a score to beat.
AHEAD = 8
#: About how many words of units a slice of a bucket holds the postings of.
WORDS = 1_000_000


class IndexConflictError(RuntimeError):
    """Another version came first."""


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class PostingIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions
    def _numbers(self) -> list[int]:
        folder = self.path(f"{self.root}/current")
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def manifest(self) -> dict:
        """{number, segments, n, words, dead, buckets}: what a reader needs; segments are names."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "segments": [], "n": 0, "words": 0, "dead": None, "buckets": self.buckets}
        stream = self.fs.open(self.path(f"{self.root}/current/{numbers[-1]}"))
        try:
            return json.loads(stream.readUTF()) | {"number": numbers[-1]}
        finally:
            stream.close()

    def _publish(self, before: dict, **now) -> dict:
        made = before | now | {"number": before["number"] + 1}
        try:
            out = self.fs.create(self.path(f"{self.root}/current/{made['number']}"), False)
        except Exception as e:
            raise IndexConflictError(f"version {made['number']} is there already") from e
        out.writeUTF(json.dumps(made))
        out.close()
        return made

    # --- writing
    def _segment(self, units: DataFrame, fields: dict, gone: DataFrame | None = None) -> tuple[str, int, int]:
        """Writes units as a segment, its frequencies less those of `gone` (terms). Returns (name, units, words)."""
        name = uuid.uuid4().hex[:16]
        at = f"{self.root}/segments/{name}"
        kind = F.col("kind") if "kind" in units.columns else F.lit(None).cast("string")
        own = retrieval.bags(units.withColumn("kind", kind), keep=("ord", "kind"), **fields).withColumn("i", F.monotonically_increasing_id())
        # A range is a run of rows of one task; its number holds the task's.
        place = [F.lit(name).alias("origin"), F.floor(F.col("i") / RANGE).alias("range"), (F.col("i") % RANGE).cast("int").alias("slot")]
        own.select(*place, "uid", "ord", "kind", "len", F.array_distinct("bag").alias("terms"), "bag").write.parquet(f"{at}/placed")
        placed = self.spark.read.parquet(f"{at}/placed")
        placed.drop("bag").write.parquet(f"{at}/units")
        rows = retrieval.postings(placed.select(F.struct("range", "slot", "kind").alias("uid"), "len", "bag"))
        entry = F.struct(F.col("uid.slot").alias("slot"), F.col("tf").cast("int").alias("tf"), "len", F.col("uid.kind").alias("kind"))
        # Postings are dealt to their slice of a bucket at once: blocks are put together and written where they arrive.
        n, words = placed.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        slices = max(1, -(-words // (self.buckets * WORDS)))
        rows = self._dealt(rows.withColumn("range", F.col("uid.range")), slices)
        blocks = rows.groupBy("bucket", "slice", "term", "range").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.count("*").cast("int").alias("n"), F.max("tf").cast("int").alias("max_tf"), F.min("len").alias("min_len"))
        each = lambda f: F.transform("e", lambda x: x[f])
        blocks = blocks.select("bucket", "slice", "term", F.lit(name).alias("origin"), "range", "n", "max_tf", "min_len", each("slot").alias("slots"), each("tf").alias("tfs"), each("len").alias("lens"), each("kind").alias("kinds"))
        self._sorted(blocks, f"{at}/blocks", "term", "origin", "range")
        counts = placed.select(F.explode("terms").alias("term"), F.lit(1).alias("c"))
        if gone is not None:
            counts = counts.unionByName(gone.select("term", F.lit(-1).alias("c")))
        self._write(counts.groupBy("term").agg(F.sum("c").alias("df")).filter("df <> 0"), f"{at}/terms", "term", slices=slices)
        self.fs.delete(self.path(f"{at}/placed"), True)
        return name, n, words

    def _dealt(self, rows: DataFrame, slices: int) -> DataFrame:
        """rows with their term's bucket and slice, dealt by them: a bucket has `slices` of them, so tasks grow in number, not
        in size, and all rows of a term are in one."""
        part = F.pmod(F.hash("term"), F.lit(slices))
        rows = rows.withColumns({"bucket": _bucket(F.col("term"), self.buckets), "slice": part})
        return rows.repartition(self.buckets * slices, "bucket", "slice")

    def _sorted(self, rows: DataFrame, path: str, *order: str) -> None:
        """Dealt rows, a file a slice or part of one, in order, so that a term's rows stand together in it."""
        rows.drop("slice").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)

    def _write(self, rows: DataFrame, path: str, *order: str, slices: int = 1) -> None:
        self._sorted(self._dealt(rows, slices), path, *order)

    def build(self, units: DataFrame, **fields) -> dict:
        """An index of units (uid, ord, kind and what retrieval.bags() reads) alone, in place of what there is."""
        before = self.manifest()
        name, n, words = self._segment(units, fields)
        return self._publish(before, segments=[name], n=n, words=words, dead=None, buckets=self.buckets)

    def update(self, changed: DataFrame, removed: DataFrame | None = None, **fields) -> dict:
        """changed units in place of those with their uids, without removed (uid): one segment more."""
        before = self.manifest()
        changed = cut(changed)
        uids = changed.select("uid")
        uids = uids if removed is None else uids.unionByName(removed.select("uid"))
        live = self._units(before, "origin", "range", "slot", "uid", "len", "terms")
        old = cut(live.join(uids.distinct(), "uid", "left_semi"))
        name, n, words = self._segment(changed, fields, old.select(F.explode("terms").alias("term")))
        lost = old.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        places = old.select("origin", "range", "slot")
        if before["dead"]:
            places = places.unionByName(self._dead(before))
        dead = uuid.uuid4().hex[:16]
        places.write.parquet(f"{self.root}/dead/{dead}")
        return self._publish(before, segments=[*before["segments"], name], n=before["n"] + n - lost[0], words=before["words"] + words - lost[1], dead=dead)

    def merge(self) -> dict:
        """All segments as one, without dead units. Places stay as they are; nothing is tokenised."""
        before = self.manifest()
        name = uuid.uuid4().hex[:16]
        at = f"{self.root}/segments/{name}"
        self._units(before, *UNIT).write.parquet(f"{at}/units")
        blocks = self._read(before, "blocks")
        if before["dead"]:
            gone = self._dead(before).groupBy("origin", "range").agg(F.collect_set("slot").alias("gone"))  # a range's slots
            blocks = blocks.join(gone, ["origin", "range"], "left")
            kept = F.filter(F.arrays_zip("slots", "tfs", "lens", "kinds"), lambda x: ~F.coalesce(F.array_contains("gone", x["slots"]), F.lit(False)))
            blocks = blocks.withColumn("e", kept).filter(F.size("e") > 0)
            each = lambda f: F.transform("e", lambda x: x[f])
            blocks = blocks.select("term", "origin", "range", F.size("e").alias("n"), F.array_max(each("tfs")).alias("max_tf"), F.array_min(each("lens")).alias("min_len"), *[each(c).alias(c) for c in ("slots", "tfs", "lens", "kinds")])
        self._write(blocks.drop("bucket"), f"{at}/blocks", "term", "origin", "range")
        counts = self._read(before, "terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        self._write(counts, f"{at}/terms", "term")
        return self._publish(before, segments=[name], dead=None)

    def vacuum(self, keep: int = 1) -> int:
        """Removes versions but the last `keep`, and segments that none of those names. Returns how many segments went."""
        numbers = self._numbers()
        kept = {m for n in numbers[-keep:] for m in self._named(n)}
        for n in numbers[:-keep]:
            self.fs.delete(self.path(f"{self.root}/current/{n}"), False)
        gone = 0
        for part in ("segments", "dead"):
            folder = self.path(f"{self.root}/{part}")
            for s in self.fs.listStatus(folder) if self.fs.exists(folder) else ():
                if s.getPath().getName() not in kept:
                    self.fs.delete(s.getPath(), True)
                    gone += part == "segments"
        return gone

    def _named(self, number: int) -> list[str]:
        stream = self.fs.open(self.path(f"{self.root}/current/{number}"))
        try:
            m = json.loads(stream.readUTF())
        finally:
            stream.close()
        return [*m["segments"], *([m["dead"]] if m["dead"] else [])]

    # --- reading
    def _read(self, m: dict, table: str) -> DataFrame:
        """A table of all segments."""
        # An empty segment has no files to take a schema from, nor its bucket folders a column.
        parts = [self.spark.read.schema(SCHEMAS[table] if table != "units" else self._unit_schema(m)).parquet(f"{self.root}/segments/{s}/{table}") for s in m["segments"]]
        return functools.reduce(DataFrame.unionByName, parts)

    def _unit_schema(self, m: dict):
        """uid and ord are of the types that the units came with."""
        return self.spark.read.parquet(f"{self.root}/segments/{m['segments'][0]}/units").schema

    def _dead(self, m: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/dead/{m['dead']}")

    def _units(self, m: dict, *columns: str) -> DataFrame:
        """Live units."""
        if not m["segments"]:
            return self.spark.createDataFrame([], "origin string, range long, slot int, uid string, ord long, kind string, len int, terms array<string>").select(*columns)
        rows = self._read(m, "units")
        rows = rows.join(self._dead(m), ["origin", "range", "slot"], "left_anti") if m["dead"] else rows
        return rows.select(*columns)

    def frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df) of all terms, or of some, from their buckets alone."""
        m = self.manifest()
        if not m["segments"]:
            return self.spark.createDataFrame([], "term string, df long")
        rows = self._asked(self._read(m, "terms"), terms, m) if terms is not None else self._read(m, "terms")
        return rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def _asked(self, rows: DataFrame, terms: list[str], m: dict) -> DataFrame:
        """Rows of some terms: the partitions of their buckets, and in those the row groups that hold them."""
        which = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), m["buckets"])).distinct().collect()] if terms else []  # a query's terms
        return rows.filter(F.col("bucket").isin(which) & F.col("term").isin(terms))

    def scores(self, terms: list[str], limit: int | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """(uid, score, ord, kind) as retrieval.bm25() has it; with a limit, of units that can be among the best `limit` (of
        some kinds) only: blocks that can't hold one of those are not read."""
        m, asked = self.manifest(), list(dict.fromkeys(terms))
        if not m["segments"] or not asked:
            return self.spark.createDataFrame([], "uid string, score double, ord long, kind string")
        stats = self.spark.createDataFrame([(m["n"], m["words"] / max(m["n"], 1))], "n long, avg double")
        dfs = F.broadcast(self.frequencies(asked))  # a row a query term
        blocks = self._asked(self._read(m, "blocks"), asked, m)
        chosen = None
        if limit is not None:
            heads = blocks.select("origin", "range", "term", "max_tf", "min_len").join(dfs, "term").crossJoin(F.broadcast(stats))
            most = retrieval.part(F.col("n"), F.col("df"), F.col("max_tf"), F.col("min_len"), F.col("avg"))
            # The sums are of rounded numbers: a little more than each is a bound for sure.
            bounds = cut(heads.groupBy("origin", "range").agg((F.sum(most) * (1 + 1e-9)).alias("bound")))
            ahead = bounds.orderBy(F.desc("bound"), "origin", "range").limit(AHEAD)
            first = self._scored(blocks.join(F.broadcast(ahead), ["origin", "range"], "left_semi"), dfs, stats, asked, m, kinds)
            worst = first.filter("score > 0").select("score").orderBy(F.desc("score")).limit(max(limit, 1)).collect()  # limit rows
            least = worst[-1][0] if len(worst) >= limit > 0 else 0.0
            chosen = bounds.filter(F.col("bound") >= least).select("origin", "range")
            blocks = blocks.join(chosen, ["origin", "range"], "left_semi")
        found = self._scored(blocks, dfs, stats, asked, m, kinds)
        units = self._read(m, "units").select("origin", "range", "slot", "uid", "ord", "kind")
        if limit is not None:
            found = found.filter((F.col("score") > 0) & (F.col("score") >= F.lit(least)))
        return found.join(units, ["origin", "range", "slot"]).select("uid", "score", "ord", "kind")

    def _scored(self, blocks: DataFrame, dfs: DataFrame, stats: DataFrame, asked: list[str], m: dict, kinds: tuple[str, ...] | None) -> DataFrame:
        """(segment, range, slot, score) of live units of some kinds in blocks."""
        rows = blocks.select("origin", "range", "term", F.explode(F.arrays_zip("slots", "tfs", "lens", "kinds")).alias("x"))
        rows = rows.select("origin", "range", "term", F.col("x.slots").alias("slot"), F.col("x.tfs").alias("tf"), F.col("x.lens").alias("len"), F.col("x.kinds").alias("kind"))
        if kinds:
            rows = rows.filter(F.col("kind").isin(*kinds))
        if m["dead"]:
            rows = rows.join(self._dead(m), ["origin", "range", "slot"], "left_anti")
        return retrieval.summed(rows, dfs, stats, asked, ["origin", "range", "slot"])

    def top(self, terms: list[str], limit: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """(uid, score): the best `limit` units of some kinds by score, ties by ord."""
        return self.scores(terms, limit, kinds).orderBy(F.desc("score"), "ord").limit(limit).select("uid", "score")
