"""A version store: commits of path -> blob, as Parquet. A version is written whole before the pointer moves to it."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.hashing import blob_id
from loomspark.operators.changes import difference, staged
from loomspark.sources.lineage import cut


TREE = "rel_path string, blob_id string, home string"


def _bucket(name: Column) -> Column:
    return F.concat(F.lit("b"), F.substring(name, 1, 2))


class ConflictError(RuntimeError):
    """Another commit came first."""


def check_paths(paths: DataFrame) -> None:
    """Stops at the first path that no tree may hold."""
    bad = paths.filter(F.col("rel_path").rlike(r"(^|/)(\.{0,2}|\.git)(/|$)|\\|[\x00-\x1f]")).limit(1).collect()
    if bad:
        raise ValueError(f"unsafe path: {bad[0].rel_path!r}")


class Store:
    """root/blobs/commit=.../bucket=... (blob_id, content; only blobs that were not there, by the first digits of their names),
    root/trees/commit=... (rel_path, blob_id, home: the commit whose blobs hold it), root/refs/<branch>/<number> (commit).
    What is read of the blobs is told by the tree alone: the folders of its homes and buckets. A commit takes the number
    after that of the version it was made from, and the file system gives a number to one writer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _refs(self, branch: str) -> list[int]:
        folder = self.path(f"{self.root}/refs/{branch}")
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def _tip(self, branch: str) -> tuple[int, str | None]:
        """The number of the newest ref and its commit."""
        refs = self._refs(branch)
        return (refs[-1], self._commit_of(branch, refs[-1])) if refs else (0, None)

    def _commit_of(self, branch: str, number: int) -> str:
        stream = self.fs.open(self.path(f"{self.root}/refs/{branch}/{number}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def tip(self, branch: str = "main") -> str | None:
        return self._tip(branch)[1]

    def tree(self, commit: str | None, prefix: str = "", suffixes: tuple[str, ...] = ()) -> DataFrame:
        """(rel_path, blob_id)."""
        return self._tree(commit, prefix, suffixes).select("rel_path", "blob_id")

    def _tree(self, commit: str | None, prefix: str = "", suffixes: tuple[str, ...] = ()) -> DataFrame:
        if commit is None:
            return self.spark.createDataFrame([], TREE)
        out = self.spark.read.schema(TREE).parquet(f"{self.root}/trees/commit={commit}").filter(F.startswith("rel_path", F.lit(prefix)))
        for i, s in enumerate(suffixes):
            hit = F.endswith("rel_path", F.lit(s)) if i == 0 else hit | F.endswith("rel_path", F.lit(s))
        return out.filter(hit) if suffixes else out

    def texts(self, commit: str | None, prefix: str = "") -> DataFrame:
        """(rel_path, text)."""
        if commit is None:
            return self.spark.createDataFrame([], "rel_path string, text string")
        wanted = self._tree(commit, prefix).select("rel_path", "blob_id", F.col("home").alias("commit"), _bucket(F.col("blob_id")).alias("bucket"))
        return wanted.join(self._blobs(), ["blob_id", "commit", "bucket"]).select("rel_path", F.col("content").alias("text"))

    def _blobs(self) -> DataFrame:
        return self.spark.read.schema("blob_id string, content string, commit string, bucket string").parquet(f"{self.root}/blobs")

    def changes(self, old: str | None, new: str | None) -> DataFrame:
        """(status, path, old_path), renames of equal content told."""
        return staged(self.tree(old), self.tree(new))

    def commit(self, files: DataFrame, branch: str = "main", expected: str | None = None, removals: DataFrame | None = None, replace_prefix: str | None = None) -> str:
        """files (rel_path, text) on top of the tip, without removals, or in place of all under replace_prefix. The tip
        must be `expected`. Returns the new commit, or the tip where nothing changes."""
        check_paths(files)
        number, found = self._tip(branch)
        if found != expected:
            raise ConflictError(f"{branch} is at {found}, not at {expected}")
        own = files.select("rel_path", blob_id(F.col("text")).alias("blob_id"), F.col("text").alias("content"))
        base = self._tree(expected)
        if replace_prefix is not None:
            base = base.filter(~F.startswith("rel_path", F.lit(replace_prefix)))
        if removals is not None:
            base = base.join(removals.select("rel_path"), "rel_path", "left_anti")
        rest = base.join(own.select("rel_path"), "rel_path", "left_anti")
        if expected is not None and not difference(self.tree(expected), rest.select("rel_path", "blob_id").unionByName(own.select("rel_path", "blob_id"))).filter("change <> 'unchanged'").limit(1).count():
            return expected
        name = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        placed = own.withColumn("bucket", _bucket(F.col("blob_id")))
        if self.fs.exists(self.path(f"{self.root}/blobs")):
            # Writers at the same time may both have stored a blob: the first commit's counts. Contents are not read.
            held = self._blobs().select("blob_id", "commit", "bucket").join(placed.select("blob_id", "bucket").distinct(), ["blob_id", "bucket"], "left_semi")
            placed = placed.join(held.groupBy("blob_id").agg(F.min("commit").alias("home")), "blob_id", "left")
        else:
            placed = placed.withColumn("home", F.lit(None).cast("string"))
        placed = cut(placed)
        fresh = placed.filter("home is null").select("blob_id", "content", "bucket").dropDuplicates(["blob_id"])
        fresh.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/blobs/commit={name}")
        tree = rest.unionByName(placed.select("rel_path", "blob_id", F.coalesce("home", F.lit(name)).alias("home")))
        tree.write.parquet(f"{self.root}/trees/commit={name}")
        try:  # the file system lets one writer make the number that follows `expected`
            out = self.fs.create(self.path(f"{self.root}/refs/{branch}/{number + 1}"), False)
        except Exception as e:
            for part in ("blobs", "trees"):
                self.fs.delete(self.path(f"{self.root}/{part}/commit={name}"), True)
            raise ConflictError(f"{branch} moved on") from e
        out.writeUTF(name)
        out.close()
        return name


def collected(store: Store, keep: int, branches: tuple[str, ...] = ("main",)) -> list[str]:
    """Removes what no version needs any more: of each branch the last `keep` stay, with the blobs that their trees name. Their
    homes are rewritten nowhere; blobs of a home that is still named in part stay with it. Returns the commits whose blobs went.
    Readers of the versions that stay go on; all branches must be named, or their blobs go too."""
    refs = {b: store._refs(b) for b in branches}
    commits = {b: [store._commit_of(b, n) for n in ns[-keep:]] for b, ns in refs.items()}
    live = sorted({c for cs in commits.values() for c in cs})
    homes: set[str] = set()
    for c in live:  # `keep` of each branch
        homes |= {r.home for r in store._tree(c).select("home").distinct().collect()}
    for b, ns in refs.items():
        for n in ns[:-keep]:
            store.fs.delete(store.path(f"{store.root}/refs/{b}/{n}"), False)
    gone = []
    for part, kept in (("trees", set(live)), ("blobs", homes)):
        folder = store.path(f"{store.root}/{part}")
        for s in store.fs.listStatus(folder) if store.fs.exists(folder) else ():
            name = s.getPath().getName().removeprefix("commit=")
            if name not in kept:
                store.fs.delete(s.getPath(), True)
                gone += [name] if part == "blobs" else []
    return sorted(gone)


@dataclass
class Batch:
    """What became of a batch. changes: (change, n). findings: (level, path, ...) of its changed files, written once and
    read again, rejected or not. commit: None where the batch was rejected or only tried."""

    changes: DataFrame
    findings: DataFrame
    accepted: bool
    commit: str | None


def ingest(store: Store, local: DataFrame, checks, branch: str = "main", dry_run: bool = False, scope: str = "") -> Batch:
    """Brings local files (rel_path, text) into the store: all of them, or all under `scope`, which takes the place of the
    tip's. checks(changed files) -> findings (level, path, ...); any of level `fail` rejects the batch. With dry_run
    nothing is committed."""
    tip = store.tip(branch)
    ids = local.filter(F.startswith("rel_path", F.lit(scope))).select("rel_path", blob_id(F.col("text")).alias("blob_id"), "text")
    diff = cut(difference(store.tree(tip, scope), ids))
    counts = diff.groupBy("change").agg(F.count("*").alias("n"))
    changed = ids.join(diff.filter("change in ('added', 'updated')").select("rel_path"), "rel_path", "left_semi").select("rel_path", "text")
    findings = cut(checks(changed))
    accepted = not findings.filter("level = 'fail'").limit(1).count()
    commit = store.commit(changed, branch, tip, diff.filter("change = 'removed'").select("rel_path")) if accepted and not dry_run else None
    return Batch(counts, findings, accepted, commit)
