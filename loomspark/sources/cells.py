"""Vectors by cells: an index for nearest neighbours by cosine, and a search that reads the nearest cells only.

Centroids are fitted on a bounded sample (the lowest hashes of uid, SAMPLE a cell); every vector is stored, in the folder of
the cell whose centroid is nearest. A query reads `probes` cells, so what it reads shrinks with their number; without
`probes` it reads all of them, which is the exact way. Queries come in blocks of a bounded size that tasks get whole; each
task keeps its best of each query.

    root/centroids           (cell, centroid): CELLS at most
    root/vectors/cell=<c>    (uid, vector), of length one
    root/recall              (probes, recall): what so many probes find of the NEAR nearest, measured when the index is built

Vectors that are null, of another length, zero or not finite have no direction: they are left out, as queries are.
Scores are rounded to nine digits, so equal vectors tie; ties go by uid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS, SAMPLE, ROUNDS = 4096, 64, 12
#: Recall is measured for so many neighbours of so many stored vectors, those with the lowest hashes.
NEAR, MEASURED = 10, 60
#: Queries that are searched together.
BLOCK = 1000


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a direction, their vectors of length one)."""
    lengths = np.array([len(v) if v is not None else -1 for v in column.to_pylist()]) if column.null_count else np.diff(np.asarray(column.offsets))
    fit = lengths == width
    rows = column.filter(pa.array(fit))
    x = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    at = np.flatnonzero(fit)[good]
    return at, x[good] / norm[good, None]


def _fitted(x: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Centroids of vectors of length one, by rounds of nearest assignment; a cell that loses all its vectors starts again at
    the one that its centroid serves worst."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = x @ centroids.T
        own = near.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(1))
        worst = iter(np.argsort(near[np.arange(len(x)), own]))
        for c in np.flatnonzero(norm == 0):
            sums[c], norm[c] = x[next(worst)], 1.0
        centroids = sums / norm[:, None]
    return centroids


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, cells: int | None = None) -> None:
        """vectors (uid, vector), all of the width that most have; cells: some square root of their number, CELLS at most."""
        rows = vectors.select("uid", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null")
        width = rows.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
        n, width = (width.n, width.w) if width else (0, 0)
        cells = min(cells or max(1, int(n**0.5)), CELLS)
        share = min(1.0, 1.5 * SAMPLE * cells / max(n, 1))
        picked = rows.filter(F.size("vector") == width).withColumn("h", F.xxhash64("uid")).filter(F.col("h") <= (2 * share - 1) * float(2**63))
        sample = picked.orderBy("h", "uid").limit(SAMPLE * cells).select("vector").toArrow()  # a bounded number of rows
        x = _matrix(sample.column("vector").combine_chunks(), width)[1] if n else np.empty((0, 0))
        centroids = _fitted(x, cells) if len(x) else x
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{self.root}/centroids")
        shared = self.spark.sparkContext.broadcast(centroids)  # CELLS at most

        def assigned(batches):
            for b in batches:
                at, x = _matrix(b.column("vector"), width) if len(shared.value) else (np.empty(0, int), x0)
                if len(at):
                    cell = (x @ shared.value.T).argmax(1).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({"uid": b.column("uid").take(pa.array(at)), "vector": list(x), "cell": cell})

        x0 = np.empty((0, 0))
        kind = rows.schema["uid"].dataType.simpleString()
        rows.select("uid").limit(0).write.mode("overwrite").parquet(f"{self.root}/kind")
        placed = rows.mapInArrow(assigned, f"uid {kind}, vector array<double>, cell int")
        # Ranges of (cell, hash): a cell with very many vectors is several files.
        placed.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "cell", F.xxhash64("uid")).write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors")
        self._measure(centroids)

    def _measure(self, centroids: np.ndarray) -> None:
        """Writes the recall of every number of probes: where the exact neighbours of a sample lie in its order of cells."""
        stored, found = self.spark.read.schema(self._schema()).parquet(f"{self.root}/vectors"), []
        asked = stored.orderBy(F.xxhash64("uid"), "uid").limit(MEASURED).select(F.col("uid").alias("q"), "vector") if len(centroids) else None
        if asked is not None:
            ranks = {r.q: np.argsort(np.argsort(-(np.array(r.vector) @ centroids.T), kind="stable")) for r in asked.collect()}  # MEASURED rows
            pairs = self.search(asked, NEAR).join(stored.select("uid", "cell"), "uid").select("q", "cell").collect()  # NEAR of each
            found = sorted(int(ranks[q][c]) + 1 for q, c in pairs)
        share = [(p, float(np.searchsorted(found, p, "right")) / len(found)) for p in range(1, len(centroids) + 1)] if found else []
        self.spark.createDataFrame(share, "probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/recall")

    def _schema(self) -> str:
        kind = self.spark.read.parquet(f"{self.root}/kind").schema["uid"].dataType.simpleString()
        return f"uid {kind}, vector array<double>, cell int"

    def probes(self, recall: float = 0.95) -> int | None:
        """The least number of probes whose measured recall is so high; None (all) where none is."""
        return self.spark.read.parquet(f"{self.root}/recall").filter(F.col("recall") >= recall).agg(F.min("probes")).first()[0]

    def _centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.root}/centroids").orderBy("cell").collect()  # CELLS at most
        return np.array([r.centroid for r in rows])

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(q, uid, score, rank) of queries (q, vector): the k nearest of each among its `probes` nearest cells, or among all."""
        centroids, out = self._centroids(), None
        width = centroids.shape[1] if len(centroids) else 0
        vectors = self.spark.read.schema(self._schema()).parquet(f"{self.root}/vectors")
        kind = vectors.schema["uid"].dataType.simpleString()
        q_kind = queries.schema["q"].dataType.simpleString()
        schema = f"q {q_kind}, uid {kind}, score double"
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "uid"))
        table = queries.select("q", F.col("vector").cast("array<double>").alias("vector"))
        for block in self._blocks(table) if width else ():
            at, x = _matrix(block.column("vector").combine_chunks(), width)
            if not len(at):
                continue
            names = block.column("q").take(pa.array(at)).to_pylist()
            near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, : probes or len(centroids)]
            of_cell = {c: np.flatnonzero((near == c).any(1)) for c in np.unique(near).tolist()}
            shared = self.spark.sparkContext.broadcast((names, x, of_cell))
            own = vectors.filter(F.col("cell").isin(sorted(of_cell))) if probes else vectors

            def scored(batches, shared=shared, q_type=block.column("q").type):
                names, x, of_cell = shared.value
                best: dict[int, list] = {}
                uid_type = None
                for b in batches:
                    uid_type = b.column("uid").type
                    cells, uids = b.column("cell").to_numpy(zero_copy_only=False), b.column("uid").to_pylist()
                    v = np.asarray(b.column("vector").flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
                    for c in np.unique(cells).tolist():
                        mine = np.flatnonzero(cells == c)
                        asked = of_cell.get(c, ())
                        scores = np.round(v[mine] @ x[asked].T, 9) if len(asked) else np.empty((0, 0))
                        for j, i in enumerate(asked):
                            column = scores[:, j]
                            top = mine[column >= np.partition(column, -k)[-k]] if len(column) > k else mine
                            kept = best.setdefault(int(i), [])
                            kept += [(-float(s), uids[m]) for m, s in zip(top.tolist(), column[np.searchsorted(mine, top)].tolist())]
                            if len(kept) > 8 * k:
                                kept.sort()
                                del kept[k:]
                rows = [(names[i], u, -s) for i, kept in best.items() for s, u in sorted(kept)[:k]]
                if rows:
                    yield pa.RecordBatch.from_pydict({"q": pa.array([r[0] for r in rows], q_type), "uid": pa.array([r[1] for r in rows], uid_type), "score": pa.array([r[2] for r in rows], pa.float64())})

            found = own.select("uid", "vector", "cell").mapInArrow(scored, schema)
            out = found if out is None else out.unionByName(found)
        if out is None:
            return self.spark.createDataFrame([], schema + ", rank int")
        return out.withColumn("rank", place).filter(F.col("rank") <= k).select("q", "uid", "score", "rank")

    def _blocks(self, queries: DataFrame):
        """The queries, BLOCK at a time."""
        numbered = queries.withColumn("i", F.monotonically_increasing_id())
        parts = numbered.select(F.floor(F.col("i") / BLOCK).alias("block")).distinct().collect()  # a row for each block
        for (block,) in sorted(parts):
            yield numbered.filter(F.floor(F.col("i") / BLOCK) == block).drop("i").toArrow()  # BLOCK rows


class VectorRetriever:
    """Beside BM25: units by the nearness of their vectors to that of the query, which `embed` makes."""

    def __init__(self, index: VectorIndex, embed, probes: int | None = None):
        self.index, self.embed, self.probes = index, embed, probes or index.probes()

    def describe(self) -> dict:
        return {"kind": "vector", "probes": self.probes, "cells": len(self.index._centroids())}

    def retrieve(self, query: str, limit: int = 5) -> DataFrame:
        """(uid, score, reason, pos)."""
        one = self.index.spark.createDataFrame([(0, [float(x) for x in self.embed(query)])], "q int, vector array<double>")
        found = self.index.search(one, max(limit, 1), self.probes).filter(F.col("rank") <= max(limit, 0))
        return found.select("uid", "score", F.lit("vector").alias("reason"), F.col("rank").alias("pos"))
