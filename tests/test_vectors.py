"""The vector index against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from loomspark.plans import ask
from loomspark.sources.cells import VectorIndex, VectorRetriever


def vectors(n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, width))
    return middles[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, width))


def frame(spark, x, name="uid"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<float>")


def nearest(x, q, k):
    x, q = (a.astype(np.float32).astype(float) for a in (x, q))
    s = np.round((x / np.linalg.norm(x, axis=1)[:, None]) @ (q / np.linalg.norm(q, axis=1)[:, None]).T, 9)
    return [sorted(range(len(x)), key=lambda i: (-s[i, j], i))[:k] for j in range(s.shape[1])]


def test_exact_and_near(spark, tmp_path):
    x = vectors(3000)
    x[100:400] = x[50]  # one vector very many times
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(frame(spark, x), cells=40)
    q = np.concatenate([vectors(40, seed=2), x[50:51]])
    want = nearest(x, q, 10)
    got = {}
    for r in index.search(frame(spark, q, "q"), 10).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.uid)
    assert [got[j] for j in range(len(q))] == want
    near = {}
    for r in index.search(frame(spark, q, "q"), 10, probes=6).collect():
        near.setdefault(r.q, set()).add(r.uid)
    recall = sum(len(near[j] & set(want[j])) for j in range(len(q))) / (10 * len(q))
    assert recall >= 0.9
    plan = index.search(frame(spark, q[:1], "q"), 10, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def test_rows_without_a_direction(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0]), ("f", [float("nan"), 1.0]), ("g", [-1.0, 0.0])]
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(spark.createDataFrame(rows, "uid string, vector array<double>"))
    ask_ = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0])], "q int, vector array<double>")
    assert [tuple(r) for r in index.search(ask_, 9).orderBy("rank").collect()] == [(1, "a", 1.0, 1), (1, "b", 0.0, 2), (1, "g", -1.0, 3)]
    empty = VectorIndex(spark, f"file://{tmp_path}/e")
    empty.build(spark.createDataFrame([], "uid string, vector array<double>"))
    assert empty.search(ask_, 3).count() == 0


def test_recall_on_the_given_table(spark, tmp_path):
    own = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"))
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(own)
    asked = own.filter("uid % 100 = 0").withColumnRenamed("uid", "q")
    exact = {(r.q, r.uid) for r in index.search(asked, 10).collect()}
    probes = index.probes()
    near = {(r.q, r.uid) for r in index.search(asked, 10, probes).collect()}
    assert len(exact & near) / len(exact) >= 0.9 and probes < len(index._centroids())


def test_retriever(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "uid string, vector array<double>"))
    own = ask.retriever_of("vector", None, index=index, embed=lambda text: [float("x" in text), 0.5])
    assert isinstance(own, VectorRetriever) and [(r.uid, r.pos) for r in own.retrieve("x", 2).orderBy("pos").collect()] == [("a", 1), ("b", 2)]
    assert own.describe()["kind"] == "vector" and own.retrieve("x", 0).count() == 0
