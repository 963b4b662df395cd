"""The persisted index against BM25 over units that are tokenised anew."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import retrieval
from loomspark.sources.postings import IndexConflictError, PostingIndex

SCHEMA = "uid string, kind string, anchor_id string, title string, text string, ord long"


def units(n, seed=1, words=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    pick = lambda k: " ".join(rnd.choices(vocabulary, weights, k=k))
    return [(f"u{i}", rnd.choice(["contract", "debate"]), f"spec-{i}", rnd.choice([None, pick(3)]), rnd.choice([None, "", pick(rnd.randint(1, 80))]), i) for i in range(n)]


def same(index, rows, asked, spark, limit=10, kinds=None):
    u = spark.createDataFrame(rows, SCHEMA)
    own = retrieval.bags(u)
    scores = retrieval.bm25(retrieval.postings(own, asked), retrieval.totals(own), asked)
    want = {r.uid: r.score for r in scores.collect()}
    got = {r.uid: r.score for r in index.scores(asked).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    best = [r.uid for r in retrieval.top(scores, u, limit, kinds).collect()]
    assert [r.uid for r in index.top(asked, limit, kinds).collect()] == best


def test_index_through_its_versions(spark, tmp_path):
    rows = units(900)
    u = lambda r: spark.createDataFrame(r, SCHEMA)
    index = PostingIndex(spark, f"file://{tmp_path}/i", buckets=8)
    assert index.top(["w1"], 5).count() == 0 and index.frequencies().count() == 0
    index.build(u(rows))
    same(index, rows, ["w59", "w3", "w3", "none"], spark)
    same(index, rows, ["w2", "spec"], spark, 7, ("debate",))
    # An update writes one segment; what it replaces and removes counts no more, in no statistic.
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "i/segments").rglob("*.parquet")}
    fresh = [(f"u{i}", "contract", "x-1", "w40 w40", "w0 new word", i) for i in range(5, 900, 90)] + [("v1", "debate", None, None, "w59 brand", 2000)]
    index.update(u(fresh), u(rows[:20]).select("uid"))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    now = [r for r in rows if r[0] not in {x[0] for x in fresh} | {f"u{i}" for i in range(20)}] + fresh
    same(index, now, ["w40", "brand"], spark)
    want = {r.term: r.df for r in retrieval.document_frequencies(u(now)).collect()}
    assert {r.term: r.df for r in index.frequencies().collect()} == want
    # The same unit again, twice over.
    index.update(u([("v1", "debate", None, None, "w1", 2000)]))
    index.update(u([("v1", "debate", None, None, "w2 w59", 2000)]))
    now[-1] = ("v1", "debate", None, None, "w2 w59", 2000)
    index.merge()
    assert len(index.manifest()["segments"]) == 1 and index.manifest()["dead"] is None
    same(index, now, ["w1", "w2", "w59"], spark)
    index.update(u([("v2", "debate", None, None, "w59", 2001)]), u([now[3]]).select("uid"))
    index.merge()
    now = now[:3] + now[4:] + [("v2", "debate", None, None, "w59", 2001)]
    assert index.vacuum() > 0 and len(list((tmp_path / "i/segments").iterdir())) == 1
    same(index, now, ["w59", "w0"], spark)


def test_a_query_reads_its_buckets_and_few_ranges(spark, tmp_path):
    rows = [(f"u{i}", "contract", None, None, "common " * (1 + i % 3) + f"t{i % 50} " + ("needle " * 9 if i == 777 else "needle" if i % 97 == 0 else "") + " pad" * (i % 40), i) for i in range(6000)]
    index = PostingIndex(spark, f"file://{tmp_path}/i", buckets=16)
    index.build(spark.createDataFrame(rows, SCHEMA), anchor=None)
    plan = index.scores(["needle", "common"], 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan.replace("IsNotNull(term), ", "")
    every, some = index.scores(["needle", "common"]).count(), index.scores(["needle", "common"], 1).count()
    assert every == 6000 and some == 1
    assert index.top(["needle", "common"], 1).first().uid == "u777"


def test_two_writers(spark, tmp_path):
    u = spark.createDataFrame(units(5), SCHEMA)
    one, other = (PostingIndex(spark, f"file://{tmp_path}/i", 4) for _ in range(2))
    one.build(u)
    old = other.manifest()
    one.update(u.limit(1))
    other.manifest = lambda: old
    with pytest.raises(IndexConflictError):
        other.merge()


def test_retriever_over_an_index(spark, tmp_path):
    rows = [("spec-1", "contract", "spec-1", "Rates", "rates of change", 0), ("spec-1#debate-0", "debate", "spec-1", "t", "rates", 1), ("adr-2", "contract", "adr-2", "Other", "nothing", 2)]
    u = spark.createDataFrame(rows, SCHEMA).withColumn("parent_anchor", F.col("anchor_id"))
    index = PostingIndex(spark, f"file://{tmp_path}/i", 4)
    index.build(u)
    own, read = retrieval.Bm25Retriever(u), retrieval.Bm25Retriever(u, index=index)
    for question in ("rates of ^ADR-2", "change", "none at all"):
        assert [tuple(r) for r in own.retrieve(question, 3).collect()] == [tuple(r) for r in read.retrieve(question, 3).collect()]
    assert read.describe()["persisted"] and not own.describe()["persisted"]


def test_buckets_have_more_slices_where_there_are_more_words(spark, tmp_path, monkeypatch):
    import os

    from loomspark.sources import postings

    u = spark.createDataFrame([(str(i), "t", f"all w{i} w{i % 7} w{i % 3}", i) for i in range(400)], "uid string, title string, text string, ord long")
    made = {}
    for name, words in (("one", 10**6), ("many", 20)):
        monkeypatch.setattr(postings, "WORDS", words)
        index = postings.PostingIndex(spark, f"file://{tmp_path}/{name}", buckets=2)
        at = f"{tmp_path}/{name}/segments/{index.build(u, anchor=None)['segments'][0]}/blocks"
        parts = [x for b in os.listdir(at) if b.startswith("bucket=") for x in os.listdir(f"{at}/{b}") if x.endswith(".parquet")]
        made[name] = len(parts), sorted(map(tuple, index.frequencies().collect())), index.top(["all", "w3"], 5).collect()
    assert made["one"][0] == 2 < made["many"][0]
    assert made["one"][1:] == made["many"][1:]
