"""Operator 12 against a plain version."""

import random

import pytest
from cases import docs, frame, prose, rows, same
from pyspark.sql import functions as F

import brute
from loomspark.llm.fingerprints import LEAST, containment, digest, fingerprinted, merged, sketched

COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def results(spark, data):
    return rows(digest(fingerprinted(spark, frame(spark, data))), *COLUMNS)


@pytest.mark.parametrize("data", [docs(), [(5, "one text alone")], [(1, None), (2, None)], []])
def test_fingerprints(spark, data):
    same(results(spark, data), brute.op12(sorted(data)))


def test_ids_null_repeated_and_far_apart(spark):
    data = docs(n=30) + [(None, "text without an id"), (2**62, "far away"), (2**62 + 1, "x " * 200_000), (-(2**62), "the other way")]
    want = brute.op12(sorted(data, key=lambda d: (d[0] is not None, d[0] or 0)))
    again = data + data[8:12] * 50
    got = results(spark, again)
    times = {d[0]: again.count(d) for d in again}
    same(got, [r for r in want for _ in range(times[r[0]])])


def test_one_doc_id_on_many_texts(spark):
    rnd = random.Random(3)
    data = [(4, prose(rnd, 8) + f" {i}") for i in range(3000)] + [(None, f"none {i}") for i in range(200)] + [(9, "last")]
    same(results(spark, data), brute.op12(brute.order(data)))


def test_equal_texts_and_copies(spark):
    rnd = random.Random(8)
    long = [prose(rnd, 1500) for _ in range(4)]
    near = " ".join(w if i % 300 else "changed" for i, w in enumerate(long[0].split()))
    got = {r[0]: r for r in results(spark, [(1, long[0]), (2, long[0]), (3, near), (4, long[1]), (5, long[2]), (6, long[3])])}
    assert got[1][3] == got[2][3] != got[3][3] and got[1][6] == 1.0 and got[2][6] > 0.9 and got[3][6] == 0.0
    assert all(0.35 < got[i][5] < 0.65 for i in range(1, 7))


def test_sketches_merge(spark):
    rnd = random.Random(5)
    texts = [prose(rnd, n) for n in (3, 20, 40, 200, 3000)]
    rows_ = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    both = sketched(sketched(rows_, "a", "sa"), "b", "sb").select("a", "b", merged(F.col("sa"), F.col("sb")).alias("m"), containment(F.col("sa"), F.col("sb")).alias("c"))
    hashes = {t: brute.sketch(t, scale=1, least=10**9) for t in texts}
    for r in both.collect():
        every = sorted(set(hashes[r.a]) | set(hashes[r.b]))
        below = [h for h in every if h < -(2**63) + 2**60]
        assert r.m == (below if len(below) >= LEAST else every[:LEAST])
        assert r.c == brute.contained(brute.sketch(r.a), brute.sketch(r.b))


def test_unequal_documents(spark):
    rnd = random.Random(6)
    short = prose(rnd, 1200)
    long = f"{prose(rnd, 20_000)} {short} {prose(rnd, 20_000)}"
    r = sketched(sketched(spark.createDataFrame([(short, long)], "a string, b string"), "a", "sa"), "b", "sb")
    r = r.select(containment(F.col("sa"), F.col("sb")).alias("up"), containment(F.col("sb"), F.col("sa")).alias("down")).first()
    assert r.up > 0.95 and r.down < 0.1
