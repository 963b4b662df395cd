"""Operator 11 and the ranks that operators 11 and 12 rest on, against plain versions."""

import random

import pytest
from cases import docs, frame, rows, same
from pyspark.sql import functions as F

import brute
from loomspark.llm.common import Scratch
from loomspark.llm.merkle import FIELDS, leaf, manifest, siblings, verified
from loomspark.llm.radix import bucketed, ranked

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def table(spark, data):
    own = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    return own.withColumns({c: F.lit(3) for c in ("g", "k", "r", "h", "item", "steps", "total")})


def results(spark, data, fanout=2):
    odd = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(n_chars=F.col("n_chars") + 1))
    got = verified(manifest(spark, table(spark, data), fanout=fanout, carry={"tampered": odd}), F.coalesce("tampered", "leaf"))
    return rows(got.withColumn("proof_sha256", F.sha2(siblings(F.col("steps")), 256)), *COLUMNS)


def corpus(n, seed=1):
    rnd = random.Random(seed)
    langs = ["en"] * 6 + ["de", "é", "z\U0001f642", "", None]
    ids = rnd.sample(range(-n, 4 * n), n)
    return [(i, rnd.choice(["a", None, ""]), rnd.choice(langs), rnd.choice([None, 5, len(str(i))]), rnd.choice([None, "", f"text {i}", "ß" * (i % 50)])) for i in ids]


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest(spark, fanout):
    same(results(spark, corpus(700), fanout), brute.op11(corpus(700), fanout))


def test_one_leaf_is_its_root(spark):
    data = [(7, "s", "en", 3, "abc")]
    same(results(spark, data), brute.op11(data))
    assert rows(manifest(spark, table(spark, data)), "leaf", "root")[0][0] == rows(manifest(spark, table(spark, data)), "leaf", "root")[0][1]


def test_no_rows(spark):
    assert results(spark, []) == []


def test_nulls_repeats_and_far_ids(spark):
    rnd = random.Random(4)
    data = corpus(60) + [(None, "s", "en", 1, f"t{i}") for i in range(40)] + [(9, "s", "en", 1, "same")] * 30 + [(2**62 + i, None, "en", None, "x") for i in range(20)] + [(-(2**63) + 1, None, "en", None, "x"), (2**63 - 1, "s", "en", 0, "long " * 300_000)]
    rnd.shuffle(data)
    same(results(spark, data), brute.op11(data))


def test_tampered_rows_are_told(spark):
    got = results(spark, corpus(300, 5))
    assert {r[-1] for r in got} == {True, False} and len({r[3] for r in got}) == 1


def test_fields_are_told_apart(spark):
    data = [(1, "a", "en", 1, "b"), (1, "a", "en", 1, None), (1, "-", "en", 1, "b"), (1, "", "en", 1, "b"), (1, None, "en", 1, "b")]
    got = rows(table(spark, data).select(leaf().alias("h")), "h")
    assert len(set(got)) == len(data) and len(FIELDS) == 5


@pytest.mark.parametrize("most,target", [(4, 2), (1, 1), (1024, 32)])
def test_ranks(spark, most, target):
    rnd = random.Random(2)
    keys = [rnd.randrange(-50, 50) for _ in range(300)] + [7] * 100 + [2**60 + rnd.randrange(9) for _ in range(50)] + [-(2**61)] * 20
    data = [(rnd.choice(["", "=a", "=b"]), k, rnd.choice([1, 2**40, -5]), i) for i, k in enumerate(keys)]
    frame_ = spark.createDataFrame(data, "g string, a long, b long, c long")
    found = bucketed(frame_, ["a", "b", "c"], Scratch(spark, "t"), "x", target, most)
    sizes = rows(found.table, "n")
    assert sum(n for (n,) in sizes) == len(data) and max(n for (n,) in sizes) <= most
    want = [(*x, i) for g in {d[0] for d in data} for i, x in enumerate(sorted(d for d in data if d[0] == g))]
    same(rows(ranked(frame_, found, ["a", "b", "c"]), "g", "a", "b", "c", "r"), want)


def test_shared_documents(spark):
    got = manifest(spark, frame(spark, docs(n=20)))
    assert got.count() == len(docs(n=20)) and got.select("root").distinct().count() == 1
