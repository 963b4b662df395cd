"""Operator 13 against a plain version."""

import random

import pytest
from cases import docs, frame, prose, rows, same

import brute
from loomspark.llm.common import Scratch
from loomspark.llm.search import build, ranked_documents, search

ITEMS = [(1, "The of and lorem"), (2, None), (3, "nothing_here zzz"), (None, "Über STRASSE x1 x1 东京 東京"), (5, "ipsum dolor sit amet " * 30), (5, "again"), (7, "one two")]


def items(spark, data):
    return spark.createDataFrame([(*x, 1, "z") for x in data], "item_id long, text string, q long, term string")


def results(spark, data, asked, **how):
    return ranked_documents(spark, frame(spark, data), items(spark, asked), **how)


@pytest.mark.parametrize("data,first,growth", [(docs(), 32, 8), (docs(), 4, 4), ([(1, None)], 32, 8), ([], 32, 8)])
def test_search(spark, data, first, growth):
    got = rows(results(spark, data, ITEMS, first=first, growth=growth), "item_id", "rank", "doc_id", "score")
    same(got, brute.op13(data, ITEMS))


def test_ties_and_repeated_rows(spark):
    data = [(i, "red green blue") for i in range(40, 0, -1)] + [(3, "red green blue"), (None, "red green blue"), (3, "red")]
    got = rows(results(spark, data, [(1, "red blue"), (1, "red blue")], first=8, growth=4), "item_id", "rank", "doc_id", "score")
    same(got, brute.op13(data, [(1, "red blue"), (1, "red blue")]))


def test_items_fall_through_until_proven(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(300)], k=rnd.randint(1, 120)))) for i in range(1500)]
    data += [(5000, f"rare{0} " + " ".join(words[:10]))]
    asked = [(i, " ".join(rnd.sample(words, n))) for i, n in enumerate((1, 2, 5, 20, 80))] + [(9, "rare0 " + " ".join(words[:10]))]
    got = results(spark, data, asked, first=8, growth=3)
    same(rows(got, "item_id", "rank", "doc_id", "score"), brute.op13(data, asked))
    tiers = {r.item_id: r.tier for r in got.collect()}
    assert max(tiers.values()) > 0  # some needed more than the first tier


def test_an_index_serves_many_batches(spark):
    scratch, data = Scratch(spark, "t"), docs()
    index = build(spark, frame(spark, data), scratch, None, 4, 3)
    for n, asked in enumerate(([(1, "lorem ipsum")], [(2, "amet the"), (3, "again")])):
        found = search(index, items(spark, asked).selectExpr("item_id AS q", "text"), Scratch(spark, f"b{n}"), 5)
        got = [(r.q, r.rank, r.k if r.k != -(2**63) else None, r.score) for r in found.collect()]
        same(sorted(got, key=repr), brute.op13(data, asked, 5))


def test_long_texts(spark):
    rnd = random.Random(2)
    data = [(1, prose(rnd, 400_000)), (2, "needle " + "hay " * 1_000_000), (3, "needle")]
    same(rows(results(spark, data, [(1, "needle lorem")]), "item_id", "rank", "doc_id", "score"), brute.op13(data, [(1, "needle lorem")]))
