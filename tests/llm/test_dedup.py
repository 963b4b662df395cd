"""Operators 2 and 4 against plain versions."""

import numpy as np
import pytest
from cases import docs, frame, rows, same

import brute
from loomspark.llm import linededup, substrings
from loomspark.llm.common import Scratch, keyed
from loomspark.llm.seen import SEGMENT, Filter

TWICE = docs() + docs()[10:30] + [(None, "Share this\nnull id"), (None, None)]


@pytest.mark.parametrize("data,least", [(TWICE, 10), (TWICE, 2), (TWICE, 3), ([], 10)])
def test_line_dedup(spark, data, least):
    got = linededup.digest(linededup.dedup_lines(spark, frame(spark, data), least))
    same(rows(got, "doc_id", "n_lines", "n_dropped", "kept_sha256"), brute.op2(data, least))


def test_a_full_filter_changes_nothing(spark):
    data = docs(n=40)
    gone = linededup.repeated_lines(frame(spark, data), Scratch(spark, "t"), 3, max_bits=SEGMENT)
    wide = linededup.repeated_lines(frame(spark, data), Scratch(spark, "t"), 3)
    assert sorted(gone.select("k", "th").collect()) == sorted(wide.select("k", "th").collect())
    full = Filter(SEGMENT, bytes([255]) * (SEGMENT // 8))
    every = linededup.suspects(keyed(frame(spark, data)), spark.sparkContext.broadcast(full))
    assert every.count() == sum(len({k for k in linededup.keys_of((t or "").encode()) if k}) for _, t in data)


def test_first_occurrence_stays(spark):
    data = [(i, f"Common\nown {i}\ncommon") for i in range(5)]
    got = dict(rows(linededup.dedup_lines(spark, frame(spark, data), 2, keep_first=True), "k", "kept"))
    assert got == {0: "Common\nown 0"} | {i: f"own {i}" for i in range(1, 5)}


def test_cover_reaches_every_residue():
    for period, cover in ((substrings.PERIOD, substrings.COVER),):
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("data", [TWICE, []])
def test_substring_dedup(spark, data):
    got = substrings.digest(substrings.dedup_substrings(spark, frame(spark, data)))
    key = [(-(2**63) if i is None else i, t) for i, t in data]
    want = [(None if r[0] == -(2**63) else r[0], *r[1:]) for r in brute.op4(key)]
    assert not data or sum(r[2] for r in want) > 1000
    same(rows(got, "doc_id", "n_words", "n_removed", "kept_sha256"), want)


def test_gram_hashes_tell_order():
    from loomspark.llm.common import gram_hashes

    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, 4000).astype(np.uint64)
    for n in (1, 2, 3, 4, 5, 7, 20, 50):
        g = gram_hashes(w, n)
        seen = {}
        for i, h in enumerate(g.tolist()):
            assert seen.setdefault(h, tuple(w[i : i + n])) == tuple(w[i : i + n])
        assert len(seen) == len({tuple(w[i : i + n]) for i in range(len(g))})


def test_copies_of_whole_texts(spark):
    long, short, other = (" ".join(f"{p}{i}" for i in range(n)) for p, n in (("a", 80), ("b", 49), ("c", 120)))
    tail = " ".join(f"a{i}" for i in range(20, 80))
    data = [(5, long), (3, long), (9, long), (7, short), (8, short), (4, f"{other} {tail}"), (9, other), (11, other), (11, "x " + other), (None, tail), (12, tail), (3, long)]
    got = rows(substrings.digest(substrings.dedup_substrings(spark, frame(spark, data))), "doc_id", "n_words", "n_removed", "kept_sha256")
    same(got, [(None if i == -1 else i, *r) for i, *r in brute.op4([(-1 if i is None else i, t) for i, t in data])])
