"""Operators 1 and 6 against the tokenizer run text by text."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import docs, frame, rows, same
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import brute
from loomspark.llm.packing import Plan, pack
from loomspark.llm.tokenio import encoder, token_output

PATH = public_tokenizers.path("word_bpe_49k.json")
TWICE = docs() + docs()[10:30] + [(None, "null id"), (None, None)]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.,éÉßİǰ̌́\x1c\x85\xa0<|>")), max_size=60))
def test_chunks_encode_as_texts(text):
    tok = Tokenizer.from_file(PATH) if not hasattr(test_chunks_encode_as_texts, "tok") else test_chunks_encode_as_texts.tok
    test_chunks_encode_as_texts.tok = tok
    enc = encoder(PATH)
    assert enc.by_chunk
    assert np.frombuffer(enc.encode(text.encode()), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("data", [TWICE, []])
def test_token_files_round_trip(spark, tok, data):
    same(rows(token_output(spark, frame(spark, data), PATH), "doc_id", "start", "n_tokens", "ids_crc32"), brute.op1(data, tok))


@pytest.mark.parametrize("data,window,unit", [(TWICE, 2048, 32), (TWICE, 64, 8), ([(i, "one two three " * 12) for i in range(50)], 64, 8), ([], 2048, 32)])
def test_packing(spark, tok, data, window, unit):
    found = pack(spark, frame(spark, data), PATH, window=window, unit=unit).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    wanted = Counter()
    for i, t in data:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        wanted[i, len(ids)] += len(ids)
    got = Counter()
    for r in found:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == wanted
    texts = dict(data)
    for i, pieces in by_doc.items():
        if sum(1 for j, _ in data if j == i) > 1 or i is None:
            continue
        ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        pieces.sort(key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length])
            at += p.length
        assert at == len(ids) == pieces[0].doc_tokens
    seqs = defaultdict(list)
    for r in found:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= window


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 255), st.integers(1, 40), max_size=25))
def test_plan_is_best_fit_decreasing(counts):
    open_windows, plan = [], Plan(counts, 256, 16)
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            best = min((c for c in open_windows if c >= length), default=None)
            if best is not None:
                open_windows.remove(best)
            open_windows.append((256 if best is None else best) - length)
    assert plan.windows == len(open_windows)
    fill = Counter()
    for length, n in counts.items():
        for rank in range(n):
            pieces = plan.place(length, rank)
            assert sum(p[1] for p in pieces) == length
            for _, size, window, _, _ in pieces:
                fill[window] += size
    assert all(v <= 256 for v in fill.values())
