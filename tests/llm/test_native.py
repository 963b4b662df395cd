"""Operators 3, 5 and 10 against plain versions, and their SQL."""

import random
import re

import pytest
from cases import docs, frame, prose, rows, same
from pyspark.sql import functions as F

import brute
from loomspark.llm.decontam import contamination, digest
from loomspark.llm.quality import POLICIES, ablations, ledger, passes
from loomspark.llm.secrets import joined, secret_spans

TWICE = docs() + docs()[10:30] + [(None, "token: abcdefgh"), (None, None)]


def spans(spark, d):
    r = secret_spans(spark, d)
    base = F.concat("assign", "access", "hex")
    return r.select("doc_id", *[F.size(c).alias(f"n_{c}") for c in ("assign", "access", "hex")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, "weak")).alias("spans"))


@pytest.mark.parametrize("data", [TWICE, []])
def test_secret_spans(spark, data):
    same(rows(spans(spark, frame(spark, data)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), brute.op3(data))


def test_weak_parts_need_a_complement(spark):
    weak = "aB3" * 14
    gap = "x " * 400
    data = [(1, f"{weak} alone"), (2, f"AKIA{'A' * 16} and {weak}"), (3, f"AKIA{'A' * 16} {gap} {weak}"), (4, f"https://h.example/p {weak}"), (5, "https://h.example/p")]
    got = dict(rows(spans(spark, frame(spark, data)), "doc_id", "spans"))
    assert "secret" not in got[1] and "secret:25:67" in got[2] and "secret" not in got[3]
    assert got[4] == "endpoint:0:19,secret:20:62" and got[5] == ""


def test_scope_lies_between_parts(spark):
    weak, access, hexed = "aB3" * 14, "AKIA" + "A" * 16, "0af3" * 8
    url, long = "https://h.example/p", "https://h.example/p?q=" + "x." * 300
    texts = [f"{long} {weak}", f"{weak * 12} {access}", f"{access} {weak * 12} {hexed}", f"{url} {hexed}", f"{hexed} {url}", f"{url}{' ' * 400}{hexed}", f"{url}{' ' * 401}{hexed}", f"{weak}{' ' * 400}{access}", f"{weak}{' ' * 401}{access}", f"{access} {'x ' * 300} {weak} {hexed} {long} {'x ' * 190} {weak}"]
    base = spans(spark, frame(spark, list(enumerate(texts)))).collect()
    for r in base:
        found = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(","))] if r.spans else []
        every = set(found) | {("secret", m.start(), m.end()) for m in re.finditer(f"({weak})+", texts[r.doc_id])} | {("endpoint", m.start(), m.end()) for m in re.finditer(r"https://\S+", texts[r.doc_id])}
        mates = {"secret": ("access", "endpoint"), "endpoint": ("assign", "hex", "secret")}
        want = {x for x in every if x[0] in mates and any(y[0] in mates[x[0]] and max(y[1] - x[2], x[1] - y[2]) <= 400 for y in every)}
        assert {x for x in found if x[0] in mates} == want, r.doc_id
    assert [bool(r.spans and ("secret" in r.spans or "endpoint" in r.spans)) for r in sorted(base)] == [True] * 6 + [False, True, False, True]


def plain_spans(text, scope=400):
    """All spans of a text by its definition: every pair of parts is looked at."""
    find = lambda p, least=0, g=0: [(m.start(), m.end()) for m in re.finditer(p, text, re.ASCII) if len(m[g]) >= least]
    parts = {
        "assign": find("""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 6, 2), "access": find("AKIA[A-Z0-9]+", 20), "hex": find("[0-9a-f]+", 24),
        "endpoint": find("""(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+"""),
    }
    parts["secret"] = [x for x in find("[A-Za-z0-9+/_-]{32,}={0,2}") if all(re.search(c, text[x[0] : x[1]]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
    ends = [m.start() for m in re.finditer(r"\n[\x20\x09\r]*\n", text)]
    block = lambda at: sum(e < at for e in ends)
    mates = {"secret": ("access", "endpoint"), "endpoint": ("assign", "hex", "secret")}

    def meets(x, y):
        gap = y[0] - x[1] if y[0] >= x[1] else x[0] - y[1]
        return 0 <= gap <= scope and block(x[0]) == block(y[0])

    kinds = ("assign", "access", "hex", "secret", "endpoint")
    out = [(s, i, e, k) for i, k in enumerate(kinds) for s, e in parts[k] if k not in mates or any(meets((s, e), y) for m in mates[k] for y in parts[m])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_spans_are_those_of_all_pairs(spark):
    rnd, weak = random.Random(6), lambda: "".join(rnd.choice("aB3/_x") for _ in range(rnd.randint(30, 45)))
    part = [lambda: f"https://h.example/{weak()}", weak, lambda: "AKIA" + "A" * rnd.randint(14, 18), lambda: "0af3" * 8, lambda: "token = " + "q" * rnd.randint(4, 8), lambda: "s3://b", lambda: "x " * rnd.choice([3, 150, 199, 200, 201]), lambda: "\n", lambda: "\n \t\n", lambda: "wörd 🙂"]
    data = [(i, "".join(rnd.choice(part)() + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(1, 14)))) for i in range(300)]
    data += [(1000, "https://h.example/" + "aB3" * 14), (1001, "https://h.example/" + "aB3" * 14 + " AKIA" + "A" * 16)]
    got = dict(rows(spans(spark, frame(spark, data)), "doc_id", "spans"))
    for i, t in data:
        assert got[i] == plain_spans(t), t
    assert got[1000] == "" and sum("secret" in x for x in got.values()) > 30


def test_many_matches_in_one_text(spark):
    text = "token=abcdef\n" * 3000
    same(rows(spans(spark, frame(spark, [(1, text)])), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), brute.op3([(1, text)]))


def items():
    rnd = random.Random(9)
    base = next(t for i, t in docs() if i == 60).split()
    return [(1, " ".join(base[50:90])), (2, " ".join(base[100:113])), (3, " ".join(base[7:12])), (4, "home about"), (10, prose(rnd, 40)), (None, " ".join(base[50:90])), (5, ""), (6, None), (7, "zig")]


@pytest.mark.parametrize("data,bench", [(TWICE, items()), (TWICE, items()[:2]), (TWICE, []), ([], items())])
def test_decontamination(spark, data, bench):
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("k", F.lit(1))
    got = digest(contamination(spark, frame(spark, data), b))
    same(rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), brute.op5(data, bench))


@pytest.mark.parametrize("data", [TWICE, []])
def test_quality_ledger(spark, data):
    got = ledger(frame(spark, data)).withColumn("base_failed", ~passes("base", 1))
    same(rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), brute.op10(data))


def test_ablations_count_what_only_one_rule_rejects(spark):
    led = ledger(frame(spark, TWICE)).cache()
    got = {r.rule: (r.n_failed, r.n_only_this) for r in ablations(led, "base", 1).collect()}
    want = brute.op10(TWICE)
    few, rep = [r[1] < 50 for r in want], [100 * r[5] > 50 * r[1] for r in want]
    assert got == {"few_words": (sum(few), sum(a and not b for a, b in zip(few, rep))), "repeated_words": (sum(rep), sum(b and not a for a, b in zip(few, rep)))}
    assert {r for rules in POLICIES.values() for r in rules} <= set(__import__("loomspark.llm.quality", fromlist=["RULES"]).RULES)


def test_a_megabyte_of_matches(spark):
    """Base spans and offsets of a text with 40,000 matches, weak secrets among them; time grows with the matches."""
    import time

    line = f"token: abcdefgh{{}} AKIA{'A' * 16} {'0af3' * 6} {'aB3' * 14} https://h.example/p\n"
    took = []
    for n in (2000, 8000):
        text = "é" + "".join(line.format(i % 10) for i in range(n))
        began = time.perf_counter()
        r = spans(spark, frame(spark, [(1, text)])).first()
        took.append(time.perf_counter() - began)
        assert (r.n_assign, r.n_access, r.n_hex) == (n, n, n)
        assert r.base_sha256 == brute.op3([(1, text)])[0][4]
        assert r.spans.count("secret:") == n and r.spans.count("endpoint:") == n
    assert took[1] < 12 * max(took[0], 1.0)
