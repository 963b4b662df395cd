"""What the configuration decides: layouts without a locale, patterns, the cache's version, levels, left out files."""

import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.config import Config, ConfigError, expanded
from loomspark.functions import nested
from loomspark.functions import text as t
from loomspark.operators import blocks, layout, retrieval
from loomspark.plans import compiler, gate
from loomspark.sources import files, snapshots
from loomspark.sources.cache import ParseCache

C = Config()
BARE = dataclasses.replace(C, suffixed=False, locales=("en",))
CORPUS = {
    "docs/public/core/a.md": "# A\n## Rule\nbody\n^spec-1\n> [!ref-spec-1] note\n> why\n",
    "docs/public/adr/b.debate.md": "# B\n> [!ops-spec-1] steps\n> one\n",
}


def placed(spark, corpus, config):
    return layout.classified(spark.createDataFrame(list(corpus.items()), "rel_path string, text string"), config)


def test_files_without_a_locale_have_the_first(spark):
    own = placed(spark, CORPUS, BARE)
    assert {r.locale for r in own.collect()} == {"en"}
    made = compiler.compiled(spark, own, BARE, "public")
    assert {r.document_id for r in made.documents.collect()} == {"a", "b"}
    assert {(r.uid, r.kind) for r in made.units.collect()} == {("spec-1", "contract"), ("spec-1#debate-0", "debate"), ("spec-1#ops-0", "ops")}
    assert {(r.locale, r.documents, r.contracts, r.debates, r.ops, r.evidence) for r in compiler.summarized(made.units, BARE).collect()} == {("en", 1, 1, 1, 1, 0)}
    broken = placed(spark, CORPUS | {"docs/public/core/c.md": "```\nopen"}, BARE)
    assert {(r.level, r.code) for r in compiler.linted(broken, BARE, spark).collect()} == {("fail", "fence")}
    drafts = spark.createDataFrame([("docs/public/core/d.md", "# D\n## R\nx\n^spec-1\n")], "rel_path string, text string")
    assert {r.code for r in gate.drafted(spark, drafts, own, BARE).collect()} == {"duplicate"}


def test_the_cache_knows_every_pattern(spark, tmp_path):
    own = placed(spark, {"docs/public/core/a.en.md": "# A\n## Rule\nbody\n^spec-1\n"}, C)
    cache = ParseCache(spark, f"file://{tmp_path}")
    assert cache.parsed(own, C)[0].count() == 1
    for patterns, n in (({"heading": r"^(%{1,6})\s+(.*\S)\s*$"}, 0), ({"spec_anchor": r"^@(?P<id>{anchor_id})$"}, 0), ({"status_directive": r"^%(?P<status>\w+)$"}, 1)):
        assert cache.parsed(own, dataclasses.replace(C, patterns=patterns))[0].count() == n
        assert cache.last == {"hits": 0, "misses": 1}


def test_patterns_as_configured(spark):
    own = dataclasses.replace(C, patterns={"blockquote_line": r"^\|\s?(.*)$", "ref_callout_start": r"^\|\s*\[(?P<kind>{kind_alt})-(?P<id>{composite_id}|{anchor_id})\](?P<title>.*)$", "status_directive": r"^%(?P<status>[a-z]+)$", "document_h1": r"^=\s(.*)$", "frontmatter_fence": r"^\+\+\+$", "loose_anchor_line": r"^@([a-z0-9-]+)$", "loose_admonition_open": r"^!x$", "subblock_suffix": r"_{subblock_letter_alt}[0-9]+$"})
    body = "+++\nstatus: draft\n+++\n= Title here\nopening\n| [ref-spec-1] t\n| b1\n| b2\n## Rule\n%active\ntext\n^spec-1\n!x\n@spec-2\n"
    f = spark.createDataFrame([("a.md", body)], "rel_path string, text string")
    assert [(r.spec_id, r.content, r.status_override) for r in blocks.contracts(f, own).collect()] == [("spec-1", "text", "active")]
    assert [(r.title, r.content, r.target_id) for r in blocks.callouts(f, own).collect()] == [("t", "b1\nb2", "spec-1")]
    r = f.select(t.title(F.col("text"), F.lit("-"), own.title_pattern).alias("t"), t.prologue(F.col("text"), own.callout_pattern, own.title_pattern, own.fence_pattern).alias("p"), files.front_matter("text", own).alias("f")).first()
    assert (r.t, r.p, r.f.status) == ("Title here", "opening", "draft")
    assert [r.token for r in blocks.typos(f, own).collect()] == ["spec-2"] and [r.construct for r in blocks.banned(f, own).collect()] == ["admonition"]


@pytest.mark.parametrize("name,template,made", [("x", r"^({a}|\({a}\))[({a}]\{a}$", r"^((?:A)|\((?:A)\))[((?:A)]\{a}$"), ("spec_anchor", r"(?P<id>{a})(?:b)[^(]", "((?:A))(?:b)[^(]"), ("heading", "(a{1,6})(?=b)(?P<n>c)", "(a{1,6})(?=b)(c)")])
def test_templates(name, template, made):
    assert expanded(name, template, {"a": "(?:A)"}) == made


@pytest.mark.parametrize("name,template", [("x", "{b}"), ("spec_anchor", "({a})"), ("spec_anchor", "(?P<other>{a})"), ("heading", "(a)"), ("x", "(a"), ("x", ""), ("x", None), ("frontmatter_fence", "(-)")])
def test_templates_that_are_refused(name, template):
    with pytest.raises(ConfigError):
        expanded(name, template, {"a": "A"})


def test_sorts_and_ignored_paths(spark):
    declared = dataclasses.replace(C, domain_sort="as_declared")
    assert declared.domain_alternation.startswith("spec|adr|sop|exec|adrint") and C.domain_alternation.split("|")[0] == "coreint"
    with pytest.raises(ConfigError):
        dataclasses.replace(C, kind_sort="shuffled")
    own = dataclasses.replace(C, ignore=("public/**/_*", "**.tmp.en.md"))
    paths = ["docs/public/core/_x.en.md", "docs/public/core/x.en.md", "docs/private/exec/a/b.tmp.en.md", "docs/public/adr/t/_y.en.md"]
    got = {r.rel_path: r.partition for r in placed(spark, dict.fromkeys(paths, ""), own).collect()}
    assert [got[p] for p in paths] == [None, "core", None, None]


def test_lock_that_is_not_enforced(spark):
    pairs = lambda d: spark.createDataFrame(list(d.items()), "rel_path string, text string")
    base = {"docs/public/core/a.en.md": "# A\n## R\nbody\n^spec-1\n", "docs/public/core/b.debate.en.md": "# B\n> [!ref-spec-1] t\n> b\n"}
    edited = base | {"docs/public/core/a.en.md": "# A\n## R\nother {status}\n^spec-1\n"}
    for enforced, level in ((True, "fail"), (False, "warn")):
        config = dataclasses.replace(C, lock_enforced=enforced)
        assert [(r.level, r.check, r.reason) for r in gate.guarded(pairs(base), pairs(edited), config).collect()] == [(level, "lock", "edited")]
        gone = base | {"docs/public/core/a.en.md": "# A\n## R\n{status: archived}\nbody\n^spec-1\n"}
        assert [(r.level, r.check) for r in gate.guarded(pairs(base), pairs(gone), config).collect()] == [("fail", "deprecation")]


def test_files_that_cite_a_more_closed_scope(spark):
    corpus = {"docs/public/core/a.en.md": "# A\n## R\nx\n^spec-1\n", "docs/public/core/b.en.md": "# B\n## R\ny\n^spec-2\n> [!ref-exec-1] t\n> b\n> more\n", "docs/private/exec/c.en.md": "# C\n## R\nz\n^exec-1\n"}
    own = placed(spark, corpus, C)
    for left_out, docs in ((False, {"a", "b", "c"}), (True, {"a", "c"})):
        made = compiler.compiled(spark, own, C, "internal", exclude_crossing=left_out)
        assert {r.document_id for r in made.documents.collect()} == docs
        assert {r.code for r in made.diagnostics.filter("code = 'boundary'").collect()} == {"boundary"}
        assert ("spec-2" in {r.uid for r in made.units.collect()}) != left_out and ("exec-1#debate-0" in {r.uid for r in made.units.collect()}) != left_out


def test_one_file(spark, tmp_path):
    at = tmp_path / "docs/public/core/t"
    at.mkdir(parents=True)
    (at / "x.ops.en.md").write_text("---\nstatus: Draft\n---\n# Hello\n")
    r = files.one_file(spark, str(at / "x.ops.en.md"), str(tmp_path), C).first()
    assert (r.rel_path, r.partition, r.document_id, r.role, r.status, r.title, r.locale) == ("docs/public/core/t/x.ops.en.md", "core", "x", "ops", "draft", "Hello", "en")


def plain_strings(value, place):
    if isinstance(value, str):
        return [(".".join(place), value)]
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in [(".".join([*place, f"key {k}"]), k), *plain_strings(v, [*place, k])]]
    if isinstance(value, T.Row):
        return [x for k, v in value.asDict().items() for x in plain_strings(v, [*place, k])]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in plain_strings(v, [*place, str(i)])]
    return []


def plain_json(value):
    if isinstance(value, T.Row):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{plain_json(value[k])}" for k in sorted(value, key=str)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(plain_json, value)) + "]"
    if isinstance(value, float):
        return plain_number(value)
    return json.dumps(value, ensure_ascii=False)


def plain_number(x):
    """ECMAScript's Number::toString, from Python's shortest digits."""
    if x != x or abs(x) == float("inf"):
        return "null"
    if x == 0:
        return "0"
    sign, (digits, exponent) = "-" * (x < 0), f"{abs(x)!r}".lower().split("e") if "e" in f"{abs(x)!r}" else (f"{abs(x)!r}", "0")
    whole, _, rest = digits.partition(".")
    point, every = len(whole) + int(exponent), (whole + rest)
    lead = len(every) - len(every.lstrip("0"))
    every, point = every.lstrip("0").rstrip("0"), point - lead
    n = len(every)
    if n <= point <= 21:
        return sign + every + "0" * (point - n)
    if 0 < point <= 21:
        return sign + every[:point] + "." + every[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + every
    e = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + every[0] + ("." + every[1:] if n > 1 else "") + e


SCHEMA = "id string, a string, b array<string>, c map<string,array<struct<x:string,y:double>>>, d struct<e:struct<f:string,g:array<array<string>>>,h:bigint,i:boolean>, j double, k map<string,string>"


def nested_rows(n):
    rnd = random.Random(7)
    word = lambda: rnd.choice(["docs/private/x", "plain", "", None, 'q"\\\n\x01é\U0001f642', "docs/privateer"])
    some = lambda f: None if rnd.random() < 0.15 else [f() for _ in range(rnd.randint(0, 3))]
    number = lambda: rnd.choice([None, 0.0, -0.0, 1.0, -1.5, 1e21, 1e20, 123456789012345680000.0, 1e-7, 1.25e-6, 0.000123, float("nan"), float("inf"), rnd.uniform(-1e9, 1e9), rnd.random() * 10 ** rnd.randint(-30, 30)])
    for i in range(n):
        c = {f"k{j}": some(lambda: T.Row(x=word(), y=number())) for j in range(rnd.randint(0, 3))}
        d = T.Row(e=T.Row(f=word(), g=some(lambda: some(word))) if rnd.random() < 0.9 else None, h=rnd.choice([None, 3, -(2**60)]), i=rnd.choice([True, False, None]))
        yield (str(i), word(), some(word), None if rnd.random() < 0.1 else c, d, number(), {word() or "z": word() for _ in range(2)})


def test_nested_strings_and_leaks(spark):
    rows = list(nested_rows(300))
    frame = spark.createDataFrame(rows, SCHEMA)
    want = sorted((f"{r.id}.{p}", v) for r in frame.collect() for p, v in plain_strings(r, []) if v.startswith("docs/private/"))
    assert sorted(map(tuple, retrieval.leaks(frame, ["docs/private/"], "id").collect())) == want and len(want) > 200
    assert retrieval.leaks(frame, ["docs/private/"], "id", 3).count() == 3


def test_canonical_json(spark):
    frame = spark.createDataFrame(list(nested_rows(400)), SCHEMA)
    got = frame.select(nested.canonical_json({c: F.col(c) for c in frame.columns}, frame.schema).alias("made"), "*").collect()
    for r in got:
        own = r.asDict()
        assert r.made == plain_json({k: own[k] for k in own if k != "made"})


def test_stream_behind_the_gate(spark, tmp_path):
    from loomspark.streaming.corpus import ingest_stream

    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    write = lambda n, d: spark.createDataFrame(list(d.items()), "rel_path string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    good, twice = "docs/public/core/a.en.md", "docs/public/core/b.en.md"
    write(1, {good: "# A\n## R\nx\n^spec-1\n"})
    run = lambda: ingest_stream(spark, f"{tmp_path}/in/*", store, f"{tmp_path}/cp", checks=gate.rejecting(store, C), rejected=f"file://{tmp_path}/out").awaitTermination()
    run()
    write(2, {twice: "# B\n## R\nx\n^spec-1\n", good: "# A\n## R\nzz\n^spec-1\n"})
    import time

    time.sleep(1.1)
    write(3, {good: "# A\n## R\nlater\n^spec-1\n"})
    run()
    assert [r.rel_path for r in store.tree(store.tip()).collect()] == [good]
    assert "later" in store.texts(store.tip()).first().text
    assert {(r.path, r.code) for r in spark.read.parquet(f"{tmp_path}/out").filter("level = 'fail'").collect()} == {(twice, "duplicate")}
