"""Configuration, layout, integrity, retrieval, versions and artifacts on small tables."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from loomspark.config import Config, ConfigError, Partition, Role
from loomspark.functions import hashing, status, text
from loomspark.operators import audit, changes, graph, integrity, layout, retrieval
from loomspark.sources import artifacts, files, snapshots

C = Config()


@pytest.mark.parametrize(
    "change",
    [
        {"separator": "-"}, {"separator": "##"}, {"strictness": C.statuses[:4]}, {"invalidating": ("gone",)}, {"subblocks": ("c", "d", "p")},
        {"roles": (*C.roles, Role("more", "ref", "x", "c", C.roles[0].layers))}, {"roles": (dataclasses.replace(C.roles[0], token="r-f"), *C.roles[1:])},
        {"roles": (dataclasses.replace(C.roles[0], layers={"kernel": "X"}), *C.roles[1:])}, {"partitions": (*C.partitions, Partition("core", "", "z", "", "public", "kernel"))},
        {"partitions": (*C.partitions, Partition("sub", "", "z", "", "public", "kernel", "docs/public/core/sub"))},
        {"partitions": (*C.partitions, Partition("x", "", "y", "", "public", "kernel", "docs/public/core-x"), Partition("sub", "", "z", "", "public", "kernel", "docs/public/core/sub"))},
        {"dependent_roles": ("debate", "ops")}, {"file_roles": ("contract", "debate", "ops")}, {"required_fields": {"gone": ("x",)}}, {"enum_fields": {"other": ("x",)}}, {"unindexed": {"core": "bad"}}, {"unindexed": {"nowhere": "warn"}},
        {"patterns": {"spec_anchor": r"^\^(?P<id>{anchor_di})$"}}, {"patterns": {"spec_anchor": r"^\^({anchor_id})$"}}, {"patterns": {"heading": "^(#+"}}, {"patterns": {"heading": r"^(#{1,6})\s+.*$"}}, {"partitions": (Partition("a", "", "z", "", "nowhere", "kernel"),)},
    ],
)
def test_bad_configurations_stop(change):
    with pytest.raises(ConfigError):
        dataclasses.replace(C, **change)


def test_renamed_vocabulary(spark):
    from loomspark.operators import blocks

    new = dataclasses.replace(C, roles=tuple(dataclasses.replace(r, token=x) for r, x in zip(C.roles, ("cite", "sops", "logs"))))
    f = spark.createDataFrame([("a.md", "> [!sops-spec-1] t\n\n> [!ops-spec-1] u\n")], "rel_path string, text string")
    assert [r.node_id for r in blocks.callouts(f, new).collect()] == ["spec-1#ops-p01"]


def test_paths(spark):
    paths = ["docs/public/core/t1/t2/01-x.contract.en.md", "docs/public/core/a.b.vi.md", "docs/public/core.en.md", "docs/public/corex/a.en.md", "docs/private/exec/x.evi.en.md", "docs/public/ops/x.fr.md"]
    got = {r.rel_path: r for r in layout.classified(spark.createDataFrame([(p,) for p in paths], "rel_path string"), C).collect()}
    r = got[paths[0]]
    assert (r.partition, r.scope, r.document_id, r.role, r.locale, r.tractate, r.extension) == ("core", "public", "01-x", "contract", "en", ["t1", "t2"], ".md")
    assert (got[paths[1]].document_id, got[paths[1]].role, got[paths[1]].tractate) == ("a.b", None, [])
    assert [got[p].partition for p in paths[2:]] == [None, None, "exec", None] and got[paths[4]].document_id == "x.evi"
    faults = spark.createDataFrame([(x,) for x in ("../x", "docs/public/core/x.en.md", "docs/other/x.en.md", "docs/public/ops/x.md", "/a")], "p string").select(layout.target_fault(F.col("p"), C)).collect()
    assert [r[0] for r in faults] == ["not normalized", None, "outside partitions", "not a corpus file name", "not normalized"]
    assert spark.createDataFrame([("drafts/public/core/x.en.md",)], "p string").select(layout.staging_target(F.col("p"), C)).first()[0] == "docs/public/core/x.en.md"


def test_globs():
    import re

    from loomspark.config import glob_to_regex

    hit = lambda g, p: bool(re.match(glob_to_regex(g), p))
    assert hit("a/**", "a") and not hit("a/**", "ab") and hit("**/drafts/**", "x/drafts")
    for bad in ("", "/a", None):
        with pytest.raises(ValueError):
            glob_to_regex(bad)
    # ** may stand anywhere in a segment.
    assert hit("a**", "a/b/c") and hit("docs/**.tmp", "docs/x/y.tmp") and not hit("docs/**.tmp", "docs/x/y.md") and hit("a**/b", "ab") and hit("a**/b", "ax/y/b") and hit("**", "a/b") and hit("**/**", "a")
    assert hit("**/x/*.md", "a/b/x/c.md") and hit("**/x/*.md", "x/c.md") and not hit("*.md", "a/b.md") and hit("a/**", "a/b/c") and not hit("a?", "a/")


def test_parents(spark):
    ids = spark.createDataFrame([(x,) for x in ("spec-1", "spec-1-c01", "spec-1#ops-p01", "spec-1-x99", "spec-2-d01")], "id string")
    assert dict(map(tuple, integrity.parents(ids, C).collect())) == {"spec-1": None, "spec-1-c01": "spec-1", "spec-1#ops-p01": "spec-1", "spec-1-x99": None, "spec-2-d01": None}


def test_orphans_take_composite_ids(spark):
    c = spark.createDataFrame([("spec-1",), ("spec-1",)], "spec_id string").withColumn("source_file", F.lit("f"))
    k = spark.createDataFrame([("spec-1", "spec-1#debate-d01"), ("spec-1#debate-d01", "q"), ("spec-9", "z")], "target_id string, node_id string")
    assert [r.target_id for r in integrity.orphans(c, k).collect()] == ["spec-9"]
    assert [(r.spec_id, r.n, r.files) for r in integrity.duplicates(c).collect()] == [("spec-1", 2, ["f"])]


def test_every_status_pair(spark):
    order, bad = {s: i for i, s in enumerate(C.strictness)}, C.invalidating
    pairs = [(c, d) for c in (*C.statuses, None) for d in (*C.statuses, None)]
    got = spark.createDataFrame(pairs, "c string, d string").select("c", "d", status.resolved(F.col("c"), F.col("d"), C).alias("x")).collect()
    for r in got:
        want = r.c if r.d is None else r.d if r.c is None or order[r.d] >= order[r.c] else "invalidated" if r.c in bad else r.c
        assert r.x == want, r
    with pytest.raises(Exception, match="unknown status"):
        spark.createDataFrame([("active", "odd")], "c string, d string").select(status.resolved(F.col("c"), F.col("d"), C)).collect()


def test_retriever_pins_anchors_and_expands(spark):
    rows = [("spec-1", "contract", "spec-1", "Rate limits", "limits on rates", 0), ("spec-1#debate-0", "debate", "spec-1", "Why rates", "rates rates", 1), ("adr-2", "contract", "adr-2", "Other", "nothing here", 2), ("adr-2#ops-0", "ops", "adr-2", "Do", "rates", 3)]
    u = spark.createDataFrame([(a, k, p, p, t, x, o) for a, k, p, t, x, o in rows], "uid string, kind string, anchor_id string, parent_anchor string, title string, text string, ord int")
    r = retrieval.Bm25Retriever(u, ("debate", "ops"))
    hits = r.retrieve("rates of ^ADR-2", 3).orderBy("pos").collect()
    assert [(h.uid, h.reason) for h in hits] == [("adr-2", "anchor"), ("adr-2#ops-0", "bm25"), ("spec-1#debate-0", "bm25")]
    more = retrieval.expanded(u, r.retrieve("rates of ^ADR-2", 3), 10).orderBy("pos").collect()
    assert [(h.uid, h.reason) for h in more] == [("adr-2", "anchor"), ("adr-2#ops-0", "child-of:adr-2"), ("spec-1", "parent-of:spec-1#debate-0"), ("spec-1#debate-0", "bm25")]
    assert [h.uid for h in retrieval.expanded(u, r.retrieve("rates of ^ADR-2", 3), 3).orderBy("pos").collect()] == ["adr-2", "adr-2#ops-0", "spec-1"]
    assert retrieval.children_of(u, "SPEC-1").count() == 1 and retrieval.by_anchor(u, "adr-2").first().title == "Other"
    shown = u.withColumns({"computed_status": F.lit(""), "status": F.lit("active"), "invalidated": F.lit(False), "layer": F.lit("L"), "source_file": F.lit("f"), "document_title": F.lit(""), "document_id": F.lit("d")})
    out = retrieval.prompt(shown, r.retrieve("rates", 1), "rates? ", "Be brief.", {"lang": "en", "hash": None}).first().prompt
    assert out == "## SYSTEM\nBe brief.\n\n## GRAPH\nlang=en\n\n## CONTEXT\n[1] DEBATE debate -> ^spec-1 | status: active | layer: L\ntitle: Why rates\nsource: f (document: d)\nrates rates\n\n## QUESTION\nrates?\n"


def test_hash_chain(spark):
    import hashlib

    rows, prev = [], hashing.GENESIS
    for i in range(25):
        h = hashlib.sha256(f"p{i}\0t\0{i}\0{prev}".encode()).hexdigest()
        rows.append((i, f"p{i}", "t", prev, h))
        prev = h
    chain = spark.createDataFrame(rows, "sequence long, payload string, timestamp string, prev_hash string, hash string")
    assert audit.first_break(chain).first().sequence is None
    assert audit.links(chain, block=4).filter("fault is not null").count() == 0
    assert tuple(audit.first_break(chain.withColumn("payload", F.when(F.col("sequence") == 7, "x").otherwise(F.col("payload")))).first()) == (7, "hash")
    assert tuple(audit.first_break(chain.filter("sequence <> 12")).first()) == (13, "gap")
    none = lambda c, n: chain.withColumn(c, F.when(F.col("sequence") != n, F.col(c)))
    assert tuple(audit.first_break(none("hash", 7)).first()) == (7, "hash") and tuple(audit.first_break(none("prev_hash", 7)).first()) == (7, "link")
    assert audit.first_break(none("hash", 24)).first().sequence == 24


def test_blob_ids_are_those_of_git(spark):
    got = spark.createDataFrame([("hello\n",), ("",)], "x string").select(hashing.blob_id(F.col("x"))).collect()
    assert [r[0] for r in got] == ["ce013625030ba8dba906f756967f9e9ca394464a", "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"]


def test_store_commits_and_conflicts(spark, tmp_path):
    s = snapshots.Store(spark, f"file://{tmp_path}")
    f = lambda **x: spark.createDataFrame(list(x.items()), "rel_path string, text string")
    one = s.commit(f(a="1", b="2"))
    assert s.commit(f(a="1"), expected=one) == one
    with pytest.raises(snapshots.ConflictError):
        s.commit(f(c="3"))
    two = s.commit(f(c="2", a="9"), expected=one, removals=spark.createDataFrame([("b",)], "rel_path string"))
    assert dict(map(tuple, s.texts(two).collect())) == {"a": "9", "c": "2"}
    assert sorted(map(tuple, s.changes(one, two).collect())) == [("M", "a", "a"), ("R", "c", "b")]
    with pytest.raises(ValueError):
        s.commit(spark.createDataFrame([("../x", "")], "rel_path string, text string"), expected=two)
    bad = lambda c: c.filter("rel_path = 'bad'").select(F.lit("fail").alias("level"), F.col("rel_path").alias("path"), F.lit("no").alias("message"))
    # Of two writers from one version the second one loses, however late it moves the pointer.
    other, raced = snapshots.Store(spark, f"file://{tmp_path}"), []
    tip = other._tip

    def late(branch):
        seen = tip(branch)
        if not raced:
            raced.append(s.commit(f(first="x"), expected=two))
        return seen

    other._tip = late
    with pytest.raises(snapshots.ConflictError):
        other.commit(f(second="y"), expected=two)
    assert s.tip() == raced[0] and dict(map(tuple, s.texts(raced[0]).collect())) == {"a": "9", "c": "2", "first": "x"}
    again = s.commit(f(copy="x"), expected=raced[0])
    assert spark.read.parquet(f"{tmp_path}/blobs").groupBy("blob_id").count().filter("count > 1").count() == 0
    got = snapshots.ingest(s, f(a="9", bad="x"), bad)
    assert not got.accepted and got.commit is None and [tuple(r) for r in got.findings.collect()] == [("fail", "bad", "no")]
    tried = snapshots.ingest(s, f(a="9", e="y"), bad, dry_run=True)
    assert tried.accepted and tried.commit is None and s.tip() == again
    assert dict(map(tuple, got.changes.collect())) == {"unchanged": 1, "added": 1, "removed": 3}
    done = snapshots.ingest(s, f(a="9", d="x"), bad).commit
    assert done == s.tip() and dict(map(tuple, s.texts(done).collect())) == {"a": "9", "d": "x"}


def test_files_from_disk(spark, tmp_path):
    for p, x in (("docs/public/core/t/a.contract.en.md", b"---\nstatus: Active\ntags: [x, 1]\nversion: 1.10\n---\n# A\n"), ("docs/private/exec/b.vi.md", "# B\n".encode()), ("docs/public/core/notes.txt", b"x")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(x)
    got = files.documents(spark, str(tmp_path), C).select("rel_path", "partition", files.front_matter("text").alias("f")).orderBy("rel_path").collect()
    assert [(r.rel_path, r.partition) for r in got] == [("docs/private/exec/b.vi.md", "exec"), ("docs/public/core/t/a.contract.en.md", "core")]
    assert (got[1].f.status, got[1].f.tags, got[1].f.version, got[1].f.raw["status"], got[0].f.status) == ("active", ["x", "1"], "1.1", "Active", None)
    assert files.documents(spark, str(tmp_path), C, "public", "en").count() == 1
    (tmp_path / "docs/public/core/bad.en.md").write_bytes(b"\xff\xfe")
    assert files.documents(spark, str(tmp_path), C, "public", strict=False).count() == 1
    with pytest.raises(Exception, match="not UTF-8"):
        files.documents(spark, str(tmp_path), C, "public").collect()


def test_artifact_round_trip(spark, tmp_path):
    from loomspark.plans.catalogue import _layered, nested_graph

    sf = "/root/testdata/sf0.001"
    g = nested_graph(spark, sf).cache()
    both = g.unionByName(g.withColumn("locale", F.lit("vi")))
    index = graph.anchor_index(*(x.withColumn("parent_anchor", F.lit(None).cast("string")) for x in _layered(spark, sf))).cache()
    index = index.unionByName(index.withColumn("locale", F.lit("vi")))
    path = str(tmp_path / "graph.json")
    write = lambda d, i, target="internal": artifacts.write(d, i, path, C, target, "2024-01-01T00:00:00Z")
    assert write(both, index) and not write(both, index)
    art = json.loads((tmp_path / "graph.json").read_text())
    assert list(art) == ["scope", "vi", "en", "metadata"] and art["metadata"]["total_nodes"] == 400
    assert [p["id"] for p in art["en"]["partitions"]] == [p.id for p in C.partitions] and list(art["en"]["partitions"][0]) == ["id", "label", "scope", "documents"]
    assert art["metadata"]["graph_hash"] == graph.graph_hash({x: art[x] for x in ("vi", "en")}) and artifacts.metadata(path) == art["metadata"]
    assert artifacts.declared_scope(path) == "internal" and artifacts.languages(path) == ["en", "vi"]
    node = art["en"]["partitions"][0]["documents"][0]["nodes"][0]
    assert art["en"]["anchor_index"][node["debates"][0]["node_id"]]["parent_anchor"] == node["anchor_id"] and tuple(node["debates"][0]) == graph.ENTRY
    kind = g.schema["document"].dataType.simpleString()
    for again in (artifacts.read(spark, path, "en", kind), artifacts.read(spark, path, "en")):
        assert again.count() == g.count()
    units = lambda d: graph.flattened(d, C).drop("ord")
    again = units(artifacts.read(spark, path, "en", kind))
    assert again.subtract(units(g)).count() == 0 and units(g).subtract(again).count() == 0
    flat = graph.units(*_layered(spark, sf), C).drop("ord")
    assert flat.select(again.columns).subtract(again).count() == 0 and flat.count() == again.count()
    with pytest.raises(artifacts.LeakError):
        write(both.filter("partition in ('core', 'adr', 'ops')"), index.filter("partition in ('core', 'adr', 'ops')"), "public")
    with pytest.raises(ValueError):
        artifacts.digest(g, index.filter("locale = 'en'"), C, "public", ["en"])
    assert json.loads(artifacts.serialize({"b": None, "a": "é"})) == {"b": None, "a": "é"}
    assert list(artifacts.strings({"a": ["x", {"b": "y"}]})) == [(".a[0]", "x"), (".a[1].b", "y")]
    from loomspark.plans import ask

    asked = graph.flattened(artifacts.read(spark, path, "en", kind), C)
    with pytest.raises(ask.ScopeError):
        ask.checked_scope(path, asked, C)
    assert ask.checked_scope(path, asked, C, internal=True) == "internal"
    (tmp_path / "old.json").write_text('{"en": {"partitions": []}, "metadata": {}}')
    with pytest.raises(ask.ScopeError):
        ask.checked_scope(str(tmp_path / "old.json"), asked, C)
    assert ask.checked_scope(str(tmp_path / "old.json"), asked.limit(0), C) == "unknown"
    with pytest.raises(ValueError):
        ask.retriever_of("none", asked)


def test_words_are_composed_and_folded(spark):
    import unicodedata

    words = ["GIỚI HẠN", unicodedata.normalize("NFD", "Giới hạn"), "Straße STRASSE", "ΣΊΣΥΦΟΣ", "ﬁn İx ŉa", "ſet", "Ж́ж", "東京 ソ", "K e\u0301"]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t string").select("i", text.tokens(F.col("t")).alias("x")).orderBy("i").collect()
    import regex

    assert [r.x for r in got] == [regex.findall(r"[\p{L}\p{N}_]+", unicodedata.normalize("NFC", w).casefold()) for w in words]


def test_scores_are_not_rounded_and_equal_ones_tie(spark):
    rows = [(str(i), "a b c", i) for i in range(30)] + [("x", "a b c " + "d " * 3, 99)]
    u = spark.createDataFrame(rows, "uid string, text string, ord int")
    own = retrieval.bags(u, title=None, anchor=None)
    scores = retrieval.bm25(retrieval.postings(own), retrieval.totals(own), ["c", "a", "b"])
    got = {r.uid: r.score for r in scores.collect()}
    assert len({got[str(i)] for i in range(30)}) == 1 and got["0"] != round(got["0"], 6) and got["x"] < got["0"]
    assert sorted(map(tuple, retrieval.postings(own, ["a", "zz"]).collect()))[0] == ("0", 3, "a", 1)
    assert dict(map(tuple, retrieval.document_frequencies(own).collect())) == {"a": 31, "b": 31, "c": 31, "d": 1}


def test_evidence_files_have_a_lifecycle(spark):
    from loomspark.plans.compiler import linted

    f = [("docs/public/core/a.evi.en.md", "---\nstatus: archived\n---\n"), ("docs/public/core/a.contract.en.md", "---\nstatus: archived\n---\n"), ("docs/public/core/b.ops.en.md", "---\nstatus: deprecated\narchived_reason: obsolete_logic\nsuperseded_by: \u00a0\n---\n")]
    d = layout.classified(spark.createDataFrame(f, "rel_path string, text string"), C).withColumn("front", files.front_matter("text"))
    got = sorted((r.path.rsplit("/", 1)[-1], r.message) for r in linted(d, C, spark).filter("code = 'lifecycle'").collect())
    assert got == [("a.evi.en.md", "archived_reason: missing"), ("b.ops.en.md", "superseded_by: missing")]


def test_lint_keeps_locales_apart(spark):
    from loomspark.plans.compiler import linted

    body = "# T\n## A\nx\n^spec-1\n"
    two = [("docs/public/core/a.en.md", body), ("docs/public/core/a.vi.md", body)]
    own = lambda fs: layout.classified(spark.createDataFrame(fs, "rel_path string, text string"), C)
    assert linted(own(two), C, spark).count() == 0
    got = linted(own([*two, ("docs/public/adr/b.en.md", body)]), C, spark).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.code) for r in got) == [("a.en.md", "duplicate"), ("b.en.md", "duplicate"), ("b.en.md", "misplaced")]


def test_configuration_is_read(tmp_path):
    import yaml

    from loomspark import config

    taxonomy = {"config_version": "1.0.0", "partitions": [{"id": "core", "label": "Core", "domain": "spec", "codeowner": "@a", "scope": "public", "flavor": "kernel"}]}
    plan = {"layout_version": "1.0.0", "root": "docs", "scopes": [{"id": "public", "level": 0, "path": "open"}], "targets": [{"id": "public", "scopes": ["public"], "artifact": "g.json"}], "filenames": {"extensions": [".md"], "locale": {"mode": "suffix", "values": ["en"]}}}
    layers = {"kernel": "K"}
    projection = {"config_version": "1.0.0", "callout_kinds": {"debate": {"graph_key": "debates", "layer_by_flavor": layers}}, "node_projection": {"contract": {"layer_by_flavor": layers}}}
    rules = {
        "config_version": "1.0.0", "document_roles": ["contract", "debate"], "status_values": ["active", "archived"], "file_naming": {"roles": ["contract", "debate"], "severity": "fail", "pattern": "^(?P<slug>[a-z]+)(?:\\.(?P<role>{file_role_alt}))?{locale_sep}(?P<locale>{locale_alt}){extension_pattern}$"},
        "callout_kinds": {"aliases": {"cite": "debate"}, "suffix_letters": {"debate": "d"}, "separator": "#", "subblock_letters": ["c", "d"]},
        "dependent_lifecycle": {"dependent_roles": ["debate"], "reasons": ["old"], "conditional_requirements": {"archived": ["why", "by"]}, "enum_fields": {"why": "reasons"}, "anchor_reference_fields": ["by"], "strictness_order": ["active", "archived"], "invalidating_parent_states": ["archived"], "severity": "warn"},
        "payload_lock": {"mutable_frontmatter_keys": ["status"]}, "unindexed_policy": {"default": "info", "by_partition": {"core": "fail"}}, "patterns": {"spec_anchor": "^@(?P<id>{anchor_id})$", "heading": "^(#{1,6})\\s+(.*\\S)\\s*$", "not_read": "{odd"},
    }

    def load(**changed):
        for name, value in (("taxonomy.yaml", taxonomy), ("corpus_layout.yaml", plan), ("ui_projection.yaml", projection), ("linter_rules.json", rules | changed)):
            (tmp_path / name).write_text(json.dumps(value) if name.endswith(".json") else yaml.safe_dump(value))
        return config.load(str(tmp_path))

    c = load()
    assert (c.required_fields, c.enum_fields, c.anchor_fields, c.mutable_keys) == ({"archived": ("why", "by")}, {"why": ("old",)}, ("by",), ("status",))
    assert (c.unindexed, c.unindexed_default, c.lifecycle_severity, c.naming_severity, c.dependent_roles) == ({"core": "fail"}, "info", "warn", "fail", ("debate",))
    assert c.anchor_pattern == "^@((?:spec)(?:-[A-Za-z0-9]+)+)$" and c.naming_pattern == r"^([a-z]+)(?:\.(contract|debate))?\.(en)\.md$"
    for bad in ({"patterns": {"spec_anchor": "^@{anchor_id}$"}}, {"dependent_lifecycle": rules["dependent_lifecycle"] | {"dependent_roles": ["ops"]}}, {"dependent_lifecycle": rules["dependent_lifecycle"] | {"enum_fields": {"why": "gone"}}}, {"unindexed_policy": {"default": "loud"}}):
        with pytest.raises(ConfigError):
            load(**bad)


def test_cache(spark):
    f = spark.createDataFrame([("a", "1"), ("b", "2")], "rel_path string, sha256 string")
    held = spark.createDataFrame([("a", "1", "v"), ("b", "2", "old"), ("z", "9", "v")], "rel_path string, sha256 string, version string")
    assert [r.rel_path for r in changes.cache_misses(f, held, "v").collect()] == ["b"]
    assert sorted(r.rel_path for r in changes.pruned(held, f).collect()) == ["a", "b"]


def test_stream_of_files(spark, tmp_path):
    from loomspark.streaming.corpus import ingest_stream

    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    spark.createDataFrame([("a", "1"), ("b", "2")], "rel_path string, text string").write.parquet(f"{tmp_path}/in/1")
    ingest_stream(spark, f"{tmp_path}/in/*", store, f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("a", "3")], "rel_path string, text string").write.parquet(f"{tmp_path}/in/2")
    ingest_stream(spark, f"{tmp_path}/in/*", store, f"{tmp_path}/cp").awaitTermination()
    assert dict(map(tuple, store.texts(store.tip()).collect())) == {"a": "3", "b": "2"}
