"""The git data source against git's own plain walk, over loose and packed objects."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from loomspark.config import Config
from loomspark.sources import gittree


def git(folder, *args, **more):
    own = ["-c", "user.name=t", "-c", "user.email=t@localhost", "-c", "commit.gpgsign=false", "-c", "init.defaultBranch=main"]
    return subprocess.run(["git", *own, *args], cwd=folder, check=True, capture_output=True, **more).stdout


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at, rnd = tmp_path_factory.mktemp("repo"), random.Random(1)
    git(at, "init", "-q")
    body = [f"line {i} {rnd.random()}\n" for i in range(400)]
    for version in range(4):
        for i in range(12):
            lines = list(body)
            for _ in range(5):
                lines[rnd.randrange(400)] = f"edit {version} {i} {rnd.random()}\n"
            f = at / "docs" / ("public/core" if i % 2 else "private/exec/t") / f"n{i}.en.md"
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text("".join(lines))
        (at / "empty.txt").write_text("")
        (at / "docs/data.bin").write_bytes(bytes(range(256)) * (version + 1))
        git(at, "add", "-A")
        git(at, "commit", "-qm", f"v{version}")
        if version == 1:
            git(at, "tag", "-a", "first", "-m", "t")
        if version == 2:
            git(at, "gc", "-q", "--aggressive")  # packs with chains of deltas, packed refs
    return at


def plain(repo, ref):
    out = {}
    for line in git(repo, "ls-tree", "-r", ref).decode().splitlines():
        meta, path = line.split("\t")
        mode, _, name = meta.split()
        out[path] = (name, mode, git(repo, "cat-file", "blob", name))
    return out


@pytest.mark.parametrize("ref", ["main", "first", "HEAD", "HEAD~2"])
def test_same_rows_as_a_plain_walk(spark, repo, ref):
    gittree.register(spark)
    name = git(repo, "rev-parse", ref).decode().strip() if "~" in ref else ref
    rows = spark.read.format("gittree").option("path", str(repo)).option("ref", name).load()
    assert {r.rel_path: (r.blob_id, r.mode, bytes(r.content)) for r in rows.collect()} == plain(repo, ref)


def test_filters_are_pushed_down(spark, repo, monkeypatch):
    gittree.register(spark)
    rows = spark.read.format("gittree").option("path", str(repo)).load()
    core = rows.filter(F.startswith("rel_path", F.lit("docs/public/")) & F.endswith("rel_path", F.lit(".en.md")) & (F.length("content") > 0))
    assert {r.rel_path for r in core.collect()} == {p for p in plain(repo, "HEAD") if p.startswith("docs/public/")}
    plan = core._jdf.queryExecution().executedPlan().toString()
    assert "length(content" in plan and "StartsWith" not in plan and "EndsWith" not in plan  # the source has taken these
    reader = gittree.TreeReader({"path": str(repo)})
    left = list(reader.pushFilters([gittree.StringStartsWith(("rel_path",), "docs/private/"), gittree.EqualTo(("mode",), "100644")]))
    assert [type(x).__name__ for x in left] == ["EqualTo"]
    opened, get = [], gittree.Objects.get
    monkeypatch.setattr(gittree.Objects, "get", lambda self, name: opened.append(name) or get(self, name))
    few = sum(len(p.objects) for p in reader.partitions())
    pruned = len(opened)
    opened.clear()
    every = sum(len(p.objects) for p in gittree.TreeReader({"path": str(repo)}).partitions())
    assert few == 6 and every == 14 and pruned < len(opened)


def test_partitions_are_ranges_of_packs(repo, monkeypatch):
    monkeypatch.setattr(gittree, "OBJECTS", 4)
    parts = gittree.TreeReader({"path": str(repo), "ref": "first"}).partitions()
    assert all(len(p.objects) <= 4 for p in parts) and all(len({o[3] and o[3][0] for o in p.objects}) == 1 for p in parts)
    offsets = [o[3] for p in parts for o in p.objects if o[3]]
    assert offsets == sorted(offsets) and len(offsets) >= 10


def test_documents_and_description(spark, repo):
    got = gittree.documents(spark, str(repo), Config())
    assert {(r.partition, r.scope, r.locale) for r in got.collect()} == {("core", "public", "en"), ("exec", "private", "en")} and got.count() == 12
    d = gittree.describe(str(repo), "main")
    assert d["commit"] == git(repo, "rev-parse", "main").decode().strip() and d["packs"] == 1 and d["packed_objects"] > 30
    for path, ref in ((str(repo), "nowhere"), (str(repo / "docs"), "main")):
        with pytest.raises(gittree.GitError):
            gittree.describe(path, ref)
