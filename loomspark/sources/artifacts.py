"""The graph artifact as a JSON file behind the leak gate, and its digest. The file is one, so the driver writes it, but
from rows that come in order: it holds a few documents at a time, never a locale. The digest is one chain over all bytes:
tasks put them in order, and hash one piece after the other from where the last task stopped."""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from functools import cache

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.config import INVALIDATED, Config
from loomspark.operators import graph
from loomspark.operators.graph import SCHEMA_VERSION
from loomspark.operators.layout import classified
from loomspark.sources.lineage import cut, files_bytes


class LeakError(ValueError):
    """A string of a restricted scope in an artifact."""


def serialize(graph: dict, indent: int | None = 2) -> str:
    return json.dumps(graph, ensure_ascii=False, indent=indent, allow_nan=False)


def strings(value, at: str = "", keys: bool = False) -> Iterator[tuple[str, str]]:
    """(location, string) of all strings, depth first; keys of maps too where asked for."""
    if isinstance(value, str):
        yield at, value
    elif isinstance(value, dict):
        for k, v in value.items():
            if keys:
                yield f"{at}.{k}", k
            yield from strings(v, f"{at}.{k}", keys)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from strings(v, f"{at}[{i}]", keys)


def _documents(documents: DataFrame) -> Iterator[tuple[str, str, dict]]:
    """(locale, partition, document) in the artifact's order, streamed a partition of rows at a time."""
    rows = documents.orderBy("locale", "partition", "tractate", "document_id").select("locale", "partition", F.to_json("document", {"ignoreNullFields": "false"}).alias("j"))
    for r in rows.toLocalIterator(prefetchPartitions=True):
        doc = json.loads(r.j)
        if doc.get("source_files") is None:  # only documents of several files name them
            doc.pop("source_files", None)
        yield r.locale, r.partition, doc


def _index(index: DataFrame) -> Iterator[tuple[str, str, dict]]:
    for r in index.orderBy("locale", "anchor").toLocalIterator(prefetchPartitions=True):
        yield r.locale, r.anchor, {"src": r.src, "document_id": r.document_id, "partition": r.partition, "title": r.title, "parent_anchor": r.parent_anchor}


class _Rows:
    """Rows of one sorted stream, taken by key in the order that the keys come."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows = rows
        self.next = next(rows, None)

    def of(self, *key: str) -> Iterator:
        while self.next is not None and self.next[: len(key)] == key:
            yield self.next[len(key) :]
            self.next = next(self.rows, None)


def _dump(x, canonical: bool = False) -> str:
    return json.dumps(x, ensure_ascii=False, allow_nan=False, sort_keys=canonical)


def _graph(docs: _Rows, index: _Rows, locale: str, partitions: list[dict]) -> Iterator[str]:
    """The JSON text of one locale's graph, piece by piece."""

    def anchors() -> Iterator[str]:
        yield '"anchor_index": {'
        for i, (anchor, entry) in enumerate(index.of(locale)):
            yield f"{', ' if i else ''}{_dump(anchor)}: {_dump(entry)}"
        yield "}"

    def every() -> Iterator[str]:
        # The stream is sorted by partition id, the artifact by the configuration: what is early waits on disk.
        held = {}
        with tempfile.TemporaryDirectory() as folder:
            for p in sorted(x["id"] for x in partitions):
                held[p] = os.path.join(folder, p)
                with open(held[p], "w", encoding="utf-8") as f:
                    n = 0
                    for n, (doc,) in enumerate(docs.of(locale, p), 1):
                        f.write((",\n" if n > 1 else "\n") + _dump(doc))  # a line a document, for read_lines()
                    f.write("\n" if n else "")
            yield '"partitions": ['
            for i, p in enumerate(partitions):
                head = [f"{_dump(k)}: {_dump(p[k])}" for k in ("id", "label", "scope")]
                yield ", " if i else ""
                yield "{" + ", ".join(head) + ', "documents": ['
                with open(held[p["id"]], encoding="utf-8") as f:
                    while part := f.read(1 << 20):
                        yield part
                yield "]}"
            yield "]"

    yield "{"
    yield from every()
    yield ", "
    yield from anchors()
    yield "}"


def _partitions(config: Config, target: str) -> list[dict]:
    emitted = set(config.emitted(target))
    return [{"id": p.id, "label": p.label, "scope": p.scope} for p in config.partitions if p.id in emitted]


# --- the digest --------------------------------------------------------------------------------------------------------
#: What a piece of the text is. A document is one piece, or its head, its nodes and its tail.
_HEAD, _NODE, _TAIL, _DOCUMENT, _ANCHOR = range(5)
_PLACE = ("section", "tractate", "name", "kind", "ord")
#: Bytes that are kept in a row once they are in order.
_RUN = 1 << 20


def _sections(config: Config, target: str, locales: list[str]) -> tuple[dict[tuple[str, str | None], int], list[str]]:
    """The number of each list in the canonical text, by locale and partition (None: the anchors), and what stands before
    each of them and after the last."""
    at, before, text = {}, [], "{"
    for i, locale in enumerate(sorted(locales)):
        text += f'{", " if i else ""}{json.dumps(locale)}: {{"anchor_index": {{'
        at[locale, None] = len(before)
        before.append(text)
        text = '}, "partitions": ['
        for k, p in enumerate(_partitions(config, target)):
            at[locale, p["id"]] = len(before)
            before.append(f'{text}{", " if k else ""}{{"documents": [')
            text = "], " + ", ".join(f"{_dump(x)}: {_dump(p[x])}" for x in ("id", "label", "scope")) + "}"
        text += "]}"
    return at, [*before, text + "}"]


def _section(at: dict, partition: Column | None) -> Column:
    """The section of a row; one that the artifact does not have comes last."""
    out = F.lit(len(at))
    for (locale, p), n in at.items():
        if (p is None) == (partition is None):
            here = F.col("locale") == locale
            out = F.when(here if p is None else here & (partition == p), n).otherwise(out)
    return out.alias("section")


def _json(value: Column | str) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"}).alias("j")


def _written(kind: int, j: str) -> str:
    """The canonical text of a piece."""
    x = json.loads(j)
    if kind == _ANCHOR:
        return f"{_dump(x.pop('anchor'))}: {_dump(x, True)}"
    if kind == _NODE:
        return _dump(x, True)
    if x.get("source_files") is None:
        x.pop("source_files", None)
    if kind == _DOCUMENT:
        return _dump(x, True)
    pairs = lambda test: [f"{_dump(k)}: {_dump(x[k], True)}" for k in sorted(x) if test(k)]
    if kind == _HEAD:
        return "{" + ", ".join([*pairs(lambda k: k < "nodes"), '"nodes": ['])
    return ", ".join(["]", *pairs(lambda k: k > "nodes")]) + "}"


def _between(one: int, other: int) -> str:
    return "" if one == _HEAD or other == _TAIL else ", "


def _runs(batches: Iterable) -> Iterator:
    """Sorted pieces as rows of some text: section, kinds of the first and last piece, bytes."""
    import pyarrow as pa

    section = first = last = None
    held, size = [], 0

    def out():
        return pa.RecordBatch.from_pylist([{"section": section, "first": first, "last": last, "text": "".join(held).encode()}], schema=pa.schema({"section": pa.int32(), "first": pa.int32(), "last": pa.int32(), "text": pa.binary()}))

    for b in batches:
        for s, kind, j in zip(*(b.column(c).to_pylist() for c in ("section", "kind", "j"))):
            if held and (s != section or size > _RUN):
                yield out()
                held, size = [], 0
            if not held:
                section, first = s, kind
            elif (last, kind) == (_TAIL, _NODE):
                raise ValueError("a node of a document that there is not")
            held.append((_between(last, kind) if held else "") + _written(kind, j))
            last, size = kind, size + len(held[-1])
    if held:
        yield out()


@cache
def _libcrypto():
    """The library that hashlib is made of, whose SHA-256 can stop and go on elsewhere; None where it can't be reached."""
    import _hashlib

    for name in (_hashlib.__file__, "libcrypto.so.3"):
        try:
            found = ctypes.CDLL(name)
            found.SHA256_Init, found.SHA256_Update, found.SHA256_Final  # noqa: B018
            return found
        except (OSError, AttributeError, TypeError):
            continue
    return None


class _Sha256:
    """SHA-256 that goes on from a state (bytes)."""

    def __init__(self, state: bytes | None = None):
        self.lib, self.state = _libcrypto(), ctypes.create_string_buffer(state or bytes(256), 256)
        if state is None:
            self.lib.SHA256_Init(self.state)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.state, data, ctypes.c_size_t(len(data)))

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.state.raw, 256))
        return out.raw.hex()


def _hashed(sha, at: tuple[int, int | None], runs: Iterable, before: list[str]) -> tuple[int, int | None]:
    """Hashes runs that come after a section and a kind; the last section and kind."""
    section, last = at
    for s, first, then, text in runs:
        if s >= len(before) - 1:
            raise ValueError("rows of locales or partitions that the artifact does not have")
        if s != section:
            sha.update("".join(before[section + 1 : s + 1]).encode())
            last = None
        if first == _NODE and last in (None, _TAIL):
            raise ValueError("a node of a document that there is not")
        sha.update(("" if last is None else _between(last, first)).encode())
        sha.update(bytes(text))
        section, last = s, then
    return section, last


def _chained(pieces: DataFrame, before: list[str]) -> str:
    """The digest of pieces (_PLACE, j) in order. Tasks sort and write them; then a task for each part of some 4 MB as packed hashes it
    from the state that the one before it came to, which is all that passes through the driver."""
    pieces = cut(pieces)
    context = pieces.sparkSession.sparkContext
    n = min(max(context.defaultParallelism, files_bytes(pieces) >> 22), 1 << 14)
    parts = pieces.repartitionByRange(n, *_PLACE).sortWithinPartitions(*_PLACE, "j").select("section", "kind", "j")
    runs = parts.mapInArrow(_runs, "section int, first int, last int, text binary").rdd.map(tuple).persist(StorageLevel.DISK_ONLY)
    try:
        if runs.filter(lambda r: r[0] >= len(before) - 1).count():  # all parts are written at once
            raise ValueError("rows of locales or partitions that the artifact does not have")
        at = (-1, None)
        if _libcrypto() is None:
            sha = hashlib.sha256()
            at = _hashed(sha, at, runs.toLocalIterator(), before)
        else:
            state = None
            for i in range(runs.getNumPartitions()):

                def go(rows, state=state, at=at):
                    sha = _Sha256(state)
                    then = _hashed(sha, at, rows, before)
                    return [(sha.state.raw, then)]

                [(state, at)] = context.runJob(runs, go, [i])
            sha = _Sha256(state)
        sha.update("".join(before[at[0] + 1 :]).encode())
        return sha.hexdigest()
    finally:
        runs.unpersist()


def _anchors(index: DataFrame, at: dict, kind: str) -> DataFrame:
    entry = F.struct("anchor", "src", "document_id", "partition", "title", "parent_anchor")
    return index.select(_section(at, None), F.lit(None).cast("array<string>").alias("tractate"), F.col("anchor").alias("name"), F.lit(_ANCHOR).alias("kind"), F.lit(None).cast(kind).alias("ord"), _json(entry))


def digest(documents: DataFrame, index: DataFrame, config: Config, target: str, locales: list[str] | None = None) -> str:
    """SHA-256 of the canonical JSON of all locales' graphs."""
    at, before = _sections(config, target, locales or list(config.locales))
    rows = documents.select(_section(at, F.col("partition")), "tractate", F.col("document_id").alias("name"), F.lit(_DOCUMENT).alias("kind"), F.lit(None).cast("int").alias("ord"), _json("document"))
    return _chained(rows.unionByName(_anchors(index, at, "int")), before)


def digest_of_nodes(nodes: DataFrame, docs: DataFrame, index: DataFrame, config: Config, target: str, locales: list[str] | None = None) -> str:
    """digest() of graph.nested(nodes, docs), where no document meets in a row: what is large has many nodes, not many
    documents. docs has a row a document; nodes of others stop it."""
    at, before = _sections(config, target, locales or list(config.locales))
    kind = nodes.schema["node_ord"].dataType.simpleString()
    name = F.col("document_id").alias("name")
    shells = graph.shells(nodes, docs).select(_section(at, F.col("partition")), "tractate", name, F.explode(F.array(F.lit(_HEAD), F.lit(_TAIL))).alias("kind"), F.lit(None).cast(kind).alias("ord"), _json("document"))
    inner = nodes.select(_section(at, F.col("partition")), "tractate", name, F.lit(_NODE).alias("kind"), F.col("node_ord").alias("ord"), _json("node"))
    return _chained(shells.unionByName(inner).unionByName(_anchors(index, at, kind)), before)


def restricted_rows(documents: DataFrame, index: DataFrame, prefixes: list[str], keys: bool = False, limit: int = 5) -> list[tuple[str, str]]:
    """(location, string) of the first strings that begin with a restricted prefix, found in Spark: only rows that have
    such a string come to the driver, `limit` of them."""
    if not prefixes:
        return []
    hit = lambda c: c.rlike("|".join('"' + re.escape(json.dumps(p, ensure_ascii=False)[1:-1]) for p in prefixes))
    found: list[tuple[str, str]] = []
    for frame, at in ((documents, ("locale", "partition", "document_id")), (index, ("locale", "anchor"))):
        j = F.to_json("document") if "document" in frame.columns else F.to_json(F.struct(*[c for c in frame.columns if c not in ("locale", "anchor")]))
        rows = frame.select(*at, j.alias("j")).filter(hit(F.col("j"))).limit(limit)
        for r in rows.collect():
            found += [(".".join(map(str, r[:-1])) + where, s) for where, s in strings(json.loads(r.j), keys=keys) if s.startswith(tuple(prefixes))]
    return found[:limit]


def write(documents: DataFrame, index: DataFrame, path: str, config: Config, target: str, generated_at: str) -> bool:
    """Writes the artifact of a target unless the same graph is there already; whether it wrote. Every locale of the
    configuration is in it, and no other. A string of a scope that the target does not emit stops it."""
    if found := restricted_rows(documents, index, config.restricted_prefixes(target)):
        raise LeakError("; ".join(f"{a}: {v}" for a, v in found))
    scope = config.target(target).id
    own = digest(documents, index, config, target)
    if os.path.exists(path) and metadata(path).get("graph_hash") == own:
        return False
    nodes = documents.agg(F.coalesce(F.sum("document.node_count"), F.lit(0))).first()[0]
    meta = {"graph_hash": own, "generated_at": generated_at, "total_nodes": nodes, "status_values": list(config.statuses), "invalidated_state": INVALIDATED, "schema_version": SCHEMA_VERSION, "locales": list(config.locales), "scope": scope}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    docs, anchors, held = _Rows(_documents(documents)), _Rows(_index(index)), {}
    with os.fdopen(fd, "w", encoding="utf-8") as f, tempfile.TemporaryDirectory() as folder:
        for locale in sorted(config.locales):  # as they come; the file has them in the configuration's order
            held[locale] = os.path.join(folder, f"{len(held)}")
            with open(held[locale], "w", encoding="utf-8") as g:
                g.writelines(_graph(docs, anchors, locale, _partitions(config, target)))
        f.write(f'{{"scope": {json.dumps(scope)}')
        for locale in config.locales:
            f.write(f", {json.dumps(locale)}: ")
            with open(held[locale], encoding="utf-8") as g:
                shutil.copyfileobj(g, f)
        # Last and on one line, so that it can be read without the rest.
        f.write(f',\n"metadata": {serialize(meta, None)}}}\n')
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    return True


def metadata(path: str) -> dict:
    """The metadata of an artifact: its last line."""
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        f.seek(max(0, f.tell() - (1 << 16)))
        last = f.read().decode("utf-8", "replace").rstrip().rpartition("\n")[2]
    try:
        return json.loads("{" + last)["metadata"]
    except (ValueError, KeyError):
        with open(path, encoding="utf-8") as f:
            return json.load(f).get("metadata") or {}


def declared_scope(path: str) -> str | None:
    """The target that an artifact says it is of."""
    meta = metadata(path)
    if isinstance(meta.get("scope"), str):
        return meta["scope"]
    with open(path, encoding="utf-8") as f:
        found = re.match(r'\s*\{\s*"scope"\s*:\s*("(?:[^"\\]|\\.)*")', f.read(4096))
    return json.loads(found[1]) if found else None


def languages(path: str) -> list[str]:
    """The locales of an artifact."""
    return sorted(metadata(path).get("locales") or [])


def read(spark: SparkSession, path: str, locale: str, kind: str | None = None) -> DataFrame:
    """(locale, partition, tractate, document_id, document) of one locale. kind is the type of `document`; without it the
    file is read once more for its schema."""
    reader = spark.read.option("multiLine", True)
    if kind:
        reader = reader.schema(f"`{locale}` struct<partitions:array<struct<id:string,label:string,scope:string,documents:array<{kind}>>>>")
    parts = reader.json(path).select(F.explode(F.col(f"`{locale}`.partitions")).alias("p"))
    rows = parts.select(F.lit(locale).alias("locale"), F.col("p.id").alias("partition"), F.explode("p.documents").alias("document"))
    return rows.select("locale", "partition", F.col("document.tractate_path").alias("tractate"), F.col("document.document_id").alias("document_id"), "document")


def read_lines(spark: SparkSession, path: str, kind: str, config: Config) -> DataFrame:
    """(locale, partition, tractate, document_id, document) of all locales, by as many tasks as the file has splits: write()
    gives each document a line of its own. A document's locale and partition follow from its `src` by the layout. kind is
    the type of `document`; a line that is not of it stops the query, and so does a file that write() did not make."""
    with open(path, encoding="utf-8") as f:
        if re.search(r'"documents": ?\[ *\{', f.read(1 << 16)):
            raise ValueError(f"{path} does not have a line a document; use read()")
    lines = spark.read.text(path).filter(F.startswith("value", F.lit('{"document_id": ')))
    rows = lines.select(F.from_json(F.regexp_replace("value", ",$", ""), kind, {"mode": "FAILFAST"}).alias("document"))
    placed = classified(rows.withColumn("rel_path", F.col("document.src")), config)
    return placed.select("locale", F.col("group_partition").alias("partition"), F.col("document.tractate_path").alias("tractate"), F.col("document.document_id").alias("document_id"), "document")
