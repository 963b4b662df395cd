"""Git trees as a Spark data source: the files of a commit, read straight from a repository's objects.

    register(spark)
    spark.read.format("gittree").option("path", "/repos/kb").option("ref", "main").load()

gives (rel_path, blob_id, mode, content). Filters on rel_path (equality, a set, prefixes, suffixes) are pushed down: trees that
can't hold such a path are not opened, blobs of other paths are not read. Paths and places of the wanted blobs are planned on
the driver, contents are read by tasks: a partition is a range of one pack, in the order of its offsets, or a number of loose
objects. Deltas are resolved where they are read, with a bounded cache of bases. The folder must be one that executors
see (any file system that Arrow opens). Submodules and symbolic links are no files; alternates are not followed.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from loomspark.config import Config
from loomspark.operators.layout import classified

SCHEMA = "rel_path string, blob_id string, mode string, content binary"
#: Objects of a partition at most; bytes of delta bases that a task keeps.
OBJECTS, CACHE = 2000, 64 << 20
_KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
_OFS, _REF = 6, 7


class GitError(ValueError):
    """Not a repository, or an object or a ref that it does not have."""


class Folder:
    """A folder of any file system that Arrow opens."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes | None:
        try:
            with self.fs.open_input_file(f"{self.base}/{name}") as f:
                f.seek(start)
                return f.read(length) if length is not None else f.read()
        except FileNotFoundError:
            return None

    def names(self, name: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/{name}", allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == fs.FileType.File)


class PackIndex:
    """Names and offsets of a pack (index format 2), looked up by bisection over its fan-out."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise GitError("a pack index of another format than 2")
        self.data = data
        self.n = int.from_bytes(data[8 + 255 * 4 : 8 + 256 * 4])

    def _name(self, i: int) -> bytes:
        return self.data[1032 + 20 * i : 1052 + 20 * i]

    def offset(self, name: bytes) -> int | None:
        fan = lambda b: int.from_bytes(self.data[8 + 4 * b : 12 + 4 * b]) if b >= 0 else 0
        low, high = fan(name[0] - 1), fan(name[0])
        while low < high:
            mid = (low + high) // 2
            if self._name(mid) < name:
                low = mid + 1
            else:
                high = mid
        if low >= self.n or self._name(low) != name:
            return None
        at = 1032 + 24 * self.n + 4 * low
        found = int.from_bytes(self.data[at : at + 4])
        if found >> 31:  # beyond 2 GB: in the table of long offsets
            at = 1032 + 28 * self.n + 8 * (found & 0x7FFFFFFF)
            found = int.from_bytes(self.data[at : at + 8])
        return found


def patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: pieces copied from it, and pieces of its own."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = delta[at]
            value, shift, at = value | (byte & 0x7F) << shift, shift + 7, at + 1
            if byte < 0x80:
                return value, at

    size, at = number(0)
    if size != len(base):
        raise GitError("a delta of another base")
    size, at = number(at)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op < 0x80:
            out += delta[at : at + op]
            at += op
            continue
        fields = [0, 0, 0, 0, 0, 0, 0]
        for i in range(7):
            if op >> i & 1:
                fields[i] = delta[at]
                at += 1
        start, length = int.from_bytes(bytes(fields[:4]), "little"), int.from_bytes(bytes(fields[4:]), "little") or 0x10000
        out += base[start : start + length]
    if len(out) != size:
        raise GitError("a delta that breaks off")
    return bytes(out)


class Objects:
    """The objects of a repository, loose or packed."""

    def __init__(self, path: str):
        self.folder = Folder(path.rstrip("/"))
        self.git = ".git/" if self.folder.read(".git/HEAD") is not None else ""
        if self.folder.read(f"{self.git}HEAD") is None:
            raise GitError(f"{path} is no git repository")
        self._packs: dict[str, PackIndex] | None = None
        self._kept: OrderedDict[tuple, tuple[str, bytes]] = OrderedDict()
        self._held = 0

    def packs(self) -> dict[str, PackIndex]:
        if self._packs is None:
            names = [n for n in self.folder.names(f"{self.git}objects/pack") if n.endswith(".idx")]
            self._packs = {n[:-4]: PackIndex(self.folder.read(f"{self.git}objects/pack/{n}")) for n in names}
        return self._packs

    def place(self, name: str) -> tuple[str, int] | None:
        """(pack, offset) of an object; None of a loose one."""
        raw = bytes.fromhex(name)
        for pack, index in self.packs().items():
            if (offset := index.offset(raw)) is not None:
                return pack, offset
        return None

    def _loose(self, name: str) -> tuple[str, bytes]:
        data = self.folder.read(f"{self.git}objects/{name[:2]}/{name[2:]}")
        if data is None:
            raise GitError(f"no object {name}")
        head, _, body = zlib.decompress(data).partition(b"\0")
        return head.split()[0].decode(), body

    def get(self, name: str) -> tuple[str, bytes]:
        """(kind, content)."""
        place = self.place(name)
        return self._loose(name) if place is None else self.packed(*place)

    def packed(self, pack: str, offset: int) -> tuple[str, bytes]:
        """The object at an offset of a pack. A chain of deltas is walked to its base, then applied from there."""
        chain, at = [], (pack, offset)
        while at not in self._kept:
            kind, base, data = self._entry(*at)
            if kind in _KINDS:
                self._keep(at, (_KINDS[kind], data))
                break
            chain.append((at, data))
            if kind == _OFS:
                at = (at[0], base)
            else:
                found = self.place(base)
                if found is None:
                    self._keep(at := ("", base), self._loose(base))
                    break
                at = found
        kind, data = self._kept[at]
        self._kept.move_to_end(at)
        for at, delta in reversed(chain):
            data = patched(data, delta)
            self._keep(at, (kind, data))
        return kind, data

    def _keep(self, at: tuple, value: tuple[str, bytes]) -> None:
        self._kept[at] = value
        self._held += len(value[1])
        while self._held > CACHE and len(self._kept) > 1:
            self._held -= len(self._kept.popitem(last=False)[1][1])

    def _entry(self, pack: str, offset: int) -> tuple[int, object, bytes]:
        """(kind, base, data) as it is stored; a base is an offset or a name."""
        name, length = f"{self.git}objects/pack/{pack}.pack", 4096
        while True:  # the packed length is not told: read on until the stream ends
            raw = self.folder.read(name, offset, length)
            at = 1
            kind, size, shift = raw[0] >> 4 & 7, raw[0] & 15, 4
            while raw[at - 1] & 0x80:
                size, shift, at = size | (raw[at] & 0x7F) << shift, shift + 7, at + 1
            base = None
            if kind == _OFS:
                back = raw[at] & 0x7F
                while raw[at] & 0x80:
                    at += 1
                    back = (back + 1) << 7 | raw[at] & 0x7F
                at += 1
                base = offset - back
            elif kind == _REF:
                base, at = raw[at : at + 20].hex(), at + 20
            stream = zlib.decompressobj()
            data = stream.decompress(raw[at:])
            if stream.eof:
                return kind, base, data
            if len(raw) < length:
                raise GitError(f"{pack} breaks off")
            length = max(length * 4, min(size, 1 << 30))

    def resolve(self, ref: str) -> str:
        """The commit of a branch, tag, full name or HEAD."""
        seen = ref
        for _ in range(10):
            found = next((x for p in ("", "refs/heads/", "refs/tags/", "refs/remotes/") if (x := self.folder.read(f"{self.git}{p}{seen}")) is not None), None) if not seen.startswith("..") else None
            if found is None:
                packed = (self.folder.read(f"{self.git}packed-refs") or b"").decode()
                rows = dict(reversed(line.split(" ", 1)) for line in packed.splitlines() if line and line[0] not in "#^")
                found = next((rows[p + seen].encode() for p in ("", "refs/heads/", "refs/tags/", "refs/remotes/") if p + seen in rows), None)
            text = seen if found is None else found.decode().strip()
            if text.startswith("ref: "):
                seen = text[5:]
                continue
            if len(text) != 40:
                raise GitError(f"no ref {ref!r}")
            kind, data = self.get(text)
            if kind == "commit":
                return text
            seen = data.split(b"\n", 1)[0].split()[1].decode()  # of a tag: its object
        raise GitError(f"{ref!r} leads nowhere")

    def tree(self, commit: str) -> str:
        return self.get(commit)[1].split(b"\n", 1)[0].split()[1].decode()

    def files(self, tree: str, may_hold, prefix: str = "") -> Iterator[tuple[str, str, str]]:
        """(path, name, mode) of files below a tree; may_hold(folder) tells whether to open one."""
        data, at = self.get(tree)[1], 0
        while at < len(data):
            space, end = data.index(b" ", at), data.index(b"\0", at)
            mode, path = data[at:space].decode(), prefix + data[space + 1 : end].decode(errors="replace")
            name, at = data[end + 1 : end + 21].hex(), end + 21
            if mode == "40000":
                if may_hold(path + "/"):
                    yield from self.files(name, may_hold, path + "/")
            elif mode in ("100644", "100755"):
                yield path, name, mode


@dataclass
class Wanted:
    """What pushed filters leave of the paths: all must hold."""

    sets: list[frozenset]
    prefixes: list[str]
    suffixes: list[str]

    def file(self, path: str) -> bool:
        return all(path in s for s in self.sets) and all(map(path.startswith, self.prefixes)) and all(map(path.endswith, self.suffixes))

    def folder(self, folder: str) -> bool:
        return all(any(x.startswith(folder) for x in s) for s in self.sets) and all(folder.startswith(p) or p.startswith(folder) for p in self.prefixes)


class Range(InputPartition):
    def __init__(self, objects: list[tuple[str, str, str, tuple[str, int] | None]]):
        self.objects = objects


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ref = options.get("path"), options.get("ref", "HEAD")
        if not self.path:
            raise GitError("name the repository: option path")
        self.wanted = Wanted([], [], [])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            own = getattr(f, "attribute", None) == ("rel_path",)
            if own and isinstance(f, EqualTo):
                self.wanted.sets.append(frozenset([f.value]))
            elif own and isinstance(f, In):
                self.wanted.sets.append(frozenset(f.value))
            elif own and isinstance(f, StringStartsWith):
                self.wanted.prefixes.append(f.value)
            elif own and isinstance(f, StringEndsWith):
                self.wanted.suffixes.append(f.value)
            else:
                yield f

    def partitions(self) -> list[Range]:
        store = Objects(self.path)
        found = [(p, n, m, store.place(n)) for p, n, m in store.files(store.tree(store.resolve(self.ref)), self.wanted.folder) if self.wanted.file(p)]
        found.sort(key=lambda x: (x[3] is None, x[3] or ("", 0), x[0]))
        out, pack = [], None
        for x in found:
            own = x[3][0] if x[3] else ""
            if not out or own != pack or len(out[-1]) >= OBJECTS:
                out.append([])
                pack = own
            out[-1].append(x)
        return [Range(x) for x in out]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None or not isinstance(partition, Range):
            return
        store = Objects(self.path)
        for path, name, mode, place in partition.objects:
            _, data = store.packed(*place) if place else store._loose(name)
            yield path, name, mode, bytes(data)


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gittree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitTree)


def describe(path: str, ref: str = "HEAD") -> dict:
    """What a source of this repository reads."""
    store = Objects(path)
    return {"kind": "gittree", "path": path, "ref": ref, "commit": store.resolve(ref), "packs": len(store.packs()), "packed_objects": sum(p.n for p in store.packs().values())}


def documents(spark: SparkSession, path: str, config: Config, ref: str = "HEAD", prefix: str = "") -> DataFrame:
    """Classified corpus files of a commit with text, as sources.files.documents() gives those of a folder; a file that is
    not UTF-8 stops the query."""
    register(spark)
    rows = spark.read.format("gittree").option("path", path).option("ref", ref).load().filter(F.startswith("rel_path", F.lit(prefix or config.root + "/")))
    text = F.col("content").cast("string")
    sound = F.when(F.is_valid_utf8(text), text).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "rel_path")).cast("string"))
    return classified(rows.select("rel_path", sound.alias("text"), F.sha2("content", 256).alias("sha256"), "blob_id"), config).filter("partition is not null")
