"""Token-ID output: flat little-endian unsigned integer files with 64-bit document offsets.

A run writes one shard for each range of doc_id, three files a shard:

    <shard>.bin   token ids, uint16 where the vocabulary fits, else uint32
    <shard>.idx   int64 offsets of its documents in ids, from 0, one more than documents
    <shard>.ids   int64 doc_ids (null: the smallest long)

and a manifest (Parquet) with each shard's lowest key and counts. Shard bases in the whole corpus come from
prefix sums over the manifest, so no task waits for another. A shard's files carry a name of their own for
each attempt: only those that a finished task has reported count, so lost executors leave no half-read file.
Readers memory-map shards of a mounted folder and read others through pyarrow's file systems.

Nulls: a null text is an empty one, so its document holds the end id alone; a null doc_id sorts first.
Rows of one doc_id stand beside each other, in the order of their texts' hashes, in as many shards as they need; so do
repeated rows. Whole texts are encoded, a few MB at a time; a very long one is written as one document. An empty table
gives no shard and no row.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, keyed, size_of, slices, slots, to_ids

END_ID = 1
#: A chunk that one look-up table can stand for: Latin letters, then common stops.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: What a tokenizer's file must say for chunks to be encoded one by one (fixed values of the file format).
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE = [
    {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def drops_white_space(spec: dict) -> bool:
    """Whether a tokenizer's description says that no token reaches across ASCII white space and none stands for it."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    plain = normal.get("normalizers") == _NORMAL and pre.get("pretokenizers") == _PRE and spec.get("post_processor") is None
    added = [t for t in spec.get("added_tokens") or () if t["content"].split() != [t["content"]] or t["lstrip"] or t["rstrip"] or t["single_word"]]
    return plain and not added and not spec.get("truncation") and not spec.get("padding")


class Kept(dict):
    """What was made of late: once `limit` entries are there they are the old ones, and those that are not asked for
    until the next `limit` are full go. 2 * limit entries at most."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder(Kept):
    """chunk (bytes without ASCII white space) -> its ids as bytes; encode() gives those of a text.

    The tokenizer of word_bpe files drops white space and never joins across it, so the ids of a text are those of
    its chunks; chunks seen of late are kept, and so are their words without stops, in lower case. Letters go straight
    to the BPE model, all else through the whole tokenizer. Of any other tokenizer whole texts are encoded. Tasks of a
    worker share one, so `limit` is what a worker may hold for good: some 150 bytes an entry, twice `limit` of them.
    """

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__(limit)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        self.by_chunk = drops_white_space(json.loads(self.tok.to_str()))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}
        self.byte_chars = {c: "".join(rest.get(b, chr(b)) for b in chr(c).encode()) for c in range(128, 256)}

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _word(self, word: str) -> bytes:
        """The ids of lower-case letters, or of stops."""
        key = word.encode()
        if (found := self.get(key)) is None:
            if (found := self.old.get(key)) is None:
                found = self._packed([t.id for t in self.model.tokenize(word.translate(self.byte_chars))])
            self.keep(key, found)
        return found

    def __missing__(self, chunk: bytes) -> bytes:
        if (found := self.old.get(chunk)) is not None:
            return self.keep(chunk, found)
        text = chunk.decode(errors="replace")
        if m := _PLAIN.fullmatch(text):
            word, stops = m.groups()
            low = word.lower()
            found = self._word(low)
            return found if low == text else self.keep(chunk, found + self._word(stops) if stops else found)
        return self.keep(chunk, self._packed(self.tok.encode(text, add_special_tokens=False).ids))

    def encode(self, text: bytes) -> bytes:
        if self.by_chunk:
            return b"".join(map(self.__getitem__, text.split()))
        return self._packed(self.tok.encode(text.decode(errors="replace"), add_special_tokens=False).ids)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4"))


#: Bytes of input (as Spark estimates them) for each shard at most, where the shuffle's partitions would be fewer.
SHARD_BYTES = 256 << 20

MANIFEST = "lowest long, lowest_th long, lowest_i long, shard string, n_docs long, n_tokens long, dtype string"


def write_shards(docs: DataFrame, root: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Encodes docs into shards under root (a URI that executors share). Returns the manifest, not yet run."""
    n = partitions or max(slots(docs.sparkSession), size_of(docs) // SHARD_BYTES)
    # The row's number splits rows that are all the same; which of them is where tells nobody anything.
    order = ("k", "th", "i")
    ordered = keyed(docs).withColumn("i", F.monotonically_increasing_id()).select(*order, "text").repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyarrow import fs

        enc, out, counts, keys, name, lowest = encoder(tokenizer), None, [], [], "", ()
        end = np.array([end_id], enc.dtype).tobytes()
        for b in (part for whole in batches for part in slices(whole)):
            if out is None:
                store, base = fs.FileSystem.from_uri(root)
                store.create_dir(base, recursive=True)
                name = f"shard-{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{base}/{name}.bin")
                lowest = [b.column(c)[0].as_py() for c in order]
            for t in b.column("text").cast(pa.binary()).to_pylist():
                ids = enc.encode(t) + end
                counts.append(len(ids) // enc.dtype.itemsize)
                out.write(ids)
            keys.append(b.column("k").to_numpy())
        if out is None:
            return
        out.close()
        offsets = np.concatenate(([0], np.cumsum(counts))).astype("<i8")
        for suffix, data in (("idx", offsets), ("ids", np.concatenate(keys).astype("<i8"))):
            with store.open_output_stream(f"{base}/{name}.{suffix}") as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({"lowest": [lowest[0]], "lowest_th": [lowest[1]], "lowest_i": [lowest[2]], "shard": [name], "n_docs": [len(counts)], "n_tokens": [int(offsets[-1])], "dtype": [enc.dtype.str]})

    return ordered.mapInArrow(run, MANIFEST)


def based(manifest: DataFrame) -> DataFrame:
    """The manifest with token_base and doc_base: prefix sums over shards in key order. It has a row a shard,
    never one a document, so the driver can add them up."""
    rows = sorted(manifest.collect(), key=lambda r: r[:3])
    tokens, docs, out = 0, 0, []
    for r in rows:
        out.append((*r, tokens, docs))
        tokens, docs = tokens + r.n_tokens, docs + r.n_docs
    return manifest.sparkSession.createDataFrame(out, MANIFEST + ", token_base long, doc_base long")


def read_shards(manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read from the files of a based manifest."""

    def run(batches):
        from pyarrow import fs

        def load(base, store, file, dtype):
            path = f"{base}/{file}"
            if isinstance(store, fs.LocalFileSystem) or getattr(store, "type_name", "") == "local":
                return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
            with store.open_input_file(path) as f:
                return np.frombuffer(f.read(), dtype)

        for b in batches:
            for r in b.to_pylist():
                store, base = fs.FileSystem.from_uri(root)
                ids, idx, keys = (load(base, store, f"{r['shard']}.{s}", d) for s, d in (("bin", r["dtype"]), ("idx", "<i8"), ("ids", "<i8")))
                for at in range(0, r["n_docs"], 4096):
                    o = np.asarray(idx[at : min(at + 4096, r["n_docs"]) + 1])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(to_ids(pa.array(np.asarray(keys[at : at + len(o) - 1]))), pa.int64()),
                            "start": o[:-1] + r["token_base"],
                            "n_tokens": np.diff(o),
                            "ids_crc32": pa.array([crc(np.asarray(ids[x:y])) for x, y in zip(o[:-1], o[1:])], pa.int64()),
                        }
                    )

    spark = manifest.sparkSession
    return manifest.repartition(slots(spark), F.xxhash64("shard")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = END_ID, root: str | None = None) -> DataFrame:
    """Writes docs as token files (under root, or in the shared folder) and returns the digest of each document read back."""
    scratch = Scratch(spark, "tokens")
    root = root or scratch.path("shards")
    manifest = scratch.write(write_shards(docs, root, tokenizer, end_id), "manifest")
    return read_shards(based(manifest), root)
