"""Which hashes at least two documents hold, by a pair of Bloom filters: one of hashes seen once, one of hashes seen twice.

Every task fills its own pair; pairs are merged by segment (twice = either's twice, or both's once), so a hash that two
documents hold is always in the second filter. Its size is bounded by what its maker asks for, so it may be broadcast;
more hashes than it has room for give false suspects and miss nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm.common import mapped, slots

SEGMENT = 1 << 20  # bits; a segment of both filters takes 256 kB
HASHES = 2


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A row of HASHES bit positions for each hash; bits is a power of two."""
    low, high = hashes, (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(bits - 1) for i in range(HASHES)], 1)


def size_for(entries: int, each: int, most: int) -> int:
    """A power of two: `each` bits an entry or more, a segment at least, `most` bits at most."""
    return min(most, max(SEGMENT, 1 << (each * entries).bit_length()))


class Filter:
    """The twice-seen filter, as bits."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = positions(hashes, self.bits)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def _squeezed(sorted_positions: np.ndarray) -> bytes:
    return zlib.compress(np.diff(sorted_positions, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.uint32)


def twice_seen(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], bits: int) -> Filter:
    """The filter over rows; hashes() gives the distinct hashes of each document of a batch."""

    def fill(batches):
        once, twice, held = [], [], 0

        def squeeze():
            at, n = np.unique(np.concatenate(once), return_counts=True) if once else (np.empty(0, np.uint32), np.empty(0, int))
            again = at[n > 1]
            return at, np.unique(np.concatenate([*twice, again])) if twice else again

        for b in batches:
            for h in hashes(b):
                if len(h):
                    # A document counts once, even where two of its hashes meet in a bit.
                    once.append(np.unique(positions(h, bits)).astype(np.uint32))
                    held += len(once[-1])
                if held > 4_000_000:
                    at, again = squeeze()
                    once, twice, held = [at], [again], len(at) // 2
        at, again = squeeze()
        for s in np.unique(at // SEGMENT):
            lo, hi = (np.searchsorted(x, [s * SEGMENT, (s + 1) * SEGMENT]) for x in (at, again))
            yield pa.RecordBatch.from_pydict({"segment": pa.array([int(s)], pa.int32()), "once": [_squeezed(at[lo[0] : lo[1]] % SEGMENT)], "twice": [_squeezed(again[hi[0] : hi[1]] % SEGMENT)]})

    def merge(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                once, twice = held.setdefault(r["segment"], [np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)])
                own = _spread(r["once"])
                twice[own[once[own]]] = True
                twice[_spread(r["twice"])] = True
                once[own] = True
        for s, (_, twice) in held.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "bits": [zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)]})

    parts = mapped(rows, fill, "segment int, once binary, twice binary").repartition(slots(rows.sparkSession), "segment")
    data = np.zeros(bits // 8, np.uint8)
    for r in mapped(parts, merge, "segment int, bits binary").collect():  # bits / SEGMENT rows of 128 kB at most
        data[r.segment * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return Filter(bits, data.tobytes())
