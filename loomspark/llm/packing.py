"""Packing: documents into sequences of at most `window` tokens by best-fit decreasing.

Overlong documents are first cut into full windows; what remains of each document (fewer ids than a window) is
packed by best-fit decreasing. Best fit needs only how many pieces have each length, so the plan is made from a
histogram of at most window - 1 counts: a segment tree indexed by remaining capacity finds the tightest open
window, and windows that are alike are placed as one run. The plan is exact best-fit decreasing over the whole
corpus and its size depends on the window alone, so it may be broadcast. Pieces then find their place in the plan
by their rank among pieces of equal length: a local rank from the task that encoded them, plus prefix sums.

Windows that best fit leaves far from full would be padding (a third of a corpus may be copies of one length).
The emptiest ones are dissolved and their documents cut, at multiples of `unit` ids, to fill the gaps of the rest;
so less than `unit` ids of padding stay in a window. Windows filled to a power of two stay as they are.

Nulls: a null text is empty (its end id alone); a null doc_id stays null. Equal rows are packed one by one. Documents of
one length are placed in the order of the tasks that encode them. Whole texts are encoded; a very long one takes its full
windows and one piece more. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, doc_id, keyed, mapped, slices
from loomspark.llm.tokenio import END_ID, encoder

WINDOW = 2048
UNIT = 32


class CapacityTree:
    """A segment tree over capacities 0..top: whether open windows have each, and the least that is enough."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = np.zeros(2 * self.leaves, np.int64)

    def add(self, capacity: int, windows: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += windows
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least `need` that an open window has."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


class Plan:
    """Where the pieces of each length go. runs: one row for each run of pieces that alike windows take.

    A run is (length, first rank, end rank, first window, pieces a window, offset, units before it in a window).
    """

    def __init__(self, counts: dict[int, int], window: int = WINDOW, unit: int = UNIT):
        self.window, self.unit = window, unit
        tree, groups = CapacityTree(window), {}  # capacity -> [(first window, windows, units in each)]
        runs, opened = [], 0

        def put(capacity: int, first: int, n: int, units: int) -> None:
            if n:
                groups.setdefault(capacity, []).append((first, n, units))
                tree.add(capacity, n)

        for length in sorted(counts, reverse=True):
            left, rank, units = counts[length], 0, -(-length // unit)
            while left:
                capacity = tree.tightest(length)
                if capacity is None:
                    n = -(-left // (window // length))
                    put(window, opened, n, 0)
                    opened += n
                    continue
                first, n, held = groups[capacity].pop()
                tree.add(capacity, -n)
                each = capacity // length
                full = min(n, left // each)
                used = full
                if full:
                    runs.append((length, rank, rank + full * each, first, each, window - capacity, held))
                    put(capacity - each * length, first, full, held + each * units)
                    rank, left = rank + full * each, left - full * each
                if left and full < n:
                    runs.append((length, rank, rank + left, first + full, left, window - capacity, held))
                    put(capacity - left * length, first + full, 1, held + left * units)
                    rank, left, used = rank + left, 0, full + 1
                put(capacity, first + used, n - used, held)
        self.runs = np.array(sorted(runs), np.int64).reshape(-1, 7)
        self.keys = (self.runs[:, 0] << 40) + self.runs[:, 1]  # no length has 2^40 pieces
        self._fill_gaps(groups)
        self.windows = opened

    def _fill_gaps(self, groups: dict) -> None:
        """donors: windows that are dissolved onto a tape of units; slots: gaps that take the tape up in turn."""
        w, u = self.window, self.unit
        alike = [(w - c, first, n, units, c // u) for c, gs in groups.items() for first, n, units in gs if c and (f := w - c) & (f - 1)]
        alike.sort()
        wanted = sum(n * s for _, _, n, _, s in alike)
        donors, slots, tape = [], [], 0
        for fill, first, n, units, slot in alike:
            m = min(n, max(0, -(-(wanted - tape) // (units + slot)))) if wanted > tape else 0
            if m:
                donors.append((first, first + m, units, tape))
                tape, wanted = tape + m * units, wanted - m * slot
            if n > m and slot:
                slots.append((first + m, n - m, slot, fill))
        self.donors = np.array(sorted(donors), np.int64).reshape(-1, 4)
        at, out = 0, []
        for first, n, slot, fill in reversed(slots):  # the fullest windows first: small gaps, few of them
            out.append((at, first, n, slot, fill))
            at += n * slot
        self.slots = np.array(out, np.int64).reshape(-1, 5)
        self.filled = at  # units of the tape that gaps take; what is left fills windows of its own
        self.tail = max(0, -(-(tape - at) // (w // u)))

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, offset, whether the window is dissolved) of pieces, as best fit places them."""
        r = self.runs[np.searchsorted(self.keys, (lengths << 40) + ranks, "right") - 1].reshape(-1, 7)
        row, j = np.divmod(ranks - r[:, 1], r[:, 4])
        window = r[:, 3] + row
        if not len(self.donors):
            return window, r[:, 5] + j * lengths, np.zeros(len(window), bool)
        d = np.searchsorted(self.donors[:, 0], window, "right") - 1
        return window, r[:, 5] + j * lengths, (d >= 0) & (window < self.donors[d, 1])

    def place(self, length: int, rank: int):
        """[(start, length, window, offset, tape position or -1)] of a piece; windows of the tail count on from self.windows."""
        r = self.runs[int(np.searchsorted(self.keys, (length << 40) + rank, "right")) - 1]
        row, j = divmod(rank - int(r[1]), int(r[4]))
        window, u = int(r[3]) + row, self.unit
        d = int(np.searchsorted(self.donors[:, 0], window, "right")) - 1
        if d < 0 or window >= self.donors[d, 1]:
            return [(0, length, window, int(r[5]) + j * length, -1)]
        units = -(-length // u)
        p0 = int(self.donors[d, 3]) + (window - int(self.donors[d, 0])) * int(self.donors[d, 2]) + int(r[6]) + j * units
        out, p = [], p0
        while p < p0 + units:
            if p < self.filled:
                at, w0, _, slot, fill = (int(x) for x in self.slots[int(np.searchsorted(self.slots[:, 0], p, "right")) - 1])
                i, within = divmod(p - at, slot)
                target, base, end = w0 + i, fill, p - within + slot
            else:
                per = self.window // u
                i, within = divmod(p - self.filled, per)
                target, base, end = self.windows + i, 0, p - within + per
            stop = min(end, p0 + units)
            a = (p - p0) * u
            out.append((a, min((stop - p) * u, length - a), target, base, p))
            p = stop
        return out


_ZEROS = bytes(1 << 16)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of bytes in a row from (crc32, number of bytes) of each part."""
    total = 0
    for part, n in parts:
        total = zlib.crc32(_ZEROS[:n], total) ^ zlib.crc32(_ZEROS[:n]) ^ part
    return total


LENGTHS = "k long, n long, window_crcs array<long>, unit_crcs array<long>, rest_crc long, pid long, rest int, rank long, windows_before long"
PIECES = "k long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tape long"


def measured(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Encodes each document once: its number of ids, crc32 of each full window and of each unit of the rest, and its
    ranks within the task. No ids are moved."""

    def run(batches):
        from pyspark import TaskContext

        enc, pid = encoder(tokenizer), TaskContext.get().partitionId()
        end, seen, windows = np.array([end_id], enc.dtype).tobytes(), np.zeros(window, np.int64), 0
        for b in (part for whole in batches for part in slices(whole)):
            cols = {x: [] for x in ("n", "window_crcs", "unit_crcs", "rest_crc", "rest", "rank", "windows_before")}
            for t in b.column("text").cast(pa.binary()).to_pylist():
                ids = memoryview(np.frombuffer(enc.encode(t) + end, enc.dtype).astype("<u4")).cast("B")
                n = len(ids) // 4
                full, rest = divmod(n, window)
                at = 4 * full * window
                row = (n, [zlib.crc32(ids[i : i + 4 * window]) for i in range(0, at, 4 * window)], [zlib.crc32(ids[i : i + 4 * unit]) for i in range(at, len(ids), 4 * unit)], zlib.crc32(ids[at:]), rest, int(seen[rest]), windows)
                seen[rest] += 1
                windows += full
                for c, v in zip(cols.values(), row):
                    c.append(v)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({"k": b.column("k"), "n": pa.array(cols["n"], pa.int64()), "window_crcs": pa.array(cols["window_crcs"], lists), "unit_crcs": pa.array(cols["unit_crcs"], lists), "rest_crc": pa.array(cols["rest_crc"], pa.int64()), "pid": pa.array([pid] * b.num_rows, pa.int64()), "rest": pa.array(cols["rest"], pa.int32()), "rank": pa.array(cols["rank"], pa.int64()), "windows_before": pa.array(cols["windows_before"], pa.int64())})

    return mapped(keyed(docs).select("k", "text"), run, LENGTHS)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    rows = scratch.write(measured(docs, tokenizer, end_id, window, unit), "lengths")
    # The plan needs a count for each length: at most window - 1 of them, whatever the corpus.
    plan = Plan({r.rest: r.n for r in rows.filter("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}, window, unit)
    # Bases of each encoding task: a row a task (full windows), and a row a task and length (ranks).
    by_rest = Window.partitionBy("rest").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ranks = rows.groupBy("pid", "rest").agg(F.count("*").alias("c")).select("pid", "rest", F.coalesce(F.sum("c").over(by_rest), F.lit(0)).alias("rank_base"))
    total, bases = plan.windows + plan.tail, []
    for r in sorted(rows.groupBy("pid").agg(F.sum(F.size("window_crcs")).alias("c")).collect(), key=lambda r: r.pid):
        bases.append((r.pid, total))
        total += r.c
    # As an Arrow table: rows of Python objects would start workers of another kind beside those that are there.
    firsts = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in (zip(*bases) if bases else ((), ()))], ["pid", "window_base"]))
    shared = spark.sparkContext.broadcast(plan)

    def run(batches):
        p, names = shared.value, [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            k, n, rest, rank, base, whole = (b.column(c).to_numpy() for c in ("k", "n", "rest", "rank", "window_base", "rest_crc"))
            rest = rest.astype(np.int64)
            # Full windows.
            each = pc.list_value_length(b.column("window_crcs")).to_numpy()
            own = np.repeat(np.arange(len(k)), each)
            i = np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
            same = np.zeros(len(own), np.int64)
            parts = [(k[own], i * p.window, same + p.window, b.column("window_crcs").flatten().to_numpy(), n[own], base[own] + i, same, same - 1)]
            # What remains of documents, where best fit puts it; what stands in a dissolved window is cut.
            at = np.flatnonzero(rest)
            window, offset, cut = p.places(rest[at], rank[at])
            stay = at[~cut]
            parts.append((k[stay], n[stay] - rest[stay], rest[stay], whole[stay], n[stay], window[~cut], offset[~cut], np.full(len(stay), -1)))
            out, size = [], 4 * p.unit
            for r in at[cut].tolist():
                crcs, start0 = b.column("unit_crcs")[r].as_py(), int(n[r] - rest[r])
                for start, length, seq, place, tape in p.place(int(rest[r]), int(rank[r])):
                    first, last = start // p.unit, (start + length - 1) // p.unit
                    crc = joined_crc([(crcs[j], min(size, 4 * (start + length) - j * size)) for j in range(first, last + 1)])
                    out.append((int(k[r]), start0 + start, length, crc, int(n[r]), seq, place, tape))
            parts.append(tuple(np.array(c, np.int64) for c in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in names))
            yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in zip(names, zip(*parts))})

    placed = rows.join(ranks, ["pid", "rest"]).join(firsts, "pid").select("k", "n", "window_crcs", "unit_crcs", "rest_crc", "rest", (F.col("rank_base") + F.col("rank")).alias("rank"), (F.col("window_base") + F.col("windows_before")).alias("window_base"))
    pieces = scratch.write(placed.mapInArrow(run, PIECES), "pieces")
    # Cut documents follow each other in a gap; a gap holds window / unit of them at most.
    before = Window.partitionBy("sequence_id").orderBy("tape").rowsBetween(Window.unboundedPreceding, -1)
    cut = pieces.filter("tape >= 0").withColumn("offset", F.col("offset") + F.coalesce(F.sum("length").over(before), F.lit(0)))
    return pieces.filter("tape < 0").unionByName(cut).select(doc_id(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
