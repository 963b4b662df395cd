"""The hash-chain audit as a stream: rows of chains in any order and any batches, each judged as soon as the row before it is
there. What a chain keeps is its last row, rows that wait for one before them, and the gaps that were given up.

Faults are those of operators.audit.links(): a row whose predecessor did not come in time (`wait`) is a gap; should that
one come later, it is judged then, and the row after it once more (`revised`). So the last fault of each (chain, sequence)
does not depend on how rows were split into batches. State lives in the checkpoint, so a query that is started again goes
on where it was. An extension: the batch audit needs none of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomspark.functions.hashing import GENESIS, chain_hash

OUT = "chain string, sequence long, fault string, revised boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for the sequence before a chain's first row.
NOTHING = -1
_ROW = "sequence long, prev_hash string, hash string, sound boolean"


def judged(sequence: int, prev_hash: str | None, sound: bool, before: tuple[int, str | None] | None) -> str | None:
    """The fault of a row after the row `before` (sequence, hash), or after none."""
    if sequence != 0 and (before is None or before[0] != sequence - 1):
        return "gap"
    known = GENESIS if sequence == 0 else before[1]
    if prev_hash is None or prev_hash != known:
        return "link"
    return None if sound else "hash"


class ChainAudit(StatefulProcessor):
    """State of a chain: `last` (sequence, hash of the last judged row), `waiting` (rows by sequence), `gaps` (by the
    sequence of the row after a gap: that row, and the sequence and hash of the one before the gap)."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sequence long, hash string")
        self.waiting = handle.getMapState("waiting", "sequence long", _ROW)
        self.gaps = handle.getMapState("gaps", "after long", "prev_hash string, hash string, sound boolean, low long, low_hash string")

    def close(self) -> None:
        pass

    def _before(self) -> tuple[int, str | None] | None:
        return tuple(self.last.get()) if self.last.exists() else None

    def _emit(self, out: list, sequence: int, fault: str | None, revised: bool = False) -> None:
        out.append((sequence, fault, revised))

    def _late(self, row: tuple, out: list) -> None:
        """A row at or before the last judged one: inside a gap it is judged there, else it repeats one."""
        sequence, prev_hash, own, sound = row
        for (after,), (after_prev, after_own, after_sound, low, low_hash) in list(self.gaps.iterator()):
            if not (low < sequence < after):
                continue
            self.gaps.removeKey((after,))
            before = None if low == NOTHING else (low, low_hash)
            self._emit(out, sequence, judged(sequence, prev_hash, sound, before))
            self._emit(out, after, judged(after, after_prev, after_sound, (sequence, own)), True)
            if sequence > 0 and sequence > low + 1:
                self.gaps.updateValue((sequence,), (prev_hash, own, sound, low, low_hash))
            if after > sequence + 1:
                self.gaps.updateValue((after,), (after_prev, after_own, after_sound, sequence, own))
            return
        self._emit(out, sequence, "gap")

    def _advance(self, out: list, give_up: bool) -> bool:
        """Judges waiting rows while the next one is there, or past gaps with give_up. Whether rows are left waiting."""
        rows = sorted(tuple(r) for _, r in self.waiting.iterator())
        at = 0
        for sequence, prev_hash, own, sound in rows:
            before = self._before()
            follows = sequence == (0 if before is None else before[0] + 1)
            if not follows and not give_up:
                break
            self._emit(out, sequence, judged(sequence, prev_hash, sound, before))
            if not follows:
                low = (NOTHING, None) if before is None else before
                self.gaps.updateValue((sequence,), (prev_hash, own, sound, *low))
            self.last.update((sequence, own))
            self.waiting.removeKey((sequence,))
            at += 1
        return at < len(rows)

    def _frame(self, key, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame({"chain": [key[0]] * len(out), "sequence": [s for s, _, _ in out], "fault": pd.Series([f for _, f, _ in out], dtype=object), "revised": [r for _, _, r in out]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        out: list = []
        for part in rows:
            for sequence, prev_hash, own, sound in part[["sequence", "prev_hash", "hash", "sound"]].itertuples(index=False, name=None):
                row = (int(sequence), None if pd.isna(prev_hash) else prev_hash, None if pd.isna(own) else own, bool(sound))
                before = self._before()
                if before is not None and row[0] <= before[0]:
                    self._late(row, out)
                elif self.waiting.containsKey((row[0],)):
                    self._emit(out, row[0], "gap")
                else:
                    self.waiting.updateValue((row[0],), row)
        if self._advance(out, self.wait_ms == 0) and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        out: list = []
        self._advance(out, True)
        yield from self._frame(key, out)


def audited(events: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    """events (chain, sequence, payload, timestamp, prev_hash, hash), a stream -> (chain, sequence, fault, revised) of every row,
    as it is judged. A gap is given up wait_ms after the first row behind it came; with 0 at the end of its batch. Rows without
    a chain or a sequence are left out. Hashes are computed before rows are grouped, so payloads are not kept.
    The session must use the state store PROVIDER. Timers ask for batches without data, so a run with availableNow ends only
    where spark.sql.streaming.noDataMicroBatches.enabled is false."""
    own = chain_hash(F.col("payload"), F.col("timestamp"), F.col("sequence"), F.col("prev_hash"))
    sound = F.col("hash").isNotNull() & F.coalesce(F.col("hash") == own, F.lit(False))
    rows = events.filter("chain is not null and sequence is not null").select(F.col("chain").cast("string").alias("chain"), F.col("sequence").cast("long").alias("sequence"), "prev_hash", "hash", sound.alias("sound"))
    return rows.groupBy("chain").transformWithStateInPandas(ChainAudit(wait_ms), OUT, "Append", "ProcessingTime")


def current(found: DataFrame, order: str = "batch") -> DataFrame:
    """(chain, sequence, fault) of what audited() gave, written with the number of its batch: the last of each row counts, one
    that was revised before one that was not. A row that repeats a sequence keeps a fault of its own in what was written."""
    return found.groupBy("chain", "sequence").agg(F.max_by("fault", F.struct(order, "revised")).alias("fault"))
