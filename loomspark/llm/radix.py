"""Places in an order without sorting a table: rows are counted by digits of their keys, and prefix sums over the counts
tell how many rows come before each bucket.

The first histogram's digits are as fine as the number of rows asks for; sums of 4096 counts each lead up to one total and
back down, so no task sees more counts than that. Buckets that are still too large (ids that cluster, one id on very many
rows) are counted again by their next digits, then by those of the next key. A bucket's rows are few, so a window puts
them in order. Counts are made where the rows are; only counts are shuffled, and the driver gets a few numbers.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch

DIGIT = 12
#: A bucket's columns: how often it was cut, and up to three keys without the digits that do not count.
BUCKET = ["lv", "b1", "b2", "b3"]


@dataclass
class Buckets:
    """table: (g, *BUCKET, base, n): rows before a bucket in its group, and in it. tag(rows) gives rows their bucket."""

    table: DataFrame
    tag: Callable[[DataFrame], DataFrame]


def _place(keys: list[str], level: int, at: int, shift: int) -> dict[str, Column]:
    """The bucket of a row at a level: keys before `at` whole, that one without its last `shift` bits."""
    whole = [F.col(k) for k in keys[:at]] + [F.shiftright(F.col(keys[at]), shift)]
    whole += [F.lit(0).cast("long")] * (3 - len(whole))
    return {"lv": F.lit(level), **dict(zip(BUCKET[1:], whole))}


def before(by: list[str], order: list[str]) -> Column:
    """The sum of n over the rows before one; few rows share what `by` names."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0).cast("long"))


def _bases(counts: DataFrame, lo: int, hi: int) -> DataFrame:
    """counts (g, x, n, ...) with base, where x lies from lo to hi: sums by the digits above, then down again."""
    if hi - lo < 1 << DIGIT:
        return counts.withColumn("base", before(["g"], ["x"]))
    up = F.shiftright("x", DIGIT).alias("x")
    above = _bases(counts.groupBy("g", up).agg(F.sum("n").alias("n")), lo >> DIGIT, hi >> DIGIT)
    above = above.select("g", F.col("x").alias("up"), F.col("base").alias("above"))
    rows = counts.withColumn("up", F.shiftright("x", DIGIT))
    rows = rows.withColumn("own", before(["g", "up"], ["x"])).join(above, ["g", "up"])
    return rows.withColumn("base", F.col("own") + F.col("above")).drop("own", "above", "up")


def bucketed(rows: DataFrame, keys: list[str], scratch: Scratch, name: str, target: int = 32, most: int = 1024) -> Buckets:
    """Buckets of rows, a written table: g (a string, never null), keys (three longs at most, never null, in order of weight). A bucket has
    some `target` rows, `most` unless its keys are all the same. An empty table has no buckets."""
    first = rows.agg(F.count("*").alias("n"), F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi")).first()
    lo, hi = (first.lo, first.hi) if first.n else (0, 0)
    shift = 0
    while shift < 63 and (hi >> shift) - (lo >> shift) > first.n // target:
        shift += 1
    ends = [F.min(k).alias(f"lo{i}") for i, k in enumerate(keys)] + [F.max(k).alias(f"hi{i}") for i, k in enumerate(keys)]
    places, opens, closed = [_place(keys, 0, 0, shift)], [], []
    counts = rows.withColumns(places[0]).groupBy("g", *BUCKET).agg(F.count("*").alias("n"), *ends)
    counts = scratch.write(counts, f"{name}-counts-0").withColumnRenamed("b1", "x")
    based = scratch.write(_bases(counts, lo >> shift, hi >> shift).withColumnRenamed("x", "b1"), f"{name}-based-0")
    scratch.drop(f"{name}-counts-0")
    at, level = 0, 0
    while True:
        large = based.filter(F.col("n") > most)
        # How many of the next bits differ inside a large bucket: those above them need no level.
        differ = [F.max(F.when(F.col(f"lo{i}") != F.col(f"hi{i}"), F.length(F.bin(F.col(f"lo{i}").bitwiseXOR(F.col(f"hi{i}"))))).otherwise(0)).alias(f"d{i}") for i in range(at, len(keys))]
        spread = large.agg(F.count("*").alias("n"), *differ).first()
        while spread.n and at < len(keys) and not spread[f"d{at}"]:
            at += 1
        if not spread.n or at == len(keys):
            closed.append(based)
            break
        closed.append(based.filter(F.col("n") <= most))
        level += 1
        opens.append(large.select("g", *BUCKET))
        places.append(_place(keys, level, at, max(0, spread[f"d{at}"] - DIGIT)))
        inner = rows.withColumns(places[-2]).join(large.select("g", *BUCKET, F.col("base").alias("above")), ["g", *BUCKET])
        old = [F.col(b).alias(f"p{b}") for b in BUCKET]
        inner = inner.select("g", "above", *keys, *old).withColumns(places[-1])
        counts = scratch.write(inner.groupBy("g", "above", *(f"p{b}" for b in BUCKET), *BUCKET).agg(F.count("*").alias("n"), *ends), f"{name}-counts-{level}")
        own = before(["g", *(f"p{b}" for b in BUCKET)], BUCKET[1:])
        counts = counts.withColumn("base", own + F.col("above")).drop("above", *(f"p{b}" for b in BUCKET))
        based = scratch.write(counts.select(*based.columns), f"{name}-based-{level}")
        scratch.drop(f"{name}-counts-{level}")
    table = functools.reduce(DataFrame.unionByName, closed).select("g", *BUCKET, "base", "n")

    def tag(frame: DataFrame) -> DataFrame:
        out = frame.withColumns(places[0])
        for large, place in zip(opens, places[1:]):
            out = out.join(large.withColumn("large", F.lit(True)), ["g", *BUCKET], "left")
            out = out.withColumns({b: F.when(F.col("large"), c).otherwise(F.col(b)) for b, c in place.items()}).drop("large")
        return out

    return Buckets(table, tag)


def ranked(rows: DataFrame, found: Buckets, order: list[str]) -> DataFrame:
    """rows with r: how many rows of their group come before, by the order that the buckets' keys begin."""
    at = F.row_number().over(Window.partitionBy("g", *BUCKET).orderBy(*order)).cast("long")
    out = found.tag(rows).join(found.table.select("g", *BUCKET, "base"), ["g", *BUCKET])
    return out.withColumn("r", F.col("base") + at - 1).drop("base", *BUCKET)
