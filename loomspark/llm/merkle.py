"""Merkle dataset manifest: a leaf hash for each row, a tree for each group, a tree over the groups' roots, and for each
row the siblings that prove it.

Rows need their exact place in their group, not a sorted table: doc_id digits are counted in histograms (radix.py), whose
prefix sums give ranks. A node's key in the trie is its rank's digits in base `fanout`, without the last ones the higher it
stands: nodes whose keys share all but the last digits are reduced together, STAGE levels at a time, so a tree of any size
takes a few aggregations with groups of a bounded size. Proofs come back down the same way; the driver sees counts.

The rule (fixed values): a leaf is the sha256 of its fields in order, each `-` if null, else its byte count, `:` and its
value; a node is that of its children's digests as hex text. A run at the end may have fewer children, even one. A lone leaf
is the root of its group. Groups are ordered as bytes, null first.

A null doc_id comes first in its group; rows of one doc_id are ordered by leaf; repeated rows are leaves of their own, side
by side. Texts of any length are hashed where they are and not moved. An empty table has no root and no rows. Other columns
are ignored, but for those that `carry` names, which go into no hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import NULL_ID, Scratch
from loomspark.llm.radix import bucketed, ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A reduction takes so many nodes together at most.
STAGE = 1024
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row; changed: values in place of fields."""
    return F.sha2(F.concat(*[field(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its steps lead to."""
    return F.aggregate(steps, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(steps: Column) -> Column:
    """The digests of all steps in order, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def _height(n: Column, fanout: int) -> Column:
    """Levels above n nodes until one is left."""
    powers = [fanout**i for i in range(64) if fanout**i < 2**62]
    out = F.lit(len(powers))
    for i in range(len(powers) - 1, -1, -1):
        out = F.when(n <= F.lit(powers[i]), F.lit(i)).otherwise(out)
    return out


def _towers(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes (g, total, r, item with h) by block of fanout**levels ranks: (g, total, r, items, tower); tower[i] has the
    digests of level i, and the last the block's one."""
    block = F.expr(f"r div {fanout**levels}")
    rows = nodes.select("g", "total", block.alias("block"), F.struct("r", "item").alias("x"))
    rows = rows.groupBy("g", "total", "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # fanout**levels rows at most
    items = F.transform("xs", lambda x: x["item"])
    rows = rows.select("g", "total", F.col("block").alias("r"), items.alias("items"))

    def above(hs: Column) -> Column:
        n = F.ceil(F.size(hs) / fanout).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(F.array_join(F.slice(hs, i * fanout + 1, F.lit(fanout)), ""), 256))

    up = F.least(_height(F.col("total"), fanout), F.lit(levels))
    start = F.array(F.transform("items", lambda x: x["h"]))
    climb = F.aggregate(F.sequence(F.lit(1), up), start, lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))
    return rows.withColumn("tower", F.when(up > 0, climb).otherwise(start))


def _steps(place: Column, fanout: int, levels: int) -> Column:
    """The siblings inside a block of its node at `place`, level by level."""
    powers = F.array(*[F.lit(fanout**i) for i in range(levels + 1)])

    def step(hs: Column, i: Column) -> Column:
        at = F.floor(place / F.get(powers, i)).cast("int")
        first = at - at % fanout
        return F.struct(F.array_join(F.slice(hs, first + 1, at - first), "").alias("left"), F.array_join(F.slice(hs, at + 2, first + fanout - 1 - at), "").alias("right"))

    return F.transform(F.slice("tower", 1, F.size("tower") - 1), step)


def trees(nodes: DataFrame, fanout: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """nodes (g, total, r, item with h), ranked: the towers of each stage from the leaves up, written, and (g, h) of roots."""
    levels = max(i for i in range(1, 11) if fanout**i <= max(STAGE, fanout))
    stages = []
    while True:
        towers = scratch.write(_towers(nodes, fanout, levels), f"{name}-{len(stages)}", "zstd")
        stages.append(towers)
        size = F.ceil(F.col("total") / fanout**levels).cast("long")
        tops = towers.select("g", size.alias("total"), "r", F.struct(F.get(F.element_at("tower", -1), F.lit(0)).alias("h")).alias("item"))
        if (tops.agg(F.max("total")).first()[0] or 1) <= 1:
            return stages, tops.select("g", "item.h")
        # A group that has its root stays as it is: of one node, no level is left.
        nodes = tops


def proofs(stages: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """(g, item, steps, *roots' columns) of each leaf; roots: (g, steps, ...)."""
    levels = max(i for i in range(1, 11) if fanout**i <= max(STAGE, fanout))
    kept = [c for c in roots.columns if c not in ("g", "steps")]
    up = roots.withColumn("r", F.lit(0).cast("long"))
    for i, towers in enumerate(reversed(stages)):
        rows = towers.join(up.withColumnRenamed("steps", "higher"), ["g", "r"])
        own = F.transform("items", lambda x, i: F.struct(x.alias("item"), i.alias("i"), _steps(i, fanout, levels).alias("steps")))
        rows = rows.select("g", "r", "higher", *kept, F.explode(own).alias("x"))
        up = rows.select("g", (F.col("r") * fanout**levels + F.col("x.i")).alias("r"), "x.item", F.concat("x.steps", "higher").alias("steps"), *kept)
        if i < len(stages) - 1:
            up = up.drop("item")
    return up.drop("r")


def _totals(found) -> DataFrame:
    return found.groupBy("g").agg(F.sum("n").alias("total"))


def manifest(spark: SparkSession, docs: DataFrame, group: str = "lang", fanout: int = 2, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, *carry) of each row of docs; steps lead from the leaf to the root."""
    scratch, carry = Scratch(spark, "merkle"), carry or {}
    # A group's name sorts as its value does, null first.
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    hashed = docs.select(name.alias("g"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("doc_id").alias("own_id"), leaf().alias("h"), F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("carried"))
    # Null ids stand just below the others: as the smallest long they would spread the digits over all 64 bits.
    hashed = scratch.write(hashed.withColumn("seq", F.monotonically_increasing_id()), "hashed")
    low = hashed.filter(F.col("id") != NULL_ID).agg(F.min("id")).first()[0]
    key = F.when(F.col("id") == NULL_ID, F.lit(max(low - 1, NULL_ID) if low is not None else 0)).otherwise(F.col("id"))
    leaves = hashed.select("g", key.alias("k"), F.conv(F.substring("h", 1, 15), 16, 10).cast("long").alias("v"), "seq", "h", "own_id", "carried")
    found = bucketed(leaves, ["k", "v", "seq"], scratch, "places")
    rows = ranked(leaves, found, ["k", "h", "seq"]).join(_totals(found.table), "g")
    stages, tops = trees(rows.select("g", "total", "r", F.struct("h", "own_id", "carried").alias("item")), fanout, scratch, "leaves")

    # The groups' roots in the order of their names: the digits are the names' bytes.
    def digits(at: int) -> Column:
        return F.conv(F.rpad(F.hex(F.substring(F.encode("name", "utf-8"), at, 7)), 14, "0"), 16, 10).cast("long")

    tops = scratch.write(tops, "subroots").select(F.lit("").alias("g"), F.col("g").alias("name"), "h")
    tops = tops.select("*", digits(1).alias("k"), digits(8).alias("v"))
    found = bucketed(tops, ["k", "v"], scratch, "groups")
    rows = ranked(tops, found, ["k", "v", "name"]).join(_totals(found.table), "g")
    above, root = trees(rows.select("g", "total", "r", F.struct("h", "name").alias("item")), fanout, scratch, "groups")
    subroots = proofs(above, root.select("g", F.lit(None).cast(STEPS).alias("steps"), F.col("h").alias("root")).withColumn("steps", F.array().cast(STEPS)), fanout)
    subroots = scratch.write(subroots.select(F.col("item.name").alias("g"), F.col("item.h").alias("subroot"), "root", "steps"), "tops")
    out = proofs(stages, subroots, fanout)
    return out.select(F.col("item.own_id").alias("doc_id"), F.col("item.h").alias("leaf"), "subroot", "root", "steps", *[F.col(f"item.carried.{k}").alias(k) for k in carry])


def verified(rows: DataFrame, digest: Column) -> DataFrame:
    """rows of a manifest with folded_root, which the digests and the manifest's siblings lead to, and verified."""
    rows = rows.withColumn("folded_root", folded(digest, F.col("steps")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
