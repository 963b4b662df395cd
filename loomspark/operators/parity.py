"""Comparisons by full outer joins: locales, sources, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def locale_parity(nodes: DataFrame, left: str, right: str) -> DataFrame:
    """For each partition: documents, nodes and what only one locale has. nodes: locale, partition, document_id, anchor_id."""
    side = lambda x: nodes.filter(F.col("locale") == x)
    docs = lambda x, n: side(x).groupBy("partition", "document_id").agg(F.count("*").alias(n))
    d = docs(left, "l").join(docs(right, "r"), ["partition", "document_id"], "full_outer")
    d = d.groupBy("partition").agg(
        F.count("l").alias("left_docs"), F.count("r").alias("right_docs"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_nodes"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_nodes"),
        F.count_if(F.col("r").isNull()).alias("only_left_docs"), F.count_if(F.col("l").isNull()).alias("only_right_docs"),
        F.count_if(F.col("l") != F.col("r")).alias("disagree"),
    )
    ids = lambda x, n: side(x).select("partition", "anchor_id").distinct().withColumn(n, F.lit(1))
    a = ids(left, "l").join(ids(right, "r"), ["partition", "anchor_id"], "full_outer")
    a = a.groupBy("partition").agg(F.count_if(F.col("r").isNull()).alias("only_left_anchors"), F.count_if(F.col("l").isNull()).alias("only_right_anchors"))
    return d.join(a, "partition", "full_outer")


def artifact_diff(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, entries): fields in which two graphs' units differ, by (locale, anchor) and by (locale, anchor, kind,
    ordinal); what only one side has is a `_row`. left, right: units as graph.units() gives them. A difference in order
    never hides one in content, and the other way round."""
    fields = ["title", "text", "layer", "status", "contract_status", "computed_status", "invalidated", "source_file"]
    sides = [x.select("locale", F.col("anchor_id").alias("anchor"), "kind", F.col("ord.e").alias("ordinal"), *fields) for x in (left, right)]
    contract = F.col("kind") == "contract"
    nodes = field_diff(*[s.filter(contract) for s in sides], ["locale", "anchor"], fields)
    return nodes, field_diff(*[s.filter(~contract) for s in sides], ["locale", "anchor", "kind", "ordinal"], fields)


def only_in(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that only one side has."""
    return a.subtract(b), b.subtract(a)


def field_diff(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, left, right): `_row` where a side lacks the key, or else each field that differs, nulls alike."""
    left = a.select(*keys, F.struct(*fields).alias("l"))
    right = b.select(*keys, F.struct(*fields).alias("r"))
    rows = left.join(right, keys, "full_outer")
    lone = rows.filter("l is null or r is null").select(*keys, F.lit("_row").alias("field"), F.when(F.col("l").isNotNull(), "present").alias("left"), F.when(F.col("r").isNotNull(), "present").alias("right"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").cast("string").alias("left"), F.col(f"r.{f}").cast("string").alias("right")) for f in fields])
    both = rows.filter("l is not null and r is not null").select(*keys, F.explode(each).alias("x")).select(*keys, "x.*").filter(~F.col("left").eqNullSafe(F.col("right")))
    return lone.unionByName(both)
