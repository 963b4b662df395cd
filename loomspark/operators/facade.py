"""Reads over two collections of a document store, nodes and debates: their union as one event log, and documents with
their nodes and each node's entries, listed under every partition of the configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.config import Config

#: What a node's entries show (fixed values), and the layer that each list takes.
ENTRY = ("node_id", "title", "body", "source_file")
LISTS = {"debates": "debate", "ops": "execution"}


def collection(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """One collection, exported as JSON lines or Parquet under root."""
    reader = spark.read.schema(schema) if schema else spark.read
    path = f"{root.rstrip('/')}/{name}"
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.parquet")
    return reader.parquet(f"{path}.parquet") if found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found) else reader.json(f"{path}.json")


def events(nodes: DataFrame, debates: DataFrame) -> DataFrame:
    """Both collections as one bag, each with the columns of both: what the hash chain runs over."""
    return nodes.unionByName(debates, allowMissingColumns=True)


def partition_of_domain(domain: Column, config: Config) -> Column:
    out = F.lit("unknown")
    for p in config.partitions:
        out = F.when(domain == p.domain, F.lit(p.id)).otherwise(out)
    return out


def looked_up(nodes: DataFrame, debates: DataFrame) -> DataFrame:
    """nodes with debates and ops: entries of a layer that target the node's anchor from its own document and locale."""
    keys = ["anchor_id", "document_id", "locale"]
    body = F.struct("ord", F.struct(*ENTRY).alias("x"))
    pick = lambda layer: F.transform(F.array_sort(F.collect_list(F.when(F.col("layer") == layer, body))), lambda e: e["x"])
    own = debates.filter(F.col("layer").isin(*LISTS.values())).groupBy(F.col("target_anchor_id").alias("anchor_id"), "document_id", "locale").agg(*[pick(layer).alias(name) for name, layer in LISTS.items()])
    rows = nodes.join(own, keys, "left")
    return rows.withColumns({name: F.coalesce(name, F.array().cast(own.schema[name].dataType)) for name in LISTS})


def documents(nodes: DataFrame, debates: DataFrame, config: Config, spark: SparkSession, locale: str) -> DataFrame:
    """(ord, partition, label, codeowner, document_id, title, src, summary, node_count, nodes): a row a document, in one
    locale; a partition without documents has one row with none. Facts of a document are those of its first node.

    nodes: anchor_id, title, layer, body, document_id, domain, locale, document_title, document_summary, source_file, ord.
    debates: target_anchor_id, document_id, locale, layer, ord, and what ENTRY shows."""
    rows = looked_up(nodes.filter(F.col("locale") == locale), debates.filter(F.col("locale") == locale))
    rows = rows.withColumn("partition", partition_of_domain(F.col("domain"), config))
    node = F.struct("anchor_id", "title", "layer", "body", *LISTS)
    first = lambda c, name: F.min_by(c, "ord").alias(name)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", node.alias("x")))), lambda e: e["x"])
    docs = rows.groupBy("partition", "document_id").agg(first("document_title", "title"), first("source_file", "src"), first("document_summary", "summary"), F.count("*").alias("node_count"), in_order.alias("nodes"))
    dims = F.broadcast(config.partition_frame(spark).select("ord", F.col("id").alias("partition"), "label", "codeowner"))  # a row a partition
    return dims.join(docs, "partition", "left").select("ord", "partition", "label", "codeowner", "document_id", "title", "src", "summary", F.coalesce("node_count", F.lit(0)).alias("node_count"), "nodes")
