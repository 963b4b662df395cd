"""Ranked retrieval over units: BM25 from postings, pinned anchors, one-hop expansion, prompt blocks.

units: uid, kind, anchor_id, parent_anchor, title, text, ord, and what blocks show. An index is two tables and a row
(postings, document frequencies, totals), so it can be written once and queried often; a query touches the postings of
its terms only, and lengths and frequencies are counted where the units are.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.config import NOT_IN_FORCE
from loomspark.functions import nested
from loomspark.functions.status import shown
from loomspark.functions.text import anchor_tokens, anchors_in, tokens

K1, B, TITLE_WEIGHT = 1.5, 0.75, 2


class Retriever(Protocol):
    """What a retriever gives: hits (uid, score, reason, pos), the same for the same input."""

    def retrieve(self, query: str, limit: int) -> DataFrame: ...


def bags(units: DataFrame, title: str | None = "title", text: str = "text", anchor: str | None = "anchor_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(uid, bag, len, *keep) of each unit: its words; a title's count twice, an anchor as a whole and in parts."""
    bag = tokens(F.col(text))
    if title:
        rows = units.select("uid", *keep, *([anchor] if anchor else []), bag.alias("bag"), tokens(F.col(title)).alias("head"))
        bag = F.concat(*[F.col("head")] * TITLE_WEIGHT, "bag")
    else:
        rows = units.select("uid", *keep, *([anchor] if anchor else []), bag.alias("bag"))
        bag = F.col("bag")
    if anchor:
        bag = F.concat(bag, anchor_tokens(F.col(anchor)))
    return rows.select("uid", *keep, bag.alias("bag")).select("uid", "bag", F.size("bag").alias("len"), *keep)


def _as_bags(units: DataFrame, **fields) -> DataFrame:
    return units if "bag" in units.columns else bags(units, **fields)


def postings(units: DataFrame, terms: list[str] | None = None, **fields) -> DataFrame:
    """(uid, len, term, tf) of units, or of bags already made; of some terms, or all. A unit's words are counted where the
    unit is: nothing is shuffled."""
    bag = F.col("bag") if terms is None else F.filter("bag", lambda t: t.isin(terms))
    # Sorted, a word's count is the distance to the next other one.
    rows = _as_bags(units, **fields).select("uid", "len", F.array_sort(bag).alias("bag"))
    first = F.filter(F.transform("bag", lambda t, i: F.when((i == 0) | (t != F.get("bag", i - 1)), F.struct(t.alias("term"), i.alias("at")))), lambda x: x.isNotNull())
    rows = rows.select("uid", "len", F.size("bag").alias("n"), first.alias("first"))
    each = F.transform("first", lambda x, i: F.struct(x["term"].alias("term"), (F.coalesce(F.get("first", i + 1)["at"], F.col("n")) - x["at"]).cast("long").alias("tf")))
    return rows.select("uid", "len", F.explode(each).alias("x")).select("uid", "len", "x.term", "x.tf")


def term_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) of postings."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def document_frequencies(units: DataFrame, **fields) -> DataFrame:
    """(term, df) of units or bags, without making postings."""
    rows = _as_bags(units, **fields).select(F.explode(F.array_distinct("bag")).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def totals(units: DataFrame, **fields) -> DataFrame:
    """One row: n units (those without words too), their mean length. From units or bags; nothing but sums is shuffled."""
    one = _as_bags(units, **fields).agg(F.count("*").alias("n"), F.sum("len").alias("words"))
    return one.select("n", (F.coalesce("words", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avg"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def part(n: Column, df: Column, tf: Column, length: Column, avg: Column) -> Column:
    """What a term adds to a unit's score; more for a greater count and for a shorter unit."""
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def summed(hit: DataFrame, dfs: DataFrame, stats: DataFrame, asked: list[str], key: list[str]) -> DataFrame:
    """(*key, score) of postings (*key, term, tf, len), whose terms' frequencies are dfs. A unit's parts are added in the
    query's order, so equal units tie."""
    rows = hit.join(F.broadcast(dfs), "term").crossJoin(F.broadcast(stats))  # a row a query term; one row
    own = part(F.col("n"), F.col("df"), F.col("tf"), F.col("len"), F.col("avg"))
    at = F.array_position(F.array(*map(F.lit, asked)), F.col("term")) if asked else F.lit(0)
    parts = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), own.alias("part")))).alias("parts"))  # a part a query term
    return parts.select(*key, F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["part"]).alias("score"))


def bm25(index: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """(uid, score) of units that hold a term. A unit's parts are added in the query's order, so equal units tie."""
    asked = list(dict.fromkeys(terms))
    hit = index.filter(F.col("term").isin(asked))
    return summed(hit, term_frequencies(hit), stats, asked, ["uid"])


def top(scores: DataFrame, units: DataFrame, limit: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The best `limit` units by score, ties in graph order; kinds restrict seeds, not statistics."""
    rows = scores.join(units.select("uid", "ord", *(["kind"] if kinds else [])), "uid").filter("score > 0")
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    return rows.orderBy(F.desc("score"), "ord").limit(limit)


def _query_terms(spark: SparkSession, query: str) -> tuple[list[str], list[str]]:
    """The query's distinct words and anchors; a query is one short text."""
    row = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t"), anchors_in(F.lit(query)).alias("a")).first()
    return row.t, row.a


class Scores(Protocol):
    """A persisted index of units (sources.postings.PostingIndex)."""

    def scores(self, terms: list[str], limit: int | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame: ...


@dataclass
class Bm25Retriever:
    """BM25 over units: their words are taken from an index that was written before, or else once from the units."""

    units: DataFrame
    seed_kinds: tuple[str, ...] = ("contract", "debate", "ops")
    index: Scores | None = None

    def __post_init__(self):
        self.bags = None if self.index else bags(self.units).cache()
        self.stats = None if self.index else totals(self.bags)

    def close(self) -> None:
        """Frees the kept words; the retriever can still be asked, from the units."""
        if self.bags is not None:
            self.bags.unpersist()

    def describe(self) -> dict:
        return {"kind": "bm25", "k1": K1, "b": B, "title_weight": TITLE_WEIGHT, "seed_kinds": list(self.seed_kinds), "persisted": self.index is not None}

    def _seeds(self, asked: list[str], limit: int) -> DataFrame:
        if self.index:
            return self.index.scores(asked, limit, self.seed_kinds).orderBy(F.desc("score"), "ord").limit(limit).select("uid", "score", "ord")
        return top(bm25(postings(self.bags, asked), self.stats, asked), self.units, limit, self.seed_kinds)

    def retrieve(self, query: str, limit: int = 5) -> DataFrame:
        """(uid, score, reason, pos): anchors that the query names come first, whatever their kind."""
        spark = self.units.sparkSession
        terms, anchors = _query_terms(spark, query)
        named = spark.createDataFrame([(a, i) for i, a in enumerate(anchors)], "anchor string, at int")
        first = self.units.filter("kind = 'contract'").groupBy(F.lower("anchor_id").alias("anchor")).agg(F.min_by("uid", "ord").alias("uid"))
        pinned = first.join(F.broadcast(named), "anchor").select("uid", F.lit(float("inf")).alias("score"), F.lit("anchor").alias("reason"), F.lit(0).alias("tier"), F.col("at").cast("long").alias("o"))
        asked = [*terms, *(a for a in anchors if a not in terms)]
        seeds = self._seeds(asked, limit + len(anchors))
        nth = F.row_number().over(Window.orderBy(F.desc("score"), "ord")).cast("long")  # limit + anchors rows
        seeds = seeds.withColumn("o", nth).join(pinned.select("uid"), "uid", "left_anti").select("uid", "score", F.lit("bm25").alias("reason"), F.lit(1).alias("tier"), "o")
        both = pinned.unionByName(seeds).orderBy("tier", "o").limit(max(limit, 0))
        return both.withColumn("pos", F.row_number().over(Window.orderBy("tier", "o"))).select("uid", "score", "reason", "pos")


def by_anchor(units: DataFrame, anchor: str) -> DataFrame:
    return units.filter((F.col("kind") == "contract") & (F.lower("anchor_id") == anchor.lower())).orderBy("ord").limit(1)


def children_of(units: DataFrame, anchor: str) -> DataFrame:
    return units.filter((F.col("kind") != "contract") & (F.lower("parent_anchor") == anchor.lower())).orderBy("ord")


def parent_of(units: DataFrame, uids: DataFrame) -> DataFrame:
    """(uid, parent): the contract above each dependent."""
    own = units.join(uids.select("uid"), "uid").filter("kind <> 'contract'").select("uid", F.lower("parent_anchor").alias("a"))
    first = units.filter("kind = 'contract'").groupBy(F.lower("anchor_id").alias("a")).agg(F.min_by("uid", "ord").alias("parent"))
    return own.join(first, "a").select("uid", "parent")


def expanded(units: DataFrame, hits: DataFrame, budget: int) -> DataFrame:
    """(uid, score, reason, pos): a dependent's contract goes before it, a contract's dependents after it; a unit keeps
    its first place, and the first `budget` stay."""
    u = units.select("uid", "kind", "ord", F.lower("anchor_id").alias("a"), F.lower("parent_anchor").alias("pa"))
    none = F.lit(None).cast(units.schema["ord"].dataType)
    seeds = hits.join(u, "uid")
    is_contract = F.col("kind") == "contract"
    own = seeds.select("uid", "score", "reason", "pos", F.when(is_contract, 0).otherwise(1).alias("slot"), none.alias("ord"))
    parents = parent_of(units, hits.select("uid")).join(hits.select("uid", "pos"), "uid").select(F.col("parent").alias("uid"), F.lit(0.0).alias("score"), F.concat(F.lit("parent-of:"), "uid").alias("reason"), "pos", F.lit(0).alias("slot"), none.alias("ord"))
    kids = u.filter(~is_contract).select(F.col("uid").alias("child"), F.col("pa").alias("under"), F.col("ord").alias("child_ord"))
    children = seeds.filter(is_contract).join(kids, F.col("a") == F.col("under")).select(F.col("child").alias("uid"), F.lit(0.0).alias("score"), F.concat(F.lit("child-of:"), "uid").alias("reason"), "pos", F.lit(1).alias("slot"), F.col("child_ord").alias("ord"))
    every = own.unionByName(parents).unionByName(children)
    first = every.withColumn("nth", F.row_number().over(Window.partitionBy("uid").orderBy("pos", "slot", "ord"))).filter("nth = 1")
    kept = first.orderBy("pos", "slot", "ord").limit(budget)
    place = Window.orderBy("pos", "slot", "ord")  # budget rows
    return kept.withColumn("p", F.row_number().over(place)).select("uid", "score", "reason", F.col("p").alias("pos"))


def citation(kind: Column, anchor: Column, parent: Column) -> Column:
    return F.when(kind == "contract", F.concat(F.lit("^"), anchor)).otherwise(F.concat(kind, F.lit(" -> ^"), parent))


def block(pos: Column) -> Column:
    """The text of a unit's context block."""
    status = shown(F.col("computed_status"), F.col("status"), F.col("invalidated"))
    flag = F.when(status.isin(*NOT_IN_FORCE), F.lit("  [NOT IN FORCE]")).otherwise(F.lit(""))
    filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    doc = F.coalesce(F.nullif("document_title", F.lit("")), F.nullif("document_id", F.lit("")), F.lit("-"))
    head = F.format_string("[%d] %s %s | status: %s%s | layer: %s", pos, F.upper("kind"), citation(F.col("kind"), F.col("anchor_id"), F.col("parent_anchor")), status, flag, filled("layer"))
    return F.concat_ws("\n", head, F.concat(F.lit("title: "), filled("title")), F.format_string("source: %s (document: %s)", filled("source_file"), doc), F.coalesce(F.nullif("text", F.lit("")), F.lit("(empty body)")))


def prompt(units: DataFrame, hits: DataFrame, query: str, system: str, meta: dict) -> DataFrame:
    """One row: the whole prompt. hits is a bounded context, so its blocks meet in one row."""
    rows = hits.join(units, "uid").select("pos", block(F.col("pos")).alias("b"))
    blocks = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "\n\n").alias("b"))
    head = ", ".join(f"{k}={meta[k]}" for k in sorted(meta) if meta[k] not in (None, "")) or "(no metadata)"
    body = F.coalesce(F.nullif("b", F.lit("")), F.lit("(no matching units)"))
    return blocks.select(F.concat(F.lit(f"## SYSTEM\n{system}\n\n## GRAPH\n{head}\n\n## CONTEXT\n"), body, F.lit(f"\n\n## QUESTION\n{query.strip()}\n")).alias("prompt"))


def leaks(rows: DataFrame, prefixes: list[str], key: str, limit: int | None = None) -> DataFrame:
    """(location, value): strings anywhere in rows, however deeply nested, that begin with a restricted prefix, in order of
    key and place. A place is a path of field names, indexes and map keys; a map's keys are looked at too."""
    found = F.array_compact(F.concat(*[nested.strings(F.col(f"`{f.name}`"), f.dataType, f.name) for f in rows.schema.fields])) if rows.schema.fields else F.array()
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith("x.value", F.lit(p))
    out = rows.select(F.col(key).alias("key"), F.posexplode(found).alias("i", "x")).filter(hit)
    out = out.select("key", "i", F.concat_ws(".", "key", "x.place").alias("location"), "x.value")
    if limit is not None:
        out = out.orderBy("key", "i").limit(limit)
    return out.select("location", "value")
