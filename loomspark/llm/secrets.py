"""Secret scans: spans of credentials, with multipart linking. DataFrame functions only.

Base kinds (fixed values) are found leftmost and non-overlapping, each kind by itself. Beyond them, weak candidates
(long mixed-case tokens, and endpoints) are parts: a part is reported only where a complementary one lies within its
scope: in the same block (lines without an empty one between them), at most `scope` code points between the end of one
and the start of the other. Access identifiers, secrets and endpoints meet by an interval join inside a document: each
interval is two events in order of position, and running extremes over them tell the greatest end before a part's start
and the least start after its end. So no pairs are made, however dense a text; and no part complements one that it
overlaps, such as the URL that it stands in.

All patterns stay within a line. Offsets are code points, ends exclusive. A null or empty text has no spans; whole texts
are scanned. Parts that begin together are ordered by kind. Equal rows get equal spans; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import Scratch, doc_id, keyed

#: Kind -> pattern, group whose length counts, least length. Patterns whose least length can stand in
#: the pattern itself have it there: their runs are maximal, so the matches are the same.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak candidates.
SECRET = r"[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"""(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+"""
KINDS = ("assign", "access", "hex", "secret", "endpoint")
#: What ends a block, as a kind of its own.
BREAK, BLOCK_END = 5, r"\n[\x20\x09\x0D]*\n"
SCOPE = 400

SPAN = "array<struct<start:int,kind:int,end:int>>"
_CHUNK = 256


def _none() -> Column:
    return F.array().cast(SPAN)


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is computed once: inside a lambda an expression is computed again for each element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def found(text: Column, kind: int, pattern: str, group: int = 0, least: int = 0, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of a pattern: what splits the text and what lies between give every match its place. keep(match) may rule
    matches out. Offsets are added up in chunks: the sums of chunks first, then inside each from where it starts, so the
    work grows with the matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("b"), matches.alias("m"), counted.alias("g"))
    size = lambda x: F.coalesce(F.length(x["g"]), F.lit(-1)) if keep is None else F.when(keep(x["m"]), F.length(x["g"])).otherwise(-1)
    parts = F.transform(parts, lambda x: F.struct(F.length(x["b"]).alias("b"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("m"), size(x).alias("g")))

    def spans(chunk: Column, start: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            at = acc["at"] + x["b"]
            own = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + x["m"]).alias("end")))
            return F.struct((at + x["m"]).alias("at"), F.when(x["g"] >= max(least, 1), F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(start.alias("at"), _none().alias("out")), add, lambda acc: acc["out"])

    def placed(chunks: Column) -> Column:
        total = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["b"] + x["m"])
        starts = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(c))))
        return _bound(starts, lambda s: F.flatten(F.transform(chunks, lambda c, i: spans(c, F.get(s, i)))))

    in_chunks = lambda ps: F.transform(F.sequence(F.lit(1), F.size(ps), F.lit(_CHUNK)), lambda i: F.slice(ps, i, F.lit(_CHUNK)))
    return _bound(parts, lambda ps: _bound(in_chunks(ps), placed))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(k, th, base spans, parts) of each row. Substring tests spare most texts the patterns."""
    t, low = F.col("text"), F.col("low")
    rows = keyed(docs).select("k", "th", "text", F.lower("text").alias("low"))

    def has(*parts: str, of: Column = low) -> Column:
        out = F.contains(of, F.lit(parts[0]))
        for p in parts[1:]:
            out = out | F.contains(of, F.lit(p))
        return out

    assign = F.when(has("passw", "secret", "token") | (has("api") & has("key")), found(t, 0, ASSIGN, 2, 6)).otherwise(_none())
    access = F.when(has("AKIA", of=t), found(t, 1, ACCESS)).otherwise(_none())
    rows = rows.select("k", "th", "text", assign.alias("assign"), access.alias("access"), F.when(t.rlike(HEX), found(t, 2, HEX)).otherwise(_none()).alias("hex"))
    endpoint = F.when(has("://", of=t), found(t, 4, ENDPOINT)).otherwise(_none())
    rows = rows.withColumn("endpoint", endpoint)
    # A weak secret needs an access identifier or an endpoint in its text at least.
    # Mixed case with digits: else long words, paths and hex would count.
    secret = F.when((F.size("access") + F.size("endpoint") > 0) & t.rlike(SECRET), found(t, 3, SECRET, keep=_mixed)).otherwise(_none())
    rows = rows.withColumn("secret", secret)
    breaks = F.when(F.size("secret") + F.size("endpoint") > 0, found(t, BREAK, BLOCK_END)).otherwise(_none())
    return rows.select("k", "th", "assign", "access", "hex", "secret", "endpoint", breaks.alias("breaks"))


def _mixed(x: Column) -> Column:
    return F.regexp_like(x, F.lit("[0-9]")) & F.regexp_like(x, F.lit("[a-z]")) & F.regexp_like(x, F.lit("[A-Z]"))


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(k, th, weak): weak parts with a complement in scope. A secret complements an access identifier or an endpoint;
    an endpoint, a secret of any kind (assigned, hex or weak)."""
    parts = rows.filter(F.size("secret") + F.size("endpoint") > 0).select("k", "th", F.explode(F.concat("assign", "access", "hex", "secret", "endpoint", "breaks")).alias("s"))
    start, end, kind = F.col("s.start"), F.col("s.end"), F.col("s.kind")
    in_order = Window.partitionBy("k", "th").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("block", F.count_if(kind == BREAK).over(in_order)).filter(kind != BREAK)
    events = parts.select("k", "th", "block", "s", F.explode(F.array(F.struct(start.alias("at"), F.lit(False).alias("ends")), F.struct(end.alias("at"), F.lit(True).alias("ends")))).alias("e"))
    events = events.select("k", "th", "block", "s", "e.at", "e.ends")
    # Both frames run to the current row: one that runs from it to the last is computed anew for each row.
    own = Window.partitionBy("k", "th", "block")
    before = own.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = own.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def near(*kinds: int) -> Column:
        ended = F.max(F.when(F.col("ends") & kind.isin(*kinds), end)).over(before)  # of those that end where this starts, or before
        begun = F.min(F.when(~F.col("ends") & kind.isin(*kinds), start)).over(after)
        return F.coalesce(F.when(F.col("ends"), begun <= end + scope).otherwise(ended >= start - scope), F.lit(False))

    events = events.select("k", "th", "s", near(1, 4).alias("by_access"), near(0, 2, 3).alias("by_secret"))
    kept = ((kind == 3) & F.col("by_access")) | ((kind == 4) & F.col("by_secret"))
    return events.filter(kept).groupBy("k", "th").agg(F.collect_set("s").alias("weak"))


def secret_spans(spark: SparkSession, docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row a document: doc_id, assign, access, hex (base spans), weak (linked parts)."""
    scratch = Scratch(spark, "secrets")
    rows = scratch.write(scan(docs), "spans")
    out = rows.select("k", "th", "assign", "access", "hex").join(linked(rows, scope), ["k", "th"], "left")
    return out.select(doc_id(), "assign", "access", "hex", F.coalesce("weak", _none()).alias("weak"))
