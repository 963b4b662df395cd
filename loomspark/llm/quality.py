"""Quality rules as a bitmask ledger: every rule is evaluated once a document, its failure kept as a bit beside the
measurements; policies (named, versioned sets of bits) and ablations are then bitwise work on the ledger alone.

DataFrame functions only. Measurements use whole texts; words are runs without ASCII white space. A null or empty
text has no words and fails `few_words`. Equal rows get equal ledgers; an empty table gives an empty ledger; the
ledger is computed from (doc_id, text) alone, so other columns, whatever their names, change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: rule -> what fails, over the measurements; the bit of a rule is its place here and never changes.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}

#: (policy, version) -> rules that reject.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_words"),
    ("prose", 1): ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    ("prose", 2): tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def words(text: Column) -> Column:
    """The words of a text; none of null, of '' and of white space."""
    cut = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(cut) > 0, F.split(cut, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def _covered(n: int):
    """How many of a text's words are in windows of n words whose sorted starts are given."""

    def add(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + (p + n) - F.greatest(p, acc["end"])).alias("n"), (p + n).alias("end"))

    return lambda starts: F.aggregate(starts, F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("end")), add, lambda acc: acc["n"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id with the measurements of its whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    squeezed = F.translate("text", SPACES, "")
    worded = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    rows = rows.select(
        "doc_id",
        words(F.col("text")).alias("w"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        worded.alias("lines"),
    )
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
        .alias("h"),
    )
    # Equal windows stand together once sorted by (hash, start).
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    rows = rows.select("doc_id", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", pairs.alias("s"))
    again = F.filter("s", lambda x, i: (x["h"] == F.get("s", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("s", i - 1)["h"])))
    starts = F.sort_array(F.transform(again, lambda x: x["p"]))
    repeated = F.when(F.col("s").isNull(), F.lit(0)).otherwise(_covered(3)(starts)).cast("long")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), "n_lines")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with `failed`: bit i is set where rule i fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs).withColumn("failed", failed)


def passes(policy: str, version: int) -> Column:
    """Whether a row of a ledger passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy, version]))) == 0


def ablations(rows: DataFrame, policy: str, version: int) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects. One partial aggregation;
    a row a rule comes back."""
    m = mask(POLICIES[policy, version])
    sums = [F.sum(F.lit(1)).alias("n_docs")]
    for i, r in enumerate(RULES):
        if m >> i & 1:
            sums += [F.sum(F.col("failed").bitwiseAND(F.lit(1 << i)) / (1 << i)).cast("long").alias(f"{r}_failed"), F.sum((F.col("failed").bitwiseAND(F.lit(m)) == 1 << i).cast("long")).alias(f"{r}_alone")]
    one = rows.agg(*sums)
    parts = [F.struct(F.lit(r).alias("rule"), F.coalesce(f"{r}_failed", F.lit(0)).alias("n_failed"), F.coalesce(f"{r}_alone", F.lit(0)).alias("n_only_this")) for i, r in enumerate(RULES) if m >> i & 1]
    return one.select(F.inline(F.array(*parts)))
