"""The thin queries op1_ ... op13_ over the documents table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.tokenio import token_output

    return token_output(spark, documents(spark, sf_dir), tokenizer_path())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.linededup import dedup_lines, digest

    return digest(dedup_lines(spark, documents(spark, sf_dir), min_docs=10))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.secrets import joined, secret_spans

    base = F.concat("assign", "access", "hex")
    rows = secret_spans(spark, documents(spark, sf_dir))
    counts = [F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, "weak")).alias("spans"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.substrings import dedup_substrings, digest

    return digest(dedup_substrings(spark, documents(spark, sf_dir)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.decontam import contamination, digest

    return digest(contamination(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.packing import pack

    return pack(spark, documents(spark, sf_dir), tokenizer_path())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.langid import languages

    return languages(spark, documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.jaccard import digest, groups

    return digest(groups(spark, documents(spark, sf_dir), size=4, percent=85))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.licenses import digest, license_matches

    return digest(license_matches(spark, documents(spark, sf_dir)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.quality import ledger, passes

    rows = ledger(documents(spark, sf_dir)).withColumn("base_failed", ~passes("base", 1))
    kept = ~F.col("base_failed") & passes("prose", 2)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "failed")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.merkle import leaf, manifest, siblings, verified

    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = manifest(spark, documents(spark, sf_dir), carry={"tampered": F.when(touched, leaf(n_chars=F.col("n_chars") + 1))})
    rows = verified(rows, F.coalesce("tampered", "leaf"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.fingerprints import digest, fingerprinted

    return digest(fingerprinted(spark, documents(spark, sf_dir)))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.search import ranked_documents

    return ranked_documents(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tier")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_output, op2_line_dedup, op3_secret_scan, op4_substring_dedup, op5_decontamination, op6_packing, op7_language_id, op8_jaccard_join, op9_license_scan, op10_quality_rules, op11_merkle_manifest, op12_document_fingerprints, op13_lexical_search)}

_SPACE = "'[^\\x20\\x09-\\x0D]+'"
_ASCII = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIP = "trim({t}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLE: dict[str, str] = {
    "op2_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, {_ASCII.format(t=_STRIP.format(t='line'))} AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE}) AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
lo AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM win JOIN lo USING (h) WHERE lo < doc_id),
ws AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
m AS (SELECT ws.*, gone.i IS NOT NULL AS g FROM ws LEFT JOIN gone USING (doc_id, i))
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN
(SELECT doc_id, count(*) AS n, count(*) FILTER (g) AS r, string_agg(x, ' ' ORDER BY i) FILTER (NOT g) AS t FROM m GROUP BY doc_id) USING (doc_id)""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII.format(t="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_ASCII.format(t="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS win FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
hit AS (SELECT DISTINCT doc_id, m, s, win FROM dw SEMI JOIN bw USING (m, win)),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS i FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit JOIN bw USING (m, win)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op8_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_ASCII.format(t="coalesce(text, '')")}, {_SPACE}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sh AS (SELECT doc_id, x FROM s SEMI JOIN (SELECT x FROM s GROUP BY x HAVING count(*) > 1) USING (x)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n nu ON u = nu.doc_id JOIN n nv ON v = nv.doc_id WHERE 100 * i >= 85 * (nu.n + nv.n - i)),
e2 AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(u, v) AS (SELECT u, v FROM e2 UNION SELECT r.u, e2.v FROM r JOIN e2 ON r.v = e2.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u AS doc_id, min(v) AS m FROM r GROUP BY u) USING (doc_id)""",
    "op10_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACE}) AS w FROM documents),
ws AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
tri AS (SELECT doc_id, i, x || ' ' || lead(x) OVER q || ' ' || lead(x, 2) OVER q AS y FROM ws WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM tri WHERE y IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, y) > 1),
rw AS (SELECT doc_id, count(*) AS r FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM ln WHERE {_STRIP.format(t='l')} <> '' GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(r, 0) AS n_repeat_words FROM d LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id)),
f AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(100 * n_dup_lines > 30 * n_lines AS BIGINT) + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 15 * n_words AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 > 0 AS base_failed, failed = 0 AS kept, failed FROM f""",
    # t: nodes by level and place; f: the fold of one leaf, a level at a time; the trees of a group and over the groups alike.
    "op11_merkle_manifest": """
WITH RECURSIVE d AS (SELECT *, encode(CAST(doc_id AS VARCHAR)) AS b FROM documents),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(b) + 1), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
  lambda c, x: xor(c >> 8, list_reduce(list_prepend(xor(c & 255, x), [CAST(0 AS BIGINT) for i in range(8)]), lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END)))), 4294967295) AS crc FROM d),
x AS (SELECT doc_id, coalesce('=' || lang, '') AS g, CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m, n_chars, source, lang, text FROM d JOIN crc USING (doc_id)),
y AS (SELECT doc_id, g, {id} || {src} || {lang} AS head, {n} AS own, {m} AS odd, {text} AS tail FROM x),
l AS (SELECT doc_id, g, sha256(head || own || tail) AS leaf, sha256(head || odd || tail) AS odd, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i FROM y),
t(lv, g, i, h, n) AS (SELECT 0, g, i, leaf, count(*) OVER (PARTITION BY g) FROM l
  UNION ALL SELECT lv + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY lv, g, i // 2),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, i, h, n) AS (SELECT 0, i, h, n FROM s
  UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lv, i // 2),
p AS (SELECT doc_id, 0 AS part, t.lv, l.i >> t.lv AS pos, o.h AS other FROM l JOIN t ON t.g = l.g AND t.i = l.i >> t.lv AND t.n > 1 LEFT JOIN t o ON o.g = t.g AND o.lv = t.lv AND o.i = xor(t.i, 1)
  UNION ALL SELECT doc_id, 1, u.lv, s.i >> u.lv, o.h FROM l JOIN s USING (g) JOIN u ON u.i = s.i >> u.lv AND u.n > 1 LEFT JOIN u o ON o.lv = u.lv AND o.i = xor(u.i, 1)),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, lv) AS k FROM p),
f(doc_id, k, h) AS (SELECT doc_id, 0, odd FROM l
  UNION ALL SELECT f.doc_id, f.k + 1, sha256(CASE WHEN pos % 2 = 1 THEN other || f.h ELSE f.h || coalesce(other, '') END) FROM f JOIN q ON q.doc_id = f.doc_id AND q.k = f.k + 1),
e AS (SELECT doc_id, arg_max(h, k) AS folded FROM f GROUP BY doc_id),
z AS (SELECT doc_id, string_agg(other, '' ORDER BY k) AS proof FROM q GROUP BY doc_id)
SELECT l.doc_id, leaf, s.h AS subroot, r.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM l JOIN s USING (g) JOIN e USING (doc_id) LEFT JOIN z USING (doc_id), (SELECT h FROM u WHERE n = 1) r""".format(
        **{k: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for k, c in (("id", "doc_id"), ("src", "source"), ("lang", "lang"), ("n", "n_chars"), ("m", "m"), ("text", "text"))}
    ),
    "op13_lexical_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII.format(t="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_ASCII.format(t="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, len(w)::BIGINT AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT item_id, doc_id, sum(CAST(floor(1000 * ln((2.0 * n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * dl * n) // l))))::BIGINT AS score
  FROM b JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM i WHERE score > 0 QUALIFY rank <= 10""",
}
