"""The query catalogue: name -> Spark query, and name -> the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import hashing, ids, status, text
from loomspark.operators import audit, blocks, changes, facade, graph, integrity, layout, parity, retrieval
from loomspark.plans import bridge as b
from loomspark.plans import compiler, gate
from loomspark.plans.bridge import CONFIG, sql, table
from loomspark.plans.incremental import Build
from loomspark.sources import artifacts, lineage
from loomspark.sources.cells import VectorIndex
from loomspark.sources.postings import PostingIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# --- retrieval ---------------------------------------------------------------------------------------------------------
TERMS = ["the", "onesen", "erblest", "andthe"]
_TOKENS = "regexp_extract_all(replace(lower({t}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"
_TITLE = "array_to_string(string_split(text, ' ')[1:5], ' ')"
_UNITS_SQL = f"""units AS (SELECT CAST(doc_id AS VARCHAR) AS uid, doc_id AS ord, list_concat(list_concat({_TOKENS.format(t=_TITLE)}, {_TOKENS.format(t=_TITLE)}), {_TOKENS.format(t='text')}) AS bag FROM documents),
postings AS (SELECT uid, len, term, count(*) AS tf FROM (SELECT uid, len(bag) AS len, unnest(bag) AS term FROM units) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n, sum(len(bag)) / count(*) AS avgl FROM units)"""
_SCORE_SQL = "round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgl))), 6)"


def _units(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("uid"), F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("title"), "text", F.col("doc_id").alias("ord"))


@query(f"WITH {_UNITS_SQL} SELECT uid, {_SCORE_SQL} AS score FROM postings JOIN dfs USING (term), stats WHERE term IN ('the', 'onesen', 'erblest', 'andthe') GROUP BY uid, CAST(uid AS BIGINT) ORDER BY score DESC, CAST(uid AS BIGINT) LIMIT 20")
def bm25_topk(spark, sf_dir):
    u = _units(spark, sf_dir)
    own = retrieval.bags(u, anchor=None)
    scores = retrieval.bm25(retrieval.postings(own, TERMS), retrieval.totals(own), TERMS)
    return retrieval.top(scores.withColumn("score", F.round("score", 6)), u, 20).select("uid", "score")


@query(f"WITH {_UNITS_SQL} SELECT term, df FROM dfs")
def term_document_frequency(spark, sf_dir):
    return retrieval.document_frequencies(_units(spark, sf_dir), anchor=None)


def _index(spark, sf_dir) -> PostingIndex:
    """The persisted index of documents; it is built where these files have none yet."""
    u = _units(spark, sf_dir)
    index = PostingIndex(spark, f"{lineage.shared_folder(spark)}/indexes/{lineage.mark(u)}", buckets=32)
    if not index.manifest()["segments"]:
        index.build(u, anchor=None)
    return index


@query(ORACLE["bm25_topk"])
def indexed_topk(spark, sf_dir):
    return _index(spark, sf_dir).top(TERMS, 20).withColumn("score", F.round("score", 6))


@query(ORACLE["term_document_frequency"])
def indexed_document_frequency(spark, sf_dir):
    return _index(spark, sf_dir).frequencies()


_NEW_SQL = f"""units AS (SELECT CAST(doc_id AS VARCHAR) AS uid, doc_id AS ord, list_concat(list_concat({_TOKENS.format(t=_TITLE)}, {_TOKENS.format(t=_TITLE)}), {_TOKENS.format(t="text || CASE WHEN doc_id % 100 = 7 THEN ' onesen onesen' ELSE '' END")}) AS bag FROM documents WHERE doc_id % 100 <> 3)""" + _UNITS_SQL[_UNITS_SQL.index(",\npostings"):]


@query(f"WITH {_NEW_SQL} SELECT uid, {_SCORE_SQL} AS score FROM postings JOIN dfs USING (term), stats WHERE term IN ('the', 'onesen', 'erblest', 'andthe') GROUP BY uid, CAST(uid AS BIGINT) ORDER BY score DESC, CAST(uid AS BIGINT) LIMIT 20")
def updated_index_topk(spark, sf_dir):
    """The index after one in a hundred units was edited and as many were removed: a second segment, nothing else."""
    u = _units(spark, sf_dir)
    index = PostingIndex(spark, f"{lineage.shared_folder(spark)}/indexes/{uuid.uuid4().hex}", buckets=32)
    index.build(u, anchor=None)
    edited = u.filter("ord % 100 = 7").withColumn("text", F.concat("text", F.lit(" onesen onesen")))
    index.update(edited, u.filter("ord % 100 = 3").select("uid"), anchor=None)
    return index.top(TERMS, 20).withColumn("score", F.round("score", 6))


def _vectors(spark, sf_dir) -> tuple[VectorIndex, DataFrame]:
    """The persisted cells of the embeddings, built where these files have none yet, and the queries: each id that 100 divides."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"))
    root = f"{lineage.shared_folder(spark)}/indexes/{lineage.mark(own)}"
    index = VectorIndex(spark, root)
    if not lineage.exists(spark, f"{root}/recall/_SUCCESS"):
        index.build(own)
    return index, own.filter("uid % 100 = 0").withColumnRenamed("uid", "q")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS uid, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS score FROM v a, v b WHERE a.vec_id % 100 = 0)
SELECT q, uid, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, uid) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def vector_neighbours(spark, sf_dir):
    """The exact way: all cells."""
    index, asked = _vectors(spark, sf_dir)
    return index.search(asked, 10).withColumn("score", F.round("score", 6))


@query()
def vector_cells(spark, sf_dir):
    """As many of each query's nearest cells as the measured recall asks for; a test holds it against the exact way."""
    index, asked = _vectors(spark, sf_dir)
    return index.search(asked, 10, index.probes())


_TURNS_SQL = """turns AS (SELECT conv_id || '-' || turn AS uid, CASE role WHEN 'user' THEN 'contract' WHEN 'assistant' THEN 'debate' ELSE 'ops' END AS kind, conv_id * 1000 + turn AS ord,
  regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS bag, text, role, conv_id, turn FROM conversations)"""


def _turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "contract").when(F.col("role") == "assistant", "debate").otherwise("ops")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uid"), kind.alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text", "conv_id", "turn", "role")


@query(f"""WITH {_TURNS_SQL}, postings AS (SELECT uid, len, term, count(*) AS tf FROM (SELECT uid, len(bag) AS len, unnest(bag) AS term FROM turns) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term), stats AS (SELECT count(*) AS n, sum(len(bag)) / count(*) AS avgl FROM turns)
SELECT uid, {_SCORE_SQL} AS score FROM postings JOIN dfs USING (term) JOIN turns USING (uid), stats WHERE term IN ('the', 'and', 'of') AND kind = 'debate' GROUP BY uid, ord ORDER BY score DESC, ord LIMIT 15""")
def bm25_seed_kinds(spark, sf_dir):
    u = _turns(spark, sf_dir)
    own, terms = retrieval.bags(u, title=None, anchor=None), ["the", "and", "of"]
    scores = retrieval.bm25(retrieval.postings(own, terms), retrieval.totals(own), terms)
    return retrieval.top(scores.withColumn("score", F.round("score", 6)), u, 15, ("debate",)).select("uid", "score")


@query(sql("SELECT spec_id AS anchor, title, CASE spec_id WHEN 'sop-p-10' THEN 1 WHEN 'spec-p-8' THEN 2 END AS pos FROM contracts WHERE spec_id IN ('sop-p-10', 'spec-p-8')", "contracts"))
def anchor_pinned_search(spark, sf_dir):
    c = b.contracts(spark, sf_dir)
    u = c.select(F.col("spec_id").alias("uid"), F.lit("contract").alias("kind"), F.col("spec_id").alias("anchor_id"), F.col("spec_id").alias("parent_anchor"), "title", F.col("content").alias("text"), "ord")
    hits = retrieval.Bm25Retriever(u).retrieve("what of ^sop-p-10 and SPEC-P-8, and none-p-1?", 2)
    return hits.join(u, "uid").select(F.col("uid").alias("anchor"), "title", "pos")


@query(f"""WITH {_TURNS_SQL}, postings AS (SELECT uid, len, term, count(*) AS tf FROM (SELECT uid, len(bag) AS len, unnest(bag) AS term FROM turns) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term), stats AS (SELECT count(*) AS n, sum(len(bag)) / count(*) AS avgl FROM turns),
best AS (SELECT uid, ord, {_SCORE_SQL} AS score FROM postings JOIN dfs USING (term) JOIN turns USING (uid), stats WHERE term IN ('the', 'and', 'of') GROUP BY uid, ord ORDER BY score DESC, ord LIMIT 8),
u AS (SELECT uid, kind, ord, conv_id FROM turns), parent AS (SELECT conv_id, arg_min(uid, ord) AS puid FROM u WHERE kind = 'contract' GROUP BY conv_id),
seeds AS (SELECT u.*, row_number() OVER (ORDER BY score DESC, u.ord) AS pos FROM u JOIN best USING (uid)),
cand AS (SELECT uid, pos, CASE kind WHEN 'contract' THEN 0 ELSE 1 END AS slot, 0 AS o, 'seed' AS reason FROM seeds
 UNION ALL SELECT puid, pos, 0, 0, 'parent-of:' || uid FROM seeds JOIN parent USING (conv_id) WHERE kind <> 'contract'
 UNION ALL SELECT u.uid, pos, 1, u.ord, 'child-of:' || s.uid FROM seeds s JOIN u ON s.conv_id = u.conv_id WHERE s.kind = 'contract' AND u.kind <> 'contract'),
firsts AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY uid ORDER BY pos, slot, o) = 1)
SELECT uid, reason, row_number() OVER (ORDER BY pos, slot, o) AS pos FROM firsts ORDER BY pos LIMIT 12""")
def expand_neighbours(spark, sf_dir):
    """The eight best turns of all by BM25, and their neighbours: twelve in all."""
    turns, terms = _turns(spark, sf_dir), ["the", "and", "of"]
    own = retrieval.bags(turns, title=None, anchor=None)
    scores = retrieval.bm25(retrieval.postings(own, terms), retrieval.totals(own), terms).withColumn("score", F.round("score", 6))
    seeds = retrieval.top(scores, turns, 8).select("uid", "score", "ord")
    u = turns.select("uid", "kind", "ord", F.col("conv_id").cast("string").alias("anchor_id"), F.col("conv_id").cast("string").alias("parent_anchor"))
    hits = seeds.select("uid", "score", F.lit("seed").alias("reason"), F.row_number().over(Window.orderBy(F.desc("score"), "ord")).alias("pos"))  # 8 rows
    return retrieval.expanded(u, hits, 12).select("uid", "reason", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {_TURNS_SQL} SELECT uid, '[' || turn || '] ' || upper(kind) || ' ' || CASE kind WHEN 'contract' THEN '^' || conv_id ELSE kind || ' -> ^' || conv_id END || ' | status: ' ||
  CASE turn % 3 WHEN 0 THEN 'deprecated  [NOT IN FORCE]' WHEN 1 THEN 'active' ELSE 'unknown' END || ' | layer: -' || chr(10) || 'title: ' || role || chr(10) || 'source: - (document: ' || conv_id || ')' || chr(10) || coalesce(nullif(text, ''), '(empty body)') AS block FROM turns""")
def prompt_blocks(spark, sf_dir):
    u = _turns(spark, sf_dir)
    c = F.col("conv_id").cast("string")
    own = F.when(F.col("turn") % 3 == 0, "deprecated").when(F.col("turn") % 3 == 1, "active").otherwise("")
    u = u.withColumns({"anchor_id": c, "parent_anchor": c, "computed_status": F.lit(""), "status": own, "invalidated": F.lit(False), "layer": F.lit(""), "title": F.col("role"), "source_file": F.lit(""), "document_title": F.lit(""), "document_id": c})
    return u.select("uid", retrieval.block(F.col("turn")).alias("block"))


# --- layout ------------------------------------------------------------------------------------------------------------
@query(sql("""SELECT source_file, p.id AS "partition", p.scope, regexp_extract(source_file, '([^/]+)\\.debate\\.en\\.md$', 1) AS document_id, 'debate' AS role, 'en' AS locale
FROM (SELECT DISTINCT source_file FROM callouts) c JOIN partitions p ON starts_with(source_file, p.path || '/')""", "partitions", "callouts"))
def classify_paths(spark, sf_dir):
    files = b.callouts(spark, sf_dir).select("source_file").distinct()
    return layout.classified(files, CONFIG, "source_file").select("source_file", "partition", "scope", "document_id", "role", "locale")


@query(sql("SELECT partition_id AS \"partition\", count(DISTINCT source_file) AS n_files, count(*) AS n_contracts FROM contracts WHERE partition_id IN ('core', 'adr', 'ops') GROUP BY 1", "contracts"))
def target_prune_counts(spark, sf_dir):
    files = layout.classified(b.contracts(spark, sf_dir).select("source_file"), CONFIG, "source_file")
    return layout.of_target(files, CONFIG, "public", "en").groupBy("partition").agg(F.countDistinct("source_file").alias("n_files"), F.count("*").alias("n_contracts"))


_NAMES_SQL = "names AS (SELECT p_partkey, 'docs/public/core/' || (CASE p_partkey % 6 WHEN 0 THEN 'a' || p_partkey || '.en.md' WHEN 1 THEN 'a.contarct.en.md' WHEN 2 THEN 'a.debate.fr.md' WHEN 3 THEN 'a' || p_partkey || '.evi.vi.md' WHEN 4 THEN 'a.txt' ELSE 'a.b.ops.en.md' END) AS path FROM part)"


@query(f"WITH {_NAMES_SQL} SELECT path, CASE p_partkey % 6 WHEN 1 THEN 'role' WHEN 2 THEN 'locale' WHEN 4 THEN 'extension' ELSE 'pattern' END AS fault FROM names WHERE p_partkey % 6 IN (1, 2, 4, 5)")
def file_naming_check(spark, sf_dir):
    k = F.col("p_partkey")
    n = k.cast("string")
    name = F.when(k % 6 == 0, F.concat(F.lit("a"), n, F.lit(".en.md"))).when(k % 6 == 1, "a.contarct.en.md").when(k % 6 == 2, "a.debate.fr.md").when(k % 6 == 3, F.concat(F.lit("a"), n, F.lit(".evi.vi.md"))).when(k % 6 == 4, "a.txt").otherwise("a.b.ops.en.md")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("docs/public/core/"), name).alias("path"))
    return rows.select("path", layout.naming_fault(F.col("path"), CONFIG).alias("fault")).filter("fault is not null")


# --- integrity ---------------------------------------------------------------------------------------------------------
@query(sql("SELECT target_id, node_id, source_file FROM callouts WHERE l_partkey % 50 = 0", "callouts"))
def orphan_refs(spark, sf_dir):
    c = b.contracts(spark, sf_dir).filter("ord % 50 <> 0")
    return integrity.orphans(c, b.callouts(spark, sf_dir)).select("target_id", "node_id", "source_file")


@query("SELECT lower(replace(p_brand, '#', '-')) || '-' || p_size AS spec_id, count(*) AS n, count(DISTINCT p_type) AS n_files FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_anchors(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.concat_ws("-", F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.col("p_size").cast("string")).alias("spec_id"), F.col("p_type").alias("source_file"))
    return integrity.duplicates(c).select("spec_id", "n", F.size("files").cast("long").alias("n_files"))


@query(sql("SELECT spec_id, e.id AS expected, a.id AS actual FROM (SELECT spec_id, ord, 'docs/' || (CASE WHEN ord % 9 = 0 THEN 'public/core' ELSE substr(source_file, 6, length(source_file) - 5 - length(regexp_extract(source_file, '/[^/]+$'))) END) || '/x.en.md' AS f FROM contracts) c JOIN partitions e ON split_part(spec_id, '-', 1) = e.domain JOIN partitions a ON starts_with(f, a.path || '/') WHERE e.id <> a.id", "partitions", "contracts"))
def misplaced_anchors(spark, sf_dir):
    moved = F.when(F.col("ord") % 9 == 0, F.lit("docs/public/core/x.en.md")).otherwise(F.col("source_file"))
    c = b.contracts(spark, sf_dir).withColumn("source_file", moved)
    return integrity.misplaced(c, CONFIG, spark).select("spec_id", "expected", "actual")


@query(sql("""SELECT node_id, c.source_file, f.scope AS from_scope, coalesce(h.scope, t.scope) AS to_scope FROM callouts c JOIN partitions f ON starts_with(c.source_file, f.path || '/')
LEFT JOIN contracts k ON c.target_id = k.spec_id LEFT JOIN partitions h ON starts_with(k.source_file, h.path || '/') JOIN partitions t ON split_part(c.target_id, '-', 1) = t.domain WHERE f.level < coalesce(h.level, t.level)""", "partitions", "contracts", "callouts"))
def cross_boundary_refs(spark, sf_dir):
    return integrity.crossing(b.contracts(spark, sf_dir), b.callouts(spark, sf_dir), CONFIG, spark).select("node_id", "source_file", "from_scope", "to_scope")


@query(sql("""SELECT id, CASE WHEN parent IN (SELECT spec_id FROM contracts WHERE ord % 3 <> 0) THEN parent END AS parent FROM (
SELECT node_id AS id, split_part(node_id, '#', 1) AS parent FROM callouts UNION SELECT spec_id || '-c01', spec_id FROM contracts UNION SELECT spec_id || '-x99', NULL FROM contracts UNION SELECT spec_id, NULL FROM contracts WHERE ord % 3 <> 0)""", "contracts", "callouts"))
def parent_anchor_resolution(spark, sf_dir):
    c = b.contracts(spark, sf_dir)
    own = c.filter("ord % 3 <> 0").select(F.col("spec_id").alias("id"))
    every = own.union(b.callouts(spark, sf_dir).select("node_id")).union(c.select(F.concat("spec_id", F.lit("-c01")))).union(c.select(F.concat("spec_id", F.lit("-x99")))).distinct()
    return integrity.parents(every, CONFIG)


_DEPENDENTS_SQL = """deps AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS line_no,
 CASE l_returnflag WHEN 'R' THEN 'debate' WHEN 'A' THEN 'ops' ELSE 'contract' END AS role, (['active', 'archived', 'deprecated', 'nonsense'])[l_suppkey % 4 + 1] AS status,
 (['obsolete_logic', 'because', ''])[l_partkey % 3 + 1] AS reason, (['spec-x-1', 'nowhere'])[l_linenumber % 2 + 1] AS sup FROM lineitem)"""


@query(f"""WITH {_DEPENDENTS_SQL}, d AS (SELECT *, l_orderkey || '/' || line_no AS rel_path FROM deps WHERE role <> 'contract')
SELECT rel_path, 'status' AS fault, 'status' AS field FROM d WHERE status = 'nonsense'
UNION ALL SELECT rel_path, CASE reason WHEN '' THEN 'missing' ELSE 'free text' END, 'archived_reason' FROM d WHERE status IN ('archived', 'deprecated') AND reason <> 'obsolete_logic'
UNION ALL SELECT rel_path, 'not an anchor', 'superseded_by' FROM d WHERE status = 'deprecated' AND sup = 'nowhere'""")
def lifecycle_check(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    pick = lambda xs, c: F.get(F.array(*map(F.lit, xs)), (F.col(c) % len(xs)).cast("int"))
    raw = F.create_map(F.lit("status"), pick(["Active ", "archived", "deprecated", "nonsense"], "l_suppkey"), F.lit("archived_reason"), pick(["obsolete_logic", "because", ""], "l_partkey"), F.lit("superseded_by"), pick(["spec-x-1", "nowhere"], "l_linenumber"))
    role = F.when(F.col("l_returnflag") == "R", "debate").when(F.col("l_returnflag") == "A", "ops").otherwise("contract")
    docs = item.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.row_number().over(w).cast("string")).alias("rel_path"), role.alias("role"), raw.alias("raw"))
    return integrity.lifecycle(docs, CONFIG)


# --- graph -------------------------------------------------------------------------------------------------------------
_WALK_SQL = "walk AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN target_id || '-c01' ELSE target_id END AS named FROM callouts)"


def _walking(spark, sf_dir):
    calls = b.callouts(spark, sf_dir)
    even = F.regexp_extract("title", "note ([0-9]+)", 1).cast("int") % 2 == 0
    return calls.withColumn("target_id", F.when(even, F.concat("target_id", F.lit("-c01"))).otherwise(F.col("target_id")))


@query(sql(f", {_WALK_SQL} SELECT named AS target_id, target_id AS anchor, source_file, line_no FROM walk WHERE l_partkey % 50 <> 0", "callouts").replace("\n, ", ", "))
def callout_attach_walkup(spark, sf_dir):
    c = b.contracts(spark, sf_dir).filter("ord % 50 <> 0")
    return graph.attached(c, _walking(spark, sf_dir), CONFIG).select("target_id", "anchor", "source_file", F.col("line_no").cast("long").alias("line_no"))


_MATRIX_SQL = "CASE WHEN d IS NULL THEN c WHEN c IS NULL THEN d WHEN list_position(['active', 'pending', 'draft', 'deprecated', 'archived'], d) >= list_position(['active', 'pending', 'draft', 'deprecated', 'archived'], c) THEN d WHEN c IN ('deprecated', 'archived') THEN 'invalidated' ELSE c END"


_ENTRIES_SQL = f"""pairs AS (SELECT k.*, x.status_override AS c, f.status AS d, x.ord AS contract_ord, x.partition_id FROM callouts k JOIN contracts x ON k.target_id = x.spec_id JOIN file_status f ON k.source_file = f.source_file),
entries AS (SELECT *, {_MATRIX_SQL} AS computed_status, coalesce(c = 'deprecated', false) AS invalidated FROM pairs)"""


def _entries(spark, sf_dir):
    c, k = b.contracts(spark, sf_dir), b.callouts(spark, sf_dir, numbered=True)  # a file's status asks for numbers too
    return graph.entries(c.withColumn("status", F.col("status_override")), k, b.file_status(k), CONFIG)


@query(sql(f", {_ENTRIES_SQL} SELECT c AS contract_status, computed_status, invalidated, count(*) AS n FROM entries GROUP BY ALL", "contracts", "callouts", "file_status").replace("\n, ", ", "))
def computed_status_counts(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy("contract_status", "computed_status", "invalidated").agg(F.count("*").alias("n"))


@query(sql(f", {_ENTRIES_SQL} SELECT c, d, computed_status AS computed, count(*) AS n FROM entries GROUP BY ALL", "contracts", "callouts", "file_status").replace("\n, ", ", "))
def status_matrix(spark, sf_dir):
    """Every pair of a contract's and its dependent's status that there is, and what they come to."""
    return _entries(spark, sf_dir).groupBy(F.col("contract_status").alias("c"), F.col("dependent_status").alias("d"), F.col("computed_status").alias("computed")).agg(F.count("*").alias("n"))


@query(sql("SELECT source_file, line_no, node_id FROM callouts", "callouts"))
def composite_ids(spark, sf_dir):
    return b.callouts(spark, sf_dir).select("source_file", F.col("line_no").cast("long").alias("line_no"), "node_id")


@query(sql(f""", {_ENTRIES_SQL} SELECT target_id AS anchor, count(*) FILTER (kind = 'debate') AS debates, count(*) FILTER (kind = 'ops') AS ops, count(*) FILTER (kind = 'evi') AS evidence,
coalesce(string_agg(node_id, ',' ORDER BY source_file, line_no) FILTER (kind = 'debate'), '') AS debate_ids FROM entries GROUP BY 1""", "contracts", "callouts", "file_status").replace("\n, ", ", "))
def node_entries_nested(spark, sf_dir):
    n = graph.nested_entries(_entries(spark, sf_dir), CONFIG, "node_id", "title", "computed_status")
    count = lambda c: F.size(c).cast("long").alias(c)
    return n.select("anchor", count("debates"), count("ops"), count("evidence"), F.array_join(F.transform("debates", lambda x: x["node_id"]), ",").alias("debate_ids"))


@query("""WITH f AS (SELECT lower(replace(p_brand, '#', '-')) AS document_id, (['contract', 'axiom', 'debate', 'ops'])[p_size % 4 + 1] AS role, p_size, p_partkey FROM part)
SELECT document_id, arg_min(name, (r, name)) AS "primary", count(*) AS n_files FROM (SELECT DISTINCT document_id, CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size % 4 END AS r, document_id || CASE WHEN p_size % 5 = 0 THEN '' ELSE '.' || role END || '.' || (CASE p_size % 3 WHEN 0 THEN 'vi' ELSE 'en' END) || '.md' AS name FROM f) GROUP BY 1""")
def document_primary_file(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    role = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("."), F.get(F.array(*map(F.lit, CONFIG.document_roles)), (F.col("p_size") % 4).cast("int"))))
    name = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), role, F.when(F.col("p_size") % 3 == 0, ".vi.md").otherwise(".en.md"))
    files = p.select(F.concat(F.lit("docs/public/core/"), name).alias("rel_path")).distinct()
    got = graph.primary_files(layout.classified(files, CONFIG), CONFIG)
    return got.select("document_id", F.substring_index("primary", "/", -1).alias("primary"), "n_files")


@query(sql(f""", {_ENTRIES_SQL} SELECT p.id AS "partition", coalesce(n.docs, 0) AS docs, coalesce(n.nodes, 0) AS nodes, coalesce(e.debates, 0) AS debates, coalesce(e.ops, 0) AS ops, coalesce(e.evidence, 0) AS evidence
FROM partitions p LEFT JOIN (SELECT partition_id, count(DISTINCT document_id) AS docs, count(*) AS nodes FROM contracts GROUP BY 1) n ON p.id = n.partition_id
LEFT JOIN (SELECT partition_id, count(*) FILTER (kind = 'debate') AS debates, count(*) FILTER (kind = 'ops') AS ops, count(*) FILTER (kind = 'evi') AS evidence FROM entries GROUP BY 1) e ON p.id = e.partition_id""", "partitions", "contracts", "callouts", "file_status").replace("\n, ", ", "))
def partition_rollup_summary(spark, sf_dir):
    c = b.contracts(spark, sf_dir)
    n = c.groupBy("partition").agg(F.countDistinct("document_id").alias("docs"), F.count("*").alias("nodes"))
    e = graph.attached(c, b.callouts(spark, sf_dir), CONFIG).withColumn("domain", ids.domain_of(F.col("anchor"))).groupBy("domain").agg(*[F.count_if(F.col("kind") == r.role).alias(r.graph_key) for r in CONFIG.roles])
    dims = CONFIG.partition_frame(spark).select(F.col("id").alias("partition"), "domain")
    full = dims.join(n, "partition", "left").join(e, "domain", "left")
    return full.select("partition", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("docs", "nodes", "debates", "ops", "evidence")])


@query(sql("""SELECT spec_id AS anchor, source_file AS src, document_id, partition_id AS "partition", title, NULL AS parent_anchor FROM contracts
UNION ALL SELECT k.node_id, x.source_file, x.document_id, x.partition_id, k.title, x.spec_id FROM contracts x JOIN (SELECT target_id, node_id, arg_max(title, (source_file, line_no)) AS title FROM callouts GROUP BY 1, 2) k ON k.target_id = x.spec_id""", "contracts", "callouts"))
def anchor_index_lookup(spark, sf_dir):
    c = b.contracts(spark, sf_dir)
    rows = graph.attached(c, b.callouts(spark, sf_dir, numbered=True), CONFIG).withColumn("locale", F.lit("en"))
    return graph.anchor_index(_nodes(c).withColumn("parent_anchor", F.lit(None).cast("string")), rows).drop("locale")


def _nodes(c: DataFrame) -> DataFrame:
    """contracts of the bridge as nodes of one locale; all of a document's are in one file."""
    place = F.struct("partition", "document_id", "line_no").alias("place")
    return c.select("*", F.lit("en").alias("locale"), F.col("spec_id").alias("anchor_id"), F.col("source_file").alias("src"), F.col("document_id").alias("document_title"), F.col("content").alias("body"), place)


def _layered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = graph.layers(b.contracts(spark, sf_dir).withColumn("status", F.col("status_override")), "spec_id", None, CONFIG, spark)
    e = graph.layers(_entries(spark, sf_dir), "anchor", "kind", CONFIG, spark)
    return _nodes(c), e.withColumns({"body": F.col("content"), "targets": F.col("target_id"), "locale": F.lit("en")})


def nested_graph(spark, sf_dir) -> DataFrame:
    """The documents of the bridge, each with its nodes: a row a document."""
    return graph.nested(*_nodes_docs(*_layered(spark, sf_dir)), CONFIG)


def _nodes_docs(c: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = graph.nested_entries(e, CONFIG, *graph.ENTRY)
    rows = c.join(own, c.spec_id == own.anchor, "left")
    empty = lambda r: F.coalesce(r.graph_key, F.array().cast(own.schema[r.graph_key].dataType)).alias(r.graph_key)
    node = F.struct("anchor_id", "title", "layer", "body", "status", F.lit(None).cast("string").alias("parent_anchor"), *[empty(r) for r in CONFIG.roles])
    keys = ["locale", "partition", F.array().cast("array<string>").alias("tractate"), "document_id"]
    nodes = rows.select(*keys, F.struct("line_no", "spec_id").alias("node_ord"), node.alias("node"))
    docs = c.groupBy("locale", "partition", "document_id").agg(F.min("src").alias("src")).select(*keys, F.struct(F.col("document_id").alias("title"), "src", F.lit("active").alias("status")).alias("doc"))
    return nodes, docs


_LAYER_SQL = """CASE {k} WHEN 'contract' THEN (CASE flavor WHEN 'kernel' THEN 'KERNEL_CONTRACT' WHEN 'policy' THEN 'POLICY_CONTRACT' ELSE 'META_CONSTITUTION' END)
 WHEN 'debate' THEN (CASE flavor WHEN 'kernel' THEN 'TECHNICAL_DEBATE' WHEN 'policy' THEN 'POLICY_DEBATE' ELSE 'META_DEBATE' END) ELSE (CASE flavor WHEN 'kernel' THEN 'OPERATIONAL_EXTENSIONS' WHEN 'policy' THEN 'EXECUTION_CHECKLIST' ELSE 'META_CHECKLIST' END) END"""


@query(sql(f""", {_ENTRIES_SQL}, u AS (SELECT spec_id AS uid, 'contract' AS kind, spec_id AS anchor_id, title, content AS text, partition_id, '' AS computed_status FROM contracts
UNION ALL SELECT target_id || '#' || kind || '-' || (row_number() OVER (PARTITION BY target_id, kind ORDER BY source_file, line_no) - 1), kind, target_id, title, content, partition_id, computed_status FROM entries WHERE kind <> 'evi')
SELECT uid, kind, anchor_id, title, text, id AS "partition", {_LAYER_SQL.format(k='kind')} AS layer, computed_status FROM u JOIN partitions ON partition_id = id""", "partitions", "contracts", "callouts", "file_status").replace("\n, ", ", "))
def flatten_units(spark, sf_dir):
    u = graph.units(*_layered(spark, sf_dir), CONFIG)
    return u.select("uid", "kind", "anchor_id", "title", "text", "partition", "layer", "computed_status")


@query()
def graph_digest(spark, sf_dir):
    c, e = _layered(spark, sf_dir)
    e = lineage.cut(e.select("kind", "locale", "anchor", "line_no", *graph.ENTRY))
    index = graph.anchor_index(c.withColumn("parent_anchor", F.lit(None).cast("string")), e)
    return spark.createDataFrame([(artifacts.digest_of_nodes(*_nodes_docs(c, e), index, CONFIG, "internal", ["en"]),)], "graph_hash string")


# --- parity and versions -----------------------------------------------------------------------------------------------
@query(sql("""SELECT "partition", count(DISTINCT document_id) FILTER (l > 0) AS left_docs, count(DISTINCT document_id) FILTER (r > 0) AS right_docs, sum(l) AS left_nodes, sum(r) AS right_nodes,
count(*) FILTER (r = 0) AS only_left_docs, count(*) FILTER (l = 0) AS only_right_docs, count(*) FILTER (l > 0 AND r > 0 AND l <> r) AS disagree, sum(lo) AS only_left_anchors, sum(ro) AS only_right_anchors
FROM (SELECT partition_id AS "partition", document_id, count(*) FILTER (ord % 7 <> 0) AS l, count(*) FILTER (ord % 11 <> 0) AS r, count(*) FILTER (ord % 7 <> 0 AND ord % 11 = 0) AS lo, count(*) FILTER (ord % 7 = 0 AND ord % 11 <> 0) AS ro
FROM contracts WHERE ord % 77 <> 0 GROUP BY 1, 2) GROUP BY 1""", "contracts"))
def locale_parity(spark, sf_dir):
    c = b.contracts(spark, sf_dir)
    vi, en = c.filter("ord % 7 <> 0").withColumn("locale", F.lit("vi")), c.filter("ord % 11 <> 0").withColumn("locale", F.lit("en"))
    got = parity.locale_parity(vi.unionByName(en).withColumn("anchor_id", F.col("spec_id")), "vi", "en")
    return got.select("partition", *[F.col(x).cast("long").alias(x) for x in got.columns if x != "partition"])


@query(sql("""SELECT coalesce(h.spec_id, i.spec_id) AS spec_id, '_row' AS field, CASE WHEN h.spec_id IS NOT NULL THEN 'present' END AS "left", CASE WHEN i.spec_id IS NOT NULL THEN 'present' END AS "right" FROM head h FULL JOIN idx i USING (spec_id) WHERE h.spec_id IS NULL OR i.spec_id IS NULL
UNION ALL SELECT spec_id, 'content', h.content, i.content FROM head h JOIN idx i USING (spec_id) WHERE h.content IS DISTINCT FROM i.content
UNION ALL SELECT spec_id, 'status', h.status, i.status FROM head h JOIN idx i USING (spec_id) WHERE h.status IS DISTINCT FROM i.status""", "contracts", "versions"))
def source_parity_diff(spark, sf_dir):
    head, index = b.head_index(spark, sf_dir)
    return parity.field_diff(head, index, ["spec_id"], ["title", "content", "status"])


@query(sql("SELECT coalesce(h.rel_path, i.rel_path) AS rel_path, CASE WHEN h.rel_path IS NULL THEN 'added' WHEN i.rel_path IS NULL THEN 'removed' WHEN sha1('blob ' || octet_length(encode(h.content)) || chr(0) || h.content) = sha1('blob ' || octet_length(encode(i.content)) || chr(0) || i.content) THEN 'unchanged' ELSE 'updated' END AS change FROM head h FULL JOIN idx i USING (rel_path)", "contracts", "versions"))
def ingest_diff(spark, sf_dir):
    head, index = (x.withColumn("blob_id", hashing.blob_id(F.col("content"))) for x in b.head_index(spark, sf_dir))
    return changes.difference(head, index)


_LINES_SQL = """SELECT doc_id, line, count(*) * octet_length(encode(line)) AS w FROM (SELECT doc_id, ls[i] || CASE WHEN i < len(ls) THEN chr(10) ELSE '' END AS line
 FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM {t}))) WHERE line <> '' GROUP BY doc_id, line"""


@query(f"""WITH o AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t || chr(10) || 'edited ' || doc_id AS t FROM o),
a AS ({_LINES_SQL.format(t='o')}), z AS ({_LINES_SQL.format(t='n')}), p AS (SELECT a.doc_id AS i, z.doc_id AS j, sum(least(a.w, z.w)) AS s FROM a JOIN z USING (line) GROUP BY ALL)
SELECT 'a/' || i AS old_path, 'b/' || j AS path, CAST(floor(s * 100 / greatest(octet_length(encode(o.t)), octet_length(encode(n.t)))) AS INTEGER) AS score
FROM p JOIN o ON o.doc_id = i JOIN n ON n.doc_id = j WHERE s * 100 >= 50 * greatest(octet_length(encode(o.t)), octet_length(encode(n.t)))""")
def similar_versions(spark, sf_dir):
    """Every text moved and edited: which removed file each added one may come from."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    gone = d.select(F.concat(F.lit("a/"), "i").alias("old_path"), "text")
    come = d.select(F.concat(F.lit("b/"), "i").alias("path"), F.concat("text", F.lit("\nedited "), "i").alias("text"))
    return changes.similar(gone, come)


@query(sql("SELECT spec_id, content FROM idx WHERE ord % 13 = 0 UNION ALL SELECT spec_id, content FROM head WHERE ord % 17 <> 0 AND NOT (ord % 13 = 0 AND ord % 17 <> 0)", "contracts", "versions"))
def upsert_view(spark, sf_dir):
    head, index = (x.select("spec_id", "content", "ord") for x in b.head_index(spark, sf_dir))
    return changes.upserted(head, index.filter("ord % 13 = 0"), "spec_id", head.filter("ord % 17 = 0")).select("spec_id", "content")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def parse_cache_misses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("rel_path"), hashing.file_hash(F.col("text")).alias("sha256"))
    cache = d.filter("doc_id % 5 <> 0").select("rel_path", F.when(F.col("doc_id") % 7 == 0, F.lit("stale")).otherwise(F.col("sha256")).alias("sha256"), F.lit("1").alias("version"))
    return changes.cache_misses(d, cache, "1").select("doc_id", "sha256")


@query(sql("SELECT h.spec_id, CASE WHEN i.spec_id IS NULL THEN 'removed' ELSE 'edited' END AS violation FROM head h LEFT JOIN idx i USING (spec_id) WHERE h.spec_id IN (SELECT target_id FROM callouts WHERE kind = 'debate') AND h.content IS DISTINCT FROM i.content", "contracts", "callouts", "versions"))
def payload_lock_violations(spark, sf_dir):
    head, index = (x.withColumn("locale", F.lit("en")) for x in b.head_index(spark, sf_dir))
    refs = changes.references(b.callouts(spark, sf_dir).filter("kind = 'debate'").withColumn("locale", F.lit("en")))
    return changes.lock_violations(head, index, refs).select("spec_id", "violation")


@query("SELECT event_id, 'k' AS name, k AS before, CASE WHEN event_id % 3 = 0 THEN k || '!' WHEN event_id % 5 = 0 THEN NULL END AS after FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) WHERE (event_id % 3 = 0 OR event_id % 5 = 0) AND k IS NOT NULL")
def frontmatter_key_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k is not null")
    n = F.col("event_id")
    head = e.select("event_id", F.create_map(F.lit("k"), F.col("k"), F.lit("status"), F.lit("draft")).alias("raw"))
    index = e.select("event_id", F.when(n % 3 == 0, F.create_map(F.lit("k"), F.concat("k", F.lit("!")), F.lit("status"), F.lit("active"))).when(n % 5 == 0, F.create_map(F.lit("tags"), F.lit("x"))).otherwise(F.create_map(F.lit("k"), F.col("k"))).alias("raw"))
    return changes.locked_keys(head, index, "event_id")


@query(sql("SELECT h.spec_id AS anchor, i.source_file AS path FROM head h JOIN idx i USING (spec_id) WHERE i.status IN ('deprecated', 'archived') AND (h.status IS NULL OR h.status NOT IN ('deprecated', 'archived'))", "contracts", "versions"))
def status_transitions(spark, sf_dir):
    return _transitions(spark, sf_dir).select("anchor", "path")


def _transitions(spark, sf_dir):
    head, index = b.head_index(spark, sf_dir)  # a file for each contract that both have, as its own path says
    both = index.join(head.select("rel_path"), "rel_path", "left_semi")
    now = both.select(F.lit("en").alias("locale"), F.col("spec_id").alias("anchor"), "status", "rel_path", F.col("source_file").alias("file"))
    was = head.select(F.col("rel_path").alias("path"), F.col("spec_id").alias("anchor"), F.col("status").alias("before"))
    got = changes.transitions(was, now.withColumnRenamed("rel_path", "path"), CONFIG)
    return got.join(now.select("anchor", "file"), "anchor").select("locale", "anchor", F.col("file").alias("path"))


@query(sql("""SELECT DISTINCT m.spec_id AS anchor, k.source_file AS dependent, CASE WHEN l_orderkey % 3 = 0 THEN 'not staged' ELSE 'still references' END AS reason
FROM (SELECT h.spec_id FROM head h JOIN idx i USING (spec_id) WHERE i.status IN ('deprecated', 'archived') AND (h.status IS NULL OR h.status NOT IN ('deprecated', 'archived'))) m
JOIN callouts k ON k.target_id = m.spec_id JOIN file_status f ON f.source_file = k.source_file WHERE l_orderkey % 3 = 0 OR (l_orderkey % 3 = 1 AND coalesce(f.status, '') NOT IN ('deprecated', 'archived'))""", "contracts", "callouts", "file_status", "versions"))
def atomic_deprecation(spark, sf_dir):
    k = b.callouts(spark, sf_dir)
    refs = k.select(F.lit("en").alias("locale"), F.col("target_id").alias("anchor"), F.col("source_file").alias("dependent")).distinct()
    order = F.regexp_extract("source_file", "/o-([0-9]+)", 1).cast("long")
    staged = k.select("source_file").distinct().withColumn("o", order).filter("o % 3 <> 0")
    c = staged.select(F.when(F.col("o") % 3 == 2, "D").otherwise("M").alias("status"), F.col("source_file").alias("path"), F.col("source_file").alias("old_path"))
    return changes.unresolved(_transitions(spark, sf_dir), refs, c, k, b.file_status(k), CONFIG).select("anchor", "dependent", "reason")


# --- text --------------------------------------------------------------------------------------------------------------
def _fenced(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    parts = ["# ", F.col("p_name"), "\n!!! note\n```py\n| a | b |\n```\n", F.when(F.col("p_size") % 2 == 0, "| x | y |\n").otherwise(""), F.when(F.col("p_size") % 3 == 0, "  ``` \nlost\n| in | it |").otherwise("^legal-1\n> [!refs-spec-1] t\n^spec-1")]
    return p.select(F.col("p_partkey").cast("string").alias("rel_path"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("text"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS rel_path, CASE WHEN p_size % 2 = 0 THEN 7 ELSE 6 END AS line_no, true AS unbalanced FROM part WHERE p_size % 3 = 0")
def fence_parity(spark, sf_dir):
    f = _fenced(spark, sf_dir)
    return blocks.unclosed_fences(f).join(f.select("rel_path", text.unbalanced_fences(F.col("text")).alias("unbalanced")), "rel_path").filter("unbalanced")


@query("SELECT CAST(p_partkey AS VARCHAR) AS rel_path, 2 AS line_no, 'admonition' AS construct FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 6, 'table' FROM part WHERE p_size % 2 = 0")
def banned_constructs(spark, sf_dir):
    return blocks.banned(_fenced(spark, sf_dir), CONFIG)


@query("SELECT CAST(p_partkey AS VARCHAR) AS rel_path, (CASE WHEN p_size % 2 = 0 THEN 7 ELSE 6 END) + i AS line_no, t AS token FROM part, (VALUES (0, 'legal-1'), (1, 'refs-spec-1')) x(i, t) WHERE p_size % 3 <> 0")
def likely_typos(spark, sf_dir):
    return blocks.typos(_fenced(spark, sf_dir), CONFIG)


def _markdown(spark, sf_dir) -> DataFrame:
    """A file a brand, a block a part: heading, prose, a status line now and then, the anchor."""
    return _rendered(b.contracts(spark, sf_dir))


def _rendered(c: DataFrame) -> DataFrame:
    block = F.concat(F.lit("## "), "title", F.lit("\n"), "content", F.lit("\n\n"), F.coalesce(F.concat(F.lit("{status: "), "status_override", F.lit("}\n")), F.lit("")), F.lit("  ^"), "spec_id", F.lit("\n\nloose\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"]), "")
    return c.groupBy(F.col("source_file").alias("rel_path")).agg(F.concat(F.lit("---\nstatus: active\n---\n\n# Doc "), F.first("document_id"), F.lit("\nIntro text.\n\n> [!ref-spec-1] early\n\n"), body).alias("text"))


@query(sql("SELECT spec_id, title, content, source_file, status_override FROM contracts", "contracts"))
def parse_contracts(spark, sf_dir):
    return blocks.contracts(_markdown(spark, sf_dir), CONFIG).select("spec_id", "title", "content", "source_file", "status_override")


@query(sql("SELECT kind, target_id, title, content || chr(10) || '> [!ref-spec-9] quoted' AS content, source_file, (line_no - 1) * 4 + 3 AS line_no, node_id, token FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ord) AS nth FROM callouts) QUALIFY true", "callouts").replace("(line_no - 1) * 4 + 3", "(nth - 1) * 4 + 3").replace(" QUALIFY true", ""))
def parse_callouts(spark, sf_dir):
    k = b.callouts(spark, sf_dir)
    block = F.concat(F.lit("> [!"), "token", F.lit("-"), "target_id", F.lit("]  "), "title", F.lit(" \n> "), "content", F.lit("\n>> [!ref-spec-9] quoted\n\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"]), "")
    files = k.groupBy(F.col("source_file").alias("rel_path")).agg(F.concat(F.lit("> plain quote\n\n"), body).alias("text"))
    return blocks.callouts(files, CONFIG).select("kind", "target_id", "title", "content", "source_file", F.col("line_no").cast("long").alias("line_no"), "node_id", "token")


@query(sql("SELECT DISTINCT source_file AS rel_path, 'Doc ' || document_id AS title FROM contracts", "contracts"))
def document_titles(spark, sf_dir):
    return _markdown(spark, sf_dir).select("rel_path", text.title(F.col("text"), F.lit("-")).alias("title"))


@query(sql("SELECT DISTINCT source_file AS rel_path, 'Intro text.' AS prologue FROM contracts", "contracts"))
def prologue_text(spark, sf_dir):
    return _markdown(spark, sf_dir).select("rel_path", text.prologue(F.col("text"), CONFIG.callout_pattern).alias("prologue"))


_STRIP_SQL = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_STRIP_SQL} AS text FROM pages")
def strip_html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(f"SELECT page_id, CASE WHEN length(t) > 160 THEN regexp_replace(left(t, 160), ' [^ ]*$', '') || '…' ELSE t END AS summary FROM (SELECT page_id, regexp_replace({_STRIP_SQL}, '\\s+([,.;:!?)\\]])', '\\1', 'g') AS t FROM pages)")
def page_summaries(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.summary(F.col("html")).alias("summary"))


@query(sql("SELECT node_id || '.source_file' AS location, source_file AS value FROM callouts WHERE starts_with(source_file, 'docs/private/') OR starts_with(source_file, 'docs/corporate/')", "callouts"))
def leak_gate(spark, sf_dir):
    rows = b.callouts(spark, sf_dir).select("node_id", "target_id", "title", "source_file")
    return retrieval.leaks(rows, CONFIG.restricted_prefixes("public"), "node_id")


# --- audit and facade --------------------------------------------------------------------------------------------------
_PAYLOAD_SQL = "event_type || '|' || user_id || '|' || CAST(round(value * 100) AS BIGINT)"


@query(f"""WITH e AS (SELECT event_id AS s, {_PAYLOAD_SQL} AS payload, sha256({_PAYLOAD_SQL}) AS own FROM events),
p AS (SELECT *, lag(own) OVER (ORDER BY s) AS own_before, lag(payload) OVER (ORDER BY s) AS payload_before FROM e),
h AS (SELECT s, payload, CASE WHEN s % 2 = 0 THEN own ELSE sha256(payload || chr(0) || 't' || chr(0) || s || chr(0) || own_before) END AS hash, own_before FROM p),
c AS (SELECT s, payload, hash, CASE WHEN s % 101 = 0 AND s > 0 THEN 'broken' ELSE coalesce(lag(hash) OVER (ORDER BY s), repeat('0', 64)) END AS prev FROM h),
k AS (SELECT *, lag(s) OVER (ORDER BY s) AS sb, lag(hash) OVER (ORDER BY s) AS hb FROM c WHERE s % 50 <> 7),
x AS (SELECT s, sha256(payload || chr(0) || 't' || chr(0) || s || chr(0) || prev) AS expected, hash, CASE WHEN s > 0 AND sb <> s - 1 THEN 'gap' WHEN prev <> coalesce(hb, repeat('0', 64)) THEN 'link' END AS f FROM k)
SELECT s AS sequence, expected, coalesce(f, CASE WHEN hash <> expected THEN 'hash' END) AS fault FROM x""")
def hash_chain_links(spark, sf_dir):
    # Odd events are chained as they should be, even ones carry another hash; some are gone, some point elsewhere.
    e = table(spark, sf_dir, "events")
    payload = F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.round(F.col("value") * 100).cast("long").cast("string"))
    e = e.select(F.col("event_id").alias("sequence"), payload.alias("payload"), F.lit("t").alias("timestamp"), F.sha2(payload, 256).alias("own"))
    before = e.select((F.col("sequence") + 1).alias("sequence"), F.col("own").alias("own_before"))
    n = F.col("sequence")
    e = e.join(before, "sequence", "left").withColumn("hash", F.when(n % 2 == 0, F.col("own")).otherwise(hashing.chain_hash(F.col("payload"), F.col("timestamp"), n, F.col("own_before"))))
    last = e.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("p"))
    prev = F.when((n % 101 == 0) & (n > 0), "broken").otherwise(F.coalesce("p", F.lit(hashing.GENESIS)))
    chain = e.join(last, "sequence", "left").withColumn("prev_hash", prev).filter(n % 50 != 7)
    got = audit.links(chain, block=1000)
    return got.select("sequence", hashing.chain_hash(F.col("payload"), F.col("timestamp"), F.col("sequence"), F.col("prev_hash")).alias("expected"), "fault")


def _collections(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """contracts as nodes; callouts as debates, told by their supplier which document they stand in."""
    c = b.contracts(spark, sf_dir)
    nodes = c.select(F.col("spec_id").alias("anchor_id"), "title", F.lit("contract").alias("layer"), F.col("content").alias("body"), "document_id", ids.domain_of(F.col("spec_id")).alias("domain"), F.lit("en").alias("locale"), F.concat(F.lit("Doc "), "document_id").alias("document_title"), F.lit("").alias("document_summary"), "source_file", "ord")
    names = ["brand-11", "brand-12", "brand-13", "brand-21", "brand-22"]
    supplier = F.regexp_extract("content", "by ([0-9]+)", 1).cast("int")
    layer = F.when(F.col("kind") == "debate", "debate").when(F.col("kind") == "ops", "execution").otherwise("evidence")
    debates = b.callouts(spark, sf_dir).select(F.col("target_id").alias("target_anchor_id"), F.get(F.array(*map(F.lit, names)), supplier % 5).alias("document_id"), F.lit("en").alias("locale"), layer.alias("layer"), "ord", "node_id", "title", F.col("content").alias("body"), "source_file")
    return nodes, debates


_DEBATES_SQL = "deb AS (SELECT target_id, kind, (['brand-11', 'brand-12', 'brand-13', 'brand-21', 'brand-22'])[l_suppkey % 5 + 1] AS document_id, node_id, ord FROM callouts)"


@query(sql(f""", {_DEBATES_SQL}, n AS (SELECT c.partition_id, c.document_id, c.spec_id, c.ord, c.source_file, count(d.kind) FILTER (d.kind = 'debate') AS debates, count(d.kind) FILTER (d.kind = 'ops') AS ops, coalesce(string_agg(d.node_id, ',' ORDER BY d.ord) FILTER (d.kind = 'debate'), '') AS debate_ids
 FROM contracts c LEFT JOIN deb d ON d.target_id = c.spec_id AND d.document_id = c.document_id GROUP BY ALL)
SELECT p.id AS "partition", n.document_id, arg_min(n.source_file, n.ord) AS src, count(n.spec_id) AS node_count, coalesce(sum(n.debates), 0)::BIGINT AS debates, coalesce(sum(n.ops), 0)::BIGINT AS ops, string_agg(n.spec_id, ',' ORDER BY n.ord) AS anchors, string_agg(n.debate_ids, ';' ORDER BY n.ord) AS debate_ids
 FROM partitions p LEFT JOIN n ON n.partition_id = p.id GROUP BY ALL""", "partitions", "contracts", "callouts").replace("\n, ", ", "))
def facade_documents(spark, sf_dir):
    d = facade.documents(*_collections(spark, sf_dir), CONFIG, spark, "en")
    total = lambda name: F.aggregate(F.coalesce(F.transform("nodes", lambda n: F.size(n[name]).cast("long")), F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x).alias(name)
    joined = lambda f: F.array_join(F.transform("nodes", f), ",")
    inner = F.array_join(F.transform("nodes", lambda n: F.array_join(F.transform(n["debates"], lambda x: x["node_id"]), ",")), ";")
    return d.select("partition", "document_id", "src", F.col("node_count").cast("long").alias("node_count"), total("debates"), total("ops"), joined(lambda n: n["anchor_id"]).alias("anchors"), inner.alias("debate_ids"))


@query(sql(f""", {_DEBATES_SQL} SELECT layer, coalesce(document_id, '-') AS document_id, count(*) AS n, count(domain) AS with_domain FROM (SELECT 'contract' AS layer, document_id, split_part(spec_id, '-', 1) AS domain FROM contracts
UNION ALL SELECT CASE kind WHEN 'debate' THEN 'debate' WHEN 'ops' THEN 'execution' ELSE 'evidence' END, document_id, NULL FROM deb) GROUP BY 1, 2""", "contracts", "callouts").replace("\n, ", ", "))
def facade_events(spark, sf_dir):
    e = facade.events(*_collections(spark, sf_dir))
    return e.groupBy("layer", F.coalesce("document_id", F.lit("-")).alias("document_id")).agg(F.count("*").alias("n"), F.count("domain").alias("with_domain"))


@query(sql("""SELECT c.document_id, count(*) AS nodes, sum(coalesce(d.n, 0)) AS debates, arg_min(c.title, c.ord) AS title FROM contracts c
LEFT JOIN (SELECT target_id, (['brand-11', 'brand-12', 'brand-13', 'brand-21', 'brand-22'])[l_suppkey % 5 + 1] AS document_id, count(*) AS n FROM callouts WHERE kind = 'debate' GROUP BY 1, 2) d ON d.target_id = c.spec_id AND d.document_id = c.document_id GROUP BY 1""", "contracts", "callouts"))
def mongo_style_grouping(spark, sf_dir):
    nodes, debates = _collections(spark, sf_dir)
    rows = facade.looked_up(nodes, debates)
    return rows.groupBy("document_id").agg(F.count("*").alias("nodes"), F.sum(F.size("debates")).alias("debates"), F.min_by("title", "ord").alias("title"))


# --- whole corpora: files, through the parser, in two locales ----------------------------------------------------------
def _corpus(spark, sf_dir) -> DataFrame:
    """Files of the bridge: a contract file a document in en, the same without every seventh rule in vi, and a debate file
    beside each in en that holds all callouts on the document's rules."""
    c = b.contracts(spark, sf_dir)
    en = _markdown(spark, sf_dir)
    vi = _rendered(c.filter("ord % 7 <> 0").withColumn("source_file", F.regexp_replace("source_file", r"\.en\.md$", ".vi.md")))
    k = b.callouts(spark, sf_dir).join(c.select(F.col("spec_id").alias("target_id"), F.col("source_file").alias("home")), "target_id")
    block = F.concat(F.lit("> [!"), "token", F.lit("-"), "target_id", F.lit("] "), "title", F.lit("\n> "), "content", F.lit("\n\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"]), "")
    notes = k.groupBy(F.regexp_replace("home", r"\.contract\.en\.md$", ".debate.en.md").alias("rel_path")).agg(F.concat(F.lit("---\nstatus: draft\n---\n\n"), body).alias("text"))
    return en.unionByName(vi).unionByName(notes)


def _compiled(spark, sf_dir):
    return compiler.compiled(spark, layout.classified(_corpus(spark, sf_dir), CONFIG), CONFIG, "internal")


_LOCALES_SQL = f"""{_ENTRIES_SQL.replace("f.status AS d", "'draft' AS d").replace("x.status_override AS c", "coalesce(x.status_override, 'active') AS c")},
loc AS (SELECT 'en' AS locale, * FROM contracts UNION ALL SELECT 'vi', * REPLACE (regexp_replace(source_file, '\\.en\\.md$', '.vi.md') AS source_file) FROM contracts WHERE ord % 7 <> 0)"""


@query(sql(f""", {_LOCALES_SQL} SELECT locale, partition_id AS "partition", document_id, 'Doc ' || document_id AS title, any_value(source_file) AS src, arg_min(content, ord) AS summary, count(*) AS node_count,
 any_value((['@core-team', '@core-team', '@ops-lead', '@board-exec', '@core-team', '@ops-lead', '@board-exec', '@core-team'])[p.o + 1]) AS codeowner, 'active' AS status,
 CASE locale WHEN 'en' THEN any_value(source_file) || ',' || replace(any_value(source_file), '.contract.', '.debate.') ELSE '' END AS files
 FROM loc JOIN (SELECT id, ord AS o FROM partitions) p ON p.id = partition_id GROUP BY locale, partition_id, document_id""", "partitions", "contracts", "callouts", "file_status").replace("\n, ", ", "))
def compiled_documents(spark, sf_dir):
    d = _compiled(spark, sf_dir).documents
    one = lambda x: F.col(f"document.{x}").alias(x)
    return d.select("locale", "partition", "document_id", one("title"), one("src"), one("summary"), F.col("document.node_count").cast("long").alias("node_count"), one("codeowner"), one("status"), F.coalesce(F.array_join("document.source_files", ","), F.lit("")).alias("files"))


@query(sql(f""", {_LOCALES_SQL}, nth AS (SELECT *, target_id || '#' || kind || '-' || CASE kind WHEN 'debate' THEN 'd' WHEN 'ops' THEN 'p' ELSE 'e' END || lpad(CAST(row_number() OVER (PARTITION BY target_id, kind ORDER BY ord) AS VARCHAR), 2, '0') AS cid FROM entries)
SELECT locale, spec_id AS anchor, source_file AS src, document_id, partition_id AS "partition", title, NULL AS parent_anchor FROM loc
UNION ALL SELECT 'en', n.cid, x.source_file, x.document_id, x.partition_id, n.title, n.target_id FROM nth n JOIN contracts x ON x.spec_id = n.target_id""", "contracts", "callouts", "file_status").replace("\n, ", ", "))
def compiled_index(spark, sf_dir):
    return _compiled(spark, sf_dir).index


@query(sql(f""", {_LOCALES_SQL}, u AS (SELECT locale, spec_id AS uid, 'contract' AS kind, spec_id AS anchor_id, title, content AS text, partition_id AS "partition", coalesce(status_override, 'active') AS status, '' AS computed_status, source_file FROM loc
UNION ALL SELECT 'en', target_id || '#' || kind || '-' || (row_number() OVER (PARTITION BY target_id, kind ORDER BY ord) - 1), kind, target_id, title, content, partition_id, 'draft', computed_status, NULL FROM entries)
SELECT locale, uid, kind, anchor_id, title, text, "partition", status, computed_status FROM u""", "contracts", "callouts", "file_status").replace("\n, ", ", "))
def compiled_units(spark, sf_dir):
    return _compiled(spark, sf_dir).units.select("locale", "uid", "kind", "anchor_id", "title", "text", "partition", "status", "computed_status")


@query(ORACLE["compiled_units"])
def recompiled_units(spark, sf_dir):
    """A build of the corpus with rules under other ids in the files of some brands, brought up to date with the true ones."""
    now = lineage.cut(_corpus(spark, sf_dir))  # read for both versions and to compare them
    other = F.regexp_like("rel_path", F.lit(r"brand-11\.contract\.en\.md$"))
    before = now.withColumn("text", F.when(other, F.replace("text", F.lit("-p-"), F.lit("-q-"))).otherwise(F.col("text")))
    build = Build(spark, f"{lineage.shared_folder(spark)}/builds/{uuid.uuid4().hex}", CONFIG, "internal", buckets=8, results=("units",))
    build.build(before)
    build.update(*build.changes(now))
    return build.result().units.select("locale", "uid", "kind", "anchor_id", "title", "text", "partition", "status", "computed_status")


@query(sql(f""", {_LOCALES_SQL} SELECT DISTINCT locale, source_file AS path, 'orphan' AS code, 1 AS n FROM loc""", "contracts", "callouts", "file_status").replace("\n, ", ", "))
def compiled_diagnostics(spark, sf_dir):
    d = _compiled(spark, sf_dir).diagnostics
    return d.groupBy("locale", "path", "code").agg(F.count("*").cast("int").alias("n"))


_MOVED_SQL = "moved AS (SELECT spec_id, ord, partition_id, title, content, CASE WHEN ord % 11 = 0 THEN 'docs/public/core' ELSE substr(source_file, 1, length(source_file) - length(regexp_extract(source_file, '/[^/]+$'))) END || '/new-' || document_id || '.en.md' AS f FROM contracts WHERE ord % 4 <> 0)"


@query(sql(f""", {_MOVED_SQL}, hit AS (SELECT spec_id, min(f) AS path FROM moved WHERE ord % 3 = 0 GROUP BY 1)
SELECT 'duplicate' AS code, path, '^' || spec_id AS subject FROM hit
UNION ALL SELECT 'misplaced', m.f, '^' || m.spec_id FROM moved m JOIN partitions p ON p.id = m.partition_id WHERE m.ord % 11 = 0 AND p.id <> 'core'
UNION ALL SELECT DISTINCT 'orphan', f, '^spec-none-' || ord FROM moved WHERE ord % 5 = 0 UNION ALL SELECT DISTINCT 'orphan', f, '^spec-1' FROM moved""", "partitions", "contracts").replace("\n, ", ", "))
def draft_gate(spark, sf_dir):
    """Drafts of new files: of rules that stand elsewhere too (every third), of some that belong elsewhere, with orphans."""
    c = b.contracts(spark, sf_dir)
    folder = F.when(F.col("ord") % 11 == 0, "docs/public/core").otherwise(F.regexp_replace("source_file", "/[^/]+$", ""))
    drafts = _rendered(c.filter("ord % 4 <> 0").withColumns({"source_file": F.concat(folder, F.lit("/new-"), "document_id", F.lit(".en.md")), "content": F.when(F.col("ord") % 5 == 0, F.concat("content", F.lit("\n\n> [!ref-spec-none-"), F.col("ord").cast("string"), F.lit("] t\n> b"))).otherwise(F.col("content"))}))
    corpus = _rendered(c.filter("ord % 3 = 0"))
    found = gate.drafted(spark, drafts, corpus, CONFIG).filter("level = 'fail'")
    return found.select("code", "path", F.regexp_extract("message", r"\^[a-z]+(?:-[a-z0-9]+)+", 0).alias("subject"))


@query(sql("""SELECT 'lock' AS "check", 'en' AS locale, source_file AS path, spec_id AS subject, CASE WHEN ord % 17 <> 0 THEN 'edited' WHEN EXISTS (SELECT 1 FROM contracts o WHERE o.source_file = c.source_file AND o.ord % 17 <> 0) THEN 'removed' ELSE 'deleted' END AS reason FROM contracts c
WHERE (ord % 17 = 0 OR ord % 13 = 0) AND EXISTS (SELECT 1 FROM callouts k WHERE k.target_id = c.spec_id)
UNION ALL SELECT 'deprecation', 'en', replace(c.source_file, '.contract.', '.debate.'), c.spec_id, 'not staged' FROM contracts c
WHERE ord % 17 <> 0 AND ord % 10 = 0 AND coalesce(status_override, 'active') NOT IN ('deprecated', 'archived') AND EXISTS (SELECT 1 FROM callouts k WHERE k.target_id = c.spec_id)""", "contracts", "callouts"))
def commit_guard(spark, sf_dir):
    """A version in which some rules are edited, some gone, some deprecated, against the one before it; vi does not change."""
    c, before = b.contracts(spark, sf_dir), lineage.cut(_corpus(spark, sf_dir))  # read for both versions
    n = F.col("ord")
    now = c.filter("ord % 17 <> 0").withColumns({"content": F.when(n % 13 == 0, F.concat("content", F.lit(" (edited)"))).otherwise(F.col("content")), "status_override": F.when(n % 10 == 0, F.lit("deprecated")).otherwise(F.col("status_override"))})
    gone = c.select(F.col("source_file").alias("rel_path")).distinct()
    after = changes.upserted(before, _rendered(now), "rel_path", gone)  # a file that is left without rules goes
    return gate.guarded(before, after, CONFIG).drop("level")
