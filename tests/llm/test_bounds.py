"""What one id on very many rows, and labels without end, may not do."""

import random

from cases import frame, prose
from pyspark.sql import functions as F

from loomspark.llm import langid
from loomspark.llm.common import Scratch
from loomspark.llm.queries import tokenizer_path
from loomspark.llm.tokenio import based, read_shards, write_shards


def test_shards_of_one_id(spark):
    data = [(None, f"row {i}") for i in range(3000)] + [(7, "the same row")] * 3000 + [(1, "a"), (9, "b")]
    scratch = Scratch(spark, "t")
    manifest = scratch.write(write_shards(frame(spark, data), scratch.path("shards"), tokenizer_path(), partitions=8), "manifest")
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == len(data) and len(sizes) == 8 and max(sizes) < 2000
    got = read_shards(based(manifest), scratch.path("shards")).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def words(rnd, letters, n=30):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_the_sample_is_bounded(spark, monkeypatch):
    rnd, seen = random.Random(1), []
    monkeypatch.setattr(langid, "fit", lambda texts, labels, **_: seen.append((texts, labels)))
    one_id = [(4, words(rnd, "abcde", 5), "x") for _ in range(4000)] + [(4, words(rnd, "vwxyz", 5), "y") for _ in range(3000)]
    equal = [(8, "same text of one row", "x")] * 3000
    langid.trained(labelled(spark, one_id + equal), per_label=20)
    texts, labels = seen.pop()
    assert labels == ["x", "y"] and [sum(x == y for x, _ in texts) for y in labels] == [20, 20]
    langid.trained(labelled(spark, [(None, words(rnd, "abcde"), f"l{i % 40}") for i in range(400)] + [(None, "x" * 5000, "l0")]), most_labels=7, most_bytes=2000)
    texts, labels = seen.pop()
    assert len(labels) == 7 and max(len(w) for _, ws in texts for w in ws) < 100


def test_rows_without_ids_are_learned_from(spark):
    rnd = random.Random(2)
    rows = [(None, words(rnd, "abcdeé"), "x") for _ in range(200)] + [(None, words(rnd, "uvwxyö"), "y") for _ in range(200)]
    got = langid.languages(spark, labelled(spark, rows)).collect()
    assert sum(r.lang_pred == "x" for r in got) == 200 and sum(r.lang_pred == "y" for r in got) == 200 and not any(r.held_out for r in got)


def test_long_prose_has_a_language(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, 40), "a") for i in range(30)] + [(99, prose(rnd, 200_000), "a")]
    assert {r.lang_pred for r in langid.languages(spark, labelled(spark, rows)).select(F.col("lang_pred")).collect()} == {"a"}


def test_batches_of_texts_are_bounded(spark):
    from loomspark.llm.common import BATCH_BYTES, mapped

    key, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", "rows long, bytes long"
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    before = spark.conf.getAll.get(key)
    try:
        spark.conf.unset(key)
        got = mapped(rows, run, sizes).collect()
        assert sum(r.rows for r in got) == 3000 and max(r.bytes for r in got) <= BATCH_BYTES + 50_000
        spark.conf.set(key, str(1 << 20))  # what a user set stays
        assert max(r.bytes for r in mapped(rows, run, sizes).collect()) < 2 << 20
        assert spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
