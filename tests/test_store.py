"""The version store's reads and its garbage."""

from loomspark.sources.snapshots import Store, collected


def test_reads_follow_the_tree_and_garbage_goes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    put = lambda expected=None, **files: store.commit(spark.createDataFrame(list(files.items()), "rel_path string, text string"), expected=expected)
    one = put(a="1", b="2", c="2")
    two = put(one, a="3", d="1")
    three = put(two, a="4", b="3")
    read = lambda c, p="": dict(map(tuple, store.texts(c, p).collect()))
    assert read(one) == {"a": "1", "b": "2", "c": "2"} and read(two) == {"a": "3", "b": "2", "c": "2", "d": "1"} and read(three) == {"a": "4", "b": "3", "c": "2", "d": "1"}
    assert read(three, "a") == {"a": "4"}
    # A blob is stored once, whichever versions hold it, and a tree says where.
    assert spark.read.parquet(f"{tmp_path}/blobs").count() == 4
    plan = store.texts(three, "a")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "commit" in plan[plan.index("dynamicpruning") - 200 :]
    store.commit(spark.createDataFrame([("a", "5"), ("b", "5")], "rel_path string, text string"), expected=three, replace_prefix="")
    assert collected(store, 1) == sorted([one, two, three]) and read(store.tip()) == {"a": "5", "b": "5"}
    assert put(store.tip(), z="1") == store.tip() and read(store.tip()) == {"a": "5", "b": "5", "z": "1"}
