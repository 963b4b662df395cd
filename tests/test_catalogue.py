"""Every catalogue query against its SQL, and the plans that matter."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomspark.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns, wanted):
    order = [columns.index(c) for c in wanted]
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_is_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(map(tuple, got.collect()), got.columns, columns) == plain(want.fetchall(), want.columns, columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    plan = lambda q: QUERIES[q](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("bm25_topk")
    assert "LeftAnti" in plan("orphan_refs")
    assert "BroadcastHashJoin" in plan("misplaced_anchors")
    assert "FullOuter" in plan("ingest_diff")
    assert "CartesianProduct" not in plan("bm25_topk")
