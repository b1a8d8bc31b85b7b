"""Every query of the store against its DuckDB oracle at the smallest scale."""

import duckdb
import pytest

from blobframe.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_not_vacuous(spark):
    for name in ("orphans", "orphans_naive_diff", "conversation_orphans", "shared_chunks", "missing_chunks", "ring_movement", "error_rate_5m"):
        assert QUERIES[name](spark, SF).count() > 0, name
    naive, true = QUERIES["orphans_naive_diff"](spark, SF).count(), QUERIES["orphans"](spark, SF).count()
    assert naive > true


def test_no_nested_loops(spark):
    for name in ("placement", "placement_at_scale", "quorum_writes", "read_failover", "gc_sweep"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_columns_are_pruned(spark):
    plan = QUERIES["orphans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
